"""Secret scans."""

import hashlib
import random

import pytest
from helpers import brute_spans, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from kindred.llm import queries, secret_scan


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["token", "ToKeN", "api_key", "apikey", "password", "ſecret", "é", '"', "'", " ", "=", ":", "AKIA", "ABCD1234EFGH5678", "0a1b2c3d4e5f6071829304a5b6", "x", "abc", "\n", "-", "."]), max_size=14).map("".join))
def test_base_spans(t):
    assert secret_scan.scan(t)[0] == brute_spans(t)


LOWEST = secret_scan.step(0.01)


def random_in(text):
    return secret_scan.random_spans(secret_scan.scan(text)[1], LOWEST)


def drawn(r, kind, n):
    return "".join(r.choice(secret_scan.ENCODINGS[kind]) for _ in range(n))


def test_secrets(docs, empty):
    got = {r["doc_id"]: r for r in secret_scan.find_secrets(docs).collect()}
    assert got[10]["n_assign"] == 1 == got[10]["n_hex"] and "random:" in got[10]["spans"] and got[0]["spans"] == "" == got[7]["spans"]
    assert got[0]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert secret_scan.find_secrets(empty).count() == 0 == secret_scan.without_secrets(empty).count()
    clean = {r["doc_id"]: r["text"] for r in secret_scan.without_secrets(docs).collect()}
    assert clean[10].startswith("[secret]") and clean[4] == prose(80, 1) and clean[0] is None


def test_secrets_query_is_brute_force_on_the_table(spark, data):
    rows = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    found = {i: secret_scan.candidates([(m.start(), m[0]) for m in secret_scan.RUN.finditer(t) if len(m[0]) >= 20]) for i, t in rows.items()}
    ps = sorted(10 ** (-secret_scan.step(p) / secret_scan.STEPS) for f in found.values() for p, *_ in f)
    last = max((p for i, p in enumerate(ps, 1) if p <= 0.01 * i / len(ps)), default=-1.0)
    name = lambda spans: ",".join(f"{k}:{a}:{b}" for a, k, b in spans)
    for r in queries.op6_secret_scan(spark, data).collect():
        base = brute_spans(rows[r["doc_id"]])
        n = [sum(k == j for _, k, _ in base) for j in range(3)]
        listed = name([(a, secret_scan.KINDS[k], b) for a, k, b in base])
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == n and r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        more = secret_scan.random_spans(found[r["doc_id"]], secret_scan.step(last) if last >= 0 else 1 << 30)
        assert r["spans"] == name([(a, secret_scan.KINDS[k], b) for a, k, b in sorted([*base, *((a, 3, b) for a, b in more)])])


def test_the_cut_is_that_of_benjamini_and_hochberg():
    r = random.Random(2)
    for share in (0, 0.02, 0.5, 1):
        ps = [r.random() ** (12 if r.random() < share else 1) for _ in range(3000)]
        steps = [secret_scan.step(p) for p in ps]
        tops = sorted(10 ** (-k / secret_scan.STEPS) for k in steps)
        found = max((i for i, p in enumerate(tops, 1) if p <= 0.01 * i / len(tops)), default=0)
        lowest = secret_scan.cut({k: steps.count(k) for k in set(steps)})
        assert sum(k >= lowest for k in steps) == found and (share < 0.5 or found > 0)
    assert secret_scan.cut({}) > secret_scan.step(0.0)


@pytest.mark.parametrize("form", ["AUTH_KEY={}", "x https://a.example/get?sig={}&n=1 y", "id={}\n", "see /v1/x_y/{} there", "my_name_{}", "HMAC_2=={}", "/srv/data/some_files/v2/{}/x"])
def test_random_values_are_apart_from_their_names(form):
    r = random.Random(form)
    values = [drawn(r, "base62", 40) for _ in range(100)]
    at = form.index("{")
    assert sum(any(a <= at and b >= at + 40 for a, b in random_in(form.format(v))) for v in values) >= 90
    for w in ("andwhenthemorningcametheyallwenthomeagain", "internationalisationofthingswithnumbers1", "getElementsByTagNameAndTheirAttributesOf", "com_example_project_HTTPServer2Impl_test", "2024-01-15_report_final_version_v2"):
        assert not random_in(w)


@pytest.mark.parametrize(("kind", "n", "least"), [("digits", 40, 90), ("hex", 20, 95), ("HEX", 20, 95), ("lower", 60, 75), ("upper", 60, 75), ("base32", 32, 75), ("lower36", 24, 80), ("upper36", 24, 80), ("letters", 32, 90), ("base62", 20, 85), ("base64", 20, 85), ("base64url", 20, 85)])
def test_random_strings_of_every_encoding_are_found(kind, n, least):
    r = random.Random(kind)
    assert sum(bool(random_in(drawn(r, kind, n))) for _ in range(200)) >= 2 * least


def test_random_values_with_padding():
    r = random.Random(4)
    padded = drawn(r, "base64", 42) + "=="
    assert random_in(f"k={padded} z") == [(2, 46)]


def test_battery_tells_random_from_prose():
    tests = lambda s, kind: secret_scan.battery(s, kind)[:3]
    assert tests("ab" * 30, "lower")[2] < 0.001 and tests("a" * 30 + "z" * 30, "lower")[1] < 0.001 and tests("e" * 20 + "abcdefghij", "lower")[0] < 0.001
    assert not random_in("internationalisationofthingswithnumbers12and34")
    assert not any(random_in("a" * n + "1") for n in range(20, 60))


def test_random_spans_overlap_base_ones_and_join():
    v = drawn(random.Random(5), "base62", 40)
    base, found = secret_scan.scan(f"token={v}")
    assert secret_scan.all_spans(base, found, LOWEST) == [(0, 0, 46), (6, 3, 46)]
    assert secret_scan.redact(f"x token={v} y", LOWEST) == "x [secret] y"
