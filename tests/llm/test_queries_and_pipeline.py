"""The queries against their SQL or brute force, and the pipeline against a version in plain Python."""

import hashlib
import math
import re

import duckdb
import numpy as np
import pytest
from helpers import DOCS, WORD, brute_components, brute_quality, brute_spans, by, plain_fingerprint, prose

import corpus_pipeline
from kindred.llm import common, queries, secret_scan


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_is_its_sql(name, spark, data):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    cur = con.execute(queries.ORACLES[name])
    df = queries.QUERIES[name](spark, data)
    assert df.columns == [x[0] for x in cur.description]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted((tuple(r) for r in df.collect()), key=key) == sorted(cur.fetchall(), key=key)


def test_every_operator_has_a_query():
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in queries.QUERIES) == list(range(1, 11))


def brute_lines(text):
    """What op1's rules leave of a text, and how many characters of how many they take."""
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    boiler = re.compile(r"\b(licensed under|all rights reserved|copyright (\(c\)|\xa9)|privacy policy|cookie policy|terms of (use|service)|enable javascript|click here|sign up|log ?in to|subscribe (now|to)|read more|share (this|on)|powered by|lorem ipsum)\b", re.IGNORECASE | re.ASCII)

    def bad(x):
        marks, shouts = len(re.findall("[#*$%&|<>~^={}\\\\»›•·]", x)), len(re.findall(r"[!?]{2,}|\.{4,}", x))
        return not re.search("[.,;:!?…。！？]", x) or marks >= 3 and marks * 25 > len(x) or shouts >= 3 and shouts * 30 > len(x) or (n := sum(1 for _ in boiler.finditer(x))) and n * 400 >= len(x)

    good = [x for x in lines if not bad(x)]
    return "\n".join(good), sum(map(len, lines)) - sum(map(len, good)), sum(map(len, lines))


def brute_near(texts):
    """The smallest ids of the groups that a Jaccard similarity of 0.8 of five-word shingles leads to."""
    sets = {}
    for i, t in texts.items():
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            x, y = sets[i], sets[j]
            if min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and (x == y or len(x & y) >= 0.8 * len(x | y)):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i for i in ids if find(i) == i}


def brute_mix(rows):
    """How often each of (id, text, source) is taken."""
    import math

    size = {i: len(WORD.findall(t or "")) for i, t, _ in rows}

    def key(i, t):
        t = t or ""
        n, lines = max(size[i], 1), t.split("\n")
        u = (int(hashlib.md5(f"{i}|7".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
        w = len(set(lines)) / len(lines) / (1 + 10 * (len(re.findall(r"[#*$%&|<>]", t)) / n)) * (1 if 4 <= len(t) / n <= 9 else 0.25)
        return -math.log(u) / w

    sources = sorted({s for *_, s in rows}, key=lambda s: (s is None, s))
    total, weight = sum(size.values()), {s: k % 3 + 1 for k, s in enumerate(sources)}
    own = {s: sum(size[i] for i, _, x in rows if x == s) for s in sources}
    free, target = set(sources), {}
    while True:
        rest = total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * own[s]}
        if not over:
            target |= share
            break
        target |= {s: 3 * own[s] for s in over}
        free -= over
    taken = {}
    for s in sources:
        epochs = int(target[s] // own[s]) if own[s] else 0
        left = target[s] - epochs * own[s]
        order = sorted((key(i, t), i) for i, t, x in rows if x == s and size[i])
        extra, sum_ = set(), 0
        for _, i in order:
            if left <= 0 or sum_ + size[i] > left:
                break
            sum_ += size[i]
            extra.add(i)
        gap = left - sum_
        fill = [(abs(size[i] - gap), k, i) for k, i in order if i not in extra and abs(size[i] - gap) < gap] if left > 0 else []
        if fill:
            extra.add(min(fill)[2])
        taken |= {i: epochs + (i in extra) for i, _, x in rows if x == s}
    return taken


def test_pipeline_is_brute_force(spark, data, tokenizer):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    texts = {}
    for i, r in rows.items():
        clean, lost, chars = brute_lines(r["text"])
        if not brute_quality(r["text"])[5] and 100 * lost <= 40 * chars:
            texts[i] = clean
    one = brute_near(texts)
    found = {i: secret_scan.scan(texts[i]) for i in one}
    counts = {}
    for _, f in found.values():
        for p, *_ in f:
            counts[secret_scan.step(p)] = counts.get(secret_scan.step(p), 0) + 1
    lowest = secret_scan.cut(counts)
    safe = {}
    for i in one:
        t, out, done = texts[i], [], 0
        for a, _, b in secret_scan.all_spans(*found[i], lowest):
            if a >= done:
                out += [t[done:a], "[secret]"]
            done = max(done, b)
        safe[i] = "".join([*out, t[done:]])
        assert not brute_spans(safe[i])
    times = brute_mix([(i, safe[i], rows[i]["source"]) for i in sorted(safe)])
    want = []
    for i, n in times.items():
        ids = tokenizer.encode(safe[i], add_special_tokens=False).ids
        want += [(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())] * n
    got = [(r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, data).collect()]
    assert sorted(got) == sorted(want)
    good = {r["doc_id"] for r in spark.read.parquet(f"{data}/labels.parquet").where("quality = 1").collect()}
    assert all(i in texts for i in good if not brute_quality(rows[i]["text"])[5])


def test_pipeline_stages_take_odd_documents(spark, docs, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows and an empty table; the columns stay those of documents."""
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    odd = plain.unionByName(spark.createDataFrame([(None, None, None, None, None), (None, prose(90, 4), None, None, None), (77, prose(95, 5), None, None, None)], DOCS))
    for name, table in (("odd", odd), ("empty", odd.limit(0))):
        table.write.parquet(str(tmp_path / name / "documents.parquet"))
        d = spark.read.parquet(str(tmp_path / name / "documents.parquet"))
        for _, stage in corpus_pipeline.STAGES[:-1]:
            d = common.table(stage(spark, d, str(tmp_path / name)), "stage")
            assert d.columns == plain.columns
        out = corpus_pipeline.run(spark, str(tmp_path / name))
        assert (out.count() > 0) == (name == "odd")
    ids = [r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()]
    assert None in ids and 77 in ids and 0 not in ids

def test_bpe_query_on_the_table(spark, data, tokenizer):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = queries.op7_bpe(spark, data).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        text = tokenizer.decode(ids, skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_simhash_query_on_the_table(spark, data):
    fps = {r["doc_id"]: plain_fingerprint(r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    comp = brute_components(fps)
    assert by(queries.op8_simhash(spark, data), "doc_id", "fingerprint", "component_id") == sorted(((i, f"{f:016x}", comp[i]) for i, f in fps.items()), key=str)
