import itertools
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kindred.functions import columns as X
from kindred.functions import normalize as N
from kindred.functions import records as R
from kindred.functions import strings as S
from kindred.operators import decision


def one(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


SKELETONS = {
    "lakshmi": "lksm", "laxmi": "lksm", "aggarwal": "agrvl", "agrawal": "agrvl", "shree": "sr", "sri": "sr", "services": "srvs", "sarvisis": "srvs",
    "private": "prvt", "praivet": "prvt", "praibhet": "prvt", "software": "sftvr", "sofatver": "sftvr",
}


def test_skeletons_agree_in_both_forms(spark):
    got = dict(one(spark, [(w,) for w in SKELETONS], "w string", "w", N.skeleton(F.col("w"))))
    assert got == SKELETONS == {w: R.skeleton(w) for w in SKELETONS}


def test_tokens_and_address(spark):
    t = lambda s: one(spark, [(s,)], "s string", N.tokens(N.fold_latin(F.col("s"))))[0][0]
    assert t("joe's l'atelier") == ["joe", "atelier"]
    assert t("m.g. road") == ["mg", "rd"]
    assert t("1st street 3rd") == ["1", "st", "3"]
    assert t("12bis") == ["12", "bis"]
    assert t("A & B") == ["and", "b"] or t("A & B") == ["b"]
    a = lambda s: one(spark, [(s,)], "s string", N.clean_address(F.col("s")))[0][0]
    assert a("Pune 411 001") == "pune 411001"
    assert a("00218 x No-0278") == "218 x no-278"
    assert one(spark, [("hospita1ity ran0ix f1int",)], "s string", N.repair_digits(F.col("s"))) == [("hospitality ranoix flint",)]


def test_region_country_placeholder(spark):
    rows = [("12 MG Road, Pune, Maharashtra",), ("a, Penfield, NY",), ("alone",), ("",)]
    assert [r[0] for r in one(spark, rows, "s string", X.region_key(F.col("s")))] == ["pune", "penfield", "alone", ""]
    assert one(spark, [("  US ",), (None,)], "s string", X.country_key(F.col("s"))) == [("us",), ("__na__",)]
    assert one(spark, [(" N/A ",), (None,), ("x",)], "s string", X.is_placeholder(F.col("s"))) == [(True,), (True,), (False,)]


def test_transliteration_and_fold():
    assert R.transliterate("प्राइवेट") == "praivet"
    assert R.fold("Ça Œuvre Straße") == "ca oeuvre strasse"
    assert R.fold("plain text") == "plain text"
    assert R.fold("मित्र", {"मित्र": "friend"}) == "friend"


def test_legal_segments_abbreviations(spark):
    apart = lambda s: tuple(one(spark, [(s.split(),)], "t array<string>", N.legal_apart(F.col("t")))[0][0])
    assert apart("acme tools pvt ltd") == (["acme", "tools"], ["pvt ltd"]) and apart("ltd") == (["ltd"], []) and apart("") == ([], [])
    assert apart("ms shri acme tools co ltd llc") == (["acme", "tools"], ["co ltd", "llc", "ms", "shri"]) and apart("sarl acme gmbh co kg") == (["sarl", "acme"], ["gmbh co kg"])
    assert R.segment("olaniqpetcare", {"olaniq": 3, "pet": 10, "care": 10}) == ["olaniq", "pet", "care"]
    assert R.segment("frontierm", {"frontier": 5}) == ["frontierm"]
    vocabulary = spark.createDataFrame([("pet", 9), ("care", 9), ("shop", 1)], "word string, n long")
    words = spark.createDataFrame([("petcarecom",), ("petcareshop",), ("xyzxyz",), (None,)], "token string")
    assert {r["token"]: r["parts"] for r in R.segmented(words, vocabulary).collect()} == {"petcarecom": ["pet", "care"], "petcareshop": ["pet", "care", "shop"], "xyzxyz": ["xyzxyz"]}
    assert R.segmented(words, vocabulary.limit(0)).where("size(parts) > 1").count() == 0
    assert all(R.is_abbreviation(a, b) for a, b in (("rd", "road"), ("pvt", "private"), ("bd", "boulevard"), ("fbg", "faubourg")))
    assert not any(R.is_abbreviation(a, b) for a, b in (("st", "south"), ("rd", "ridge")))
    assert R.token_similarity("r", "rue") == 0.5 and R.token_similarity("rd", "road") == 0.9 and R.token_similarity("12", "13") == 0


def test_alignment():
    same = R.soft_align(["acme", "tools"], ["tools", "acme"], [1.0, 2.0], [2.0, 1.0])
    assert same[0] == pytest.approx(1.0) and same[3] == 0
    assert R.soft_align([], ["a"], [], [1.0]) == (0, 0, 0, 0, 1, 0, 0, 0, 1)
    assert R.soft_align(["st", "r"], ["south", "rue"], [1.0, 4.0], [1.0, 2.0])[:3] == pytest.approx((0.5 * 6 / 8, 0.5 * 4 / 5, 0.5 * 2 / 3))


def brute_align(a, b, wa, wb):
    """The greedy choice spelled out."""
    left, right, got = list(range(len(a))), list(range(len(b))), []
    while True:
        pairs = [(s * (wa[i] + wb[j]) / 2, s, i, j) for i in left for j in right if (s := R.token_similarity(a[i], b[j])) > 0]
        if not pairs:
            break
        _, s, i, j = max(pairs)
        left.remove(i)
        right.remove(j)
        got.append((s, i, j))
    ta, tb = sum(wa), sum(wb)
    shared = [min(wa[i], wb[j]) for s, i, j in got if s >= 0.85] or [0]
    na, nb = sum(s * wa[i] for s, i, j in got), sum(s * wb[j] for s, i, j in got)
    return (na + nb) / (ta + tb), na / ta, nb / tb, max([wa[i] for i in left], default=0), max([wb[j] for j in right], default=0), max(shared), min(shared), ta, tb


@settings(max_examples=150, deadline=None)
@given(*[st.lists(st.sampled_from("road rd ridge street st south private pvt praivet acme akme 12 7 r a international intl".split()), min_size=1, max_size=7)] * 2, st.randoms(use_true_random=False))
def test_alignment_is_the_greedy_choice(a, b, r):
    wa, wb = ([r.choice((0.5, 1.0, 2.0, 3.25)) for _ in x] for x in (a, b))
    assert R.soft_align(a, b, wa, wb) == pytest.approx(brute_align(a, b, wa, wb))


GOLDEN = [
    ("olaniqpetcare.com", "", ["olaniq", "pet", "care"]),
    ("Hospita1ity of Saint Mary Pvt. Ltd.", "", ["hospitality", "st", "mary"]),
    ("Joe's L'Atelier (Acme Tools LLC)", "", ["joe", "atelier", "acme", "tools"]),
    ("Olaniq Ltd d/b/a Pet Care", "", ["olaniq", "pet", "care"]),
    ("\u092e\u093f\u0924\u094d\u0930 \u092a\u094d\u0930\u093e\u0907\u0935\u0947\u091f", "", ["mitra"]),
    ("1st Street 12bis", "", ["1", "st", "12", "bis"]),
]


def test_golden_records(spark):
    vocabulary = spark.createDataFrame([("olaniq", 3), ("pet", 10), ("care", 10)], "word string, n long")
    df = spark.createDataFrame([(i, n, a) for i, (n, a, _) in enumerate(GOLDEN)] + [(90, "x", "00218 1st St, near Pune Station; Pune 411 001, Maharashtra"), (91, None, None)], "doc_id long, name string, addr string")
    got = {r["doc_id"]: r for r in R.normalized(df, vocabulary=vocabulary).collect()}
    for i, (_, _, core) in enumerate(GOLDEN):
        assert got[i]["n_core"] == core, GOLDEN[i]
    assert got[1]["n_legal"] == ["pvt ltd"] and got[2]["n_legal"] == ["llc"] and got[3]["n_variants"] == [["olaniq"], ["pet", "care"]] and got[4]["n_legal"] == ["pvt"]
    a = got[90]
    assert a["a_core"] == ["218", "1", "st", "pune", "411001", "mh"] and a["a_landmark"] == ["pune", "sta"] and a["a_nums"] == ["218", "1"] and a["a_postal"] == ["411001"]
    assert got[91]["n_core"] == [] == got[91]["a_core"]


def test_columns_of_tokens_agree_with_python(spark):
    words = "rd road ridge st south pvt private bd boulevard fbg faubourg r rue a1 12 1st street".split()
    df = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string").select("a", "b", R.abbreviates(F.col("a"), F.col("b")).alias("x"))
    assert all(r["x"] == R.is_abbreviation(r["a"], r["b"]) for r in df.collect())


def test_acronym_and_keys(spark):
    rows = [(["state", "bank", "of", "india"], ["sboi"]), (["a", "b"], ["c"])]
    assert one(spark, rows, "a array<string>, b array<string>", N.acronym(F.col("a"), F.col("b"))) == [(True,), (False,)]
    k = lambda t: set(one(spark, [(t,)], "t array<string>", N.generator_keys(F.col("t")))[0][0])
    assert "d_olaniqpetcare" in k(["olaniq", "pet", "care"]) & k(["olaniqpetcare"])
    assert one(spark, [(["28", "chennai"], ["28"])], "t array<string>, n array<string>", N.house_locality(F.col("t"), F.col("n"))) == [(["28#chennai"],)]
    assert one(spark, [([],)], "t array<string>", N.name_tokens(F.col("t"))) == [([],)]


def test_names_share_keys_with_their_other_forms(spark):
    k = lambda t: set(one(spark, [(t.split(),)], "t array<string>", N.shared_keys(F.col("t")))[0][0])
    assert k("stewart gustafson cooley") == {"d_stewartgustafsoncooley", "s_cooley_gustafson_stewart", "d_sg", "d_sgcooley", "d_gustafsoncooley", "d_stewartgustafson", "d_sgc"}
    for name, form in (("stewart gustafson cooley", "sgc"), ("stewart gustafson cooley", "sg"), ("cameron cerrone fields", "ccfields"), ("economic development institute", "developmentinstitute"), ("a1 b c d e", "abcde"), ("ab cd", "cd ab")):
        assert k(name) & k(form)
    assert k("acme") == {"d_acme", "s_acme"} and k("") == k("7 8") == set()


def test_metrics():
    assert S.jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert S.ratio("", "") == 1 and S.ratio("abc", "") == 0
    assert S.token_set_ratio("new york mets", "mets new york") == 1
    assert S.partial_ratio("yankees", "new york yankees") == 1


def brute_lcs(a, b):
    return max((len(c) for n in range(len(a) + 1) for c in itertools.combinations(a, n) if is_sub(c, b)), default=0)


def is_sub(c, b):
    it = iter(b)
    return all(x in it for x in c)


@settings(max_examples=60, deadline=None)
@given(st.text("abc", max_size=7), st.text("abc", max_size=7))
def test_lcs(a, b):
    assert S.lcs(a, b) == brute_lcs(a, b) == S.lcs(b, a)
    assert 0 <= S.partial_ratio(a, b) <= 1 and S.ratio(a, b) == S.ratio(b, a)


def brute_f(ps, k):
    total = 0.0
    for out in itertools.product((0, 1), repeat=len(ps)):
        pr = math.prod(p if o else 1 - p for p, o in zip(ps, out, strict=True))
        tp, g = sum(out[:k]), sum(out)
        total += pr * ((1.0 if g == 0 else 0.0) if k == 0 else 1.25 * tp / (k + 0.25 * g))
    return total


def test_expected_f_against_all_outcomes(spark):
    r = random.Random(3)
    rows = [(i, sorted((r.random() for _ in range(r.randint(0, 7))), reverse=True)) for i in range(60)] + [(99, [0.9, 0.6, 0.2])]
    df = spark.createDataFrame(rows, "s1 int, ps array<double>").select("s1", F.transform("ps", lambda p: F.struct(p.alias("p"), F.lit(1).alias("cand"))).alias("slots"))
    got = {x["s1"]: (x["vals"], x["k"]) for x in decision.f_values(df).withColumn("k", decision.best_k(F.col("vals"))).collect()}
    for i, ps in rows:
        ps = [p for p in ps if p >= decision.LEAST_P]
        want = [brute_f(ps, k) for k in range(len(ps) + 1)]
        assert got[i][0] == pytest.approx(want, abs=1e-9)
        assert want[got[i][1]] == pytest.approx(max(want), abs=1e-8)
    assert one(spark, [([0.9, 0.6, 0.2],)], "p array<double>", decision.pmf(F.col("p")))[0][0] == pytest.approx([0.032, 0.344, 0.516, 0.108])


def test_metrics_from_sql(spark):
    S.register(spark)
    assert spark.sql("SELECT jaro_winkler('martha', 'marhta'), lcs_similarity('abc', 'xbc'), token_set_ratio(NULL, 'a')").first()[:] == pytest.approx((0.9611111, 2 / 3, None), abs=1e-6)


def test_every_query_named_in_the_coverage_is_registered():
    import re
    from pathlib import Path

    import __spark_entry__ as driver

    known = driver.queries()
    text = Path(__file__).resolve().parents[1].joinpath("COVERAGE.md").read_text()
    for row in text.split("\n")[6:]:
        for name in re.findall(r"`(\w+)`", row.rsplit("|", 2)[-2]) if row else ():
            assert name in known, name
