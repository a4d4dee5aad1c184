"""The search by blocks gives what the table of all pairs gives, whichever way it sums, and writes no such table."""

import numpy as np
import pytest

from kindred.operators import blocking, nearest


def _weights(spark, n, kinds, seed, common=0):
    g = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        toks = {f"t{int(x)}" for x in g.zipf(1.3, 8) % kinds} | ({"all"} if i < common else set())
        rows += [(f"p{i % 2}", int(i % 5 != 0), i, t, float(g.integers(1, 9)) / 16) for t in sorted(toks)]
    return spark.createDataFrame(rows, "part string, side int, id bigint, tok string, w double")


@pytest.mark.parametrize("limits", [{}, {"PRODUCTS": 40, "CELLS": 300}, {"DENSE": 0}, {"ANCHORS": 50, "POOL": 90}, {"PRODUCTS": 60, "DENSE": 0}])
def test_best_are_those_of_all_pairs(spark, monkeypatch, limits):
    w = _weights(spark, 400, 60, 3, 200)
    a = {(r["s1"], r["cand"]): r["score"] for r in blocking.cosines(w).collect()}
    for name, x in limits.items():
        monkeypatch.setattr(nearest, name, x)
    if "PRODUCTS" in limits or "DENSE" in limits:  # a worker has its own copy of the limits: the sums are asked here
        found = _here(w)
    else:
        found = {tuple(r)[1:] for r in blocking.best_forward(w, 3, w.count()).drop("rank").collect()}
    want = {r for r in blocking.top_forward(blocking.cosines(w), 3).drop("part", "rank").collect()}
    assert {(s, c, round(v, 9)) for s, c, v in found} == {(r["s1"], r["cand"], r["score"]) for r in want}
    assert a


def _here(w, k=3):
    rows = [r.asDict() for r in w.collect()]
    side = lambda s: sorted({r["id"] for r in rows if r["side"] == s})
    a, b = side(0), side(1)
    key = {t: i for i, t in enumerate(sorted({(r["part"], r["tok"]) for r in rows}))}
    post = lambda s, ids, by: sorted(((ids.index(r["id"]), key[r["part"], r["tok"]], r["w"]) for r in rows if r["side"] == s), key=lambda x: x[by])
    pa_, pb = post(0, a, 0), post(1, b, 1)
    at = np.concatenate([[0], np.cumsum(np.bincount([x[0] for x in pa_], minlength=len(a)))])
    kinds, which = np.unique([x[1] for x in pa_], return_inverse=True)
    kinds2, first = np.unique([x[1] for x in pb], return_index=True)
    out = nearest.sums(at, kinds, which, np.array([x[2] for x in pa_]), np.append(first, len(pb)), kinds2, np.array([x[0] for x in pb]), np.array([x[2] for x in pb]), len(b), k)
    return {(a[r], b[c], float(v)) for rec, col, s in out for r, c, v in zip(rec, col, s, strict=True)}


def test_back(spark):
    w = _weights(spark, 300, 40, 5, 100)
    row = lambda df: {tuple(r) for r in df.select("part", "s1", "cand", "score", "rank").collect()}
    assert row(blocking.best_reverse(w, 3, w.count())) == row(blocking.top_reverse(blocking.cosines(w), 3))


def test_no_posting_meets_another_in_a_join(spark, data):
    """The lists of candidates come without a join of tokens with tokens, which is what filled the disks."""
    from kindred.operators import nearest as n
    from kindred.plans import texts

    made = []
    real = blocking.cosines
    blocking.cosines = lambda *a, **b: made.append(1) or real(*a, **b)
    try:
        assert texts.best(spark, data, 5).count() and n.POOL
    finally:
        blocking.cosines = real
    assert not made


def test_empty(spark):
    w = _weights(spark, 10, 5, 1)
    assert blocking.best_forward(w.where("side = 0"), 3, 10).count() == 0
    assert blocking.best_forward(w.where("false"), 3, 10).count() == 0


@pytest.mark.parametrize("name", ["candidate_list_writer", "two_hop", "exact_cosines", "union_provenance", "resolve_entities"])
def test_queries_make_no_table_of_all_pairs(spark, data, monkeypatch, name):
    import __spark_entry__

    def fail(*a, **b):
        raise AssertionError("a table of all pairs")

    monkeypatch.setattr(blocking, "cosines", fail)
    assert __spark_entry__.queries()[name](spark, data).columns


def test_blocks_of_records_are_those_of_rows(spark, monkeypatch):
    """Records straight to blocks, or by a row for each token where an id is repeated: the same best, and the same copies."""
    from pyspark.sql import functions as F

    rows = [(i, "S1" if i % 3 == 0 else "S2", "en" if i % 4 else "de", ["all", f"a{i % 7}", f"a{i % 7}", f"b{i % 11}"] if i % 5 else ["all"]) for i in range(2000, 2240)] + [(1, "S1", None, ["a1"]), (2, "S2", "en", []), (3, "S1", "en", None)]
    r = spark.createDataFrame(rows, "doc_id bigint, src string, cty string, t array<string>")
    sizes = r.groupBy(F.col("cty").alias("part")).agg(F.count("*").alias("n"))
    row = lambda df: sorted(tuple(x) for x in df.select("part", "s1", "cand", "score", "rank").collect())
    got = row(blocking.best_and_copies(r, F.col("t"), sizes, 4))
    monkeypatch.setattr(blocking, "packed", lambda *a: None)
    assert got == row(blocking.best_and_copies(r, F.col("t"), sizes, 4)) and any(x[3] == 1.0 for x in got)
