"""Blocks of all token tables give what tables by row give, whichever way records are dealt, and no table of all pairs is written."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kindred.operators import blocking, channels, packs


def _records(spark, n, seed):
    g = np.random.default_rng(seed)
    word = lambda k: f"w{'abcdefghij'[int(k) % 10]}{'klmnop'[int(k) % 6]}{int(k)}"
    rows = [(i, "S1" if i % 4 == 0 else "S2", "en" if i % 3 else "de", [word(x) for x in g.zipf(1.4, 3) % 40], [] if i % 7 == 0 else [str(int(g.integers(1, 90))), *[word(x) for x in g.zipf(1.4, 3) % 40]]) for i in range(n)]
    rows += [(n, "S2", "en", [], []), (n + 1, "S1", "en", None, None), (n + 2, "S1", None, ["wak0"], ["wak0"])]
    return spark.createDataFrame(rows, "doc_id bigint, src string, cty string, nt array<string>, at array<string>").repartition(5)


def _found(r):
    w = channels.weight_tables(r)
    u = channels.union(channels.hits(w, r.where(F.size("at") == 0).select(F.col("doc_id").alias("cand")))).localCheckpoint()
    rows = channels.with_cosines(u, w).collect()
    cols = sorted(rows[0].asDict()) if rows else []
    return {(x["s1"], x["cand"]): [x[c] for c in cols] for x in rows}, w


def test_blocks_are_rows(spark, monkeypatch):
    r = _records(spark, 400, 1).localCheckpoint()
    got, w = _found(r)
    assert not isinstance(w, dict) and w.where("side = 1").count() > 1
    monkeypatch.setattr(channels.packs, "blocks", lambda *a: {k: _by_row(r, k) for k in channels.TABLES})
    want, w = _found(r)
    assert isinstance(w, dict) and set(got) == set(want) and len(got) > 1000
    for k, x in got.items():
        assert x == pytest.approx(want[k], abs=2e-9)


def _by_row(r, key):
    t = blocking.token_table(r, channels.token_columns(F.col("nt"), F.col("at"))[key])
    sizes = r.groupBy(F.col("cty").alias("part")).agg(F.count("*").alias("n"))
    return blocking.weighted(t, blocking.pruned(blocking.frequencies(t, sizes)))


def test_repeated_ids_go_by_row(spark):
    r = _records(spark, 40, 2)
    assert isinstance(channels.weight_tables(r.unionByName(r.where("doc_id = 3"))), dict)


def test_empty(spark):
    r = _records(spark, 20, 3)
    assert _found(r.where("src = 'S1'"))[0] == {} and _found(r.where("false"))[0] == {}


@pytest.mark.parametrize("name", ["channel_union", "channel_cosines", "meta_blocking"])
def test_queries_make_no_table_of_all_pairs(spark, data, monkeypatch, name):
    import __spark_entry__

    def fail(*a, **b):
        raise AssertionError("a table of all pairs")

    monkeypatch.setattr(blocking, "cosines", fail)
    monkeypatch.setattr(blocking, "exact_cosines", fail)
    assert __spark_entry__.queries()[name](spark, data).columns


def test_long_records_of_one_batch_are_several_blocks(monkeypatch):
    monkeypatch.setattr(packs, "TOKENS", 100)
    monkeypatch.setattr(packs, "ADDED", 150, raising=False)
    n = [70, 0, 70, 400, 5, 80, 80, 1, 0]
    toks = pa.array([[[100 * i + j for j in range(x)], [7] * (x % 3)] for i, x in enumerate(n)], pa.list_(pa.list_(pa.int64())))
    b = pa.RecordBatch.from_arrays([pa.array(["en"] * 9), pa.array([1, 1, 1, 1, 1, 1, 0, 1, 1], pa.int32()), pa.array(range(9)), pa.array([0] * 9, pa.int8()), toks], ["part", "side", "id", "flag", "toks"])
    got = [(x.column("side")[0].as_py(), packs._Block(x, 0, "tf")) for x in packs._counted(iter([b.slice(0, 0), b]))]
    assert sorted(i for _, x in got for i in x.ids) == list(range(9)) and {int(i) for s, x in got if s == 0 for i in x.ids} == {6}
    for _, x in got:
        size = sum(int(t[3].sum()) for t in x.tables)
        assert len(x.ids) == 1 or size <= 250
        for i, rec in enumerate(x.ids):
            for t, want in zip(x.tables, toks[int(rec)].as_py(), strict=True):
                at, kinds, which, tf = t
                assert sorted(np.repeat(kinds[which[at[i] : at[i + 1]]], tf[at[i] : at[i + 1]])) == sorted(want)
