"""Nearest neighbours."""

import numpy as np
import pytest
from helpers import by
from pyspark.sql import functions as F

from kindred.llm import ann, queries


def test_ann_recall_and_ties(spark):
    r = np.random.default_rng(3)
    centres = r.normal(size=(6, 24))
    x = (centres[r.integers(0, 6, 3000)] + 0.4 * r.normal(size=(3000, 24))).astype(np.float32)
    x[100:700] = x[100]  # one very common vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9001, None), (9050, [0.0] * 24), (9100, [float("nan")] * 24), (9150, [None] + [1.0] * 23), (None, [1.0] * 24), (0, x[0].tolist()), (9200, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cell", F.lit("clash"))
    got = {}
    for q, k, v, s in sorted(tuple(t) for t in ann.nearest(df).collect()):
        got.setdefault(q, []).append((k, v, s))
    assert set(got) == set(range(0, 3000, 50))
    d = x.astype(np.float64)
    n = np.sqrt((d**2).sum(axis=1))
    hits = 0
    for q, rows_ in got.items():
        s = (d * d[q]).sum(axis=1) / (n * n[q])
        s[q] = -9
        best = np.lexsort((np.arange(3000), -s))[:5]
        assert [k for k, *_ in rows_] == [1, 2, 3, 4, 5]
        assert all(abs(t - s[v]) < 1e-12 for _, v, t in rows_)
        hits += len({v for _, v, _ in rows_} & set(best.tolist()))
    assert hits >= 0.95 * 5 * len(got)
    assert [v for _, v, _ in got[150]] == [100, 101, 102, 103, 104]
    assert ann.nearest(df.limit(0)).count() == 0
    two = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert by(ann.nearest(two), "query_id", "vec_id") == [(0, 1)]


def test_ann_of_extreme_magnitudes(spark):
    rows = [(0, [2.0**660] * 2), (1, [1.0, 1.0]), (2, [1e200, 0.0]), (3, [2.0**-660] * 2), (50, [1e-320, 0.0]), (4, [-1e308, 1e308])]
    got = {}
    for q, _, v, s in sorted(tuple(r) for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()):
        got.setdefault(q, []).append((v, s))
    half = 2**-0.5
    assert [v for v, _ in got[0]] == [1, 3, 2, 50, 4] and [s for _, s in got[0]][:2] == [got[0][0][1]] * 2 and [s for _, s in got[0]] == pytest.approx([1, 1, half, half, 0])
    assert [v for v, _ in got[50]] == [2, 0, 1, 3, 4] and [s for _, s in got[50]] == pytest.approx([1, half, half, half, -half])


def test_ann_query_against_brute_force(spark, data):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect() if r["embedding"] is not None]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    n = np.sqrt((x * x).sum(axis=1))
    got = {}
    for r in queries.op4_ann(spark, data).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(got) == {i for i in ids.tolist() if i % 50 == 0}
    hits = 0
    for q, best in got.items():
        k = int(np.flatnonzero(ids == q)[0])
        s = (x * x[k]).sum(axis=1) / (n * n[k])
        order = [i for i in np.lexsort((ids, -s)) if i != k][:5]
        hits += len({v for v, _ in best.values()} & set(ids[order].tolist()))
        assert all(score == s[ids == v][0] for v, score in best.values())
    assert hits >= 0.95 * 5 * len(got)


def test_anisotropic_loss_keeps_inner_products():
    r = np.random.default_rng(1)
    x = r.normal(size=(2000, 16)).astype(np.float32)
    m = ann.Quantiser(x, 2)
    u = ann.unit(x)
    left = u - m.cells[m.cell(x)]
    left = left / m.scale[m.cell(x)][:, None]
    codes = m._codes(u, left)
    e = left - np.concatenate([m.books[j][codes[:, j]] for j in range(8)], axis=1)
    plain = left - np.concatenate([(b := ann.kmeans(np.ascontiguousarray(left[:, 2 * j : 2 * j + 2]), 16))[ann._assign(np.ascontiguousarray(left[:, 2 * j : 2 * j + 2]), b)] for j in range(8)], axis=1)
    if m.eta > 1:
        assert ((e * u).sum(axis=1) ** 2).mean() <= ((plain * u).sum(axis=1) ** 2).mean()
