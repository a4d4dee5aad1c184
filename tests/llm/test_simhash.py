"""SimHash near-duplicates, components, and near copies by Jaccard similarity."""

import random

import numpy as np
import pytest
from helpers import brute_components, by, plain_fingerprint
from pyspark.sql import functions as F

import corpus_pipeline
from kindred.llm import common, graph, nearcopies, simhash


def test_fingerprint_and_components(docs, empty):
    fps = {r["doc_id"]: plain_fingerprint(r["text"]) for r in docs.collect()}
    want = brute_components(fps)
    got = by(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id")
    assert got == sorted([(i, f"{fps[i]:016x}", want[i]) for i in [*fps, 4]], key=str)
    assert simhash.near_duplicates(empty).count() == 0
    left = sorted(r["doc_id"] for r in simhash.one_of_each(docs).collect())
    assert left == sorted(set(want.values()))
    nameless = docs.select(F.lit(None).cast("bigint").alias("doc_id"), "text")
    assert simhash.one_of_each(nameless).count() == docs.count() == simhash.near_duplicates(nameless).where("component_id is null").count()


@pytest.mark.parametrize("crowded", [2048, 20])
def test_trie_join_of_clusters(spark, monkeypatch, crowded):
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    r = random.Random(11)
    fps, i = {}, 0
    for _ in range(40):
        x = r.getrandbits(64)
        for _ in range(r.randint(1, 12)):
            fps[i] = x
            for _ in range(r.randint(0, 3)):
                x ^= 1 << r.randrange(64)
            i += 1
    rows = [(v - (1 << 64) if v >> 63 else v, k) for k, v in fps.items()]
    each = spark.createDataFrame(rows, "fp long, doc_id long").groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    edges = common.table(simhash.links(each), "links")
    got = {r["node"]: r["component"] for r in graph.components(edges).collect()}
    want = brute_components(fps)
    first = {}
    for k, v in fps.items():
        first.setdefault(v, k)
    assert {k: got.get(k, k) for k in first.values()} == {k: want[k] for k in first.values()}


def test_near_copies_down_to_the_least_similarity(spark):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    rows = [(0, None), (1, ""), (2, "one two"), (3, "One  two")]
    for k in range(60):
        base = [word() for _ in range(r.randint(60, 400))]
        for m in range(1 + k % 7):  # changed words scattered over the text, some pairs above and some below the least
            t = list(base)
            for _ in range(int(len(t) * 0.03 * m / 6 * r.random() * 2)):
                t[r.randrange(len(t))] = word()
            rows.append((len(rows), " ".join(t)))
    sets = [set(nearcopies.shingles(t).tolist()) for _, t in rows]
    best = list(range(len(rows)))
    near = [(a, b) for a in range(len(rows)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for _ in rows:
        for a, b in near:
            best[a] = best[b] = min(best[a], best[b])
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    each, edges = nearcopies.links(df)
    comp = {x["node"]: x["component"] for x in graph.components(common.table(edges, "edges")).collect()}
    node = {x["key"]: x["node"] for x in each.collect()}
    groups = [comp.get(n, n) for n in (node[nearcopies._key(nearcopies.shingles(t))] for _, t in rows)]
    assert {frozenset(k for k, g in enumerate(groups) if g == h) for h in groups} == {frozenset(k for k, g in enumerate(best) if g == h) for h in best}
    twice = df.unionByName(spark.createDataFrame([(5, "another text of the id"), (5, "a text of the same id"), (None, "x"), (None, "x")], "doc_id bigint, text string"))
    one = [tuple(r) for r in nearcopies.one_of_each(twice).collect()]
    assert one.count((None, "x")) == 2 and [t for i, t in one if i == 5] == [min("another text of the id", "a text of the same id", dict(rows)[5])]
    stage = dict(corpus_pipeline.STAGES)["near-duplicates"]
    assert sorted(x["doc_id"] for x in stage(spark, df, "").collect()) == sorted(set(best))
    assert nearcopies.one_of_each(df.limit(0)).count() == 0


@pytest.mark.parametrize(("block", "others"), [(256, 2048), (2, 2048), (2, 0)])
def test_large_buckets_are_cut_into_blocks(spark, monkeypatch, block, others):
    monkeypatch.setattr(nearcopies, "BLOCK", block)
    monkeypatch.setattr(nearcopies, "MOST_OTHERS", others)
    monkeypatch.setattr(nearcopies, "LEAST", 0.95)  # far above what the bands bring together, so that buckets stay open
    base = [f"w{i}" for i in range(300)]
    rows = [(k, " ".join([*base[k * 4 :], *(f"v{i}" for i in range(k * 4))])) for k in range(40)]
    one = {r["doc_id"] for r in nearcopies.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert one == {0}


def test_open_buckets_are_joined_by_any_pair():
    a, b, c = (np.arange(x, x + 100, dtype=np.uint64) for x in (0, 10, 20))  # a-b and b-c are near, a-c is not
    assert nearcopies.joins(np.array([7, 8, 9]), np.array([7, 8, 9]), [a, c, b]) == [(7, 9), (8, 9)]


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(50)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame([*chain, *star, (7, 7)], "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{1000 + i: 1000 for i in range(300)}}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
