"""Mixing sources."""

import pytest
from helpers import prose
from pyspark.sql import functions as F

from kindred.llm import mixing


def test_targets(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 5)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    total, cap, w = 2015, {"a": 30, "b": 3000, "c": 3000, None: 15}, {"a": 1, "b": 2, "c": 3, None: 1}
    free = set(cap)
    want = {}
    while True:
        rest = total - sum(want.values())
        share = {k: rest * w[k] / sum(w[x] for x in free) for k in free}
        over = {k for k in free if share[k] > cap[k]}
        if not over:
            want |= share
            break
        want |= {k: cap[k] for k in over}
        free -= over
    assert got == pytest.approx(want)


def test_mixing_of_nameless_rows_equal_keys_and_empty_tables(spark):
    rows = [(None, "a b c", "s"), (None, "a b c", "s"), (None, "d e", "s"), (1, "x " * 30, "t"), (1, "x " * 30, "t"), (2, None, None), (3, "", "t")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = [r.asDict() for r in mixing.mix(df).collect()]
    assert len(got) == 7
    nameless = [r["taken"] for r in got if r["doc_id"] is None and r["size"] == 3]
    assert len(nameless) == 2 and nameless[0] == nameless[1] and len({r["taken"] for r in got if r["doc_id"] == 1}) == 1
    out = mixing.mixed(df)
    assert out.columns == df.columns and out.count() == sum(r["copies"] for r in got)
    assert mixing.mixed(df.limit(0)).count() == 0 == mixing.mix(df.where("size(split(text, ' ')) > 99")).count()


def test_weights_are_by_quality(spark):
    bad = "buy ### now ***\n" * 20
    df = spark.createDataFrame([(1, prose(60, 1)), (2, bad), (3, "x " * 50), (4, None)], "doc_id long, text string")
    w = {r["doc_id"]: r["w"] for r in df.select("doc_id", mixing.quality_weight(F.col("text"), mixing.word_count(F.col("text"))).alias("w")).collect()}
    assert w[1] == 1 and w[2] < 0.02 and w[3] == 0.25 and w[4] > 0


def test_mixing(docs, empty, spark):
    got = [r.asDict() for r in mixing.mix(docs).collect()]
    assert len(got) == docs.count() and sorted(map(str, got)) == sorted(str(r.asDict()) for r in mixing.mix(docs).collect())
    assert all(r["taken"] <= 3 * r["size"] for r in got) and mixing.mix(empty).count() == 0
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), (F.col("id") % 50 + 1).cast("int")).alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"))
    m = mixing.mix(many).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()
    assert all(abs(r["t"] - r["g"]) <= 50 for r in m)
    copies = mixing.mixed(many).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in copies} == {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(many).collect() if r["taken"]}
