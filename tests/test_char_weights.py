"""Only the table of distinct runs may be sent to all executors, never the runs of all documents, however small their file is."""

import pytest
from pyspark.sql import functions as F

from kindred.operators import blocking


def _docs(spark, tmp_path):
    rows = [(i if i % 50 else None, ["large", f"ring{i % 9}", None if i % 4 else "x"]) for i in range(3000)] + [(7, ["ring", "ring"])]
    spark.createDataFrame(rows, "id bigint, words array<string>").coalesce(1).write.parquet(f"{tmp_path}/docs")
    return spark.read.parquet(f"{tmp_path}/docs")


def test_runs_are_not_sent(spark, tmp_path, monkeypatch):
    docs = _docs(spark, tmp_path)
    w = blocking.char_weights(docs, F.col("words"))
    plan = w._jdf.queryExecution().sparkPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan and "SortMergeJoin" not in plan
    got = {(r["id"], r["tok"]): r["w"] for r in w.collect()}
    monkeypatch.setattr(blocking, "SENT", 0)
    w = blocking.char_weights(docs, F.col("words"))
    plan = w._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    want = {(r["id"], r["tok"]): r["w"] for r in w.collect()}
    assert set(got) == set(want) and all(x == pytest.approx(want[k], abs=1e-12) for k, x in got.items())


def test_documents_are_shuffled_but_not_their_runs(spark, tmp_path):
    docs = _docs(spark, tmp_path)
    plan = blocking.char_weights(docs, F.col("words"))._jdf.queryExecution().executedPlan().toString()
    hashed = [x for x in plan.splitlines() if "hashpartitioning" in x]
    assert hashed and all("REPARTITION" in x for x in hashed)


def test_null_is_no_document_of_a_run(spark):
    """df counts ids as the SQL does, of which null is none; repeated ids are one document."""
    docs = spark.createDataFrame([(None, ["abc"]), (1, ["abc"]), (1, ["abc", "zz"])], "id bigint, words array<string>")
    w = {(r["id"], r["tok"]): r["w"] for r in blocking.char_weights(docs, F.col("words")).collect()}
    from math import log, sqrt

    idf = log(4 / 2) + 1
    mine = {t: (1 + log(2)) * idf for t in (" ab", "abc", "bc ", " abc", "abc ")} | {t: idf for t in (" zz", "zz ", " zz ")}
    norm = sqrt(sum(x * x for x in mine.values()))
    got = {t: x for (i, t), x in w.items() if i == 1}
    assert got.keys() >= mine.keys() and all(got[t] == pytest.approx(x / norm, abs=1e-12) for t, x in mine.items())
