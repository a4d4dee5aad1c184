"""Files, stages, models and the whole flow on generated data."""

import json
import os

import pytest
from pyspark.sql import functions as F

from kindred.functions import normalize as N
from kindred.functions import records as R
from kindred.operators import blocking, calibration, decision, evaluation, models, sampling
from kindred.plans import scoring
from kindred.plans.control import Stages
from kindred.sources import files, generator, report
from kindred.streaming.chunks import run_chunks


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("er")
    generator.write(str(root), "train", generator.make(60, seed=7))
    generator.write(str(root), "test", generator.make(40, ("us", "india", "france"), seed=8))
    return str(root)


def test_generator_is_seeded():
    assert generator.make(20, seed=1) == generator.make(20, seed=1) != generator.make(20, seed=2)


def test_readers(spark, folder, tmp_path):
    assert files.find_data_dir(folder) == files.find_data_dir(f"{folder}/train") == folder
    s1 = files.read_source(spark, f"{folder}/train/train_source1.tsv")
    assert s1.columns == list(files.SOURCE_COLUMNS) and s1.count() == s1.select("entity_id").distinct().count()
    bad = tmp_path / "odd.tsv"
    bad.write_text("﻿entity_id\tbusiness_name\tbusiness_address\n S1-1 \tNA\t\"quoted\n\tno id\t\nS1-1\tagain\tx\n", encoding="utf-8")
    rows = [tuple(r) for r in files.read_source(spark, str(bad)).collect()]
    assert rows == [("S1-1", "NA", '"quoted', "")]
    lines = spark.createDataFrame([("a\tb\tc\td\te",), ("a",), ("  ",), ("a\tb\tc\td",)], "value string")
    assert {tuple(r) for r in files.tolerant(lines, ("w", "x", "y", "z")).collect()} == {("a", "b", "c\td", "e"), ("a", "", "", ""), ("a", "b", "c", "d")}


def test_lists_round_trip_and_pass_the_check(spark, tmp_path):
    anchors = spark.createDataFrame([(i,) for i in range(5)], "s1 bigint")
    pairs = spark.createDataFrame([(0, 10, 0.5), (0, 11, 0.9), (0, 10, 0.4), (3, 12, 0.1)], "s1 bigint, cand bigint, p double")
    lists = files.id_lists(anchors, pairs, [-F.col("p")])
    assert {r[0]: r[1] for r in lists.collect()} == {0: "11,10", 1: "", 2: "", 3: "12", 4: ""}
    pool = spark.createDataFrame([(i,) for i in range(10, 13)], "id bigint")
    assert files.check_lists(lists, anchors, pool, pairs).count() == 0
    assert {r["problem"] for r in files.check_lists(lists, anchors.limit(0), pool.limit(0)).collect()} == {"unknown anchor", "not in the pool"}
    files.write_tsv(lists, str(tmp_path / "out"))
    back = files.read_tsv(spark, str(tmp_path / "out"))
    assert back.count() == 5


def test_scores_and_reports_of_files(spark, tmp_path):
    gold, match, cand = (tmp_path / f"{x}.tsv" for x in ("gold", "match", "cand"))
    gold.write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S3-1\nS1-2\t\nS1-3\tS2-9\n")
    match.write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1\nS1-2\tS2-4\nS1-3\t\n")
    cand.write_text("source1_entity_id\tcandidate_entity_ids\nS1-1\tS2-1,S3-1\nS1-2\tS2-4\nS1-3\t\n")
    out = scoring.score_files(spark, str(match), str(gold), str(cand))
    assert {r["s1"]: round(r["f"], 4) for r in out["anchors"].collect()} == {"S1-1": 0.8333, "S1-2": 0.0, "S1-3": 0.0}
    assert {r["bucket"] for r in out["budget"].collect()} == {"extra_missed", "singleton_merge", "missed_blocking"}
    report.write_report({"By kind": out["budget"]}, str(tmp_path / "r.md"), "# Run")
    assert "| extra_missed | 1 |" in (tmp_path / "r.md").read_text()
    a, b = (report.package([str(gold), str(match)], str(tmp_path / f"{x}.zip")) for x in "ab")
    assert files.sha256(a) == files.sha256(b)
    assert scoring.keep_variant(0.002, 0.001) and not scoring.keep_variant(0.002, 0.001, 10, 5)


def test_end_to_end_quality(spark, folder):
    src = lambda k: files.read_source(spark, f"{folder}/train/train_source{k}.tsv").withColumn("src", F.lit(f"S{k}"))
    gold = files.explode_gold(files.read_tsv(spark, f"{folder}/train/train_ground_truth.tsv"))
    s1, pool, gold = files.load_split(src(1), src(2), src(3), gold)
    both = R.normalized(s1.unionByName(pool), "business_name", "business_address").withColumnsRenamed({"entity_id": "doc_id", "country": "cty"})
    toks = F.concat(N.name_tokens(F.col("n_core")), F.transform(N.address_tokens(F.col("a_core")), lambda w: F.concat(F.lit("@"), w)), F.col("a_postal"))
    t = blocking.token_table(both, toks).cache()
    sizes = both.groupBy(F.col("cty").alias("part")).agg(F.count("*").alias("n"))
    pairs = blocking.top_forward(blocking.cosines(blocking.weighted(t, blocking.pruned(blocking.frequencies(t, sizes)))), 6)
    scored = pairs.select("s1", "cand", F.least(F.lit(0.99), F.pow("score", F.lit(0.6))).alias("p"))
    chosen = decision.run_policy(scored, "hard")
    anchors = s1.select(F.col("entity_id").alias("s1"))
    result = evaluation.per_anchor(anchors, gold, chosen, scored)
    f = result.agg(F.avg("f")).first()[0]
    assert f > 0.8
    assert chosen.groupBy("cand").count().where("count > 1").count() == 0
    losses = evaluation.error_budget(result).agg(F.sum("loss")).first()[0]
    assert losses + f == pytest.approx(1)


def test_records_of_common_tokens_meet_their_copies(spark):
    rows = [("a", side, i, t) for side, i, text in [(0, 1, "x y"), (0, 2, "x z"), (1, 11, "y x"), (1, 12, "x y"), (1, 13, "x y"), (1, 14, "x"), (0, 3, "x rare"), (1, 15, "x y rare")] for t in text.split()]
    t = spark.createDataFrame([*rows, ("b", 1, 16, "x"), ("b", 1, 16, "y")], "part string, side int, id bigint, tok string").withColumn("tf", F.lit(1))
    w = t.where("tok = 'rare'").withColumn("w", F.lit(1.0))
    assert {(r["s1"], r["cand"], r["score"]) for r in blocking.copies(t, w, 2).collect()} == {(1, 11, 1.0), (1, 12, 1.0)}
    assert {r["cand"] for r in blocking.copies(t, w, 9).collect()} == {11, 12, 13}


def test_flagship_finds_copies_of_common_passages(spark, tmp_path):
    from kindred.plans.flagship import resolve

    docs = spark.read.parquet(f"{os.environ.get('TEST_SF_DIR', '/root/testdata/sf0.001')}/documents.parquet")
    one = docs.limit(1)
    same = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("alpha beta gamma delta").alias("text")).crossJoin(one.drop("doc_id", "text")).select(docs.columns)
    same.write.parquet(str(tmp_path / "documents.parquet"))
    lists = resolve(spark, str(tmp_path)).collect()
    assert lists and any(r["matched_entity_ids"] for r in lists)


def test_folds_cover_each_row_once(spark):
    d = spark.range(103).withColumn("g", F.when(F.col("id") < 2, "a").otherwise("b"))
    out = sampling.stratified_folds(d, "id", F.col("g")).collect()
    assert len(out) == 103 and {r["fold"] for r in out} == set(range(5)) and {r["stratum"] for r in out} == {"b"}


def test_models_and_isotonic(spark):
    d = spark.range(400).select(F.col("id").alias("s1"), (F.col("id") % 97 / 97.0).alias("x"), F.when(F.col("id") % 7 > 0, F.col("id") % 5).alias("z")).withColumn("y", (F.col("x") > 0.5).cast("int")).withColumn("fold", F.col("s1") % 2)
    out, fitted = models.out_of_fold(d, ["x", "z"], "y", "fold", 2, "q", rounds=2, depth=2)
    auc = evaluation.binary_metrics(out, p="q").first()["auc"]
    assert out.count() == 400 and auc > 0.99 and len(fitted[0].importance()) == 4
    assert models.mean_score(fitted, d.drop("y"), ["x", "z"]).where("p < 0 or p > 1").count() == 0
    const, _ = models.out_of_fold(d.withColumn("y", F.lit(0)), ["x"], "y", "fold", 2, "q")
    assert const.where("q <> 0").count() == 0
    iso = calibration.Isotonic(d, p="x")
    q = [r[0] for r in d.orderBy("x").select(iso(F.col("x"))).collect()]
    assert q == sorted(q) and 0 <= q[0] and q[-1] <= 1


def test_stages_resume(spark, tmp_path, monkeypatch):
    made = []

    def make(n):
        made.append(n)
        return spark.range(n)

    s = Stages(spark, str(tmp_path / "st"), str(tmp_path / "log.json"))
    assert s.run("a", lambda: make(3), 3).count() == 3 == s.run("a", lambda: make(3), 3).count()
    assert made == [3]
    monkeypatch.setenv("FAIL_AFTER", "a")
    with pytest.raises(RuntimeError):
        s.run("b", lambda: make(4), 4)
    monkeypatch.delenv("FAIL_AFTER")
    again = Stages(spark, str(tmp_path / "other"), look_in=(str(tmp_path / "st"),))
    assert again.run("a", lambda: make(3), 3).count() == 3 and made == [3]
    assert "a" in json.load(open(tmp_path / "log.json"))
    assert files.sha256(str(tmp_path / "log.json")) and os.path.exists(tmp_path / "log.json")


def test_stream_resumes(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    spark.range(10).repartition(2).write.parquet(src)
    double = lambda b: b.withColumn("q", F.col("id") * 2)
    assert run_chunks(spark, src, out, state, double).count() == 10
    spark.range(10, 15).write.mode("append").parquet(src)
    got = run_chunks(spark, src, out, state, double)
    assert got.count() == 15 and got.select("id").distinct().count() == 15


def test_native_words_are_learned_from_names_and_addresses(spark):
    from kindred.functions import records as R
    from kindred.operators import lexicon

    pool = [(10, "मित्र भारत", "लक्ष्मी रोड, 12"), (11, "मित्र दुकान", "लक्ष्मी नगर"), (12, "मित्र", "x"), (13, "plain", "latin only"), (14, None, None)]
    anchors = [(1, "Friend India", "12 Lakshmi Road"), (2, "Friend Shop", "Lakshmi Nagar"), (3, "Friend Of All", "y"), (4, "plain", "")]
    gold = [(1, 10), (2, 11), (3, 12), (4, 13), (4, 14), (9, 10)]
    t = "id long, name string, addr string"
    pairs = lexicon.native_pairs(spark.createDataFrame(gold, "s1 long, cand long"), spark.createDataFrame(anchors, t), spark.createDataFrame(pool, t))
    assert pairs.count() == 3
    got = {r["word"]: r["meaning"] for r in lexicon.learn_native(pairs).collect()}
    assert got == {"मित्र": "friend", "लक्ष्मी": "lakshmi"}
    once = {r["word"]: r["meaning"] for r in lexicon.learn_native(pairs, least=1).collect()}
    assert once["भारत"] == "india" and once["नगर"] == "nagar" and once["रोड"] == "road"
    df = spark.createDataFrame([(1, "मित्र Ltd", "")], "doc_id long, name string, addr string")
    assert R.normalized(df, native=got).first()["n_core"] == ["friend"]


def test_dense_vectors_that_take_no_part(spark):
    from kindred.operators import dense

    t = "part string, id long, v array<float>"
    q = spark.createDataFrame([("a", 0, [1.0, 0.0]), ("a", 1, None), ("a", 2, [1.0, None]), ("a", 3, [1.0, 2.0, 3.0]), (None, 4, [1.0, 1.0]), ("b", 5, [1.0, 1.0])], t)
    r = spark.createDataFrame([("a", 10, [2.0, 0.0]), ("a", 11, [1.0, 1.0]), ("a", 12, None), ("a", 13, [float("nan"), 1.0]), ("a", 14, [0.0, 0.0, 1.0]), ("a", 15, [])], t)
    got = sorted(tuple(x) for x in dense.dense_topk(q, r, 5).select("s1", "rank", "cand", "score").collect())
    assert got == [(0, 1, 10, 2.0), (0, 2, 11, 1.0), (3, 1, 14, 3.0)]
    assert dense.dense_topk(q.limit(0), r, 5).count() == 0 == dense.dense_topk(q, r.limit(0), 5).count()


def test_dense_blocks_meet_pairwise(spark, monkeypatch):
    import numpy as np

    from kindred.operators import dense

    monkeypatch.setattr(dense, "BLOCK", 7)
    x = np.random.default_rng(1).normal(size=(60, 4)).round(2)
    df = spark.createDataFrame([("p", i, v.tolist()) for i, v in enumerate(x)], "part string, id long, v array<double>")
    got = {(r["s1"], r["rank"]): r["cand"] for r in dense.dense_topk(df, df, 3).collect()}
    for i in range(60):
        s = np.round(x @ x[i], 9)
        assert [got[i, k] for k in (1, 2, 3)] == np.lexsort((np.arange(60), -s))[:3].tolist()


def test_percentiles_folds_and_budget_do_not_depend_on_ranges(spark):
    import hashlib

    import numpy as np

    from kindred.operators import aggregates, ranking, sampling

    rows = [(i % 3 if i % 3 else None, float((i * 7919) % 101) if i % 10 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "g int, v double")
    for r in aggregates.percentiles(df, "g", "v").collect():
        vals = [v for g, v in rows if g == r["g"] and v is not None]
        assert [r["p50"], r["p95"], r["p99"]] == pytest.approx(np.percentile(vals, [50, 95, 99]).tolist())
    d = spark.createDataFrame([(i, f"k{i % 17}") for i in range(400)], "id long, g string")
    order = sorted(range(17), key=lambda k: hashlib.md5(f"k{k}|g".encode()).hexdigest())
    want = {f"k{k}": n % 5 for n, k in enumerate(order)}
    assert all(r["fold"] == want[r["g"]] for r in sampling.group_folds(d, F.col("g")).collect())
    b = ranking.cumulative_budget(spark.range(100).withColumn("n", F.col("id") % 5), "n", [F.col("id")], 37)
    total, kept = 0, []
    for i in range(100):
        if total >= 37:
            break
        kept.append(i)
        total += i % 5
    assert sorted(r["id"] for r in b.collect()) == kept


def test_shift_calibration_borrows_by_country(spark):
    from kindred.operators import calibration

    rows = [(c, i, (i % 50) / 50 + 0.01, int(i % 50 > (20 if c == "us" else 35))) for c in ("us", "in") for i in range(600)]
    known = spark.createDataFrame([(c, p, y) for c, _, p, y in rows], "cty string, p double, y int")
    new = spark.createDataFrame([(c, p) for c in ("us", "in", "fr") for _, _, p, _ in rows[:600:7]], "cty string, p double")
    n = {"us": 100, "in": 100}
    at = lambda borrow: {(r["cty"], r["p"]): r["q"] for r in calibration.shift_calibrated(known, n, new, {"us": 15, "in": 15, "fr": 15}, borrow).collect()}
    own, lent = at(None), at({"fr": "us"})
    ps = sorted({p for _, p in own})
    assert [lent["fr", p] for p in ps] == pytest.approx([own["us", p] for p in ps]) and any(abs(own["fr", p] - own["us", p]) > 1e-3 for p in ps)
    for c in ("us", "in", "fr"):
        q = [own[c, p] for p in ps]
        assert q == sorted(q) and 0 <= q[0] and q[-1] <= 1


def test_early_stopping_and_seeds(spark):
    from kindred.operators import models

    df = spark.range(300).select("id", (F.col("id") % 7).cast("double").alias("x"), (F.xxhash64("id") % 11).cast("double").alias("noise"), F.pmod("id", F.lit(3)).alias("fold")).withColumn("y", (F.col("x") > 3).cast("int"))
    scored, fitted = models.out_of_fold(df, ["x", "noise"], "y", "fold", 3, rounds=25, depth=2, seeds=(1, 2), stop=True)
    assert len(fitted) == 6 and scored.count() == 300 and all(m.model.getNumTrees <= 25 for m in fitted)
    assert scored.where((F.col("p") > 0.5) != (F.col("y") == 1)).count() == 0
