"""Quality of decisions and of candidates, as grouped sums; every anchor counts, also those without candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions.columns import bucket, clip, f_beta, lit


#: Ranges of scores between 0 and 1 for running sums.
RANGES = 1024


def per_anchor(anchors: DataFrame, truth: DataFrame, chosen: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """(anchors' columns, g, k, tp, f[, seen]): gold and chosen set sizes, true ones among the chosen, F0.5, gold among candidates.

    ``anchors`` has s1; ``truth`` and ``chosen`` have distinct (s1, cand).
    """
    t = truth.select("s1", "cand").withColumn("__t", F.lit(1))
    c = chosen.select("s1", "cand").withColumn("__c", F.lit(1))
    both = t.join(c, ["s1", "cand"], "full")
    if candidates is not None:
        both = both.join(candidates.select("s1", "cand").distinct().withColumn("__u", F.lit(1)), ["s1", "cand"], "left")
    seen = [F.count(F.when(F.col("__t").isNotNull() & F.col("__u").isNotNull(), 1)).alias("seen")] if candidates is not None else []
    sums = both.groupBy("s1").agg(F.count("__t").alias("g"), F.count("__c").alias("k"), F.count(F.when(F.col("__t").isNotNull() & F.col("__c").isNotNull(), 1)).alias("tp"), *seen)
    zero = ["g", "k", "tp", *(["seen"] if seen else [])]
    out = anchors.drop(*zero).join(sums, "s1", "left").fillna(0, zero)
    return out.withColumn("f", f_beta(F.col("tp"), F.col("k"), F.col("g")))


def error_bucket(f: Column, g: Column, k: Column, tp: Column, seen: Column) -> Column:
    """Where an anchor's loss 1 - F comes from."""
    return (
        F.when(f == 1, "none")
        .when((g == 0) & (k > 0), "singleton_merge")
        .when((k == 0) & (seen == 0), "missed_blocking")
        .when(k == 0, "missed_model")
        .when(tp == 0, "wrong_pick")
        .when(k > tp, "extra_fp")
        .otherwise("extra_missed")
    )


def error_budget(scored: DataFrame) -> DataFrame:
    """(bucket, n, loss): losses as shares of all anchors; with the mean F0.5 they sum to 1."""
    b = scored.withColumn("bucket", error_bucket(*(F.col(c) for c in ("f", "g", "k", "tp", "seen"))))
    n = scored.agg(F.count("*").alias("__n"))
    return b.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(1 - F.col("f")).alias("__s")).crossJoin(F.broadcast(n)).select("bucket", "n", (F.col("__s") / F.col("__n")).alias("loss"))


def breakdown(scored: DataFrame, by: str = "cty") -> DataFrame:
    """Overall, by country and by number of true matches (0, 1, 2, 3+) in one pass of grouping sets."""
    d = scored.withColumn("m", F.least(F.col("g"), F.lit(3)))
    cond = lambda c, x: F.avg(F.when(c, x))
    return d.groupingSets([[], [by], ["m"]], by, "m").agg(
        F.count("*").alias("n"), F.avg("f").alias("f05"), cond(F.col("k") > 0, F.col("tp") / F.col("k")).alias("precision"), cond(F.col("g") > 0, F.col("tp") / F.col("g")).alias("recall"),
        cond(F.col("g") == 0, (F.col("k") == 0).cast("double")).alias("singleton_accuracy"), F.avg((F.col("k") > 0).cast("double")).alias("nonempty"), F.grouping_id().cast("bigint").alias("level"),
    )


def blocking_kpis(anchors: DataFrame, truth: DataFrame, candidates: DataFrame, pool: int) -> DataFrame:
    """Pair completeness, entity completeness, reduction ratio, pair quality and candidates for each anchor (mean, p95, max)."""
    u = candidates.select("s1", "cand").distinct()
    hits = u.join(truth.select("s1", "cand").withColumn("__t", F.lit(1)), ["s1", "cand"], "left")
    by = hits.groupBy("s1").agg(F.count("*").alias("n"), F.count("__t").alias("found"))
    g = truth.groupBy("s1").agg(F.count("*").alias("g"))
    d = anchors.select("s1").join(by, "s1", "left").join(g, "s1", "left").fillna(0)
    return d.agg(
        (F.sum("found") / F.sum("g")).alias("pc"),
        F.avg(F.when(F.col("g") > 0, (F.col("found") == F.col("g")).cast("double"))).alias("entity_completeness"),
        (1 - F.sum("n") / (F.count("*") * lit(pool))).alias("reduction"),
        (F.sum("found") / F.sum("n")).alias("pq"),
        F.avg("n").alias("mean_candidates"),
        F.percentile("n", F.lit(0.95)).alias("p95_candidates"),
        F.max("n").alias("max_candidates"),
    )


def channel_audit(hits: DataFrame, truth: DataFrame) -> DataFrame:
    """(channel, found, alone): true pairs that a channel finds, and that it alone finds."""
    t = hits.select("s1", "cand", "channel").distinct().join(truth.select("s1", "cand"), ["s1", "cand"], "left_semi")
    n = F.count("*").over(Window.partitionBy("s1", "cand"))
    return t.withColumn("__n", n).groupBy("channel").agg(F.count("*").alias("found"), F.count_if(F.col("__n") == 1).alias("alone"))


def recall_at(ranked: DataFrame, truth: DataFrame, caps: list[int], rank: str = "rank") -> DataFrame:
    """(cap, recall): share of all gold pairs that rank at or above each cap; cap null: any rank."""
    r = truth.select("s1", "cand").join(ranked.select("s1", "cand", rank), ["s1", "cand"], "left")
    sums = r.agg(F.count("*").alias("__n"), *[F.count_if(F.col(rank) <= c).alias(f"c{c}") for c in caps], F.count(rank).alias("call"))
    pairs = ", ".join(f"bigint({c}), c{c}" for c in caps)
    return sums.selectExpr("__n", f"stack({len(caps) + 1}, {pairs}, cast(null as bigint), call) as (cap, hit)").select("cap", (F.col("hit") / F.col("__n")).alias("recall"))


def binary_metrics(df: DataFrame, y: str = "y", p: str = "p", by: str | None = None) -> DataFrame:
    """AUC (average ranks on ties), average precision by distinct thresholds, log loss and Brier score; null where one class is missing.

    Rows are counted by distinct score. Running sums go over ranges of scores first and then inside each range, so no task
    sorts all scores, however many there are.
    """
    key = [by] if by else []
    s = df.groupBy(*key, F.col(p).cast("double").alias("p")).agg(F.sum(F.col(y).cast("bigint")).alias("pos"), F.count("*").alias("n"))
    s = s.withColumn("__b", bucket(F.col("p"), RANGES))
    up, down = (lambda w: w.rowsBetween(Window.unboundedPreceding, -1)), (lambda w: w.rowsBetween(Window.unboundedPreceding, 0))
    c = s.groupBy(*key, "__b").agg(F.sum("pos").alias("__pos"), F.sum("n").alias("__n"))
    over, under = Window.partitionBy(*key).orderBy("__b"), Window.partitionBy(*key).orderBy(F.col("__b").desc())
    first = lambda x, w: F.coalesce(F.sum(x).over(up(w)), F.lit(0))
    c = c.select(*key, "__b", first(F.col("__n") - F.col("__pos"), over).alias("__below"), first(F.col("__pos"), under).alias("__tp"), first(F.col("__n"), under).alias("__upto"))
    inside, back = Window.partitionBy(*key, "__b").orderBy("p"), Window.partitionBy(*key, "__b").orderBy(F.col("p").desc())
    s = s.join(c, [*key, "__b"])
    s = s.withColumn("below", F.col("__below") + first(F.col("n") - F.col("pos"), inside)).withColumn("tp", F.col("__tp") + F.sum("pos").over(down(back))).withColumn("upto", F.col("__upto") + F.sum("n").over(down(back)))
    q = clip(F.col("p"), 1e-7)
    neg = F.col("n") - F.col("pos")
    a = s.groupBy(*key).agg(
        F.sum("n").alias("n"), F.sum("pos").alias("pos"), F.sum(F.col("pos") * (F.col("below") + neg / 2)).alias("__u"), F.sum(F.col("pos") * F.col("tp") / F.col("upto")).alias("__ap"),
        F.sum(-(F.col("pos") * F.ln(q) + neg * F.ln(1 - q))).alias("__ll"), F.sum(F.col("pos") * F.pow(1 - F.col("p"), lit(2)) + neg * F.pow("p", lit(2))).alias("__b"),
    )
    both = (F.col("pos") > 0) & (F.col("pos") < F.col("n"))
    when = lambda x: F.when(both, x)
    return a.select(*key, "n", "pos", when(F.col("__u") / (F.col("pos") * (F.col("n") - F.col("pos")))).alias("auc"), when(F.col("__ap") / F.col("pos")).alias("ap"), when(F.col("__ll") / F.col("n")).alias("logloss"), when(F.col("__b") / F.col("n")).alias("brier"))


def calibration_table(df: DataFrame, y: str = "y", p: str = "p", bins: int = 10) -> DataFrame:
    """(bin, n, mean_p, rate, gap) by equal-width bins; the expected calibration error is sum(n * gap) / sum(n)."""
    d = df.groupBy(bucket(F.col(p), bins).alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("rate"))
    return d.withColumn("gap", F.abs(F.col("mean_p") - F.col("rate")))


def counterfactuals(scored: DataFrame) -> DataFrame:
    """Mean F0.5 as it is, without false positives, with every true candidate taken too, and with all gold found; and errors of the count."""
    free = f_beta(F.col("tp"), F.col("tp"), F.col("g"))
    taken = f_beta(F.col("seen"), F.col("seen") + (F.col("k") - F.col("tp")), F.col("g"))
    found = f_beta(F.col("g"), F.col("g") + (F.col("k") - F.col("tp")), F.col("g"))
    off = F.greatest(F.lit(-3), F.least(F.lit(3), F.col("k") - F.col("g")))
    return scored.agg(
        F.avg("f").alias("f05"), F.avg(free).alias("no_fp"), F.avg(taken).alias("all_candidates"), F.avg(found).alias("all_gold"),
        F.count_if(off < 0).alias("too_few"), F.count_if(off == 0).alias("right_count"), F.count_if(off > 0).alias("too_many"),
    )


def dashboard(scored: DataFrame, tops: DataFrame, by: str = "cty") -> DataFrame:
    """By country: anchors without candidates, empty decisions, mean number chosen, and a histogram of best scores as columns."""
    d = scored.join(tops.select("s1", "top1"), "s1", "left")
    b = bucket(F.col("top1"))
    return d.groupBy(by).agg(
        F.count("*").alias("n"), F.avg(F.col("top1").isNull().cast("double")).alias("no_candidate"), F.avg((F.col("k") == 0).cast("double")).alias("empty"), F.avg("k").alias("mean_chosen"),
        *[F.count_if(b == i).alias(f"top_{i}") for i in range(10)],
    )
