"""The decision layer: exclusivity, calibration of scores, and exact choice of a set by expected F0.5.

A decision takes the ``k`` best candidates of an anchor. With independent probabilities p the number of true ones among
them and among the rest have Poisson-binomial laws; both are folded up with array functions inside one row, so the
only shuffle of the decoder is the one that gathers an anchor's candidates, at most MAX_CANDIDATES of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions.columns import lit, odds
from kindred.operators.collective import with_rivals
from kindred.operators.ranking import best_first, grouped_rank

MAX_CANDIDATES = 15
LEAST_P = 1e-3


def pmf(ps: Column) -> Column:
    """Law of the number of successes of independent trials, as an array from 0."""
    pad = lambda a, left: F.concat(*((F.array(lit(0)), a) if left else (a, F.array(lit(0)))))
    return F.aggregate(ps, F.array(lit(1)), lambda acc, p: F.zip_with(pad(acc, False), pad(acc, True), lambda stay, step: stay * (1 - p) + step * p))


def expected_f(ps: Column, k: Column) -> Column:
    """Expected F0.5 of the first ``k`` of descending probabilities, k >= 1."""
    taken, rest = pmf(F.slice(ps, 1, k)), pmf(F.slice(ps, k + 1, F.greatest(F.size(ps) - k, F.lit(0))))
    per_t = F.transform(taken, lambda a, t: F.aggregate(F.transform(rest, lambda b, u: b * 1.25 * t / (k + 0.25 * (t + u))), lit(0), lambda s, x: s + x) * a)
    return F.aggregate(per_t, lit(0), lambda s, x: s + x)


def decode_matrix(df: DataFrame, key: str = "s1", p: str = "p", tie: str = "cand", most: int = MAX_CANDIDATES) -> DataFrame:
    """One row for each anchor with candidates: ``slots``, its best ones as array<struct<p, cand>>, best first."""
    best = grouped_rank(df, key, p, tie, "__r").where(F.col("__r") <= most)
    packed = F.array_sort(F.collect_list(F.struct("__r", F.col(p).alias("p"), F.col(tie).alias("cand"))))
    return best.groupBy(key).agg(F.transform(packed, lambda x: F.struct(x["p"], x["cand"])).alias("slots"))


def f_values(matrix: DataFrame) -> DataFrame:
    """Adds ``vals``: expected F0.5 of taking 0, 1, ... of the slots whose probability isn't negligible."""
    ps = F.transform(F.filter("slots", lambda x: x["p"] >= LEAST_P), lambda x: x["p"].cast("double"))
    m = matrix.withColumn("__ps", ps)
    none = F.aggregate("__ps", lit(1), lambda s, p: s * (1 - p))
    some = F.when(F.size("__ps") > 0, F.transform(F.sequence(F.lit(1), F.size("__ps")), lambda k: expected_f(F.col("__ps"), k))).otherwise(F.array().cast("array<double>"))
    return m.withColumn("vals", F.concat(F.array(none), some)).drop("__ps")


def best_k(vals: Column, digits: int = 9) -> Column:
    """The smallest k of the largest value; values are compared after rounding, so that noise decides no tie."""
    r = F.transform(vals, lambda v: F.round(v, digits))
    return (F.array_position(r, F.array_max(r)) - 1).cast("bigint")


def gated(vals: Column, h: Column) -> Column:
    """Values when a separate model gives the probability ``h`` that there is a true one at all."""
    some = F.greatest(1 - F.get(vals, F.lit(0)), lit(1e-9))
    return F.transform(vals, lambda v, i: F.when(i == 0, 1 - h).otherwise(v * h / some))


def threshold_k(slots: Column, t1: float, t2: float, r: float) -> Column:
    """0 unless the best reaches t1; else 1 and the leading extras that reach t2 and r times the best."""
    top = F.get(slots, F.lit(0))["p"]
    extras = F.slice(slots, 2, MAX_CANDIDATES)
    fits = F.aggregate(extras, F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(True).alias("go")), lambda a, x: F.struct((a["n"] + (a["go"] & (x["p"] >= t2) & (x["p"] >= r * top)).cast("bigint")).alias("n"), (a["go"] & (x["p"] >= t2) & (x["p"] >= r * top)).alias("go")))
    return F.when(top >= t1, 1 + fits["n"]).otherwise(F.lit(0)).cast("bigint")


def selections(decoded: DataFrame, k: str = "k", key: str = "s1") -> DataFrame:
    """(s1, cand, q, slot) of the first ``k`` slots."""
    return decoded.select(key, F.posexplode(F.slice("slots", 1, F.col(k).cast("int"))).alias("slot", "__s")).select(key, "__s.cand", F.col("__s.p").alias("q"), (F.col("slot") + 1).cast("bigint").alias("slot"))


def soft_exclusivity(df: DataFrame, gamma: float, p: str = "p") -> DataFrame:
    """Claims of a pool record that are not its best are worth ``gamma`` times as much."""
    d = with_rivals(df, p)
    return d.select(*df.columns, F.when(F.col("is_best"), F.col(p)).otherwise(F.col(p) * gamma).alias("q"))


def exclusivity(df: DataFrame, mode: str = "hard", lam: float = 1.0, p: str = "p") -> DataFrame:
    """Adds q: p as it is (none), zero for all but a record's best claim (hard), its odds against its rivals' (joint), or both (hardjoint)."""
    d, o = df.drop("q"), odds(F.col(p))
    columns = d.columns
    if mode in ("hard", "hardjoint"):
        d = with_rivals(d, p)
    if mode in ("joint", "hardjoint"):  # sums are partial before they are shuffled, and joined back
        d = d.join(df.groupBy("cand").agg(F.sum(o).alias("__odds")), "cand").withColumn("__joint", o / (1 + o + lam * F.greatest(F.col("__odds") - o, lit(0))))
    first = lambda c: F.when(F.col("is_best"), c).otherwise(lit(0))
    q = {"none": lambda: F.col(p), "hard": lambda: first(F.col(p)), "joint": lambda: F.col("__joint"), "hardjoint": lambda: first(F.col("__joint"))}[mode]()
    return d.select(*columns, q.alias("q"))


def one_owner(chosen: DataFrame, q: str = "q") -> DataFrame:
    """Of the selections of one pool record only the best stays."""
    return chosen.withColumn("__r", F.row_number().over(best_first("cand", q, "s1"))).where("__r <= 1").drop("__r")  # limited before the shuffle


def run_policy(pairs: DataFrame, mode: str = "hard", a: float = 1.0, b: float = 0.0) -> DataFrame:
    """(s1, cand, q): exclusivity, recalibration, expected-F0.5 choice, one owner for each record."""
    from kindred.functions.columns import recalibrate

    q = exclusivity(pairs, mode).withColumn("q", recalibrate(F.col("q"), a, b))
    d = f_values(decode_matrix(q, p="q")).withColumn("k", best_k(F.col("vals")))
    return one_owner(selections(d)).select("s1", "cand", "q")


def grid(vals: DataFrame, policies: DataFrame) -> DataFrame:
    """All policies (t1, t2, r) against all anchors; the policy table is a handful of literal rows, which go to every task."""
    return vals.crossJoin(F.broadcast(policies))


def shift_logits(df: DataFrame, by: dict[str, float], key: str = "cty", p: str = "p", everywhere: float = 0.0) -> DataFrame:
    """Moves the logit of p by a country's amount, or by ``everywhere``; zero stays zero."""
    from kindred.functions.columns import logit, sigmoid

    x = F.lit(float(everywhere))
    for k, v in by.items():
        x = F.when(F.col(key) == k, F.lit(float(v))).otherwise(x)
    return df.withColumn("q", F.when(F.col(p) <= 0, lit(0)).otherwise(sigmoid(logit(F.col(p), 1e-7) + x)))
