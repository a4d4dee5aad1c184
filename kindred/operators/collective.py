"""Features of a pair among its anchor's and its record's other pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions.columns import entropy_term, lit, logit, safe_div
from kindred.operators.ranking import best_first, group_summary


def within(df: DataFrame, p: str = "p") -> DataFrame:
    """Rank, gap to the best, relative score and sums among the pairs of an anchor; one window partitioning."""
    w, order = Window.partitionBy("s1"), best_first("s1", p, "cand")
    d = df.withColumns({"rank_in_s1": F.row_number().over(order).cast("bigint"), "s1_max": F.max(p).over(w), "s1_sum": F.sum(p).over(w), "n_strong": F.count_if(F.col(p) > 0.5).over(w), "n_mid": F.count_if(F.col(p) > 0.2).over(w), "n_cands": F.count("*").over(w)})
    d = d.withColumn("s1_2nd", F.coalesce(F.max(F.when(F.col("rank_in_s1") == 2, F.col(p))).over(w), lit(0)))
    return d.withColumn("gap", F.col("s1_max") - F.col(p)).withColumn("rel", safe_div(F.col(p), F.col("s1_max")))


def rivals(df: DataFrame, p: str = "p") -> DataFrame:
    """(cand, first_s1, cand_max, cand_2nd, n_claims, cand_sum, n_claims_strong): the two best claims of a record, and sums.

    Ranks beyond two leave before the shuffle and sums are partial, so a record of very many claims is no single task's.
    """
    top = df.withColumn("__r", F.row_number().over(best_first("cand", p, "s1"))).where(F.col("__r") <= 2)
    at = lambda k, c: F.max(F.when(F.col("__r") == k, F.col(c)))
    top = top.groupBy("cand").agg(at(1, "s1").alias("first_s1"), at(1, p).alias("cand_max"), F.coalesce(at(2, p), lit(0)).alias("cand_2nd"))
    sums = df.groupBy("cand").agg(F.count("*").alias("n_claims"), F.sum(p).alias("cand_sum"), F.count_if(F.col(p) > 0.5).alias("n_claims_strong"))
    return top.join(sums, "cand")


def with_rivals(df: DataFrame, p: str = "p") -> DataFrame:
    """Adds the columns of ``rivals``, is_best, and rival_p: the best other claim of the record, 0 without one."""
    d = df.join(rivals(df, p), "cand").withColumn("is_best", F.col("s1") == F.col("first_s1")).drop("first_s1")
    return d.withColumn("rival_p", F.when(F.col("is_best"), F.col("cand_2nd")).otherwise(F.col("cand_max")))


def across(df: DataFrame, p: str = "p") -> DataFrame:
    """Rank, margin over the rival and sums among the claims of a pool record, and whether each is the other's best."""
    d = with_rivals(df, p).withColumn("margin", F.col(p) - F.col("rival_p"))
    d = d.withColumn("rank_in_cand", F.row_number().over(best_first("cand", p, "s1")).cast("bigint"))
    mine = F.row_number().over(best_first("s1", p, "cand")) == 1
    return d.withColumn("reciprocal", F.col("is_best") & mine).drop("cand_2nd")


def sibling_support(df: DataFrame, sims: DataFrame, p: str = "p", order: str = "p", top_m: int = 10) -> DataFrame:
    """Support of each candidate by its anchor's other good ones: max p_j sim_ij, the number of strong likenesses, and max sim_ij.

    ``sims`` is (cand_i, cand_j, sim). Only the ``top_m`` of an anchor by ``order`` pair up, so an anchor makes 90 pairs at most.
    """
    top = df.withColumn("__r", F.row_number().over(best_first("s1", order, "cand"))).where(F.col("__r") <= top_m).select("s1", "cand", p)
    i, j = top.select("s1", F.col("cand").alias("cand_i")), top.select("s1", F.col("cand").alias("cand_j"), F.col(p).alias("pj"))
    e = i.join(j, "s1").where("cand_i <> cand_j").join(sims, ["cand_i", "cand_j"])
    s = e.groupBy("s1", F.col("cand_i").alias("cand")).agg(F.max(F.col("pj") * F.col("sim")).alias("sib_support"), F.count_if((F.col("pj") > 0.5) & (F.col("sim") > 0.6)).alias("sib_count"), F.max("sim").alias("sib_sim"))
    return df.join(s, ["s1", "cand"], "left").fillna(0, ["sib_support", "sib_count", "sib_sim"])


#: What entity_features takes of a pair beside its score, 0 where the table has no such column; and of an anchor.
PAIR_COLUMNS = ("n_cos", "a_cos", "j_cos", "n_sd", "a_sd", "post_eq", "post_conf")
ANCHOR_COLUMNS = ("ntok_n", "ntok_a", "has_post", "name_freq", "name_idf")


def _with_zeros(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), lit(0)) if c in df.columns else lit(0) for c in names})


def entity_features(anchors: DataFrame, df: DataFrame, p: str = "p") -> DataFrame:
    """One row for each anchor, zeros for those without candidates: best scores, mass, entropy and counts; the largest cosines; of the
    best candidate whether each is the other's best, how their names and addresses align, postal codes (1 agree, -1 conflict)
    and the margin over its other claims; and the anchor's own tokens, postal code, log of its name's frequency and mean weight of its words."""
    s = group_summary(df, "s1", p, "cand").select("s1", "top1", "top2", (F.col("top1") - F.col("top2")).alias("gap"), "mass", "entropy", "n03", "n05", "n07", "n")
    d = _with_zeros(with_rivals(df, p), PAIR_COLUMNS).withColumn("__top", F.row_number().over(best_first("s1", p, "cand")) == 1)
    top = lambda c: F.max(F.when(F.col("__top"), c))
    more = d.groupBy("s1").agg(
        F.max("n_cos").alias("max_ncos"), F.max("a_cos").alias("max_acos"), F.max("j_cos").alias("max_jcos"), top(F.col("is_best").cast("double")).alias("top1_recip"), top(F.col("n_sd")).alias("top1_nsd"), top(F.col("a_sd")).alias("top1_asd"),
        top(F.col("post_eq") - F.col("post_conf")).alias("top1_post"), top(F.col(p) - F.col("rival_p")).alias("top1_margin"),
    )
    a = _with_zeros(anchors, ANCHOR_COLUMNS).select("s1", *[F.col(c).alias(f"s1_{c}") for c in ANCHOR_COLUMNS])
    out = a.join(s.join(more, "s1"), "s1", "left").fillna(0)
    return out.select("s1", *[F.col(c).alias(f"e_{c}") for c in out.columns if c != "s1"])


def gate_features(anchors: DataFrame, df: DataFrame, p: str = "p") -> DataFrame:
    """What tells whether an anchor has a match at all: its best scores, mass, counts and entropy; the meta-blocker's and the first
    model's view (columns meta and p1, 0 without them); and what rivals claim of its best candidate and of those it loses."""
    d = _with_zeros(with_rivals(df, p), ("meta", "p1")).withColumn("__r", F.row_number().over(best_first("s1", p, "cand")))
    d = d.withColumn("__n", F.col("n_claims_strong") - (F.col(p) > 0.5).cast("bigint"))
    at = lambda k, c: F.coalesce(F.max(F.when(F.col("__r") == k, F.col(c))), lit(0))
    above = lambda t: F.count_if(F.col(p) > t)
    g = d.groupBy("s1").agg(
        at(1, p).alias("h_top1"), at(2, p).alias("h_top2"), at(3, p).alias("h_top3"), F.sum(p).alias("h_sum"), above(0.1).alias("h_n01"), above(0.3).alias("h_n03"), above(0.5).alias("h_n05"), above(0.7).alias("h_n07"), above(0.9).alias("h_n09"),
        F.count("*").alias("h_ncand"), at(1, "meta").alias("h_meta_top"), F.max("meta").alias("h_meta_max"), at(1, "p1").alias("h_p1_top"), at(1, "rival_p").alias("h_rival_top"), at(1, "__n").alias("h_rival_n05_top"),
        F.count_if((F.col(p) > 0.5) & (F.col("rival_p") > F.col(p))).alias("h_lost05"), F.sum(entropy_term(F.col(p))).alias("h_entropy"),
    )
    return anchors.select("s1").join(g, "s1", "left").fillna(0)


def stack_features(df: DataFrame, p: str = "p", members: tuple[str, ...] = ()) -> DataFrame:
    """Inputs of a second-level model: logits of both models (p and p1; p for both without it), the meta-blocker's score, place and
    share among an anchor's and among a record's pairs. Each of ``members``, logits of other scorers that may be missing, adds
    itself, whether it is there, and its distance from the logit of p."""
    d = df if "p1" in df.columns else df.withColumn("p1", F.col(p))
    a = _with_zeros(across(within(d, p), p), ("meta",))
    n_mid = F.count_if((F.col(p) > 0.2) & (F.col(p) <= 0.8)).over(Window.partitionBy("s1"))
    cols = {
        "lp2": logit(F.col(p)), "lp1": logit(F.col("p1")), "meta": F.col("meta"), "rank_s1": F.col("rank_in_s1"), "gap_top": F.col("gap"), "rel_top": F.col("rel"), "s1_mass": F.col("s1_sum"), "s1_strong": F.col("n_strong"), "s1_mid": n_mid,
        "s1_cnt": F.col("n_cands"), "rival_p": F.col("rival_p"), "rival_n": F.col("n_claims_strong") - (F.col(p) > 0.5).cast("bigint"), "claim_rank": F.col("rank_in_cand"), "margin_rival": F.col("margin"),
    }
    for m in members:
        cols |= {m: F.col(m), f"has_{m}": F.col(m).isNotNull().cast("int"), f"{m}_x_lp2": F.col(m) - logit(F.col(p))}
    return a.select("s1", "cand", *[c.alias(k) for k, c in cols.items()])


def profile(df: DataFrame, anchors: DataFrame, p: str = "p") -> DataFrame:
    """What a score table looks like without labels: pairs for each anchor, gray share, strong ones, weak anchors, contested records."""
    s = df.groupBy("s1").agg(F.count("*").alias("n"), F.count_if((F.col(p) > 0.05) & (F.col(p) < 0.95)).alias("gray"), F.count_if(F.col(p) > 0.5).alias("strong"), F.max(p).alias("top"))
    c = df.where(F.col(p) > 0.5).groupBy("cand").agg(F.count("*").alias("claims")).agg(F.count("*").alias("__c"), F.count_if(F.col("claims") >= 2).alias("__m"))
    d = anchors.select("s1").join(s, "s1", "left").agg(
        (F.sum("n") / F.count("*")).alias("pairs_per_s1"), (F.sum("gray") / F.sum("n")).alias("gray_share"), (F.sum("strong") / F.count("*")).alias("strong_per_s1"), F.avg((F.coalesce("top", lit(0)) < 0.5).cast("double")).alias("weak_share"),
    )
    return d.crossJoin(F.broadcast(c)).select("pairs_per_s1", "gray_share", "strong_per_s1", "weak_share", (F.col("__m") / F.col("__c")).alias("contested_share"))
