"""Candidate pairs by shared rare tokens: weights, one equi-join for both directions, unions with provenance, exact cosines.

Tables of tokens are (part, side, id, tok, tf), side 0 for anchors and 1 for the pool, one row for each token of a record. Tokens of too
many records leave before the join, so no posting list is longer than the cap and the join's rows are bounded by
records x tokens x cap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions.columns import smooth_idf
from kindred.operators import nearest
from kindred.sources.shared import table

#: A token is too common beyond MAX_SHARE of a part's records or MAX_RECORDS, whichever is less, but never below LEAST_CAP.
MAX_SHARE, MAX_RECORDS, LEAST_CAP = 0.02, 3000, 25


def token_table(records: DataFrame, toks: Column) -> DataFrame:
    """(part, side, id, tok, tf) of records (cty, src, doc_id).

    Occurrences are counted before anything is shuffled, as a record's lie together. The outer form, as for the inner one
    Spark would work out all tokens a second time to see whether there are any.
    """
    t = records.select(F.col("cty").alias("part"), (F.col("src") != "S1").cast("int").alias("side"), F.col("doc_id").alias("id"), F.explode_outer(toks).alias("tok")).where("tok is not null")
    return t.groupBy("part", "side", "id", "tok").agg(F.count("*").alias("tf"))


def frequencies(tokens: DataFrame, sizes: DataFrame) -> DataFrame:
    """(part, tok, df, idf): records that have a token, of both sides; ``sizes`` is (part, n)."""
    df = tokens.groupBy("part", "tok").agg(F.count("*").alias("df"))
    return df.join(sizes, "part").select("part", "tok", "df", smooth_idf(F.col("n"), F.col("df")).alias("idf"), "n")


def pruned(freq: DataFrame, share: float = MAX_SHARE, most: int = MAX_RECORDS) -> DataFrame:
    """The tokens that are rare enough; a smaller share suits texts of many words, whose rare ones suffice to find them."""
    cap = F.greatest(F.lit(float(LEAST_CAP)), F.least(F.col("n") * share, F.lit(float(most))))
    return freq.where(F.col("df") <= cap)


def weighted(tokens: DataFrame, freq: DataFrame) -> DataFrame:
    """(part, side, id, tok, w): ln(1 + tf) * idf of the tokens in ``freq``, each record of length 1."""
    w = tokens.join(freq.select("part", "tok", "idf"), ["part", "tok"]).withColumn("w", F.ln(1 + F.col("tf")) * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("part", "side", "id")))
    return w.select("part", "side", "id", "tok", (F.col("w") / norm).alias("w"))


#: Documents from which a share caps how many may have a character n-gram, and that share; distinct ones that are sent to every executor at most.
CAP_FROM, CHAR_SHARE, SENT = 2000, 0.2, 20_000


def char_weights(docs: DataFrame, words: Column, share: float = CHAR_SHARE) -> DataFrame:
    """(id, tok, w) of runs of three and four characters within words: (1 + ln tf) * idf, each of ``docs`` (id) of length 1. Of CAP_FROM
    documents or more, runs that more than ``share`` of them have are left out.

    Documents are dealt by id before they are taken apart, so runs are counted and weights summed where they are made. Spark takes their table
    for no larger than the file of ``docs``, and would send it to the driver and all executors: the join is told which side, if any, is sent.
    """
    from kindred.functions.normalize import char_ngrams

    spark = docs.sparkSession
    deal = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    t = docs.select("id", words.alias("words")).repartition(deal, "id")
    t = t.select("id", F.explode(F.concat(char_ngrams(F.col("words"), 3), char_ngrams(F.col("words"), 4))).alias("tok")).groupBy("id", "tok").agg(F.count("*").alias("tf"))
    n = docs.agg(F.count("*").alias("n"))
    df = t.groupBy("tok").agg(F.count("id").alias("df")).crossJoin(F.broadcast(n)).where((F.col("n") < CAP_FROM) | (F.col("df") <= share * F.col("n")))
    df = table(df, "frequencies")
    df = F.broadcast(df) if df.limit(SENT + 1).count() <= SENT else df.hint("merge")
    w = t.join(df, "tok").withColumn("w", (1 + F.ln("tf")) * smooth_idf(F.col("n"), F.col("df")))
    return w.select("id", "tok", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))).alias("w"))


def cosines(w: DataFrame, least: float = 1e-9) -> DataFrame:
    """(part, s1, cand, score) of every anchor and pool record that share a token; score rounded so that noise decides no tie."""
    a = w.where("side = 0").select("part", "tok", F.col("id").alias("s1"), F.col("w").alias("wa"))
    b = w.where("side = 1").select("part", "tok", F.col("id").alias("cand"), F.col("w").alias("wb"))
    s = a.join(b, ["part", "tok"]).groupBy("part", "s1", "cand").agg(F.round(F.sum(F.col("wa") * F.col("wb")), 9).alias("score"))
    return s.where(F.col("score") > least)


def best_forward(w: DataFrame, k: int, rows: int) -> DataFrame:
    """``top_forward(cosines(w), k)`` without a table of all pairs; ``rows``: how many ``w`` has at most."""
    return top_forward(nearest.nearest(nearest.blocks(w, rows), k), k)


def best_reverse(w: DataFrame, k: int, rows: int) -> DataFrame:
    """``top_reverse(cosines(w), k)`` likewise."""
    return top_reverse(nearest.nearest(nearest.blocks(w, rows, 1), k, 1), k)


def packed(records: DataFrame, toks: Column, sizes: DataFrame) -> DataFrame | None:
    """The records' weights in blocks (``nearest.record_blocks``); None if an id is repeated, as its tokens must be put together first."""
    if records.groupBy("cty", "src", "doc_id").count().where("count > 1").limit(1).count():
        return None
    return nearest.record_blocks(records, toks, sizes, pruned)


def best_of(records: DataFrame, toks: Column, sizes: DataFrame, k: int) -> DataFrame:
    """The k best pool records of each anchor, from the records themselves."""
    b = packed(records, toks, sizes)
    if b is not None:
        return top_forward(nearest.nearest(b, k), k)
    t = table(token_table(records, toks), "tokens")
    return best_forward(weighted(t, pruned(frequencies(t, sizes))), k, t.count())


def best_and_copies(records: DataFrame, toks: Column, sizes: DataFrame, k: int) -> DataFrame:
    """``best_of``, with the ``copies`` of records without a rare token."""
    b = packed(records, toks, sizes)
    if b is not None:
        left = b.select("side", F.explode("bare").alias("x")).select("x.part", "side", "x.id", "x.h")
        return top_forward(nearest.nearest(b, k).unionByName(alike(left, k)), k)
    t = table(token_table(records, toks), "tokens")
    w = table(weighted(t, pruned(frequencies(t, sizes))), "weights")
    return top_forward(best_forward(w, k, w.count()).drop("rank").unionByName(copies(t, w, k)), k)


def copies(tokens: DataFrame, w: DataFrame, k: int) -> DataFrame:
    """(part, s1, cand, score) of records of which no token is left in ``w``: those of the very same tokens, whose cosine is 1.

    The pool's records are grouped first, a group's k smallest ids in one row: with equal scores no others are among an anchor's k best.
    """
    ids = ["part", "side", "id"]
    left = tokens.join(w.select(*ids).distinct(), ids, "left_anti").groupBy(*ids).agg(F.sha2(F.to_json(F.sort_array(F.collect_list(F.struct("tok", "tf")))), 256).alias("h"))
    return alike(left, k)


def alike(left: DataFrame, k: int) -> DataFrame:
    """(part, s1, cand, score) of anchors and pool records of ``left`` (part, side, id, h) with the same h, score 1."""
    best = lambda *by: F.row_number().over(Window.partitionBy("part", "h", *by).orderBy("id"))
    pool = left.where("side = 1").withColumn("deal", F.pmod(F.xxhash64("id"), F.lit(64)))
    pool = pool.withColumn("r", best("deal")).where(F.col("r") <= k).withColumn("r", best()).where(F.col("r") <= k)
    groups = pool.groupBy("part", "h").agg(F.collect_list("id").alias("cands"))
    found = left.where("side = 0").select("part", "h", F.col("id").alias("s1")).join(groups, ["part", "h"])
    return found.select("part", "s1", F.explode("cands").alias("cand"), F.lit(1.0).alias("score"))


def top_forward(scores: DataFrame, k: Column | int) -> DataFrame:
    """The k best pool records of each anchor."""
    r = F.row_number().over(Window.partitionBy("s1").orderBy(F.col("score").desc(), "cand"))
    return scores.withColumn("rank", r.cast("bigint")).where(F.col("rank") <= k)


def top_reverse(scores: DataFrame, k: int) -> DataFrame:
    """The k best anchors of each pool record."""
    r = F.row_number().over(Window.partitionBy("cand").orderBy(F.col("score").desc(), "s1"))
    return scores.withColumn("rank", r.cast("bigint")).where(F.col("rank") <= k)


def two_hop(forward: DataFrame, neighbours: DataFrame, seed_rank: int = 3, seed_score: float = 0.3, hop_score: float = 0.6, k: int = 15) -> DataFrame:
    """Pool records near an anchor's best ones: product of the two scores, the best of several ways.

    ``neighbours`` is (seed, cand, sim): pool records and their near ones.
    """
    seeds = forward.where((F.col("rank") <= seed_rank) & (F.col("score") >= seed_score)).select("part", "s1", F.col("cand").alias("seed"), "score")
    hop = seeds.join(neighbours.where(F.col("sim") >= hop_score), "seed").where("seed <> cand")
    best = hop.groupBy("part", "s1", "cand").agg(F.max(F.round(F.col("score") * F.col("sim"), 9)).alias("score"))
    return top_forward(best, k)


def union(hits: DataFrame, channels: dict[str, int]) -> DataFrame:
    """One row for each pair of ``hits`` (s1, cand, channel, score, rank): s_<channel> (0 if not found), k_<channel> (K + 1), n_ch."""
    cols = []
    for c, k in channels.items():
        cols.append(F.coalesce(F.max(F.when(F.col("channel") == c, F.col("score"))), F.lit(0.0)).alias(f"s_{c}"))
        cols.append(F.coalesce(F.min(F.when(F.col("channel") == c, F.col("rank"))), F.lit(k + 1)).cast("bigint").alias(f"k_{c}"))
    return hits.groupBy("s1", "cand").agg(*cols, F.countDistinct("channel").alias("n_ch"))


def exact_cosines(pairs: DataFrame, w: DataFrame) -> DataFrame:
    """(s1, cand, cos) of given pairs, 0 without a shared token: tokens of the pairs' own records only are joined."""
    p = pairs.select("s1", "cand").distinct()
    a = w.where("side = 0").select(F.col("id").alias("s1"), "tok", F.col("w").alias("wa"))
    b = w.where("side = 1").select(F.col("id").alias("cand"), "tok", F.col("w").alias("wb"))
    s = p.join(a, "s1").join(b, ["cand", "tok"]).groupBy("s1", "cand").agg(F.sum(F.col("wa") * F.col("wb")).alias("cos"))
    return p.join(s, ["s1", "cand"], "left").select("s1", "cand", F.coalesce("cos", F.lit(0.0)).alias("cos"))


def postal_agreement(a: Column, b: Column) -> tuple[Column, Column]:
    """(agree, conflict) of two lists of postal codes; neither if one is empty."""
    both = (F.size(a) > 0) & (F.size(b) > 0)
    return both & F.arrays_overlap(a, b), both & ~F.arrays_overlap(a, b)
