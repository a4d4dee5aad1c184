"""Queries over records made of ``pages``: a host's labels are a name, the path an address."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions import columns as X
from kindred.functions import normalize as N
from kindred.functions import records as R
from kindred.operators import blocking, features, models
from kindred.plans.contract import Catalogue
from kindred.plans.decisions import CLAIMS
from kindred.sources.shared import table
from kindred.sources.tables import anchors, claims, read

C = Catalogue()


def web_records(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "pages")
    parts = F.split("url", "/")
    r = F.pmod("page_id", F.lit(5))
    return p.select(
        F.col("page_id").alias("id"), F.col("page_id").alias("doc_id"), F.when(r == 0, "S1").when(r <= 2, "S2").otherwise("S3").alias("src"), F.coalesce(F.get(parts, F.lit(3)), F.lit("")).alias("cty"),
        F.translate(F.coalesce(F.get(parts, F.lit(2)), F.lit("")), ".-", "  ").alias("name"), F.regexp_replace(F.array_join(F.slice(parts, 4, 99), ", "), "[?&=#]", ", ").alias("addr"),
    )


@C.add("clean_name", "page_id:i name:s domains:s", "SELECT page_id, CASE WHEN len(dm) > 0 THEN trim(regexp_replace(regexp_replace(lower(url), 'https?://(www\\.)?', ' ', 'g'), '[/?#=&]+', ' ', 'g')) ELSE lower(url) END AS name, array_to_string(dm, ' ') AS domains FROM (SELECT page_id, url, list_transform(regexp_extract_all(lower(url), '(" + N.DOMAIN + ")', 1), lambda x: regexp_replace(x, '^www\\.', '')) AS dm FROM pages)")
def _(spark, d):
    """Web markers go only where a domain is found."""
    dm = N.domains(F.col("url"))
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower("url"), r"https?://(www\.)?", " "), "[/?#=&]+", " "))
    return read(spark, d, "pages").select("page_id", F.when(F.size(dm) > 0, plain).otherwise(F.lower("url")).alias("name"), F.array_join(dm, " ").alias("domains"))


def feature_table(spark: SparkSession, d: str) -> DataFrame:
    r = web_records(spark, d)
    normal = table(R.normalized(r, key="id"), "normal")
    sizes = r.groupBy(F.col("cty").alias("part")).agg(F.count("*").alias("n"))
    toks = table(blocking.token_table(normal, F.concat("n_core", F.transform("a_core", lambda w: F.concat(F.lit("@"), w)))), "tokens")
    freq = table(blocking.frequencies(toks, sizes), "frequencies")
    w = table(blocking.weighted(toks, blocking.pruned(freq)), "weights")
    pairs = table(blocking.top_forward(blocking.cosines(w), 5).select("s1", "cand", "score", "rank"), "pairs")
    weights = freq.withColumn("tok", F.regexp_replace("tok", "^@", "")).groupBy("part", "tok").agg(F.max("idf").alias("idf"))
    f = features.pair_features(pairs.select("s1", "cand"), features.with_idf(normal, weights))
    union = blocking.union(pairs.withColumn("channel", F.lit("all")), {"all": 5})
    k = r.select("id", "src", "cty", X.squeezed(F.col("name")).alias("n"), X.squeezed(F.col("addr")).alias("a"))
    names = k.groupBy("cty", "n").agg(F.log1p(F.count_if(F.col("src") != "S1").cast("double")).alias("n_pool"), F.log1p(F.count_if(F.col("src") == "S1").cast("double")).alias("n_s1"))
    addrs = k.where("a <> ''").groupBy("cty", "a").agg(F.log1p(F.count("*").cast("double")).alias("a_all"))
    rarity = k.join(names, ["cty", "n"]).join(addrs, ["cty", "a"], "left").select("id", "n_pool", "n_s1", F.coalesce("a_all", F.lit(0.0)).alias("a_all"))
    return features.attach(f, union, {"all": blocking.exact_cosines(pairs, w)}, rarity)


@C.add("pair_features", "s1:i cand:i n_jw:d n_lev:d n_tset:d n_sd:d a_sd:d n_prefix:d legal_eq:i skel_jacc:d num_shared:i post_eq2:i name_in_addr_a:d n_cands:i s_all:d k_all:i cos_all:d n_pool_b:d a_all_b:d n_var_gain:d")
def _(spark, d):
    """All families of pair features; the contract's columns are a selection."""
    return feature_table(spark, d)


#: Word weights as 1 + ln(tf), and the same cosine; the other form of the weights is in tfidf_weights.
@C.add("sublinear_tf", "id:i tok:s w:d", "SELECT id, tok, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM (SELECT t.id, t.tok, (1 + ln(tf)) * (ln((1 + n) / (1 + df)::DOUBLE) + 1) AS w FROM (SELECT p_partkey AS id, unnest(string_split(p_name || ' ' || lower(p_type) || ' ' || p_name, ' ')) AS tok, count(*) AS tf FROM part GROUP BY 1, 2) t JOIN (SELECT tok, count(DISTINCT id) AS df FROM (SELECT p_partkey AS id, unnest(string_split(p_name || ' ' || lower(p_type), ' ')) AS tok FROM part) GROUP BY tok) f ON f.tok = t.tok, (SELECT count(*) AS n FROM part))")
def _(spark, d):
    from pyspark.sql import Window

    p = read(spark, d, "part")
    t = p.select(F.col("p_partkey").alias("id"), F.explode(F.split(F.concat_ws(" ", "p_name", F.lower("p_type"), "p_name"), " ")).alias("tok")).groupBy("id", "tok").agg(F.count("*").alias("tf"))
    df = t.groupBy("tok").agg(F.count("*").alias("df"))
    n = p.agg(F.count("*").alias("n"))
    w = t.join(df, "tok").crossJoin(F.broadcast(n)).withColumn("w", (1 + F.ln("tf")) * X.smooth_idf(F.col("n"), F.col("df")))
    return w.select("id", "tok", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))).alias("w"))


FUSED = f"SELECT s1, cand, y, p AS m1, greatest(1e-6, least(1 - 1e-6, 0.5 * p + 0.2 * y + 0.1)) AS m2 FROM ({CLAIMS})"
METRICS_SQL = """SELECT member, sum(n) AS n, sum(pos) AS pos, sum(pos * (below + (n - pos) / 2)) / (sum(pos) * (sum(n) - sum(pos))) AS auc, sum(pos * tp / upto) / sum(pos) AS ap, sum(-(pos * ln(q) + (n - pos) * ln(1 - q))) / sum(n) AS logloss FROM (SELECT *,
 coalesce(sum(n - pos) OVER (PARTITION BY member ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(pos) OVER (PARTITION BY member ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS tp, sum(n) OVER (PARTITION BY member ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS upto, greatest(1e-7, least(1 - 1e-7, p)) AS q
 FROM (SELECT member, p, sum(y) AS pos, count(*) AS n FROM ({}) GROUP BY member, p)) GROUP BY member"""


@C.add("fusion_metrics", "member:s n:i pos:i auc:d ap:d logloss:d", METRICS_SQL.format(f"SELECT 'm1' AS member, round(m1, 9) AS p, y FROM ({FUSED}) UNION ALL SELECT 'm2', round(m2, 9), y FROM ({FUSED}) UNION ALL SELECT 'mean', round(1 / (1 + exp(-(ln(greatest(1e-6, least(1 - 1e-6, m1)) / (1 - greatest(1e-6, least(1 - 1e-6, m1)))) + ln(m2 / (1 - m2))) / 2)), 9), y FROM ({FUSED})"))
def _(spark, d):
    """Two members' scores and the mean of their logits."""
    from kindred.operators.evaluation import binary_metrics

    c = claims(spark, d).withColumn("m1", F.col("p")).withColumn("m2", X.clip(F.lit(0.5) * F.col("p") + F.lit(0.2) * F.col("y") + F.lit(0.1), 1e-6))
    c = c.withColumn("mean", X.sigmoid((X.logit(F.col("m1")) + X.logit(F.col("m2"))) / 2))
    long = c.selectExpr("y", "stack(3, 'm1', m1, 'm2', m2, 'mean', mean) as (member, q)")
    return binary_metrics(long.withColumn("q", F.round("q", 9)), p="q", by="member")


@C.add("leave_one_out", "held:i n:i pos:i auc:d ap:d logloss:d brier:d")
def _(spark, d):
    """Trained without one group of countries, scored on it; also with half of the unmatched pool gone (held = -1)."""
    from kindred.functions.columns import uniform
    from kindred.operators import collective
    from kindred.operators.evaluation import binary_metrics

    cols = ["p", "rank_in_s1", "gap", "rel", "s1_sum"]
    a = anchors(spark, d).select("s1", F.pmod("cty", F.lit(3)).alias("held"))
    f = collective.within(claims(spark, d)).join(a, "s1").select("s1", "cand", "y", "held", *cols)
    scored, fitted = models.out_of_fold(f, cols, "y", "held", 3, "q", rounds=2, depth=3)
    thin = collective.within(claims(spark, d).where((F.col("y") == 1) | (uniform(F.col("cand"), "thin") < 0.5))).select("s1", "cand", "y", *cols)
    return binary_metrics(scored, p="q", by="held").unionByName(binary_metrics(models.mean_score(fitted, thin, cols, "q"), p="q").withColumn("held", F.lit(-1)))
