"""Queries over scored pairs: ranks, collective features, decisions and their evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions.columns import lit, recalibrate
from kindred.operators import collective, decision, evaluation, ranking
from kindred.plans.contract import Catalogue
from kindred.sources.tables import anchors, claims, read

C = Catalogue()

CLAIMS = """SELECT l_orderkey AS s1, l_partkey AS cand, ((7919 * l_partkey + 104729 * l_orderkey) % 997) / 997.0::DOUBLE AS p,
 max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS y FROM lineitem GROUP BY l_orderkey, l_partkey"""
ANCHORS = f"""SELECT o.o_orderkey AS s1, c.c_nationkey AS cty, coalesce(g.g, 0) AS g FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
 LEFT JOIN (SELECT s1, count(*) AS g FROM ({CLAIMS}) WHERE y = 1 GROUP BY s1) g ON g.s1 = o.o_orderkey"""
#: A closed choice that needs no model: pairs above 0.6, one owner for each record.
CHOSEN = f"""SELECT s1, cand, p FROM (SELECT *, row_number() OVER (PARTITION BY cand ORDER BY p DESC, s1) AS rk FROM ({CLAIMS})) WHERE rk = 1 AND p > 0.6"""
F05 = "CASE WHEN g = 0 THEN CASE WHEN k = 0 THEN 1.0 ELSE 0.0 END WHEN tp = 0 THEN 0.0 ELSE 1.25 * tp / (k + 0.25 * g) END"
SCORED = f"""SELECT *, {F05} AS f FROM (SELECT a.s1, a.cty, coalesce(g.g, 0) AS g, coalesce(c.k, 0) AS k, coalesce(c.tp, 0) AS tp, coalesce(u.seen, 0) AS seen
 FROM ({ANCHORS}) a LEFT JOIN (SELECT s1, count(*) AS g FROM ({CLAIMS}) WHERE y = 1 GROUP BY s1) g ON g.s1 = a.s1
 LEFT JOIN (SELECT h.s1, count(*) AS k, sum(t.y) AS tp FROM ({CHOSEN}) h JOIN ({CLAIMS}) t ON t.s1 = h.s1 AND t.cand = h.cand GROUP BY h.s1) c ON c.s1 = a.s1
 LEFT JOIN (SELECT s1, sum(y) AS seen FROM ({CLAIMS}) WHERE p > 0.3 GROUP BY s1) u ON u.s1 = a.s1)"""


def chosen(spark: SparkSession, d: str) -> DataFrame:
    return decision.exclusivity(claims(spark, d), "hard").where("q > 0.6").select("s1", "cand", "p")


def scored(spark: SparkSession, d: str) -> DataFrame:
    c = claims(spark, d)
    return evaluation.per_anchor(anchors(spark, d), c.where("y = 1"), chosen(spark, d), c.where("p > 0.3"))


@C.add("grouped_rank", "s1:i cand:i p:d rank:i", f"SELECT s1, cand, p, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, cand) AS rank FROM ({CLAIMS})")
def _(spark, d):
    return ranking.grouped_rank(claims(spark, d), "s1", "p", "cand")


@C.add("group_broadcast", "s1:i cand:i g_max:d g_sum:d g_n:i", f"SELECT s1, cand, max(p) OVER w AS g_max, sum(p) OVER w AS g_sum, count(*) OVER w AS g_n FROM ({CLAIMS}) WINDOW w AS (PARTITION BY s1)")
def _(spark, d):
    return ranking.group_broadcast(claims(spark, d), "s1", "p")


@C.add("second_best", "s1:i cand:i second:d", f"SELECT s1, cand, coalesce(max(CASE WHEN r = 2 THEN p END) OVER (PARTITION BY s1), 0) AS second FROM (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, cand) AS r FROM ({CLAIMS}))")
def _(spark, d):
    return ranking.second_best(claims(spark, d), "s1", "p", "cand")


SUMMARY = f"""SELECT s1, coalesce(max(CASE WHEN r = 1 THEN p END), 0) AS top1, coalesce(max(CASE WHEN r = 2 THEN p END), 0) AS top2, coalesce(max(CASE WHEN r = 3 THEN p END), 0) AS top3,
 sum(p) AS mass, sum(-p * ln(greatest(p, 1e-9))) AS entropy, count(*) FILTER (p > 0.3) AS n03, count(*) FILTER (p > 0.5) AS n05, count(*) FILTER (p > 0.7) AS n07,
 count(*) FILTER (p > 0.2 AND p <= 0.8) AS n_gray, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, cand) AS r FROM ({CLAIMS})) GROUP BY s1"""


@C.add("top3_entropy_summary", "s1:i top1:d top2:d top3:d mass:d entropy:d n03:i n05:i n07:i n_gray:i n:i", SUMMARY)
def _(spark, d):
    return ranking.group_summary(claims(spark, d), "s1", "p", "cand")


@C.add("cumulative_tp", "s1:i cand:i rank:i tp:i", f"SELECT s1, cand, row_number() OVER w AS rank, sum(y) OVER (w ROWS UNBOUNDED PRECEDING) AS tp FROM ({CLAIMS}) WINDOW w AS (PARTITION BY s1 ORDER BY p DESC, cand)")
def _(spark, d):
    return ranking.running_true(claims(spark, d), "s1", "p", "y", "cand")


@C.add("topn_per_bucket", "bucket:i s1:i cand:i p:d", f"SELECT least(CAST(floor(p * 10) AS BIGINT), 9) AS bucket, s1, cand, p FROM ({CLAIMS}) QUALIFY row_number() OVER (PARTITION BY least(CAST(floor(p * 10) AS BIGINT), 9) ORDER BY md5(s1 || '|' || cand), s1, cand) <= 50")
def _(spark, d):
    from kindred.functions.columns import bucket

    return ranking.top_per_group(claims(spark, d).withColumn("bucket", bucket(F.col("p"))), "bucket", [F.md5(F.concat_ws("|", "s1", "cand").cast("binary")), F.col("s1"), F.col("cand")], 50)


@C.add("candidate_selection", "s1:i cand:i rank:i", f"SELECT * FROM (SELECT s1, cand, p, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, cand) AS rank FROM ({CLAIMS})) WHERE (rank <= 2 OR p >= 0.7) AND rank <= 4")
def _(spark, d):
    """(rank within the first two or a good score) and within the cap."""
    return ranking.grouped_rank(claims(spark, d), "s1", "p", "cand").where("(rank <= 2 or p >= 0.7D) and rank <= 4")


@C.add("band_filter", "s1:i cand:i p:d", f"SELECT s1, cand, p FROM ({CLAIMS}) WHERE p BETWEEN 0.05 AND 0.95")
def _(spark, d):
    return claims(spark, d).where(F.col("p").between(0.05, 0.95))


@C.add("hard_mask", "s1:i cand:i", f"""SELECT s1, cand FROM (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, cand) AS rank FROM ({CLAIMS}))
 WHERE y = 1 OR rank <= 2 OR ('0x' || substr(md5(s1 || ':' || cand || '|hard'), 1, 8))::BIGINT / 4294967296.0 < 0.35""")
def _(spark, d):
    """True pairs, those of the first ranks and a hash-drawn share of the others."""
    from kindred.operators.sampling import bernoulli

    r = ranking.grouped_rank(claims(spark, d), "s1", "p", "cand")
    return r.where((F.col("y") == 1) | (F.col("rank") <= 2) | bernoulli(F.concat_ws(":", "s1", "cand"), "hard", 0.35))


@C.add("negative_subsample", "s1:i cand:i y:i", f"SELECT s1, cand, y FROM ({CLAIMS}) WHERE y = 1 OR ('0x' || substr(md5(s1 || ':' || cand || '|neg'), 1, 8))::BIGINT / 4294967296.0 < 0.25")
def _(spark, d):
    from kindred.operators.sampling import bernoulli

    return claims(spark, d).where((F.col("y") == 1) | bernoulli(F.concat_ws(":", "s1", "cand"), "neg", 0.25))


@C.add(
    "within_collective",
    "s1:i cand:i rank_in_s1:i gap:d rel:d s1_max:d s1_2nd:d s1_sum:d n_strong:i n_mid:i n_cands:i",
    f"""SELECT *, s1_max - p AS gap, p / greatest(s1_max, 1e-9) AS rel, coalesce(max(CASE WHEN rank_in_s1 = 2 THEN p END) OVER (PARTITION BY s1), 0) AS s1_2nd FROM (SELECT s1, cand, p,
 row_number() OVER (PARTITION BY s1 ORDER BY p DESC, cand) AS rank_in_s1, max(p) OVER w AS s1_max, sum(p) OVER w AS s1_sum, count(*) FILTER (p > 0.5) OVER w AS n_strong,
 count(*) FILTER (p > 0.2) OVER w AS n_mid, count(*) OVER w AS n_cands FROM ({CLAIMS}) WINDOW w AS (PARTITION BY s1))""",
)
def _(spark, d):
    return collective.within(claims(spark, d))


ACROSS = f"""SELECT *, CASE WHEN rank_in_cand = 1 THEN p - cand_2nd ELSE p - cand_max END AS margin, rank_in_cand = 1 AS is_best, rank_in_cand = 1 AND rank_in_s1 = 1 AS reciprocal FROM (SELECT *,
 coalesce(max(CASE WHEN rank_in_cand = 2 THEN p END) OVER (PARTITION BY cand), 0) AS cand_2nd FROM (SELECT *, row_number() OVER (PARTITION BY cand ORDER BY p DESC, s1) AS rank_in_cand,
 row_number() OVER (PARTITION BY s1 ORDER BY p DESC, cand) AS rank_in_s1, count(*) OVER w AS n_claims, sum(p) OVER w AS cand_sum, max(p) OVER w AS cand_max FROM ({CLAIMS}) WINDOW w AS (PARTITION BY cand)))"""


@C.add("across_collective", "s1:i cand:i rank_in_cand:i n_claims:i cand_sum:d cand_max:d margin:d is_best:b reciprocal:b", ACROSS)
def _(spark, d):
    return collective.across(claims(spark, d))


@C.add(
    "sibling_pairs",
    "s1:i cand:i sib_support:d sib_count:i sib_sim:d",
    f"""WITH t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, cand) AS r FROM ({CLAIMS})) WHERE r <= 10),
 e AS (SELECT i.s1, i.cand, max(j.p * s.sim) AS sup, count(*) FILTER (j.p > 0.5 AND s.sim > 0.6) AS cnt, max(s.sim) AS sim FROM t i JOIN t j ON i.s1 = j.s1 AND i.cand <> j.cand
 JOIN (SELECT a.p_partkey AS x, b.p_partkey AS y, (CASE WHEN a.p_brand = b.p_brand THEN 0.5 ELSE 0 END + CASE WHEN a.p_type = b.p_type THEN 0.25 ELSE 0 END + CASE WHEN a.p_size % 5 = b.p_size % 5 THEN 0.25 ELSE 0 END) AS sim
 FROM part a, part b) s ON s.x = i.cand AND s.y = j.cand GROUP BY i.s1, i.cand)
 SELECT c.s1, c.cand, coalesce(sup, 0) AS sib_support, coalesce(cnt, 0) AS sib_count, coalesce(sim, 0) AS sib_sim FROM ({CLAIMS}) c LEFT JOIN e ON e.s1 = c.s1 AND e.cand = c.cand""",
)
def _(spark, d):
    """Likeness of two parts: brand, type and size class; computed for the pairs that meet, not for all."""
    c = claims(spark, d)
    top = ranking.top_per_group(c, "s1", [F.col("p").desc(), F.col("cand")], 10).select("s1", "cand")
    pairs = top.select("s1", F.col("cand").alias("cand_i")).join(top.select("s1", F.col("cand").alias("cand_j")), "s1").where("cand_i <> cand_j").select("cand_i", "cand_j").distinct()
    part = lambda s: read(spark, d, "part").select(F.col("p_partkey").alias(f"cand_{s}"), F.struct("p_brand", "p_type", (F.col("p_size") % 5).alias("z")).alias(f"x{s}"))
    same = lambda c, w: F.when(F.col(f"xi.{c}") == F.col(f"xj.{c}"), lit(w)).otherwise(lit(0))
    sims = pairs.join(part("i"), "cand_i").join(part("j"), "cand_j").select("cand_i", "cand_j", (same("p_brand", 0.5) + same("p_type", 0.25) + same("z", 0.25)).alias("sim"))
    return collective.sibling_support(c, sims)


#: Stand-ins for what other steps know of a pair and of an anchor, from their ids.
KNOWN = """SELECT *, (31 * cand + 17 * s1) % 101 / 101.0::DOUBLE AS n_cos, (57 * cand + 11 * s1) % 89 / 89.0::DOUBLE AS a_cos, (13 * cand + 7 * s1) % 83 / 83.0::DOUBLE AS j_cos, (19 * cand + 5 * s1) % 79 / 79.0::DOUBLE AS n_sd, (23 * cand + 3 * s1) % 73 / 73.0::DOUBLE AS a_sd,
 CASE WHEN (cand + s1) % 5 = 0 THEN 1 ELSE 0 END AS post_eq, CASE WHEN (cand + s1) % 5 = 1 THEN 1 ELSE 0 END AS post_conf, (3 * cand + s1) % 91 / 91.0::DOUBLE AS meta, (5 * cand + 2 * s1) % 95 / 95.0::DOUBLE AS p1, CASE WHEN cand % 3 > 0 THEN (cand % 10 - 5) / 3.0::DOUBLE END AS ce"""


def _known(df: DataFrame) -> DataFrame:
    of = lambda a, b, m: F.pmod(a * F.col("cand") + b * F.col("s1"), F.lit(m)) / lit(m)
    k = F.pmod(F.col("cand") + F.col("s1"), F.lit(5))
    return df.withColumns(
        {
            "n_cos": of(31, 17, 101), "a_cos": of(57, 11, 89), "j_cos": of(13, 7, 83), "n_sd": of(19, 5, 79), "a_sd": of(23, 3, 73), "post_eq": (k == 0).cast("int"), "post_conf": (k == 1).cast("int"),
            "meta": of(3, 1, 91), "p1": of(5, 2, 95), "ce": F.when(F.pmod("cand", F.lit(3)) > 0, (F.pmod("cand", F.lit(10)) - 5) / lit(3)),
        }
    )


_E = "top1 top2 gap mass entropy n03 n05 n07 n max_ncos max_acos max_jcos top1_recip top1_nsd top1_asd top1_post top1_margin".split()


@C.add(
    "entity_feats",
    "s1:i e_s1_ntok_n:d e_s1_ntok_a:d e_s1_has_post:d e_s1_name_freq:d e_s1_name_idf:d " + " ".join(f"e_{c}:d" for c in _E),
    f"""SELECT o_orderkey AS s1, o_orderkey % 7 AS e_s1_ntok_n, o_orderkey % 11 AS e_s1_ntok_a, o_orderkey % 2 AS e_s1_has_post, ln(1 + o_orderkey % 13) AS e_s1_name_freq, o_orderkey % 17 / 17.0::DOUBLE AS e_s1_name_idf, {', '.join(f'coalesce({c}, 0) AS e_{c}' for c in _E)}
 FROM orders LEFT JOIN (SELECT *, top1 - top2 AS gap FROM ({SUMMARY})) s ON s.s1 = o_orderkey LEFT JOIN (SELECT s1, max(n_cos) AS max_ncos, max(a_cos) AS max_acos, max(j_cos) AS max_jcos, {', '.join(f'max(CASE WHEN rank_in_s1 = 1 THEN {x} END) AS top1_{c}' for c, x in (('recip', 'CASE WHEN is_best THEN 1 ELSE 0 END'), ('nsd', 'n_sd'), ('asd', 'a_sd'), ('post', 'post_eq - post_conf'), ('margin', 'margin')))}
 FROM ({KNOWN} FROM ({ACROSS})) GROUP BY s1) t ON t.s1 = o_orderkey""",
)
def _(spark, d):
    k = F.col("s1")
    a = anchors(spark, d).withColumns({"ntok_n": F.pmod(k, F.lit(7)), "ntok_a": F.pmod(k, F.lit(11)), "has_post": F.pmod(k, F.lit(2)), "name_freq": F.log1p(F.pmod(k, F.lit(13)).cast("double")), "name_idf": F.pmod(k, F.lit(17)) / lit(17)})
    return collective.entity_features(a, _known(claims(spark, d)))


_H = {
    "h_top1": "max(CASE WHEN rank_in_s1 = 1 THEN p END)", "h_top2": "max(CASE WHEN rank_in_s1 = 2 THEN p END)", "h_top3": "max(CASE WHEN rank_in_s1 = 3 THEN p END)", "h_sum": "sum(p)", **{f"h_n0{k}": f"count(*) FILTER (p > 0.{k})" for k in (1, 3, 5, 7, 9)},
    "h_ncand": "count(*)", "h_meta_top": "max(CASE WHEN rank_in_s1 = 1 THEN meta END)", "h_meta_max": "max(meta)", "h_p1_top": "max(CASE WHEN rank_in_s1 = 1 THEN p1 END)", "h_rival_top": "max(CASE WHEN rank_in_s1 = 1 THEN p - margin END)",
    "h_rival_n05_top": "max(CASE WHEN rank_in_s1 = 1 THEN strong - CASE WHEN p > 0.5 THEN 1 ELSE 0 END END)", "h_lost05": "count(*) FILTER (p > 0.5 AND p - margin > p)", "h_entropy": "sum(-p * ln(greatest(p, 1e-9)))",
}


@C.add(
    "gate_feats",
    "s1:i " + " ".join(f"{c}:d" for c in _H),
    f"SELECT o_orderkey AS s1, {', '.join(f'coalesce({c}, 0) AS {c}' for c in _H)} FROM orders LEFT JOIN (SELECT s1, {', '.join(f'{x} AS {c}' for c, x in _H.items())} FROM (SELECT *, count(*) FILTER (p > 0.5) OVER (PARTITION BY cand) AS strong FROM ({KNOWN} FROM ({ACROSS}))) GROUP BY s1) h ON h.s1 = o_orderkey",
)
def _(spark, d):
    return collective.gate_features(anchors(spark, d), _known(claims(spark, d)))


_LOGIT = lambda x: f"ln(greatest(1e-6, least(1 - 1e-6, {x})) / (1 - greatest(1e-6, least(1 - 1e-6, {x}))))"


@C.add(
    "stack_feats",
    "s1:i cand:i lp2:d lp1:d meta:d rank_s1:i gap_top:d rel_top:d s1_mass:d s1_strong:i s1_mid:i s1_cnt:i rival_p:d rival_n:i claim_rank:i margin_rival:d ce:d has_ce:i ce_x_lp2:d",
    f"""SELECT s1, cand, {_LOGIT('p')} AS lp2, {_LOGIT('p1')} AS lp1, meta, rank_in_s1 AS rank_s1, s1_max - p AS gap_top, p / greatest(s1_max, 1e-9) AS rel_top, s1_mass, s1_strong, s1_mid, s1_cnt, p - margin AS rival_p, strong - CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS rival_n, rank_in_cand AS claim_rank, margin AS margin_rival,
 ce, CASE WHEN ce IS NOT NULL THEN 1 ELSE 0 END AS has_ce, ce - {_LOGIT('p')} AS ce_x_lp2
 FROM ({KNOWN}, max(p) OVER w AS s1_max, sum(p) OVER w AS s1_mass, count(*) FILTER (p > 0.5) OVER w AS s1_strong, count(*) FILTER (p > 0.2 AND p <= 0.8) OVER w AS s1_mid, count(*) OVER w AS s1_cnt, count(*) FILTER (p > 0.5) OVER (PARTITION BY cand) AS strong FROM ({ACROSS}) WINDOW w AS (PARTITION BY s1))""",
)
def _(spark, d):
    return collective.stack_features(_known(claims(spark, d)), members=("ce",))


@C.add(
    "score_profile",
    "pairs_per_s1:d gray_share:d strong_per_s1:d weak_share:d contested_share:d",
    f"""SELECT sum(n) / count(*) AS pairs_per_s1, sum(gray) / sum(n) AS gray_share, sum(strong) / count(*) AS strong_per_s1, avg(CASE WHEN coalesce(top, 0) < 0.5 THEN 1.0 ELSE 0.0 END) AS weak_share,
 (SELECT count(*) FILTER (k >= 2) / count(*) FROM (SELECT count(*) AS k FROM ({CLAIMS}) WHERE p > 0.5 GROUP BY cand)) AS contested_share
 FROM orders LEFT JOIN (SELECT s1, count(*) AS n, count(*) FILTER (p > 0.05 AND p < 0.95) AS gray, count(*) FILTER (p > 0.5) AS strong, max(p) AS top FROM ({CLAIMS}) GROUP BY s1) ON s1 = o_orderkey""",
)
def _(spark, d):
    return collective.profile(claims(spark, d), anchors(spark, d))


@C.add("decode_matrix", "s1:i slot:i cand:i p:d", f"SELECT s1, slot, cand, p FROM (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, cand) AS slot FROM ({CLAIMS})) WHERE slot <= 15")
def _(spark, d):
    m = decision.decode_matrix(claims(spark, d)).withColumn("k", F.size("slots"))
    return decision.selections(m).withColumnRenamed("q", "p")


#: Expected F0.5 of every k by folding the law of the count up one candidate at a time, in SQL.
VALS = f"""WITH RECURSIVE r AS (SELECT s1, cand, p, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, cand) AS i FROM ({CLAIMS}) WHERE p >= 1e-3 QUALIFY i <= 15),
 l AS (SELECT s1, list(p ORDER BY i) AS ps FROM r GROUP BY s1),
 base AS (SELECT c.s1, coalesce(l.ps, CAST([] AS DOUBLE[])) AS ps FROM (SELECT DISTINCT s1 FROM ({CLAIMS})) c LEFT JOIN l ON l.s1 = c.s1),
 pm(s1, ps, k, i, t, u) AS (SELECT s1, ps, k, 0, [1.0::DOUBLE], [1.0::DOUBLE] FROM base, unnest(range(0, len(ps) + 1)) x(k)
 UNION ALL SELECT s1, ps, k, i + 1, CASE WHEN i < k THEN list_transform(range(1, len(t) + 2), lambda j: coalesce(t[j], 0) * (1 - ps[i + 1]) + CASE WHEN j > 1 THEN t[j - 1] ELSE 0 END * ps[i + 1]) ELSE t END,
 CASE WHEN i >= k THEN list_transform(range(1, len(u) + 2), lambda j: coalesce(u[j], 0) * (1 - ps[i + 1]) + CASE WHEN j > 1 THEN u[j - 1] ELSE 0 END * ps[i + 1]) ELSE u END FROM pm WHERE i < len(ps)),
 v AS (SELECT s1, k, CASE WHEN k = 0 THEN u[1] ELSE list_sum(list_transform(range(1, len(t) + 1), lambda a: t[a] * list_sum(list_transform(range(1, len(u) + 1), lambda b: u[b] * 1.25 * (a - 1) / (k + 0.25 * (a - 1 + b - 1)))))) END AS val FROM pm WHERE i = len(ps))"""


@C.add("expected_f_values", "s1:i k:i val:d", f"{VALS} SELECT s1, k, val FROM v")
def _(spark, d):
    return decision.f_values(decision.decode_matrix(claims(spark, d))).select("s1", F.posexplode("vals").alias("k", "val"))


@C.add("best_k", "s1:i k:i", f"{VALS} SELECT s1, k FROM v QUALIFY row_number() OVER (PARTITION BY s1 ORDER BY round(val, 9) DESC, k) = 1")
def _(spark, d):
    return decision.f_values(decision.decode_matrix(claims(spark, d))).select("s1", decision.best_k(F.col("vals")).alias("k"))


@C.add("gated_best_k", "s1:i k:i", f"{VALS}, h AS (SELECT s1, k, CASE WHEN k = 0 THEN 1 - hh ELSE val * hh / greatest(1 - first_value(val) OVER (PARTITION BY s1 ORDER BY k), 1e-9) END AS val FROM (SELECT *, (s1 % 89) / 89.0::DOUBLE AS hh FROM v)) SELECT s1, k FROM h QUALIFY row_number() OVER (PARTITION BY s1 ORDER BY round(val, 9) DESC, k) = 1")
def _(spark, d):
    """The probability that an anchor has a match at all comes from its id here."""
    v = decision.f_values(decision.decode_matrix(claims(spark, d)))
    return v.select("s1", decision.best_k(decision.gated(F.col("vals"), F.pmod("s1", F.lit(89)) / lit(89))).alias("k"))


THRESHOLD = f"""SELECT s1, CASE WHEN max(CASE WHEN r = 1 THEN p END) >= 0.5 THEN coalesce(min(CASE WHEN r > 1 AND NOT (p >= 0.4 AND p >= 0.7 * top) THEN r END) - 1, max(r)) ELSE 0 END AS k
 FROM (SELECT *, max(p) OVER (PARTITION BY s1) AS top FROM (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, cand) AS r FROM ({CLAIMS})) WHERE r <= 15) GROUP BY s1"""


@C.add("d1_policy", "s1:i k:i", THRESHOLD)
def _(spark, d):
    """Leading extras by a running condition."""
    return decision.decode_matrix(claims(spark, d)).select("s1", decision.threshold_k(F.col("slots"), 0.5, 0.4, 0.7).alias("k"))


@C.add("recalibrate", "s1:i cand:i q:d", f"SELECT s1, cand, CASE WHEN p <= 0 THEN 0 ELSE 1 / (1 + exp(-(1.25 * ln(c / (1 - c)) - 0.1))) END AS q FROM (SELECT *, greatest(1e-7, least(1 - 1e-7, p)) AS c FROM ({CLAIMS}))")
def _(spark, d):
    return claims(spark, d).withColumn("q", recalibrate(F.col("p"), 1.25, -0.1))


@C.add("exclusivity_gamma", "s1:i cand:i q:d", f"SELECT s1, cand, CASE WHEN row_number() OVER (PARTITION BY cand ORDER BY p DESC, s1) = 1 THEN p ELSE 0.6 * p END AS q FROM ({CLAIMS})")
def _(spark, d):
    return decision.soft_exclusivity(claims(spark, d), 0.6)


ODDS = f"SELECT *, sum(o) OVER (PARTITION BY cand) - o AS rivals, row_number() OVER (PARTITION BY cand ORDER BY p DESC, s1) AS rk FROM (SELECT *, least(p, 1 - 1e-6) / (1 - least(p, 1 - 1e-6)) AS o FROM ({CLAIMS}))"
for _mode, _q in {"none": "p", "hard": "CASE WHEN rk = 1 THEN p ELSE 0 END", "joint": "o / (1 + o + greatest(rivals, 0))", "hardjoint": "CASE WHEN rk = 1 THEN o / (1 + o + greatest(rivals, 0)) ELSE 0 END"}.items():

    @C.add(f"exclusivity_{_mode}", "s1:i cand:i q:d", f"SELECT s1, cand, {_q} AS q FROM ({ODDS})")
    def _(spark, d, mode=_mode):
        return decision.exclusivity(claims(spark, d), mode)


@C.add("one_owner", "s1:i cand:i p:d", f"SELECT s1, cand, p FROM ({CLAIMS}) QUALIFY row_number() OVER (PARTITION BY cand ORDER BY p DESC, s1) = 1")
def _(spark, d):
    return decision.one_owner(claims(spark, d), "p")


HARD = f"(SELECT s1, cand, CASE WHEN rk = 1 THEN CASE WHEN p <= 0 THEN 0 ELSE 1 / (1 + exp(-(1.25 * ln(c / (1 - c))))) END ELSE 0 END AS p FROM (SELECT *, greatest(1e-7, least(1 - 1e-7, p)) AS c, row_number() OVER (PARTITION BY cand ORDER BY p DESC, s1) AS rk FROM ({CLAIMS})))"


@C.add("policy_run", "s1:i cand:i q:d", f"{VALS.replace(f'({CLAIMS})', HARD)}, b AS (SELECT s1, k FROM v QUALIFY row_number() OVER (PARTITION BY s1 ORDER BY round(val, 9) DESC, k) = 1) SELECT r.s1, r.cand, r.p AS q FROM r JOIN b ON b.s1 = r.s1 AND r.i <= b.k QUALIFY row_number() OVER (PARTITION BY r.cand ORDER BY r.p DESC, r.s1) = 1")
def _(spark, d):
    return decision.run_policy(claims(spark, d), "hard", 1.25, 0.0)


def _evaluated(spark: SparkSession, d: str) -> DataFrame:
    """(t1, t2, r, fold, f) of every policy and anchor."""
    rows = [(t1, t2, r) for t1 in (0.3, 0.5, 0.7) for t2 in (0.4, 0.6) for r in (0.5, 0.8)]
    policies = spark.createDataFrame(rows, "t1 double, t2 double, r double")
    c = claims(spark, d)
    m = decision.decode_matrix(c)
    y = c.groupBy("s1").agg(F.collect_set(F.when(F.col("y") == 1, F.col("cand"))).alias("true"))
    base = anchors(spark, d).select("s1", "g").join(m, "s1", "left").join(y, "s1", "left")
    top = F.coalesce(F.get("slots", F.lit(0))["p"], lit(0))
    grid = decision.grid(base, policies).withColumn("good", F.transform(F.slice("slots", 2, 15), lambda x: (x["p"] >= F.col("t2")) & (x["p"] >= F.col("r") * top)))
    lead = F.when(F.array_position("good", False) > 0, F.array_position("good", False) - 1).otherwise(F.size("good"))
    grid = grid.withColumn("k", F.when(top >= F.col("t1"), 1 + F.greatest(lead, F.lit(0))).otherwise(F.lit(0)).cast("int"))
    grid = grid.withColumn("tp", F.coalesce(F.size(F.array_intersect(F.transform(F.slice("slots", 1, F.col("k")), lambda x: x["cand"]), "true")), F.lit(0)))
    from kindred.functions.columns import f_beta

    return grid.select("t1", "t2", "r", F.pmod("s1", F.lit(5)).alias("fold"), f_beta(F.greatest("tp", F.lit(0)), F.greatest("k", F.lit(0)), F.col("g")).alias("f"))


GRID = f"""SELECT t1, t2, r, s1 % 5 AS fold, {F05} AS f FROM (SELECT a.s1, a.g, t1, t2, r, CASE WHEN coalesce(top, 0) >= t1 THEN kk ELSE 0 END AS k, (SELECT 0) AS z,
 CASE WHEN coalesce(top, 0) >= t1 THEN coalesce(list_sum(ys[1:kk]), 0) ELSE 0 END AS tp FROM (SELECT *, CASE WHEN len(bad) > 0 THEN bad[1] ELSE len(ps) END AS kk
 FROM (SELECT *, list_filter(range(1, len(ps)), lambda i: NOT (ps[i + 1] >= t2 AND ps[i + 1] >= r * top)) AS bad FROM (SELECT b.*, l.ps, l.ys, l.ps[1] AS top, t1, t2, r FROM ({ANCHORS}) b
 LEFT JOIN (SELECT s1, list(p ORDER BY p DESC, cand)[1:15] AS ps, list(y ORDER BY p DESC, cand)[1:15] AS ys FROM ({CLAIMS}) GROUP BY s1) l ON l.s1 = b.s1,
 (VALUES (0.3::DOUBLE), (0.5::DOUBLE), (0.7::DOUBLE)) x(t1), (VALUES (0.4::DOUBLE), (0.6::DOUBLE)) y(t2), (VALUES (0.5::DOUBLE), (0.8::DOUBLE)) w(r)))) a)"""


@C.add("grid_eval", "t1:d t2:d r:d fold:i n:i f:d", f"SELECT t1, t2, r, fold, count(*) AS n, sum(f) AS f FROM ({GRID}) GROUP BY t1, t2, r, fold")
def _(spark, d):
    return _evaluated(spark, d).groupBy("t1", "t2", "r", "fold").agg(F.count("*").alias("n"), F.sum("f").alias("f"))


@C.add(
    "nested_cv",
    "fold:i t1:d t2:d r:d f:d",
    f"""WITH s AS (SELECT t1, t2, r, fold, sum(f) AS f, count(*) AS n FROM ({GRID}) GROUP BY t1, t2, r, fold), o AS (SELECT *, (sum(f) OVER w - f) / (sum(n) OVER w - n) AS rest FROM s WINDOW w AS (PARTITION BY t1, t2, r))
 SELECT fold, t1, t2, r, f / n AS f FROM o QUALIFY row_number() OVER (PARTITION BY fold ORDER BY round(rest, 9) DESC, t1, t2, r) = 1""",
)
def _(spark, d):
    """For each fold the policy that is best on the others, and what it scores on this one."""
    from pyspark.sql import Window

    s = _evaluated(spark, d).groupBy("t1", "t2", "r", "fold").agg(F.count("*").alias("n"), F.sum("f").alias("f"))
    w = Window.partitionBy("t1", "t2", "r")
    s = s.withColumn("rest", (F.sum("f").over(w) - F.col("f")) / (F.sum("n").over(w) - F.col("n")))
    return ranking.top_per_group(s, "fold", [F.round("rest", 9).desc(), F.col("t1"), F.col("t2"), F.col("r")], 1).withColumn("f", F.col("f") / F.col("n"))


@C.add("logit_shift", "s1:i cand:i q:d", f"SELECT s1, cand, CASE WHEN p <= 0 THEN 0 ELSE 1 / (1 + exp(-(ln(c / (1 - c)) + CASE WHEN cty = 3 THEN 0.25 WHEN cty = 7 THEN -0.4 ELSE 0.1 END))) END AS q FROM (SELECT c.*, a.cty, greatest(1e-7, least(1 - 1e-7, p)) AS c FROM ({CLAIMS}) c JOIN ({ANCHORS}) a ON a.s1 = c.s1)")
def _(spark, d):
    a = anchors(spark, d).select("s1", F.col("cty").cast("string").alias("cty"))
    return decision.shift_logits(claims(spark, d).join(a, "s1"), {"3": 0.25, "7": -0.4}, everywhere=0.1)


@C.add("entity_f05", "s1:i cty:i g:i k:i tp:i f:d", SCORED)
def _(spark, d):
    return scored(spark, d)


BUCKET = "CASE WHEN f = 1 THEN 'none' WHEN g = 0 AND k > 0 THEN 'singleton_merge' WHEN k = 0 AND seen = 0 THEN 'missed_blocking' WHEN k = 0 THEN 'missed_model' WHEN tp = 0 THEN 'wrong_pick' WHEN k > tp THEN 'extra_fp' ELSE 'extra_missed' END"


@C.add("error_budget", "bucket:s n:i loss:d", f"SELECT {BUCKET} AS bucket, count(*) AS n, sum(1 - f) / (SELECT count(*) FROM orders) AS loss FROM ({SCORED}) GROUP BY 1")
def _(spark, d):
    return evaluation.error_budget(scored(spark, d))


@C.add(
    "evaluate_breakdown",
    "cty:i m:i level:i n:i f05:d precision:d recall:d singleton_accuracy:d nonempty:d",
    f"""SELECT cty, m, grouping(cty, m) AS level, count(*) AS n, avg(f) AS f05, avg(CASE WHEN k > 0 THEN tp / k END) AS precision, avg(CASE WHEN g > 0 THEN tp / g END) AS recall,
 avg(CASE WHEN g = 0 THEN CASE WHEN k = 0 THEN 1.0 ELSE 0.0 END END) AS singleton_accuracy, avg(CASE WHEN k > 0 THEN 1.0 ELSE 0.0 END) AS nonempty FROM (SELECT *, least(g, 3) AS m FROM ({SCORED})) GROUP BY GROUPING SETS ((), (cty), (m))""",
)
def _(spark, d):
    return evaluation.breakdown(scored(spark, d))


@C.add(
    "blocking_kpis",
    "pc:d entity_completeness:d reduction:d pq:d mean_candidates:d p95_candidates:d max_candidates:i",
    f"""SELECT sum(found) / sum(g) AS pc, avg(CASE WHEN g > 0 THEN CASE WHEN found = g THEN 1.0 ELSE 0.0 END END) AS entity_completeness, 1 - sum(n) / (count(*) * (SELECT count(*) FROM part)::DOUBLE) AS reduction, sum(found) / sum(n) AS pq,
 avg(n) AS mean_candidates, quantile_cont(n, 0.95) AS p95_candidates, max(n) AS max_candidates FROM (SELECT a.s1, a.g, coalesce(u.n, 0) AS n, coalesce(u.found, 0) AS found FROM ({ANCHORS}) a
 LEFT JOIN (SELECT s1, count(*) AS n, sum(y) AS found FROM ({CLAIMS}) WHERE p > 0.3 GROUP BY s1) u ON u.s1 = a.s1)""",
)
def _(spark, d):
    c = claims(spark, d)
    return evaluation.blocking_kpis(anchors(spark, d), c.where("y = 1"), c.where("p > 0.3"), read(spark, d, "part").count())


CHANNELS = f"SELECT s1, cand, y, 'strong' AS channel FROM ({CLAIMS}) WHERE p > 0.7 UNION ALL SELECT s1, cand, y, 'even' FROM ({CLAIMS}) WHERE cand % 2 = 0 UNION ALL SELECT s1, cand, y, 'near' FROM ({CLAIMS}) WHERE abs(s1 % 100 - cand % 100) < 30"


@C.add("channel_audit", "channel:s found:i alone:i", f"SELECT channel, count(*) AS found, count(*) FILTER (n = 1) AS alone FROM (SELECT *, count(*) OVER (PARTITION BY s1, cand) AS n FROM ({CHANNELS}) WHERE y = 1) GROUP BY channel")
def _(spark, d):
    """Three stand-in channels over the same pairs."""
    c = claims(spark, d)
    at = lambda cond, name: c.where(cond).select("s1", "cand", F.lit(name).alias("channel"))
    hits = at("p > 0.7", "strong").unionByName(at("cand % 2 = 0", "even")).unionByName(at("abs(s1 % 100 - cand % 100) < 30", "near"))
    return evaluation.channel_audit(hits, c.where("y = 1"))


@C.add("recall_at_cap", "cap:i recall:d", f"WITH r AS (SELECT y, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, cand) AS rank FROM ({CLAIMS})) SELECT cap, count(*) FILTER (cap IS NULL OR rank <= cap) / count(*) AS recall FROM r, (VALUES (1), (2), (4), (NULL)) c(cap) WHERE y = 1 GROUP BY cap")
def _(spark, d):
    c = claims(spark, d)
    return evaluation.recall_at(ranking.grouped_rank(c, "s1", "p", "cand"), c.where("y = 1"), [1, 2, 4])


@C.add("error_tree", "f05:d no_fp:d all_candidates:d all_gold:d too_few:i right_count:i too_many:i", f"""SELECT avg(f) AS f05, avg(CASE WHEN g = 0 THEN CASE WHEN tp = 0 THEN 1.0 ELSE 0.0 END WHEN tp = 0 THEN 0 ELSE 1.25 * tp / (tp + 0.25 * g) END) AS no_fp,
 avg(CASE WHEN g = 0 THEN CASE WHEN seen + k - tp = 0 THEN 1.0 ELSE 0.0 END WHEN seen = 0 THEN 0 ELSE 1.25 * seen / (seen + k - tp + 0.25 * g) END) AS all_candidates,
 avg(CASE WHEN g = 0 THEN CASE WHEN g + k - tp = 0 THEN 1.0 ELSE 0.0 END ELSE 1.25 * g / (g + k - tp + 0.25 * g) END) AS all_gold, count(*) FILTER (k < g) AS too_few, count(*) FILTER (k = g) AS right_count, count(*) FILTER (k > g) AS too_many FROM ({SCORED})""")
def _(spark, d):
    return evaluation.counterfactuals(scored(spark, d))


TOPS = ", ".join(f"count(*) FILTER (least(CAST(floor(top1 * 10) AS BIGINT), 9) = {i}) AS top_{i}" for i in range(10))


@C.add("dashboard", "cty:i n:i no_candidate:d empty:d mean_chosen:d " + " ".join(f"top_{i}:i" for i in range(10)), f"SELECT cty, count(*) AS n, avg(CASE WHEN top1 IS NULL THEN 1.0 ELSE 0.0 END) AS no_candidate, avg(CASE WHEN k = 0 THEN 1.0 ELSE 0.0 END) AS empty, avg(k) AS mean_chosen, {TOPS} FROM ({SCORED}) s LEFT JOIN (SELECT s1 AS t, max(p) AS top1 FROM ({CLAIMS}) GROUP BY s1) ON t = s1 GROUP BY cty")
def _(spark, d):
    tops = claims(spark, d).groupBy("s1").agg(F.max("p").alias("top1"))
    return evaluation.dashboard(scored(spark, d), tops)


@C.add("error_samples", "bucket:s s1:i f:d order_status:s total:d", f"SELECT bucket, s1, f, o_orderstatus AS order_status, o_totalprice AS total FROM (SELECT *, {BUCKET} AS bucket FROM ({SCORED})) JOIN orders ON o_orderkey = s1 WHERE bucket <> 'none' QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY 1 - f DESC, md5(s1::VARCHAR), s1) <= 50")
def _(spark, d):
    """The worst fifty of each kind of loss (a report), with the order's own columns."""
    s = scored(spark, d).withColumn("bucket", evaluation.error_bucket(*(F.col(c) for c in ("f", "g", "k", "tp", "seen")))).where("bucket <> 'none'")
    s = ranking.top_per_group(s, "bucket", [(1 - F.col("f")).desc(), F.md5(F.col("s1").cast("string").cast("binary")), F.col("s1")], 50)
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("s1"), F.col("o_orderstatus").alias("order_status"), F.col("o_totalprice").alias("total"))
    return s.join(o, "s1")


@C.add("binary_metrics", "cty:i n:i pos:i auc:d ap:d logloss:d brier:d", f"""WITH d AS (SELECT a.cty, c.p, c.y FROM ({CLAIMS}) c JOIN ({ANCHORS}) a ON a.s1 = c.s1), s AS (SELECT cty, p, sum(y) AS pos, count(*) AS n FROM d GROUP BY cty, p),
 w AS (SELECT *, coalesce(sum(n - pos) OVER (PARTITION BY cty ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(pos) OVER (PARTITION BY cty ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS tp, sum(n) OVER (PARTITION BY cty ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS upto, greatest(1e-7, least(1 - 1e-7, p)) AS q FROM s)
 SELECT cty, sum(n) AS n, sum(pos) AS pos, sum(pos * (below + (n - pos) / 2)) / (sum(pos) * (sum(n) - sum(pos))) AS auc, sum(pos * tp / upto) / sum(pos) AS ap, sum(-(pos * ln(q) + (n - pos) * ln(1 - q))) / sum(n) AS logloss, sum(pos * (1 - p) * (1 - p) + (n - pos) * p * p) / sum(n) AS brier FROM w GROUP BY cty""")
def _(spark, d):
    return evaluation.binary_metrics(claims(spark, d).join(anchors(spark, d).select("s1", "cty"), "s1"), by="cty")


@C.add("calibration_table", "bin:i n:i mean_p:d rate:d gap:d", f"SELECT *, abs(mean_p - rate) AS gap FROM (SELECT least(CAST(floor(p * 10) AS BIGINT), 9) AS bin, count(*) AS n, avg(p) AS mean_p, avg(y) AS rate FROM ({CLAIMS}) GROUP BY 1)")
def _(spark, d):
    return evaluation.calibration_table(claims(spark, d))
