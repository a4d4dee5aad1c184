"""Queries over all blocking channels, on records made of ``pages``: a host's labels are a name, the path an address."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions import normalize as N
from kindred.operators import channels
from kindred.plans.contract import Catalogue
from kindred.plans.features import web_records
from kindred.plans.texts import BI, NOT_NUM, PRE, SKEL_T, nums_sql, once_sql
from kindred.sources.shared import table

C = Catalogue()

WEB = f"""SELECT page_id AS doc_id, CASE WHEN page_id % 5 = 0 THEN 'S1' WHEN page_id % 5 <= 2 THEN 'S2' ELSE 'S3' END AS src, coalesce(x[4], '') AS cty, {N.tokens_sql(N.fold_latin_sql("translate(coalesce(x[3], ''), '.-', '  ')"))} AS nt,
 {N.tokens_sql(N.steps_sql(N.fold_latin_sql("regexp_replace(array_to_string(x[4:], ', '), '[?&=#]', ', ', 'g')"), N.ADDRESS_STEPS))} AS adt FROM (SELECT page_id, string_split(url, '/') AS x FROM pages)"""
_w = "list_filter(nt, lambda w: NOT regexp_matches(w, '^[0-9]+$'))"
_ini = f"array_to_string(list_transform({_w}, lambda x: substr(x, 1, 1)), '')"
_z = f"coalesce(({_w})[len({_w})], '')"
_keys = f"list_filter(['d_' || array_to_string({_w}, ''), 's_' || array_to_string(list_sort({_w}), '_'), 'd_' || substr({_ini}, 1, 2), 'd_' || substr({_ini}, 1, greatest(length({_ini}) - 1, 0)) || {_z}, 'd_' || array_to_string(({_w})[2:], ''), 'd_' || array_to_string(({_w})[1:2], ''), 'd_' || substr({_ini}, 1, 3), 'd_' || {_ini}], lambda x: length(x) >= 4)"
_grams = lambda t, n: f"list_filter(flatten(list_transform({t}, lambda w: list_transform(range(1, greatest(length(w) + 2 - {n - 1}, 1) + 1), lambda i: substr(' ' || w || ' ', i, {n})))), lambda x: length(x) = {n})"
_nums = once_sql(nums_sql("adt"))
_far = once_sql(f"list_filter(adt, lambda w: length(w) >= 3{NOT_NUM})")
TOKENS = {
    "keys": once_sql(_keys),
    "name": f"list_concat(nt, {SKEL_T('nt')}, {PRE('nt')}, {BI('nt')})",
    "skel": f"list_transform(nt, lambda w: {N.skeleton_sql('w')})",
    "addr": f"list_concat(adt, {PRE('adt', NOT_NUM)}, {BI('adt')})",
    "joint": "list_concat(nt, list_transform(adt, lambda w: '@' || w))",
    "house": f"flatten(list_transform(({_nums})[1:2], lambda x: list_transform(({_far})[greatest(len({_far}) - 7, 1):], lambda y: x || '#' || y)))",
    "name_chars": f"list_concat({_grams('nt', 3)}, {_grams('nt', 4)})",
    "addr_chars": f"list_concat({_grams('adt', 3)}, {_grams('adt', 4)})",
}


def _weights_sql(key: str) -> str:
    t = f"SELECT cty AS part, CASE WHEN src = 'S1' THEN 0 ELSE 1 END AS side, doc_id AS id, unnest({TOKENS[key]}) AS tok FROM web"
    f = f"SELECT f.part, tok, ln((1 + n) / (1 + df)::DOUBLE) + 1 AS idf FROM (SELECT part, tok, count(DISTINCT id) AS df FROM ({t}) GROUP BY part, tok) f JOIN (SELECT cty AS part, count(*) AS n FROM web GROUP BY cty) s ON s.part = f.part WHERE df <= greatest(25, least(n * 0.02, 3000))"
    return f"SELECT part, side, id, tok, w / sqrt(sum(w * w) OVER (PARTITION BY part, side, id)) AS w FROM (SELECT t.part, side, id, t.tok, ln(1 + tf) * idf AS w FROM (SELECT part, side, id, tok, count(*) AS tf FROM ({t}) GROUP BY ALL) t JOIN ({f}) f ON f.part = t.part AND f.tok = t.tok)"


def _channel_sql(name: str) -> str:
    c = channels.CHANNELS[name]
    by, tie = ("cand", "s1") if c.back else ("s1", "cand")
    s = f"SELECT * FROM sc_{c.tokens}" + (" WHERE cand IN (SELECT doc_id FROM web WHERE len(adt) = 0)" if c.bare else "")
    return f"SELECT s1, cand, '{name}' AS channel, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, {tie}) AS rank FROM ({s})) WHERE rank <= {c.depth}"


_score = lambda key: f"SELECT * FROM (SELECT a.part, a.id AS s1, b.id AS cand, round(sum(a.w * b.w), 9) AS score FROM wt_{key} a JOIN wt_{key} b ON a.part = b.part AND a.tok = b.tok AND a.side = 0 AND b.side = 1 GROUP BY ALL) WHERE score > 1e-9"
_used = list(dict.fromkeys(c.tokens for c in channels.CHANNELS.values()))
_with = f"WITH web AS MATERIALIZED ({WEB}), " + ", ".join(f"wt_{k} AS MATERIALIZED ({_weights_sql(k)})" for k in TOKENS) + ", " + ", ".join(f"sc_{k} AS MATERIALIZED ({_score(k)})" for k in _used)
_hits = " UNION ALL ".join(_channel_sql(c) for c in channels.CHANNELS)
_cols = ", ".join(f"coalesce(max(score) FILTER (channel = '{c}'), 0) AS s_{c}, coalesce(min(rank) FILTER (channel = '{c}'), {x.depth + 1}) AS k_{c}" for c, x in channels.CHANNELS.items())


def _records(spark: SparkSession, d: str) -> DataFrame:
    r = web_records(spark, d).select("doc_id", "src", "cty", N.tokens(N.fold_latin(F.col("name"))).alias("nt"), N.tokens(N.clean_address(F.col("addr"))).alias("at"), N.postal(F.col("addr")).alias("codes"))
    return table(r, "web")


def _union(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame | dict[str, DataFrame], DataFrame]:
    r = _records(spark, d)
    w = channels.weight_tables(r)
    found = channels.hits(w, r.where(F.size("at") == 0).select(F.col("doc_id").alias("cand")))
    return table(channels.union(found), "union"), w, r


@C.add("channel_union", "s1:i cand:i " + " ".join(f"s_{c}:d k_{c}:i" for c in channels.CHANNELS) + " n_ch:i", f"{_with}, h AS ({_hits}) SELECT s1, cand, {_cols}, count(DISTINCT channel) AS n_ch FROM h GROUP BY s1, cand")
def _(spark, d):
    """All nine channels, one row for each pair."""
    return _union(spark, d)[0]


_cosine = lambda name, key: f"(SELECT coalesce(sum(a.w * b.w), 0) FROM wt_{key} a JOIN wt_{key} b ON a.tok = b.tok WHERE a.id = u.s1 AND a.side = 0 AND b.id = u.cand AND b.side = 1) AS {name}"


@C.add("channel_cosines", "s1:i cand:i " + " ".join(f"{c}:d" for c in channels.COSINES), f"{_with}, h AS ({_hits}), u AS (SELECT DISTINCT s1, cand FROM h) SELECT s1, cand, " + ", ".join(_cosine(n, k) for n, k in channels.COSINES.items()) + " FROM u")
def _(spark, d):
    """Six exact cosines of every pair that any channel found."""
    u, w, _ = _union(spark, d)
    return channels.with_cosines(u.select("s1", "cand"), w)


@C.add("meta_blocking", "s1:i cand:i meta:d")
def _(spark, d):
    """The meta-blocker out of fold, and the candidates it lets pass; pages whose paths end alike count as true pairs here."""
    u, w, r = _union(spark, d)
    p = channels.with_postal(channels.with_cosines(u, w), r.select(F.col("doc_id").alias("id"), "codes"))
    end = lambda k, to: r.select(F.col("doc_id").alias(k), F.element_at(F.concat(F.array(F.lit("")), "at"), -1).alias(to))
    p = p.join(end("s1", "x"), "s1").join(end("cand", "z"), "cand").withColumn("y", (F.col("x") == F.col("z")).cast("int")).drop("x", "z").withColumn("fold", F.pmod(F.xxhash64("s1"), F.lit(3)))
    scored, _ = channels.meta_scores(p, "y", "fold", 3, rounds=5, depth=3)
    return channels.meta_select(table(scored, "meta"), 3, 20, 0.95)
