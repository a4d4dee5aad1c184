"""Queries over relations: readers and writers, joins of pairs, aggregates, samples and folds, models."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from kindred.functions import columns as X
from kindred.operators import aggregates, calibration, collective, evaluation, holdout, lexicon, models, ranking, sampling
from kindred.plans.contract import Catalogue
from kindred.plans.decisions import ANCHORS, CHANNELS, CLAIMS, chosen
from kindred.plans.texts import FORWARD, REC, TOK, best
from kindred.sources import files
from kindred.sources.shared import table
from kindred.sources.tables import anchors, claims, read, records

C = Catalogue()

# ---- sources and sinks


@C.add("tsv_tolerant_fold", "conv_id:i turn:i a:s b:s c:s d:s", "SELECT conv_id, turn, f[1] AS a, coalesce(f[2], '') AS b, coalesce(array_to_string(f[3:greatest(len(f) - 1, 3)], chr(9)), '') AS c, CASE WHEN len(f) >= 4 THEN f[len(f)] ELSE '' END AS d FROM (SELECT conv_id, turn, string_split(replace(replace(text, ' ', chr(9)), chr(10), '/'), chr(9)) AS f FROM conversations WHERE trim(replace(text, chr(10), '/')) <> '')")
def _(spark, d):
    """Turns with a tab for every space: too many fields for four columns, or too few."""
    lines = read(spark, d, "conversations").select("conv_id", "turn", F.translate("text", " \n", "\t/").alias("value"))
    return files.tolerant(lines, ("a", "b", "c", "d"))


@C.add("gold_explode", "s1:s cand:s", "SELECT DISTINCT o_orderkey::VARCHAR AS s1, trim(x) AS cand FROM (SELECT o_orderkey, unnest(string_split(o_orderkey || ', ' || o_custkey || ', ,' || o_orderpriority, ',')) AS x FROM orders) WHERE trim(x) <> ''")
def _(spark, d):
    o = read(spark, d, "orders")
    lists = o.select(F.col("o_orderkey").cast("string").alias("source1_entity_id"), F.concat(F.col("o_orderkey").cast("string"), F.lit(", "), F.col("o_custkey").cast("string"), F.lit(", ,"), "o_orderpriority").alias("matched_entity_ids"))
    return files.explode_gold(lists)


@C.add("source_dedup_keep_first", "entity_id:s name:s", f"SELECT entity_id, name FROM (SELECT trim(name) AS entity_id, text AS name, row_number() OVER (PARTITION BY trim(name) ORDER BY doc_id) AS r FROM ({REC}) WHERE trim(name) <> '') WHERE r = 1")
def _(spark, d):
    """Records whose id is their name's line: copies share it."""
    r = records(spark, d).select(F.col("name").alias("entity_id"), F.col("text").alias("name"), "doc_id")
    return files.dedup_source(r, "doc_id")


@C.add("split_union_semi", "s1:i cand:i", f"SELECT s1, cand FROM ({CLAIMS}) WHERE y = 1 AND cand % 7 <> 0")
def _(spark, d):
    """Orders are anchors and returned parts their gold; the parts divisible by 7 are in neither source, so their pairs leave with the
    semi-join to the pool."""
    p = read(spark, d, "part").select(F.col("p_partkey").alias("entity_id"))
    part = lambda a, b: p.where(F.pmod("entity_id", F.lit(7)).between(a, b))
    s1 = read(spark, d, "orders").select(F.col("o_orderkey").alias("entity_id"))
    return files.load_split(s1, part(1, 3), part(4, 6), claims(spark, d).where("y = 1").select("s1", "cand"))[2]


@C.add("partition_scan", "cty:s n:i chars:i", f"SELECT cty, count(*) AS n, sum(length(text)) AS chars FROM ({REC}) GROUP BY cty")
def _(spark, d):
    """What partitions there are, and what is in each."""
    return records(spark, d).groupBy("cty").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@C.add("id_only_scan", "src:s n:i least:i most:i", f"SELECT src, count(*) AS n, min(doc_id) AS least, max(doc_id) AS most FROM ({REC}) GROUP BY src")
def _(spark, d):
    """Reads the id column only."""
    return records(spark, d).select("src", "doc_id").groupBy("src").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))


@C.add("id_list_writer", "s1:i ids:s", f"SELECT o_orderkey AS s1, coalesce(ids, '') AS ids FROM orders LEFT JOIN (SELECT s1, string_agg(cand::VARCHAR, ',' ORDER BY p DESC, cand) AS ids FROM ({CLAIMS}) WHERE p > 0.6 GROUP BY s1) ON s1 = o_orderkey")
def _(spark, d):
    return files.id_lists(anchors(spark, d), claims(spark, d).where("p > 0.6D"), [-F.col("p")], "ids")


@C.add("candidate_list_writer", "s1:i ids:s", f"SELECT s1, string_agg(cand::VARCHAR, ',' ORDER BY score DESC, cand) AS ids FROM ({FORWARD(TOK, 5)}) GROUP BY s1")
def _(spark, d):
    p = table(best(spark, d, 5), "best")
    return files.id_lists(p.select("s1").distinct(), p, [-F.col("score")], "ids")


LISTS = "SELECT o_orderkey AS s1, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey || ',' || o_custkey WHEN o_orderkey % 3 = 1 THEN o_custkey || ',x' ELSE '' END AS ids FROM orders WHERE o_orderkey % 7 <> 0 UNION ALL SELECT o_orderkey, '' FROM orders WHERE o_orderkey % 11 = 0 UNION ALL SELECT -1, ''"


@C.add(
    "output_check_violations",
    "problem:s s1:s id:s",
    f"""WITH l AS ({LISTS}), e AS (SELECT s1, unnest(list_filter(string_split(ids, ','), lambda x: x <> '')) AS id FROM l)
 SELECT 'repeated anchor' AS problem, s1::VARCHAR AS s1, NULL AS id FROM l GROUP BY s1 HAVING count(*) > 1 UNION ALL SELECT 'missing anchor', o_orderkey::VARCHAR, NULL FROM orders WHERE o_orderkey NOT IN (SELECT s1 FROM l)
 UNION ALL SELECT 'unknown anchor', s1::VARCHAR, NULL FROM l WHERE s1 NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'repeated id', s1::VARCHAR, id FROM e GROUP BY s1, id HAVING count(*) > 1
 UNION ALL SELECT 'not in the pool', s1::VARCHAR, id FROM e WHERE id NOT IN (SELECT c_custkey::VARCHAR FROM customer) UNION ALL SELECT 'no candidate', s1::VARCHAR, id FROM e WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = s1 AND o_custkey::VARCHAR = id AND o_orderstatus <> 'F')""",
)
def _(spark, d):
    """Lists with every kind of fault, made of the orders."""
    o = read(spark, d, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    ids = F.when(k % 3 == 0, F.concat(c, F.lit(","), c)).when(k % 3 == 1, F.concat(c, F.lit(",x"))).otherwise(F.lit(""))
    lists = o.where(k % 7 != 0).select(k.alias("s1"), ids.alias("ids"))
    lists = lists.unionByName(o.where(k % 11 == 0).select(k.alias("s1"), F.lit("").alias("ids"))).unionByName(spark.createDataFrame([(-1, "")], "s1 bigint, ids string"))
    return files.check_lists(lists, o.select(k.alias("s1")), read(spark, d, "customer").select(F.col("c_custkey").alias("id")), o.where("o_orderstatus <> 'F'").select(k.alias("s1"), F.col("o_custkey").alias("cand")), "ids")


@C.add("pair_export", "s1:i cand:i p:d", f"SELECT s1, cand, p FROM ({CLAIMS}) c WHERE p BETWEEN 0.002 AND 0.998 AND NOT EXISTS (SELECT 1 FROM ({CLAIMS}) x WHERE x.s1 = c.s1 AND x.cand = c.cand AND x.y = 1)")
def _(spark, d):
    """Pairs of the uncertain band that an earlier export (here: the true ones) lacks."""
    c = claims(spark, d)
    return files.export_pairs(c, read(spark, d, "part").select(F.col("p_partkey").alias("id")), c.where("y = 1"), 0.002, 0.998)[0]


# ---- joins of pairs


@C.add("label_pairs", "s1:i cand:i label:b", f"SELECT c.s1, c.cand, g.cand IS NOT NULL AS label FROM ({CLAIMS}) c LEFT JOIN (SELECT DISTINCT l_orderkey, l_partkey AS cand FROM lineitem WHERE l_quantity > 25) g ON g.l_orderkey = c.s1 AND g.cand = c.cand")
def _(spark, d):
    g = read(spark, d, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("s1"), F.col("l_partkey").alias("cand"), F.lit(True).alias("label")).distinct()
    return claims(spark, d).join(g, ["s1", "cand"], "left").select("s1", "cand", F.coalesce("label", F.lit(False)).alias("label"))


for _kind, _not in (("left_semi", ""), ("left_anti", "NOT ")):

    @C.add(f"label_pairs_{_kind[5:]}", "s1:i cand:i", f"SELECT s1, cand FROM ({CLAIMS}) c WHERE {_not}EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = c.s1 AND l.l_partkey = c.cand AND l.l_quantity > 25)")
    def _(spark, d, kind=_kind):
        g = read(spark, d, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("s1"), F.col("l_partkey").alias("cand"))
        return claims(spark, d).join(g, ["s1", "cand"], kind)


@C.add("scores_full_outer", "s1:i cand:i m1:d m2:d", f"SELECT coalesce(a.s1, b.s1) AS s1, coalesce(a.cand, b.cand) AS cand, a.p AS m1, b.p AS m2 FROM (SELECT * FROM ({CLAIMS}) WHERE p > 0.3) a FULL JOIN (SELECT * FROM ({CLAIMS}) WHERE p < 0.6) b ON a.s1 = b.s1 AND a.cand = b.cand")
def _(spark, d):
    c = claims(spark, d).withColumnRenamed("p", "score")
    return files.merge_scores({"m1": c.where("score > 0.3D"), "m2": c.where("score < 0.6D")})


@C.add("owner_lookup", "s1:i cand:i owner:i owner_p:d", f"SELECT c.s1, c.cand, o.s1 AS owner, o.p AS owner_p FROM ({CLAIMS}) c LEFT JOIN (SELECT cand, s1, p FROM ({CLAIMS}) WHERE p > 0.6 QUALIFY row_number() OVER (PARTITION BY cand ORDER BY p DESC, s1) = 1) o ON o.cand = c.cand")
def _(spark, d):
    """The anchor that got each candidate in the end."""
    o = chosen(spark, d).select("cand", F.col("s1").alias("owner"), F.col("p").alias("owner_p"))
    return claims(spark, d).join(o, "cand", "left")


# ---- aggregates


@C.add("weighted_counts", "flag:s n:i total:d", "SELECT l_returnflag AS flag, count(*) AS n, sum(l_quantity) AS total FROM lineitem GROUP BY 1")
def _(spark, d):
    return aggregates.weighted_counts(read(spark, d, "lineitem").withColumnRenamed("l_returnflag", "flag"), "flag", F.col("l_quantity"))


@C.add("value_counts", "p_name:s n:i", "SELECT p_name, count(*) AS n FROM part GROUP BY 1")
def _(spark, d):
    return read(spark, d, "part").groupBy("p_name").agg(F.count("*").alias("n"))


@C.add("distinct_counts", "l_returnflag:s n_l_orderkey:i n_l_partkey:i", "SELECT l_returnflag, count(DISTINCT l_orderkey) AS n_l_orderkey, count(DISTINCT l_partkey) AS n_l_partkey FROM lineitem GROUP BY 1")
def _(spark, d):
    return aggregates.distinct_counts(read(spark, d, "lineitem"), "l_returnflag", "l_orderkey", "l_partkey")


@C.add("percentiles", "event_type:s p50:d p95:d p99:d", "SELECT event_type, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99 FROM events GROUP BY 1")
def _(spark, d):
    return aggregates.percentiles(read(spark, d, "events"), "event_type", "value")


@C.add("equal_width_hist", "bin:i n:i", f"SELECT least(CAST(floor(p * 10) AS BIGINT), 9) AS bin, count(*) AS n FROM ({CLAIMS}) GROUP BY 1")
def _(spark, d):
    return aggregates.histogram(claims(spark, d), "p")


BAND = "CASE WHEN p <= 0 THEN 0 WHEN p >= 1 THEN 40 ELSE greatest(0, least(40, CAST(floor((ln(p / (1 - p)) + 5.0::DOUBLE) / (13.0::DOUBLE / 39) + 1e-9) AS BIGINT) + 1)) END"


@C.add("logit_bands", "band:i n:i pos:i", f"SELECT {BAND} AS band, count(*) AS n, sum(y) AS pos FROM ({CLAIMS}) GROUP BY 1")
def _(spark, d):
    return claims(spark, d).groupBy(aggregates.band(F.col("p")).alias("band")).agg(F.count("*").alias("n"), F.sum("y").alias("pos"))


@C.add("mode_with_share", "p_brand:s p_name:s n:i share:d", "SELECT p_brand, p_name, n, n / total AS share FROM (SELECT *, sum(n) OVER (PARTITION BY p_brand) AS total, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_name) AS r FROM (SELECT p_brand, p_name, count(*) AS n FROM part GROUP BY 1, 2)) WHERE r = 1 AND n >= 2 AND n / total >= 0.02")
def _(spark, d):
    return aggregates.mode_with_share(read(spark, d, "part"), "p_brand", "p_name", 2, 0.02)


@C.add("top_n_common", "p_name:s n:i", "SELECT p_name, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_name LIMIT 10")
def _(spark, d):
    """A report of ten."""
    return aggregates.most_common(read(spark, d, "part"), "p_name", 10)


@C.add("cumulative_budget", "nation:i n:i", "WITH g AS (SELECT c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 1) SELECT nation, n FROM (SELECT *, coalesce(sum(n) OVER (ORDER BY md5(nation::VARCHAR), nation ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g) WHERE before < 600")
def _(spark, d):
    g = read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n"))
    return ranking.cumulative_budget(g, "n", [F.md5(F.col("nation").cast("string").cast("binary")), F.col("nation")], 600)


@C.add("density_by_partition", "nation:i pool:i anchors:i density:d", "SELECT s.nation, coalesce(pool, 0) AS pool, anchors, coalesce(pool, 0) / anchors AS density FROM (SELECT s_nationkey AS nation, count(*) AS anchors FROM supplier GROUP BY 1) s LEFT JOIN (SELECT c_nationkey AS nation, count(*) AS pool FROM customer GROUP BY 1) c ON c.nation = s.nation")
def _(spark, d):
    return aggregates.density(read(spark, d, "customer").withColumnRenamed("c_nationkey", "nation"), read(spark, d, "supplier").withColumnRenamed("s_nationkey", "nation"), "nation")


@C.add("partition_vote", "same:d partitioned:b", "SELECT avg(CASE WHEN c.c_nationkey % 3 = o.o_custkey % 3 THEN 1.0 ELSE 0.0 END) AS same, avg(CASE WHEN c.c_nationkey % 3 = o.o_custkey % 3 THEN 1.0 ELSE 0.0 END) >= 0.999 AS partitioned FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey")
def _(spark, d):
    o, c = read(spark, d, "orders"), read(spark, d, "customer")
    gold = o.select(F.col("o_orderkey").alias("s1"), (-1 - F.col("o_custkey")).alias("cand"))
    keys = o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 3).alias("key")).unionByName(c.select((-1 - F.col("c_custkey")).alias("id"), (F.col("c_nationkey") % 3).cast("bigint").alias("key")))
    return aggregates.partition_vote(gold, keys)


@C.add("set_algebra", "s1:i n_a:i n_b:i n_both:i n_any:i jacc:d", f"SELECT s1, len(a) AS n_a, len(b) AS n_b, len(list_intersect(a, b)) AS n_both, len(a) + len(b) - len(list_intersect(a, b)) AS n_any, CASE WHEN len(a) + len(b) > 0 THEN len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) END AS jacc FROM (SELECT s1, coalesce(list(cand) FILTER (p > 0.4), []) AS a, coalesce(list(cand) FILTER (y = 1), []) AS b FROM ({CLAIMS}) GROUP BY s1)")
def _(spark, d):
    c = claims(spark, d).groupBy("s1").agg(F.collect_set(F.when(F.col("p") > 0.4, F.col("cand"))).alias("a"), F.collect_set(F.when(F.col("y") == 1, F.col("cand"))).alias("b"))
    a, b = F.col("a"), F.col("b")
    return c.select("s1", F.size(a).alias("n_a"), F.size(b).alias("n_b"), F.size(F.array_intersect(a, b)).alias("n_both"), F.size(F.array_union(a, b)).alias("n_any"), X.jaccard(a, b).alias("jacc"))


@C.add("intersect_relation", "k:i", "SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def _(spark, d):
    return read(spark, d, "orders").select(F.col("o_custkey").alias("k")).intersect(read(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k")))


@C.add("except_relation", "k:i", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def _(spark, d):
    return read(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(read(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")))


@C.add("union_all", "channel:s n:i pos:i", f"SELECT channel, count(*) AS n, sum(y) AS pos FROM ({CHANNELS}) GROUP BY channel")
def _(spark, d):
    c = claims(spark, d)
    at = lambda cond, name: c.where(cond).select("y", F.lit(name).alias("channel"))
    return at("p > 0.7", "strong").unionByName(at("cand % 2 = 0", "even")).unionByName(at("abs(s1 % 100 - cand % 100) < 30", "near")).groupBy("channel").agg(F.count("*").alias("n"), F.sum("y").alias("pos"))


@C.add(
    "eda_gates",
    "gate:s value:d",
    f"""WITH r AS ({REC}), g AS (SELECT a.doc_id AS s1, b.doc_id AS cand, a.cty = b.cty AS same, b.src FROM r a JOIN r b ON md5(a.text) = md5(b.text) AND a.src = 'S1' AND b.src <> 'S1'), m AS (SELECT s1, count(*) AS n, max(k) AS k FROM (SELECT *, count(*) OVER (PARTITION BY s1, src) AS k FROM g) GROUP BY s1)
 SELECT 'anchors' AS gate, count(*)::DOUBLE AS value FROM r WHERE src = 'S1' UNION ALL SELECT 'pool', count(*) FROM r WHERE src <> 'S1' UNION ALL SELECT 'share_matched', (SELECT count(*) FROM m) / (SELECT count(*) FROM r WHERE src = 'S1')
 UNION ALL SELECT 'pool_matched', (SELECT count(DISTINCT cand) FROM g) / (SELECT count(*) FROM r WHERE src <> 'S1') UNION ALL SELECT 'exclusive', (SELECT avg(CASE WHEN n = 1 THEN 1.0 ELSE 0.0 END) FROM (SELECT count(*) AS n FROM g GROUP BY cand))
 UNION ALL SELECT 'same_country', avg(CASE WHEN same THEN 1.0 ELSE 0.0 END) FROM g UNION ALL SELECT 'two_of_one_source', avg(CASE WHEN k > 1 THEN 1.0 ELSE 0.0 END) FROM m UNION ALL SELECT 'share_s3', avg(CASE WHEN src = 'S3' THEN 1.0 ELSE 0.0 END) FROM g
 UNION ALL SELECT 'shared_names', (SELECT sum(n) FROM (SELECT count(*) AS n FROM r GROUP BY name HAVING count(*) > 1)) / (SELECT count(*) FROM r)""",
)
def _(spark, d):
    """What a data set is like before anything is fitted: sizes, how many match, whether matches exclude each other and cross countries."""
    r = records(spark, d).select("src", "cty", F.md5(F.col("name").cast("binary")).alias("hn"), F.md5(F.col("text").cast("binary")).alias("h"))
    n = r.agg(F.count_if(F.col("src") == "S1").cast("double").alias("anchors"), F.count_if(F.col("src") != "S1").cast("double").alias("pool"), F.count("*").cast("double").alias("n"))
    # equal texts are counted, not paired: anchors and pool records of each text, and of each text and country
    of = lambda s: F.count_if(F.col("src") == s).cast("double")
    c = r.groupBy("h", "cty").agg(of("S1").alias("a"), of("S2").alias("b"), of("S3").alias("c"))
    t = c.groupBy("h").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("c").alias("c"), F.sum(F.col("a") * (F.col("b") + F.col("c"))).alias("same")).where("a > 0 and b + c > 0")
    g = t.agg(
        F.sum("a").alias("m"), F.sum(F.expr("b + c")).alias("k"), F.sum(F.expr("if(a = 1, b + c, 0)")).alias("alone"), F.sum(F.expr("if(b > 1 or c > 1, a, 0)")).alias("two"), F.sum("same").alias("same"), F.sum(F.expr("a * c")).alias("s3"), F.sum(F.expr("a * (b + c)")).alias("pairs")
    )
    names = r.groupBy("hn").agg(F.count("*").alias("k")).where("k > 1").agg(F.sum("k").alias("shared"))
    one = n.crossJoin(F.broadcast(g)).crossJoin(F.broadcast(names))
    return one.selectExpr("stack(9, 'anchors', anchors, 'pool', pool, 'share_matched', coalesce(m, 0) / anchors, 'pool_matched', coalesce(k, 0) / pool, 'exclusive', alone / k, 'same_country', same / pairs, 'two_of_one_source', two / m, 'share_s3', s3 / pairs, 'shared_names', shared / n) as (gate, value)")


@C.add("drift_gate", "half:i side:s cty:s n:i name_len:d addr_len:d addr_empty:d", f"SELECT doc_id % 2 AS half, CASE WHEN src = 'S1' THEN 'S1' ELSE 'pool' END AS side, cty, count(*) AS n, avg(length(name)) AS name_len, avg(length(addr)) AS addr_len, avg(CASE WHEN trim(addr) = '' THEN 1.0 ELSE 0.0 END) AS addr_empty FROM ({REC}) GROUP BY ALL")
def _(spark, d):
    """What may differ between two splits, here even and odd records: sizes, lengths of names and addresses, and empty addresses, by side and country."""
    r = records(spark, d).withColumns({"half": F.pmod("doc_id", F.lit(2)), "side": F.when(F.col("src") == "S1", "S1").otherwise("pool")})
    return r.groupBy("half", "side", "cty").agg(F.count("*").alias("n"), F.avg(F.char_length("name")).alias("name_len"), F.avg(F.char_length("addr")).alias("addr_len"), F.avg((F.trim("addr") == "").cast("double")).alias("addr_empty"))


# ---- samples and folds


@C.add("hash_sample", "o_orderkey:i", "SELECT o_orderkey FROM orders ORDER BY md5(o_orderkey || '|s'), o_orderkey LIMIT 500")
def _(spark, d):
    """A sampling operator: exactly 500."""
    return sampling.hash_sample(read(spark, d, "orders"), "o_orderkey", 500)


@C.add("md5_val_split", "o_orderkey:i is_val:b", "SELECT o_orderkey, ('0x' || substr(md5(o_orderkey::VARCHAR), 1, 8))::BIGINT % 20 = 0 AS is_val FROM orders")
def _(spark, d):
    return sampling.split(read(spark, d, "orders"), "o_orderkey")


@C.add("stratified_folds", "s1:i stratum:s fold:i", f"""WITH a AS (SELECT s1, cty || ':' || least(g, 3) AS st FROM ({ANCHORS})), n AS (SELECT st, count(*) AS n FROM a GROUP BY st), t AS (SELECT st, CASE WHEN n >= 5 THEN st WHEN sum(CASE WHEN n < 5 THEN n ELSE 0 END) OVER () < 5 THEN first_value(st) OVER (ORDER BY n DESC, st DESC) ELSE '__rare__' END AS stratum FROM n)
 SELECT s1, stratum, (row_number() OVER (PARTITION BY stratum ORDER BY md5(s1::VARCHAR), s1) - 1) % 5 AS fold FROM a JOIN t ON t.st = a.st""")
def _(spark, d):
    return sampling.stratified_folds(anchors(spark, d), "s1", F.concat_ws(":", "cty", F.least(F.col("g"), F.lit(3))))


@C.add("region_folds", "page_id:i region:s fold:i", "WITH p AS (SELECT page_id, string_split(url, '/')[3] AS region FROM pages), k AS (SELECT region, (row_number() OVER (ORDER BY md5(region || '|g'), region) - 1) % 5 AS fold FROM (SELECT DISTINCT region FROM p)) SELECT page_id, p.region, fold FROM p JOIN k ON k.region = p.region")
def _(spark, d):
    p = read(spark, d, "pages").select("page_id", F.get(F.split("url", "/"), F.lit(2)).alias("region"))
    return sampling.group_folds(p, F.col("region"))


@C.add("holdout_select", "c_custkey:i nation:i", """WITH a AS (SELECT s_nationkey AS nation, count(*) AS n FROM supplier GROUP BY 1), b AS (SELECT c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 1), s AS (SELECT a.nation, greatest(0, least(0.6, 1 - (1 / b.n::DOUBLE * a.n) / (0.1 + a.nation / 100.0::DOUBLE))) AS share FROM a JOIN b ON a.nation = b.nation)
 SELECT c_custkey, c_nationkey AS nation FROM customer LEFT JOIN s ON s.nation = c_nationkey WHERE ('0x' || substr(md5(c_custkey || '|holdout'), 1, 8))::BIGINT / 4294967296.0 >= coalesce(share, 0)""")
def _(spark, d):
    """Customers are anchors, suppliers their pool; the test density is given by nation."""
    c, s = read(spark, d, "customer").withColumnRenamed("c_nationkey", "nation"), read(spark, d, "supplier").withColumnRenamed("s_nationkey", "nation")
    train = aggregates.density(s, c, "nation").where("pool > 0")
    test = train.select("nation", (F.lit(0.1) + F.col("nation") / F.lit(100.0)).alias("density"))
    return holdout.select(c, holdout.removal_share(train, test, "nation"), "nation", "c_custkey")


# ---- thresholds, calibration and models


@C.add("choose_tau", "tau:d", f"""WITH r AS (SELECT p, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, cand) AS k, y FROM ({CLAIMS})), t AS (SELECT count(*) AS n, count(*) FILTER (k <= 1) AS kept, ceil(count(*) * 0.6 - 1e-9) - count(*) FILTER (k <= 1) AS need FROM r WHERE y = 1)
 SELECT CASE WHEN n = 0 THEN 1.0 WHEN need <= 0 THEN 1.0 + 1e-6 ELSE coalesce((SELECT max(p) FROM (SELECT p, sum(count(*)) OVER (ORDER BY p DESC) AS upto FROM r WHERE y = 1 AND k > 1 AND k <= 4 GROUP BY p) WHERE upto >= need), 0) END AS tau FROM t""")
def _(spark, d):
    return calibration.choose_tau(claims(spark, d), 1, 4, 0.6)


@C.add("shift_band_table", "band:i n_known:i rate:d n_new:i mean_new:d expected:d rate_new:d", f"""WITH k AS (SELECT {BAND} AS band, count(*) AS n, sum(y)::DOUBLE AS pos FROM ({CLAIMS}) WHERE s1 % 2 = 0 GROUP BY 1), w AS (SELECT {BAND} AS band, count(*) AS n, avg(p) AS m FROM ({CLAIMS}) WHERE s1 % 2 = 1 GROUP BY 1),
 c AS (SELECT count(*) FILTER (o_orderkey % 2 = 0) AS a, count(*) FILTER (o_orderkey % 2 = 1) AS b FROM orders) SELECT w.band, coalesce(k.n, 0) AS n_known, pos / k.n AS rate, w.n AS n_new, m AS mean_new, coalesce(pos, 0) / a * b AS expected, least(coalesce(pos / k.n, 1), coalesce(pos, 0) / a * b / w.n) AS rate_new FROM w LEFT JOIN k ON k.band = w.band, c""")
def _(spark, d):
    """Even orders are known, odd ones new."""
    c, o = claims(spark, d), read(spark, d, "orders")
    return calibration.shift_bands(c.where("s1 % 2 = 0"), o.where("o_orderkey % 2 = 0").count(), c.where("s1 % 2 = 1"), o.where("o_orderkey % 2 = 1").count())


#: Monotone fit of (x, avg, w) in the order of x: the greatest over all beginnings of the least mean over all ends.
PAV = lambda points, by="": f"""SELECT {by and by + ','} x, max(least_mean) AS v FROM (SELECT {by and 'b.' + by + ','} e.x, min((e.s - b.s + b.w * b.y) / (e.n - b.n + b.w)) OVER (PARTITION BY {by and 'b.' + by + ','} b.x ORDER BY e.x DESC ROWS UNBOUNDED PRECEDING) AS least_mean
 FROM ({points}) b JOIN ({points}) e ON e.x >= b.x {by and f'AND e.{by} = b.{by}'}) GROUP BY {by and by + ','} x"""  # noqa: E731
_sums = lambda t, by="": f"SELECT {by and by + ','} x, y, w, sum(w) OVER ({by and 'PARTITION BY ' + by} ORDER BY x) AS n, sum(w * y) OVER ({by and 'PARTITION BY ' + by} ORDER BY x) AS s FROM ({t})"
_points = _sums(f"SELECT p AS x, avg(y) AS y, count(*)::DOUBLE AS w FROM ({CLAIMS}) GROUP BY p")


@C.add("isotonic_fit", "s1:i cand:i q:d", f"SELECT s1, cand, v AS q FROM ({CLAIMS}) c JOIN ({PAV(_points)}) k ON k.x = c.p")
def _(spark, d):
    c = claims(spark, d)
    return c.withColumn("q", calibration.Isotonic(c)(F.col("p")))


_foldpoints = _sums(f"SELECT f AS fold, p AS x, avg(y) AS y, count(*)::DOUBLE AS w FROM ({CLAIMS}), (VALUES (0), (1), (2)) v(f) WHERE s1 % 3 <> f GROUP BY f, p", "fold")


@C.add("calibrate_oof", "s1:i cand:i q:d", f"WITH k AS MATERIALIZED ({PAV(_foldpoints, 'fold')}), c AS (SELECT *, s1 % 3 AS fold FROM ({CLAIMS})), l AS (SELECT c.*, k.x AS lx, k.v AS lv FROM c ASOF LEFT JOIN k ON c.fold = k.fold AND c.p >= k.x), b AS (SELECT l.*, k.x AS hx, k.v AS hv FROM l ASOF LEFT JOIN k ON l.fold = k.fold AND l.p <= k.x) SELECT s1, cand, CASE WHEN lx IS NULL THEN hv WHEN hx IS NULL OR hx = lx THEN lv ELSE lv + (hv - lv) * (p - lx) / (hx - lx) END AS q FROM b")
def _(spark, d):
    """Each fold's scores calibrated on the others."""
    return calibration.refitted(claims(spark, d).withColumn("fold", F.pmod("s1", F.lit(3))), "fold", 3)


_bands = f"""SELECT mean_new AS x, least(rate, expected / n_new) AS y, n_new::DOUBLE AS w FROM (SELECT w.n AS n_new, m AS mean_new, pos / k.n AS rate, pos / a * b AS expected FROM (SELECT {BAND} AS band, count(*) AS n, avg(p) AS m FROM ({CLAIMS}) WHERE s1 % 2 = 1 GROUP BY 1) w
 JOIN (SELECT {BAND} AS band, count(*) AS n, sum(y)::DOUBLE AS pos FROM ({CLAIMS}) WHERE s1 % 2 = 0 GROUP BY 1) k ON k.band = w.band, (SELECT count(*) FILTER (o_orderkey % 2 = 0) AS a, count(*) FILTER (o_orderkey % 2 = 1) AS b FROM orders) c)"""


@C.add("shift_calibrator", "s1:i cand:i q:d", f"WITH k AS MATERIALIZED ({PAV(_sums(_bands))}), c AS (SELECT * FROM ({CLAIMS}) WHERE s1 % 2 = 1), l AS (SELECT c.*, k.x AS lx, k.v AS lv FROM c ASOF LEFT JOIN k ON c.p >= k.x), b AS (SELECT l.*, k.x AS hx, k.v AS hv FROM l ASOF LEFT JOIN k ON l.p <= k.x) SELECT s1, cand, CASE WHEN lx IS NULL THEN hv WHEN hx IS NULL OR hx = lx THEN lv ELSE lv + (hv - lv) * (p - lx) / (hx - lx) END AS q FROM b")
def _(spark, d):
    """The weighted monotone fit of the bands of odd orders, applied to their pairs; all orders are one country."""
    c, o = claims(spark, d).withColumn("cty", F.lit("x")), read(spark, d, "orders")
    n = {k: o.where(F.pmod("o_orderkey", F.lit(2)) == k).count() for k in (0, 1)}
    return calibration.shift_calibrated(c.where("s1 % 2 = 0"), {"x": n[0]}, c.where("s1 % 2 = 1"), {"x": n[1]})


def _features(spark: SparkSession, d: str):
    f = collective.within(claims(spark, d))
    return f.withColumn("fold", F.pmod("s1", F.lit(3)))


FEATURES = ["p", "rank_in_s1", "gap", "rel", "s1_sum", "n_strong"]


@C.add("gbt_oof", "s1:i cand:i y:i q:d")
def _(spark, d):
    """Pairs scored out of fold by boosted trees."""
    return models.out_of_fold(_features(spark, d), FEATURES, "y", "fold", 3, "q", rounds=3, depth=3)[0]


@C.add("stacker_oof", "cty:i n:i pos:i auc:d ap:d logloss:d brier:d")
def _(spark, d):
    """A second model on the first one's scores and their place among rivals, and how good it is by country."""
    first, _ = models.out_of_fold(_features(spark, d).select("s1", "cand", "y", "fold", *FEATURES), FEATURES, "y", "fold", 3, "q", rounds=2, depth=3)
    st = collective.stack_features(first.drop("p").withColumnRenamed("q", "p")).join(first.select("s1", "cand", "y", "fold"), ["s1", "cand"])
    second, _ = models.out_of_fold(st, ["lp2", "rank_s1", "gap_top", "rel_top", "s1_mass", "s1_strong", "rival_p", "claim_rank", "margin_rival"], "y", "fold", 3, "q", rounds=2, depth=3)
    return evaluation.binary_metrics(second.join(anchors(spark, d).select("s1", "cty"), "s1"), p="q", by="cty")


@C.add("entity_gate", "s1:i h:d")
def _(spark, d):
    """The probability that an anchor has a match at all, out of fold."""
    a = anchors(spark, d)
    f = collective.gate_features(a, claims(spark, d)).join(a.select("s1", (F.col("g") > 0).cast("int").alias("y")), "s1").withColumn("fold", F.pmod("s1", F.lit(3)))
    return models.out_of_fold(f, ["h_top1", "h_top2", "h_sum", "h_n05", "h_ncand", "h_rival_top", "h_rival_n05_top", "h_lost05", "h_entropy"], "y", "fold", 3, "h", rounds=2, depth=3)[0]


@C.add("lexicon_learn", "word:s meaning:s n:i share:d", "SELECT word, meaning, n, n / total AS share FROM (SELECT *, sum(n) OVER (PARTITION BY word) AS total, row_number() OVER (PARTITION BY word ORDER BY n DESC, meaning) AS r FROM (SELECT x[1] AS word, y[1] AS meaning, count(*) AS n FROM (SELECT string_split(p_name, ' ') AS x, string_split(p_name, ' ')[2:] || [lower(p_type)] AS y FROM part WHERE len(string_split(p_name, ' ')) = 2) GROUP BY 1, 2 UNION ALL SELECT x[2], y[2], count(*) FROM (SELECT string_split(p_name, ' ') AS x, string_split(p_name, ' ')[2:] || [lower(p_type)] AS y FROM part WHERE len(string_split(p_name, ' ')) = 2) GROUP BY 1, 2)) WHERE r = 1 AND n >= 2 AND n / total >= 0.1")
def _(spark, d):
    """Part names against their second word and type, word by word."""
    x = F.split("p_name", " ")
    p = read(spark, d, "part").where(F.size(x) == 2)
    return lexicon.learn(p, x, F.concat(F.slice(x, 2, 1), F.array(F.lower("p_type"))), 2, 0.1)


@C.add("scalar_functions", "l_orderkey:i l_partkey:i l_linenumber:i lg:d od:d sg:d ent:d cl:d ce:i", "SELECT l_orderkey, l_partkey, l_linenumber, ln(1 + l_quantity) AS lg, least(l_discount, 1 - 1e-6) / (1 - least(l_discount, 1 - 1e-6)) AS od, 1 / (1 + exp(-l_tax)) AS sg, -l_discount * ln(greatest(l_discount, 1e-9)) AS ent, greatest(0.02, least(0.98, l_discount)) AS cl, ceil(l_quantity * 0.3) AS ce FROM lineitem")
def _(spark, d):
    q = F.col("l_discount")
    return read(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", F.log1p("l_quantity").alias("lg"), X.odds(q).alias("od"), X.sigmoid(F.col("l_tax")).alias("sg"), X.entropy_term(q).alias("ent"), X.clip(q, 0.02).alias("cl"), F.ceil(F.col("l_quantity") * F.lit(0.3)).alias("ce"))


@C.add("chunked_scoring_stream", "event_id:i q:d", "SELECT event_id, 1 / (1 + exp(-value / 100)) AS q FROM events")
def _(spark, d):
    """Events scored in micro-batches with resume; input, output and state in the shared folder of spark.checkpoint.dir."""
    import uuid

    from kindred.sources.shared import shared_dir
    from kindred.streaming.chunks import run_chunks

    root = f"{shared_dir(spark)}/chunks-{uuid.uuid4().hex}"
    read(spark, d, "events").repartition(4).write.parquet(f"{root}/in")
    return run_chunks(spark, f"{root}/in", f"{root}/out", f"{root}/state", lambda b: b.withColumn("q", X.sigmoid(F.col("value") / 100)), 2)
