"""Queries over texts: normalization, tokens, blocking and pair features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions import columns as X
from kindred.functions import normalize as N
from kindred.functions import records as R
from kindred.functions import strings as S
from kindred.operators import blocking, dense, ranking
from kindred.plans.contract import Catalogue
from kindred.sources.shared import table
from kindred.sources.tables import read, records

C = Catalogue()

REC = """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'S1' WHEN doc_id % 5 <= 2 THEN 'S2' ELSE 'S3' END AS src, lang AS cty, text,
 CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, 1, instr(text, chr(10)) - 1) ELSE text END AS name, CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, instr(text, chr(10)) + 1) ELSE '' END AS addr
 FROM (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents)"""
name_toks = lambda: N.tokens(N.fold_latin(F.col("name")))
addr_toks = lambda: N.tokens(N.clean_address(F.col("addr")))
NAME_SQL = N.tokens_sql(N.fold_latin_sql("name"))
ADDR_SQL = N.tokens_sql(N.steps_sql(N.fold_latin_sql("addr"), N.ADDRESS_STEPS))
joined = lambda c: F.array_join(c, " ")
once_sql = lambda u: f"list_filter({u}, lambda el, i: list_position({u}, el) = i)"
nums_sql = lambda t: f"list_transform(list_filter({t}, lambda w: regexp_matches(w, '^[0-9]{{1,4}}$')), lambda w: regexp_replace(w, '^0+([0-9])', '\\1'))"


@C.add("coalesce_empty_views", "doc_id:i view:s joint:s", f"SELECT doc_id, CASE WHEN length(addr) > 0 THEN addr ELSE name END AS view, concat_ws(' | ', name, addr) AS joint FROM ({REC})")
def _(spark, d):
    return records(spark, d).select("doc_id", X.coalesce_empty(F.col("addr"), F.col("name")).alias("view"), R.text_of(F.col("name"), F.col("addr")).alias("joint"))


HOLDERS = ", ".join(f"'{p}'" for p in X.PLACEHOLDERS)


@C.add("placeholder_counts", "src:s empty_name:i empty_addr:i n:i", f"SELECT src, count(*) FILTER (lower(trim(name)) IN ({HOLDERS})) AS empty_name, count(*) FILTER (lower(trim(addr)) IN ({HOLDERS})) AS empty_addr, count(*) AS n FROM ({REC}) GROUP BY src")
def _(spark, d):
    return records(spark, d).groupBy("src").agg(F.count_if(X.is_placeholder(F.col("name"))).alias("empty_name"), F.count_if(X.is_placeholder(F.col("addr"))).alias("empty_addr"), F.count("*").alias("n"))


@C.add("script_predicate", "lang:s indic:i digits:i accented:i", "SELECT lang, count(*) FILTER (regexp_matches(text, '[\\x{0900}-\\x{0D7F}]')) AS indic, count(*) FILTER (regexp_matches(text, '[0-9]{5}')) AS digits, count(*) FILTER (regexp_matches(text, '[à-ÿ]')) AS accented FROM documents GROUP BY lang")
def _(spark, d):
    t = F.col("text")
    return read(spark, d, "documents").groupBy("lang").agg(F.count_if(N.has_indic(t)).alias("indic"), F.count_if(t.rlike("[0-9]{5}")).alias("digits"), F.count_if(t.rlike("[à-ÿ]")).alias("accented"))


@C.add("fold_latin", "doc_id:i folded:s", f"SELECT doc_id, {N.fold_latin_sql('text')} AS folded FROM documents")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", N.fold_latin(F.col("text")).alias("folded"))


@C.add("country_key", "key:s n:i", "SELECT CASE WHEN trim(regexp_replace(lower(x), '\\s+', ' ', 'g')) = '' THEN '__na__' ELSE trim(regexp_replace(lower(x), '\\s+', ' ', 'g')) END AS key, count(*) AS n FROM (SELECT '  ' || upper(lang) || '   X ' AS x FROM documents UNION ALL SELECT '' FROM documents) GROUP BY 1")
def _(spark, d):
    """Country names with white space and capitals around, and empty ones."""
    t = read(spark, d, "documents")
    x = t.select(F.concat(F.lit("  "), F.upper("lang"), F.lit("   X ")).alias("x")).unionByName(t.select(F.lit("").alias("x")))
    return x.groupBy(X.country_key(F.col("x")).alias("key")).agg(F.count("*").alias("n"))


@C.add("region_key", "doc_id:i region:s", "SELECT doc_id, lower(CASE WHEN len(f) >= 2 THEN f[len(f) - 1] WHEN len(f) = 1 THEN f[1] ELSE '' END) AS region FROM (SELECT doc_id, list_filter(list_transform(string_split(text, ','), lambda x: trim(x)), lambda x: x <> '') AS f FROM documents)")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", X.region_key(F.col("text")).alias("region"))


@C.add("raw_casefold", "doc_id:i folded:s", "SELECT doc_id, trim(regexp_replace(lower(text), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS folded FROM documents")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", X.squeezed(F.col("text")).alias("folded"))


@C.add("record_text", "doc_id:i t:s", f"SELECT doc_id, '[' || src || '] ' || concat_ws(' | ', name, addr) AS t FROM ({REC})")
def _(spark, d):
    return records(spark, d).select("doc_id", R.text_of(F.col("name"), F.col("addr"), F.col("src")).alias("t"))


@C.add("clean_address", "doc_id:i a:s", f"SELECT doc_id, {N.steps_sql(N.fold_latin_sql('addr'), N.ADDRESS_STEPS)} AS a FROM ({REC})")
def _(spark, d):
    return records(spark, d).select("doc_id", N.clean_address(F.col("addr")).alias("a"))


@C.add("numbers_postal", "doc_id:i nums:s postal:s", f"SELECT doc_id, array_to_string(list_filter(u, lambda w, i: list_position(u, w) = i), ' ') AS nums, array_to_string(list_filter(p, lambda w, i: list_position(p, w) = i), ' ') AS postal FROM (SELECT doc_id, {nums_sql(N.tokens_sql(N.steps_sql(N.fold_latin_sql('text'), N.ADDRESS_STEPS)))} AS u, regexp_extract_all(text, '[0-9]{{5,}}') AS p FROM ({REC}))")
def _(spark, d):
    return records(spark, d).select("doc_id", joined(N.numbers(N.tokens(N.clean_address(F.col("text"))))).alias("nums"), joined(N.postal(F.col("text"))).alias("postal"))


@C.add("canon_tokens", "doc_id:i name:s addr:s", f"SELECT doc_id, array_to_string({NAME_SQL}, ' ') AS name, array_to_string({ADDR_SQL}, ' ') AS addr FROM ({REC})")
def _(spark, d):
    return records(spark, d).select("doc_id", joined(name_toks()).alias("name"), joined(addr_toks()).alias("addr"))


@C.add("domain_tokens", "page_id:i domains:s", f"SELECT page_id, array_to_string(list_transform(regexp_extract_all(lower(url), '({N.DOMAIN})', 1), lambda x: regexp_replace(x, '^www\\.', '')), ' ') AS domains FROM pages")
def _(spark, d):
    return read(spark, d, "pages").select("page_id", joined(N.domains(F.col("url"))).alias("domains"))


@C.add("repair_digits", "s:s r:s", f"SELECT s, {N.repair_digits_sql('s')} AS r FROM (SELECT 'x' || replace(replace(lower(p_name), 'o', '0'), 'e', '3') || p_partkey || 'y' AS s FROM part)")
def _(spark, d):
    s = F.concat(F.lit("x"), F.replace(F.replace(F.lower("p_name"), F.lit("o"), F.lit("0")), F.lit("e"), F.lit("3")), F.col("p_partkey"), F.lit("y"))
    return read(spark, d, "part").select(s.alias("s")).withColumn("r", N.repair_digits(F.col("s")))


WORDS = f"SELECT DISTINCT unnest({NAME_SQL}) AS w FROM ({REC})"


def _words(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).select(F.explode(name_toks()).alias("w")).distinct()


@C.add("skeleton_keys", "w:s skel:s", f"SELECT w, {N.skeleton_sql('w')} AS skel FROM ({WORDS})")
def _(spark, d):
    return _words(spark, d).withColumn("skel", N.skeleton(F.col("w")))


@C.add("skeleton_canon", "skel:s w:s", f"SELECT skel, min(w) AS w FROM (SELECT w, {N.skeleton_sql('w')} AS skel FROM ({WORDS}) WHERE length(w) >= 5) WHERE length(skel) >= 3 GROUP BY skel HAVING count(*) = 1")
def _(spark, d):
    """Skeletons that stand for one word only."""
    s = _words(spark, d).where(F.length("w") >= 5).withColumn("skel", N.skeleton(F.col("w"))).where(F.length("skel") >= 3)
    return s.groupBy("skel").agg(F.min("w").alias("w"), F.count("*").alias("n")).where("n = 1")


INI = lambda t: f"array_to_string(list_transform(list_filter({t}, lambda w: NOT regexp_matches(w, '^[0-9]+$')), lambda w: substr(w, 1, 1)), '')"
ACR = lambda x, y: f"(length({INI(x)}) >= 2 AND (list_contains({y}, {INI(x)}) OR array_to_string({y}, '') = {INI(x)}))"


@C.add("acronym_match", "doc_id:i hit:b", f"SELECT doc_id, {ACR('n', 'a')} OR {ACR('a', 'n')} AS hit FROM (SELECT doc_id, {NAME_SQL} AS n, list_concat({ADDR_SQL}, [{INI(NAME_SQL)}]) AS a FROM ({REC}) WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, {NAME_SQL} AS n, {ADDR_SQL} AS a FROM ({REC}) WHERE doc_id % 2 <> 0)")
def _(spark, d):
    """Every second record carries its name's initials as an added token."""
    r = records(spark, d).select("doc_id", name_toks().alias("n"), addr_toks().alias("a"))
    ini = F.array_join(F.transform(F.filter("n", lambda w: ~w.rlike("^[0-9]+$")), lambda w: F.substring(w, 1, 1)), "")
    r = r.withColumn("a", F.when(F.col("doc_id") % 2 == 0, F.concat("a", F.array(ini))).otherwise(F.col("a")))
    return r.select("doc_id", N.acronym(F.col("n"), F.col("a")).alias("hit"))


SKEL_T = lambda t: f"list_transform({t}, lambda w: '~' || {N.skeleton_sql('w')})"
PRE = lambda t, more="": f"list_transform(list_filter({t}, lambda w: length(w) >= 6{more}), lambda w: '^' || substr(w, 1, 4))"
BI = lambda t: f"list_transform(range(1, greatest(len({t}), 1)), lambda i: {t}[i] || '_' || {t}[i + 1])"


@C.add("tokens_name", "doc_id:i toks:s", f"SELECT doc_id, array_to_string(list_concat(t, {SKEL_T('t')}, {PRE('t')}, {BI('t')}), ' ') AS toks FROM (SELECT doc_id, {NAME_SQL} AS t FROM ({REC}))")
def _(spark, d):
    return records(spark, d).select("doc_id", name_toks().alias("t")).select("doc_id", joined(N.name_tokens(F.col("t"))).alias("toks"))


NOT_NUM = " AND NOT regexp_matches(w, '^[0-9]+$')"


@C.add("tokens_addr", "doc_id:i toks:s", f"SELECT doc_id, array_to_string(list_concat(t, {PRE('t', NOT_NUM)}, {BI('t')}), ' ') AS toks FROM (SELECT doc_id, {ADDR_SQL} AS t FROM ({REC}))")
def _(spark, d):
    return records(spark, d).select("doc_id", addr_toks().alias("t")).select("doc_id", joined(N.address_tokens(F.col("t"))).alias("toks"))


@C.add("numloc_keys", "doc_id:i keys:s", f"""SELECT doc_id, array_to_string(flatten(list_transform(n[1:2], lambda x: list_transform(w[greatest(len(w) - 7, 1):], lambda y: x || '#' || y))), ' ') AS keys FROM (SELECT doc_id, list_filter(u, lambda x, i: list_position(u, x) = i) AS n, list_filter(v, lambda x, i: list_position(v, x) = i) AS w
 FROM (SELECT doc_id, {nums_sql('t')} AS u, list_filter(t, lambda w: length(w) >= 3{NOT_NUM}) AS v FROM (SELECT doc_id, {N.tokens_sql(N.steps_sql(N.fold_latin_sql('text'), N.ADDRESS_STEPS))} AS t FROM ({REC}))))""")
def _(spark, d):
    t = records(spark, d).select("doc_id", N.tokens(N.clean_address(F.col("text"))).alias("t"))
    return t.select("doc_id", joined(N.house_locality(F.col("t"), N.numbers(F.col("t")))).alias("keys"))


@C.add("generator_keys", "doc_id:i keys:s", f"""SELECT doc_id, array_to_string(list_filter(k, lambda x, i: list_position(k, x) = i), ' ') AS keys FROM (SELECT doc_id, list_filter(['d_' || array_to_string(w, ''), 's_' || array_to_string(list_sort(w), ''), 'i_' || substr(ini, 1, 2) || z, 'l_' || substr(ini, 1, 1) || z, 'r_' || array_to_string(w[2:], ''), 'f_' || array_to_string(w[1:2], ''), 'a_' || ini], lambda x: length(x) >= 6) AS k
 FROM (SELECT doc_id, w, coalesce(w[len(w)], '') AS z, array_to_string(list_transform(w, lambda x: substr(x, 1, 1)), '') AS ini FROM (SELECT doc_id, list_filter({NAME_SQL}, lambda w: NOT regexp_matches(w, '^[0-9]+$')) AS w FROM ({REC}))))""")
def _(spark, d):
    return records(spark, d).select("doc_id", name_toks().alias("t")).select("doc_id", joined(N.generator_keys(F.col("t"))).alias("keys"))


@C.add("shared_keys", "doc_id:i keys:s", f"""SELECT doc_id, array_to_string(list_filter(k, lambda x, i: list_position(k, x) = i), ' ') AS keys FROM (SELECT doc_id, list_filter(['d_' || array_to_string(w, ''), 's_' || array_to_string(list_sort(w), '_'), 'd_' || substr(ini, 1, 2), 'd_' || substr(ini, 1, greatest(length(ini) - 1, 0)) || z, 'd_' || array_to_string(w[2:], ''), 'd_' || array_to_string(w[1:2], ''), 'd_' || substr(ini, 1, 3), 'd_' || ini], lambda x: length(x) >= 4) AS k
 FROM (SELECT doc_id, w, coalesce(w[len(w)], '') AS z, array_to_string(list_transform(w, lambda x: substr(x, 1, 1)), '') AS ini FROM (SELECT doc_id, list_filter({NAME_SQL}, lambda w: NOT regexp_matches(w, '^[0-9]+$')) AS w FROM ({REC}))))""")
def _(spark, d):
    return records(spark, d).select("doc_id", name_toks().alias("t")).select("doc_id", joined(N.shared_keys(F.col("t"))).alias("keys"))


@C.add("char_ngrams", "p_name:s n:i grams:i sample:s", "SELECT p_name, count(*) AS n, min(len(g)) AS grams, min(array_to_string(g, '.')) AS sample FROM (SELECT p_name, list_filter(flatten(list_transform(string_split(p_name, ' '), lambda w: list_transform(range(1, greatest(length(w) + 2 - 2, 1) + 1), lambda i: substr(' ' || w || ' ', i, 3)))), lambda x: length(x) = 3) AS g FROM part) GROUP BY p_name")
def _(spark, d):
    g = read(spark, d, "part").withColumn("g", N.char_ngrams(F.split("p_name", " "), 3))
    return g.groupBy("p_name").agg(F.count("*").alias("n"), F.min(F.size("g")).alias("grams"), F.min(F.array_join("g", ".")).alias("sample"))


_GRAMS = lambda n: f"list_filter(flatten(list_transform(string_split(p_name || ' ' || lower(p_type), ' '), lambda w: list_transform(range(1, greatest(length(w) + 2 - {n - 1}, 1) + 1), lambda i: substr(' ' || w || ' ', i, {n})))), lambda x: length(x) = {n})"


@C.add("char_tfidf", "id:i tok:s w:d", f"""WITH t AS (SELECT p_partkey AS id, unnest(list_concat({_GRAMS(3)}, {_GRAMS(4)})) AS tok FROM part), n AS (SELECT count(*) AS n FROM part), f AS (SELECT tok, count(DISTINCT id) AS df FROM t GROUP BY tok),
 w AS (SELECT t.id, t.tok, (1 + ln(count(*))) * (ln((1 + n) / (1 + df)::DOUBLE) + 1) AS w FROM t JOIN f ON f.tok = t.tok, n WHERE n < 2000 OR df <= 0.2 * n GROUP BY t.id, t.tok, n, df) SELECT id, tok, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM w""")
def _(spark, d):
    """Runs of three and four characters within words, 1 + ln(tf), those of more than a fifth of 2000 records or more left out."""
    p = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.split(F.concat_ws(" ", "p_name", F.lower("p_type")), " ").alias("w"))
    return blocking.char_weights(p, F.col("w"))


# ---- blocking

TOK = f"SELECT cty AS part, CASE WHEN src = 'S1' THEN 0 ELSE 1 END AS side, doc_id AS id, unnest({NAME_SQL}) AS tok FROM ({REC})"
ATOK = f"SELECT cty AS part, CASE WHEN src = 'S1' THEN 0 ELSE 1 END AS side, doc_id AS id, unnest({ADDR_SQL}) AS tok FROM ({REC})"
FREQ = lambda tok: f"SELECT f.part, tok, df, n, ln((1 + n) / (1 + df)::DOUBLE) + 1 AS idf FROM (SELECT part, tok, count(DISTINCT id) AS df FROM ({tok}) GROUP BY part, tok) f JOIN (SELECT lang AS part, count(*) AS n FROM documents GROUP BY lang) s ON s.part = f.part"
PRUNED = lambda tok: f"SELECT * FROM ({FREQ(tok)}) WHERE df <= greatest(25, least(n * 0.02, 3000))"
WEIGHTED = lambda tok: f"SELECT part, side, id, tok, w / sqrt(sum(w * w) OVER (PARTITION BY part, side, id)) AS w FROM (SELECT t.part, side, id, t.tok, ln(1 + tf) * idf AS w FROM (SELECT part, side, id, tok, count(*) AS tf FROM ({tok}) GROUP BY part, side, id, tok) t JOIN ({PRUNED(tok)}) f ON f.part = t.part AND f.tok = t.tok)"
SCORES = lambda tok: f"SELECT * FROM (SELECT a.part, a.id AS s1, b.id AS cand, round(sum(a.w * b.w), 9) AS score FROM ({WEIGHTED(tok)}) a JOIN ({WEIGHTED(tok)}) b ON a.part = b.part AND a.tok = b.tok AND a.side = 0 AND b.side = 1 GROUP BY ALL) WHERE score > 1e-9"
FORWARD = lambda tok, k: f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY score DESC, cand) AS rank FROM ({SCORES(tok)})) WHERE rank <= {k}"
REVERSE = lambda tok, k: f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cand ORDER BY score DESC, s1) AS rank FROM ({SCORES(tok)})) WHERE rank <= {k}"


def sizes(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").groupBy(F.col("lang").alias("part")).agg(F.count("*").alias("n"))


def toks(spark: SparkSession, d: str, which: str = "name") -> DataFrame:
    """Tokens, normalized once for all that reads them."""
    return table(blocking.token_table(records(spark, d), name_toks() if which == "name" else addr_toks()), f"tokens-{which}")


def weights(spark: SparkSession, d: str, which: str = "name") -> DataFrame:
    t = toks(spark, d, which)
    return blocking.weighted(t, blocking.pruned(blocking.frequencies(t, sizes(spark, d))))


def best(spark: SparkSession, d: str, k: int, which: str = "name") -> DataFrame:
    """The k best pool records of each anchor."""
    return blocking.best_of(records(spark, d), name_toks() if which == "name" else addr_toks(), sizes(spark, d), k)


def scores(spark: SparkSession, d: str, which: str = "name") -> DataFrame:
    return blocking.cosines(table(weights(spark, d, which), f"weights-{which}"))


@C.add("default_idf", "part:s tok:s df:i idf:d fallback:d", f"SELECT part, tok, df, idf, max(idf) OVER (PARTITION BY part) AS fallback FROM ({FREQ(TOK)})")
def _(spark, d):
    """Inverse document frequencies, and the largest of a part, which stands for tokens never seen."""
    from pyspark.sql import Window

    f = blocking.frequencies(toks(spark, d), sizes(spark, d))
    return f.withColumn("fallback", F.max("idf").over(Window.partitionBy("part")))


@C.add("df_pruned_tokens", "part:s tok:s df:i", f"SELECT part, tok, df FROM ({PRUNED(TOK)})")
def _(spark, d):
    return blocking.pruned(blocking.frequencies(toks(spark, d), sizes(spark, d)))


@C.add("tfidf_weights", "part:s side:i id:i tok:s w:d", WEIGHTED(TOK))
def _(spark, d):
    return weights(spark, d)


@C.add("topk_forward", "part:s s1:i cand:i score:d rank:i", FORWARD(TOK, 5))
def _(spark, d):
    return blocking.top_forward(scores(spark, d), 5)


@C.add("topk_reverse", "part:s s1:i cand:i score:d rank:i", REVERSE(TOK, 3))
def _(spark, d):
    return blocking.top_reverse(scores(spark, d), 3)


@C.add("topk_depth_split", "part:s s1:i cand:i score:d rank:i", f"SELECT r.* FROM ({FORWARD(TOK, 6)}) r JOIN ({REC}) d ON d.doc_id = r.s1 WHERE rank <= CASE WHEN length(addr) = 0 THEN 6 ELSE 3 END")
def _(spark, d):
    """Anchors without an address search twice as deep."""
    deep = records(spark, d).select(F.col("doc_id").alias("s1"), F.when(F.length("addr") == 0, 6).otherwise(3).alias("depth"))
    return blocking.top_forward(scores(spark, d), 6).join(deep, "s1").where("rank <= depth")


@C.add("topk_filtered_reverse", "part:s s1:i cand:i score:d rank:i", f"SELECT * FROM (SELECT c.*, row_number() OVER (PARTITION BY cand ORDER BY score DESC, s1) AS rank FROM ({SCORES(TOK)}) c JOIN ({REC}) d ON d.doc_id = c.cand WHERE length(addr) = 0) WHERE rank <= 25")
def _(spark, d):
    """Only pool records without an address search back."""
    bare = records(spark, d).where(F.length("addr") == 0).select(F.col("doc_id").alias("cand"))
    return blocking.top_reverse(scores(spark, d).join(bare, "cand", "left_semi"), 25)


POOL = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY sim DESC, cand) AS r FROM (SELECT a.id AS seed, b.id AS cand, round(sum(a.w * b.w), 9) AS sim FROM ({WEIGHTED(TOK)}) a JOIN ({WEIGHTED(TOK)}) b ON a.part = b.part AND a.tok = b.tok AND a.side = 1 AND b.side = 1 AND a.id <> b.id GROUP BY ALL)) WHERE r <= 5"


@C.add("two_hop", "part:s s1:i cand:i score:d rank:i", f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY score DESC, cand) AS rank FROM (SELECT f.part, f.s1, n.cand, max(round(f.score * n.sim, 9)) AS score FROM ({FORWARD(TOK, 3)}) f JOIN ({POOL}) n ON n.seed = f.cand WHERE f.score >= 0.3 AND n.sim >= 0.6 GROUP BY ALL)) WHERE rank <= 15")
def _(spark, d):
    w = table(weights(spark, d), "weights-name")
    pool, n = w.where("side = 1"), w.count()
    first = table(blocking.best_forward(w, 3, n), "first")
    seeds = first.where("score >= 0.3D").select(F.col("cand").alias("id")).distinct()  # others have no neighbours to give
    both = pool.join(seeds, "id", "left_semi").withColumn("side", F.lit(0)).unionByName(pool)
    # one more than five, as one of them may be the record itself
    near = blocking.top_forward(blocking.best_forward(both, 6, 2 * n).where("s1 <> cand"), 5).select(F.col("s1").alias("seed"), "cand", F.col("score").alias("sim"))
    return blocking.two_hop(first, near)


def _hits(spark: SparkSession, d: str) -> DataFrame:
    w = table(weights(spark, d), "weights-name")
    n = w.count()
    at = lambda df, c: df.select("s1", "cand", F.lit(c).alias("channel"), "score", "rank")
    return at(blocking.best_forward(w, 5, n), "name").unionByName(at(blocking.best_reverse(w, 3, n), "back")).unionByName(at(best(spark, d, 5, "addr"), "addr"))


HITS = f"SELECT s1, cand, 'name' AS channel, score, rank FROM ({FORWARD(TOK, 5)}) UNION ALL SELECT s1, cand, 'back', score, rank FROM ({REVERSE(TOK, 3)}) UNION ALL SELECT s1, cand, 'addr', score, rank FROM ({FORWARD(ATOK, 5)})"


@C.add(
    "union_provenance",
    "s1:i cand:i s_name:d k_name:i s_back:d k_back:i s_addr:d k_addr:i n_ch:i",
    "SELECT s1, cand, " + ", ".join(f"coalesce(max(score) FILTER (channel = '{c}'), 0) AS s_{c}, coalesce(min(rank) FILTER (channel = '{c}'), {k + 1}) AS k_{c}" for c, k in (("name", 5), ("back", 3), ("addr", 5))) + f", count(DISTINCT channel) AS n_ch FROM ({HITS}) GROUP BY s1, cand",
)
def _(spark, d):
    return blocking.union(_hits(spark, d), {"name": 5, "back": 3, "addr": 5})


@C.add("exact_cosines", "s1:i cand:i cos:d", f"WITH w AS ({WEIGHTED(TOK)}) SELECT p.s1, p.cand, coalesce(sum(a.w * b.w), 0) AS cos FROM (SELECT DISTINCT s1, cand FROM ({FORWARD(ATOK, 5)})) p LEFT JOIN w a ON a.id = p.s1 AND a.side = 0 LEFT JOIN w b ON b.id = p.cand AND b.side = 1 AND b.tok = a.tok GROUP BY p.s1, p.cand")
def _(spark, d):
    """Name cosines of pairs that the address channel found."""
    pairs = table(best(spark, d, 5, "addr").select("s1", "cand"), "pairs")
    return blocking.exact_cosines(pairs, table(weights(spark, d), "weights-name"))


@C.add("postal_agree", "s1:i cand:i eq:b conf:b", f"WITH p AS (SELECT doc_id, regexp_extract_all(text, '[0-9]{{5,}}') AS z FROM ({REC})) SELECT s1, cand, len(a.z) > 0 AND len(b.z) > 0 AND list_has_any(a.z, b.z) AS eq, len(a.z) > 0 AND len(b.z) > 0 AND NOT list_has_any(a.z, b.z) AS conf FROM ({FORWARD(TOK, 5)}) JOIN p a ON a.doc_id = s1 JOIN p b ON b.doc_id = cand")
def _(spark, d):
    z = records(spark, d).select("doc_id", N.postal(F.col("text")).alias("z"))
    p = blocking.top_forward(scores(spark, d), 5).join(z.select(F.col("doc_id").alias("s1"), F.col("z").alias("a")), "s1").join(z.select(F.col("doc_id").alias("cand"), F.col("z").alias("b")), "cand")
    eq, conf = blocking.postal_agreement(F.col("a"), F.col("b"))
    return p.select("s1", "cand", eq.alias("eq"), conf.alias("conf"))


@C.add("dense_topk", "s1:i cand:i score:d rank:i", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY score DESC, cand) AS rank FROM (SELECT a.vec_id AS s1, b.vec_id AS cand, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS score FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id % 5 = 0 AND b.vec_id % 5 <> 0)) WHERE rank <= 10")
def _(spark, d):
    e = read(spark, d, "embeddings").select(F.col("label").alias("part"), F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return dense.dense_topk(e.where("id % 5 = 0"), e.where("id % 5 <> 0"), 10)


# ---- pair features

URLS = "SELECT a.page_id, a.url AS x, b.url AS y FROM pages a JOIN pages b ON b.page_id = a.page_id + 1"


def urls(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "pages")
    return p.select("page_id", F.col("url").alias("x")).join(p.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("y")), "page_id")


@C.add("feat_levenshtein", "page_id:i sim:d", f"SELECT page_id, 1 - levenshtein(x, y) / greatest(length(x), length(y), 1)::DOUBLE AS sim FROM ({URLS})")
def _(spark, d):
    return urls(spark, d).select("page_id", (1 - F.levenshtein("x", "y") / F.greatest(F.length("x"), F.length("y"), F.lit(1))).alias("sim"))


@C.add("feat_jaro_winkler", "page_id:i sim:d", f"SELECT page_id, jaro_winkler_similarity(x, y) AS sim FROM ({URLS})")
def _(spark, d):
    return urls(spark, d).select("page_id", S.metric(S.jaro_winkler)("x", "y").alias("sim"))


@C.add("feat_prefix", "page_id:i sim:d", f"SELECT page_id, len(list_filter(range(1, least(length(x), length(y)) + 1), lambda i: substr(x, 1, i) = substr(y, 1, i))) / greatest(length(x), length(y), 1)::DOUBLE AS sim FROM ({URLS})")
def _(spark, d):
    x, y = F.col("x"), F.col("y")
    same = F.filter(F.sequence(F.lit(1), F.greatest(F.least(F.length(x), F.length(y)), F.lit(1))), lambda i: (i <= F.length(x)) & (i <= F.length(y)) & (x.substr(F.lit(1), i) == y.substr(F.lit(1), i)))
    return urls(spark, d).select("page_id", (F.size(same) / F.greatest(F.length(x), F.length(y), F.lit(1))).alias("sim"))


_plain = lambda c: f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"
_set = lambda c: f"list_sort(list_distinct(list_filter(string_split({c}, ' '), lambda w: w <> '')))"
_both = f"list_filter({_set('x')}, lambda w: list_contains({_set('y')}, w))"
_rest = lambda c: f"array_to_string(list_concat({_both}, list_filter({_set(c)}, lambda w: NOT list_contains({_both}, w))), ' ')"
_sorted = lambda c: f"array_to_string(list_sort(list_filter(string_split({c}, ' '), lambda w: w <> '')), ' ')"
#: Longest common subsequences by the rows of the dynamic programme: a row's entries are maxima over those before, so one step is a list function.
LCS = """RECURSIVE l AS (SELECT a, b, 0 AS n, list_transform(range(1, length(a) + 1), lambda i: 0::BIGINT) AS r FROM (SELECT DISTINCT a, b FROM jobs) UNION ALL
 SELECT a, b, n + 1, list_transform(range(1, length(a) + 1), lambda i: list_max(v[1:i])) FROM (SELECT a, b, n, list_transform(range(1, length(a) + 1), lambda i: greatest(r[i], CASE WHEN substr(a, i::INT, 1) = substr(b, n + 1, 1) THEN coalesce(r[i - 1], 0) + 1 ELSE 0 END)) AS v FROM l WHERE n < length(b)))"""
_ratio = "CASE WHEN length(d.a) + length(d.b) = 0 THEN 1.0 ELSE 2 * lcs / (length(d.a) + length(d.b))::DOUBLE END"


@C.add(
    "feat_ratio_family",
    "page_id:i indel:d tsort:d tset:d partial:d lcs:d",
    f"""WITH {LCS.replace('RECURSIVE l', f"RECURSIVE p AS (SELECT page_id, {_plain('x')} AS x, {_plain('y')} AS y FROM ({URLS})), jobs AS (SELECT page_id, 'r' AS k, x AS a, y AS b FROM p UNION ALL SELECT page_id, 's', {_sorted('x')}, {_sorted('y')} FROM p UNION ALL SELECT page_id, 't', {_rest('x')}, {_rest('y')} FROM p UNION ALL SELECT page_id, 'w', s, substr(t, greatest(i, 0) + 1, i + length(s) - greatest(i, 0)) FROM (SELECT page_id, CASE WHEN length(x) <= length(y) THEN x ELSE y END AS s, CASE WHEN length(x) <= length(y) THEN y ELSE x END AS t FROM p), unnest(range(1 - length(s), length(t))) u(i)), l")},
 d AS (SELECT a, b, coalesce(r[length(a)], 0) AS lcs FROM l WHERE n = length(b)), q AS (SELECT jobs.*, lcs, {_ratio} AS ratio FROM jobs JOIN d ON d.a = jobs.a AND d.b = jobs.b),
 m AS (SELECT page_id, max(ratio) FILTER (k = 'r') AS indel, max(ratio) FILTER (k = 's') AS tsort, max(ratio) FILTER (k = 't') AS tset, max(ratio) FILTER (k = 'w') AS win, max(lcs) FILTER (k = 'r') AS lcs FROM q GROUP BY page_id),
 z AS (SELECT page_id, x, y, length(array_to_string({_both}, ' ')) AS sh, length({_rest('x')}) AS lx, length({_rest('y')}) AS ly, len({_both}) AS nb, len({_set('x')}) AS nx, len({_set('y')}) AS ny FROM p)
 SELECT z.page_id, indel, tsort, CASE WHEN nb > 0 AND (nb = nx OR nb = ny) THEN 1.0 WHEN nb > 0 THEN greatest(tset, 2 * sh / (sh + lx)::DOUBLE, 2 * sh / (sh + ly)::DOUBLE) ELSE tset END AS tset,
 CASE WHEN least(length(x), length(y)) = 0 THEN CASE WHEN length(x) + length(y) = 0 THEN 1.0 ELSE 0.0 END ELSE win END AS partial, CASE WHEN length(x) + length(y) = 0 THEN 1.0 ELSE lcs / greatest(length(x), length(y))::DOUBLE END AS lcs FROM z JOIN m ON m.page_id = z.page_id""",
)
def _(spark, d):
    words = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    u = urls(spark, d).select("page_id", words("x").alias("x"), words("y").alias("y"))
    m = lambda n: S.metric(S.METRICS[n])("x", "y")
    return u.select("page_id", m("indel_ratio").alias("indel"), m("token_sort_ratio").alias("tsort"), m("token_set_ratio").alias("tset"), m("partial_ratio").alias("partial"), m("lcs_similarity").alias("lcs"))


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """The five best pool records of each anchor with both sides' normalized columns as structs a and b."""
    n = records(spark, d).select("doc_id", "src", "cty", name_toks().alias("nt"), addr_toks().alias("at"), N.postal(F.col("text")).alias("pc"), F.col("text"))
    n = n.withColumns({"nums": N.numbers(F.col("at")), "skel": F.transform("nt", N.skeleton)})
    side = lambda s, k: n.select(F.col("doc_id").alias(k), F.struct("src", "cty", "nt", "at", "pc", "nums", "skel").alias(s))
    return blocking.top_forward(scores(spark, d), 5).select("s1", "cand", "score").join(side("a", "s1"), "s1").join(side("b", "cand"), "cand")


SIDE = f"SELECT doc_id, src, cty, nt, adt, pc, list_distinct({nums_sql('adt')}) AS nums FROM (SELECT doc_id, src, cty, {NAME_SQL} AS nt, {ADDR_SQL} AS adt, list_distinct(regexp_extract_all(text, '[0-9]{{5,}}')) AS pc FROM ({REC}))"
PAIR = f"WITH n AS ({SIDE}), q AS (SELECT s1, cand, a.src AS asrc, b.src AS bsrc, a.cty AS acty, b.cty AS bcty, list_distinct(a.nt) AS an, list_distinct(b.nt) AS bn, list_distinct(a.adt) AS aa, list_distinct(b.adt) AS ba, a.nums AS anum, b.nums AS bnum, a.pc AS apc, b.pc AS bpc, a.nt AS an0, b.nt AS bn0, a.adt AS aa0, b.adt AS ba0 FROM ({FORWARD(TOK, 5)}) f JOIN n a ON a.doc_id = f.s1 JOIN n b ON b.doc_id = f.cand)"
LI = lambda a, b: f"len(list_intersect({a}, {b}))"


@C.add(
    "feat_sets",
    "s1:i cand:i name_jacc:d addr_ovl:d addr_cont_a:d addr_cont_b:d num_jacc:d num_shared:i num_conf:b post_eq:b post_conf:b post_miss:b name_in_addr:d n_first_eq:b",
    f"""{PAIR} SELECT s1, cand, CASE WHEN len(an) + len(bn) > 0 THEN {LI('an', 'bn')} / (len(an) + len(bn) - {LI('an', 'bn')}) END AS name_jacc, CASE WHEN least(len(aa), len(ba)) > 0 THEN {LI('aa', 'ba')} / least(len(aa), len(ba)) END AS addr_ovl,
 CASE WHEN len(aa) > 0 THEN {LI('aa', 'ba')} / len(aa) END AS addr_cont_a, CASE WHEN len(ba) > 0 THEN {LI('aa', 'ba')} / len(ba) END AS addr_cont_b, CASE WHEN len(anum) > 0 AND len(bnum) > 0 THEN {LI('anum', 'bnum')} / (len(anum) + len(bnum) - {LI('anum', 'bnum')}) END AS num_jacc,
 {LI('anum', 'bnum')} AS num_shared, CASE WHEN len(anum) > 0 AND len(bnum) > 0 THEN {LI('anum', 'bnum')} = 0 END AS num_conf, len(apc) > 0 AND len(bpc) > 0 AND {LI('apc', 'bpc')} > 0 AS post_eq, len(apc) > 0 AND len(bpc) > 0 AND {LI('apc', 'bpc')} = 0 AS post_conf, (len(apc) > 0) <> (len(bpc) > 0) AS post_miss,
 CASE WHEN len(an) > 0 THEN {LI('an', 'ba')} / len(an) END AS name_in_addr, coalesce(an0[1] = bn0[1], FALSE) AS n_first_eq FROM q""",
)
def _(spark, d):
    p = candidates(spark, d)
    u = lambda c: F.array_distinct(F.col(c))
    an, bn, aa, ba, anum, bnum = u("a.nt"), u("b.nt"), u("a.at"), u("b.at"), F.col("a.nums"), F.col("b.nums")
    both = (F.size(anum) > 0) & (F.size(bnum) > 0)
    eq, conf = blocking.postal_agreement(F.col("a.pc"), F.col("b.pc"))
    return p.select(
        "s1", "cand", X.jaccard(an, bn).alias("name_jacc"), X.overlap(aa, ba).alias("addr_ovl"), X.containment(aa, ba).alias("addr_cont_a"), X.containment(ba, aa).alias("addr_cont_b"),
        F.when(both, X.jaccard(anum, bnum)).alias("num_jacc"), F.size(F.array_intersect(anum, bnum)).alias("num_shared"), F.when(both, ~F.arrays_overlap(anum, bnum)).alias("num_conf"), eq.alias("post_eq"), conf.alias("post_conf"),
        ((F.size("a.pc") > 0) != (F.size("b.pc") > 0)).alias("post_miss"), X.containment(an, ba).alias("name_in_addr"), F.coalesce(F.get("a.nt", F.lit(0)) == F.get("b.nt", F.lit(0)), F.lit(False)).alias("n_first_eq"),
    )


@C.add("feat_flags", "s1:i cand:i ntok_a:i ntok_b:i atok_a:i atok_b:i a_empty_a:b a_empty_b:b is_s3:b same_cty:b n_cands:i", f"{PAIR} SELECT s1, cand, len(an0) AS ntok_a, len(bn0) AS ntok_b, len(aa0) AS atok_a, len(ba0) AS atok_b, len(aa0) = 0 AS a_empty_a, len(ba0) = 0 AS a_empty_b, bsrc = 'S3' AS is_s3, acty = bcty AS same_cty, count(*) OVER (PARTITION BY s1) AS n_cands FROM q")
def _(spark, d):
    from pyspark.sql import Window

    z = F.size
    return candidates(spark, d).select("s1", "cand", z("a.nt").alias("ntok_a"), z("b.nt").alias("ntok_b"), z("a.at").alias("atok_a"), z("b.at").alias("atok_b"), (z("a.at") == 0).alias("a_empty_a"), (z("b.at") == 0).alias("a_empty_b"), (F.col("b.src") == "S3").alias("is_s3"), (F.col("a.cty") == F.col("b.cty")).alias("same_cty"), F.count("*").over(Window.partitionBy("s1")).alias("n_cands"))


@C.add("feat_rarity", "doc_id:i n_pool:d n_s1:d a_all:d", f"""WITH k AS (SELECT doc_id, src, cty, trim(regexp_replace(lower(name), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS n, trim(regexp_replace(lower(addr), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS a FROM ({REC}))
 SELECT doc_id, ln(1 + count(*) FILTER (src <> 'S1') OVER (PARTITION BY cty, n)) AS n_pool, ln(1 + count(*) FILTER (src = 'S1') OVER (PARTITION BY cty, n)) AS n_s1, CASE WHEN a <> '' THEN ln(1 + count(*) OVER (PARTITION BY cty, a)) ELSE 0 END AS a_all FROM k""")
def _(spark, d):
    """Counts by key with partial sums, joined back: a name that a third of all records have is no single task's."""
    k = records(spark, d).select("doc_id", "src", "cty", X.squeezed(F.col("name")).alias("n"), X.squeezed(F.col("addr")).alias("a")).withColumns({"hn": F.xxhash64("n"), "ha": F.xxhash64("a")})
    names = k.groupBy("cty", "hn", "n").agg(F.log1p(F.count_if(F.col("src") != "S1").cast("double")).alias("n_pool"), F.log1p(F.count_if(F.col("src") == "S1").cast("double")).alias("n_s1"))
    addrs = k.where("a <> ''").groupBy("cty", "ha", "a").agg(F.log1p(F.count("*").cast("double")).alias("a_all"))
    return k.join(names, ["cty", "hn", "n"]).join(addrs, ["cty", "ha", "a"], "left").select("doc_id", "n_pool", "n_s1", F.coalesce("a_all", F.lit(0.0)).alias("a_all"))


_PATTERN = lambda a: f"regexp_replace(regexp_replace({a}, '(.)', '\\1\\\\D*', 'g'), '\\\\D\\*$', '')"
_ABB = lambda a, b: f"(length({a}) > 1 AND length({a}) < length({b}) AND NOT regexp_matches({a}, '[0-9]') AND regexp_matches({b}, CASE WHEN length({a}) > 2 THEN '^' || {_PATTERN(a)} || '\\D*$' ELSE '^(' || {a} || '\\D*|' || {_PATTERN(a)} || ')$' END))"
_SIM = lambda x, y: f"""CASE WHEN {x} = {y} THEN 1.0 WHEN {_ABB(x, y)} OR {_ABB(y, x)} THEN 0.9 WHEN regexp_matches({x}, '^[0-9]+$') OR regexp_matches({y}, '^[0-9]+$') THEN 0.0 WHEN least(length({x}), length({y})) < 2 THEN CASE WHEN substr({x}, 1, 1) = substr({y}, 1, 1) THEN 0.5 ELSE 0.0 END
 WHEN least(length({x}), length({y})) > 3 THEN CASE WHEN jaro_winkler_similarity({x}, {y}) >= 0.9 THEN jaro_winkler_similarity({x}, {y}) WHEN length({x}) >= 5 AND {N.skeleton_sql(x)} = {N.skeleton_sql(y)} THEN 0.85 ELSE 0.0 END ELSE 0.0 END"""  # noqa: E731
_both_sides = lambda x: f"CASE WHEN len(a) > 0 AND len(b) > 0 THEN {x} ELSE 0.0 END"
#: The greedy choice, one candidate of each pair of names at a time, best first.
ALIGNED = f"""WITH RECURSIVE n AS MATERIALIZED (SELECT doc_id, ({NAME_SQL})[1:{R.MOST_TOKENS}] AS t FROM ({REC})),
p AS MATERIALIZED (SELECT f.s1, f.cand, x.t AS a, y.t AS b FROM ({FORWARD(TOK, 5)}) f JOIN n x ON x.doc_id = f.s1 JOIN n y ON y.doc_id = f.cand),
e AS MATERIALIZED (SELECT s1, cand, i, j, a[i] AS x, b[j] AS y, ln(1 + length(a[i])) AS wa, ln(1 + length(b[j])) AS wb FROM p, unnest(range(1, len(a) + 1)) u(i), unnest(range(1, len(b) + 1)) v(j)),
k AS MATERIALIZED (SELECT x, y, {_SIM('x', 'y')} AS s FROM (SELECT DISTINCT x, y FROM e)),
o AS MATERIALIZED (SELECT s1, cand, list({{'s': s, 'i': i, 'j': j, 'wa': wa, 'wb': wb}} ORDER BY s * (wa + wb) / 2 DESC, s DESC, i DESC, j DESC) AS c FROM e JOIN k ON k.x = e.x AND k.y = e.y WHERE s > 0 GROUP BY s1, cand),
g(s1, cand, c, m, ua, ub, got) AS (SELECT s1, cand, c, 1, [0::BIGINT], [0::BIGINT], c[1:0] FROM o UNION ALL SELECT s1, cand, c, m + 1, CASE WHEN ok THEN list_append(ua, c[m].i) ELSE ua END, CASE WHEN ok THEN list_append(ub, c[m].j) ELSE ub END, CASE WHEN ok THEN list_append(got, c[m]) ELSE got END
 FROM (SELECT *, NOT list_contains(ua, c[m].i) AND NOT list_contains(ub, c[m].j) AS ok FROM g WHERE m <= len(c))),
r AS (SELECT p.s1, p.cand, a, b, coalesce(ua, []) AS ua, coalesce(ub, []) AS ub, got, list_transform(a, lambda w: ln(1 + length(w))) AS wa, list_transform(b, lambda w: ln(1 + length(w))) AS wb FROM p LEFT JOIN (SELECT * FROM g WHERE m = len(c) + 1) h ON h.s1 = p.s1 AND h.cand = p.cand),
t AS (SELECT *, greatest(coalesce(list_sum(wa), 0), 1e-9) AS ta, greatest(coalesce(list_sum(wb), 0), 1e-9) AS tb, coalesce(list_sum(list_transform(got, lambda q: q.s * q.wa)), 0) AS na, coalesce(list_sum(list_transform(got, lambda q: q.s * q.wb)), 0) AS nb, list_transform(list_filter(got, lambda q: q.s >= 0.85), lambda q: least(q.wa, q.wb)) AS sh FROM r)
SELECT t.s1, t.cand, {_both_sides('(na + nb) / (ta + tb)')} AS sd, {_both_sides('na / ta')} AS cov_a, {_both_sides('nb / tb')} AS cov_b, coalesce(list_max(list_filter(wa, lambda w, i: NOT list_contains(ua, i))), 0) AS mu_a, coalesce(list_max(list_filter(wb, lambda w, i: NOT list_contains(ub, i))), 0) AS mu_b,
 {_both_sides('coalesce(list_max(sh), 0)')} AS sh_max, {_both_sides('coalesce(list_min(sh), 0)')} AS sh_min, k.s AS first_sim FROM t LEFT JOIN k ON k.x = a[1] AND k.y = b[1]"""


@C.add("feat_alignment", "s1:i cand:i sd:d cov_a:d cov_b:d mu_a:d mu_b:d sh_max:d sh_min:d first_sim:d", ALIGNED)
def _(spark, d):
    """Soft alignment of the names' first MOST_TOKENS tokens, as pair features have it; every token's weight is the log of its length
    here, so that no lookup is needed."""
    w = lambda c: F.transform(c, lambda x: F.ln(1 + F.length(x)))
    p = candidates(spark, d).withColumn("al", R.align("a.nt", "b.nt", w("a.nt"), w("b.nt"), R.MOST_TOKENS))
    return p.select("s1", "cand", "al.*", R.similarity(F.get("a.nt", F.lit(0)), F.get("b.nt", F.lit(0))).alias("first_sim"))


_core, _forms = N.legal_sql("t")
_canon = lambda x: N.canonical_sql(N.words_sql(x))
#: The Latin path of records.normalized, stage by stage.
NORMAL = f"""WITH f AS (SELECT doc_id, {N.repair_digits_sql(N.fold_latin_sql('name'))} AS n, {N.steps_sql(N.fold_latin_sql('addr'), N.ADDRESS_STEPS)} AS a FROM ({REC})),
m AS (SELECT doc_id, a, CASE WHEN len(list_filter(list_concat(regexp_extract_all(n, '{N.LABEL}', 1), regexp_extract_all(n, '{N.HANDLE}', 1)), lambda x: regexp_replace(x, '[^a-z0-9]+', '', 'g') <> '')) > 0 THEN regexp_replace(n, '{N.MARKS}', ' ', 'g') ELSE n END AS n FROM f),
p AS (SELECT doc_id, n, a, list_filter(list_transform(string_split_regex(regexp_replace(n, '{N.DBA}', '|', 'g'), '[|()\\[\\]]'), lambda x: {_canon('x')}), lambda t: len(t) > 0) AS p, string_split_regex(a, '[,;\\n]') AS s FROM m),
c AS (SELECT doc_id, n, a, list_transform(p, lambda t: {_core}) AS v, flatten(list_transform(p, lambda t: {_forms})) AS l, flatten(list_transform(s, lambda x: {_canon(f"CASE WHEN regexp_matches(x, '{N.LANDMARK}') THEN regexp_extract(x, '^(.*?)(?:{N.LANDMARK})', 1) ELSE x END")})) AS a_core,
 flatten(list_transform(s, lambda x: {_canon(f"regexp_extract(x, '(?:{N.LANDMARK})(.*)', 1)")})) AS a_landmark, {nums_sql("flatten(list_transform(s, lambda x: " + _canon(f"CASE WHEN regexp_matches(x, '{N.LANDMARK}') THEN regexp_extract(x, '^(.*?)(?:{N.LANDMARK})', 1) ELSE x END") + "))")} AS an, regexp_extract_all(a, '[0-9]{{5,}}') AS z FROM p),
d AS (SELECT *, flatten(v) AS w, {_canon('n')} AS n_full FROM c),
e AS (SELECT *, {once_sql('w')} AS core FROM d)
SELECT doc_id, array_to_string(core, ' ') AS n_core, array_to_string(n_full, ' ') AS n_full, array_to_string(list_sort(list_distinct(l)), ' ') AS n_legal, array_to_string(list_filter(list_transform(core, lambda w: {N.skeleton_sql('w')}), lambda w: w <> ''), ' ') AS n_skel,
 array_to_string(a_core, ' ') AS a_core, array_to_string(a_landmark, ' ') AS a_landmark, array_to_string({once_sql('an')}, ' ') AS a_nums, array_to_string({once_sql('z')}, ' ') AS a_postal, CASE WHEN len(v) > 1 THEN len(v) ELSE 0 END AS variants FROM e"""


@C.add("normalize_record", "doc_id:i n_core:s n_full:s n_legal:s n_skel:s a_core:s a_landmark:s a_nums:s a_postal:s variants:i", NORMAL)
def _(spark, d):
    r = R.normalized(records(spark, d))
    return r.select("doc_id", *[joined(F.col(c)).alias(c) for c in ("n_core", "n_full", "n_legal", "n_skel", "a_core", "a_landmark", "a_nums", "a_postal")], F.size("n_variants").alias("variants"))


@C.add("legal_forms", "p_partkey:i core:s legal:s", f"SELECT p_partkey, array_to_string({_core}, ' ') AS core, array_to_string({_forms}, ' ') AS legal FROM (SELECT p_partkey, string_split(CASE p_partkey % 6 WHEN 0 THEN 'ms shri ' || p_name WHEN 1 THEN p_name || ' pvt ltd' WHEN 2 THEN 'ltd' WHEN 3 THEN p_name || ' co ltd llc' WHEN 4 THEN 'sarl ' || string_split(p_name, ' ')[1] || ' gmbh co kg' ELSE p_name END, ' ') AS t FROM part)")
def _(spark, d):
    """Part names with legal forms around."""
    k, n = F.pmod("p_partkey", F.lit(6)), F.col("p_name")
    forms = F.when(k == 0, F.concat(F.lit("ms shri "), n)).when(k == 1, F.concat(n, F.lit(" pvt ltd"))).when(k == 2, F.lit("ltd")).when(k == 3, F.concat(n, F.lit(" co ltd llc"))).when(k == 4, F.concat(F.lit("sarl "), F.get(F.split(n, " "), F.lit(0)), F.lit(" gmbh co kg"))).otherwise(n)
    x = read(spark, d, "part").select("p_partkey", N.legal_apart(F.split(forms, " ")).alias("x"))
    return x.select("p_partkey", joined(F.col("x.core")).alias("core"), joined(F.col("x.legal")).alias("legal"))


_LONG = "SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part"
_SHORT = f"SELECT w AS x FROM ({_LONG}) UNION SELECT substr(w, 1, 2) FROM ({_LONG}) UNION SELECT substr(w, 1, 1) FROM ({_LONG}) UNION SELECT substr(w, 1, 1) || substr(w, 3, 1) || substr(w, length(w), 1) FROM ({_LONG}) UNION SELECT substr(w, 1, 1) || substr(w, length(w), 1) FROM ({_LONG}) UNION SELECT w || w FROM ({_LONG}) UNION SELECT replace(w, 'e', 'a') || 's' FROM ({_LONG}) UNION SELECT substr(w, 1, 1) || '7' FROM ({_LONG})"
_TOKENS = f"SELECT a.x, b.w AS y FROM ({_SHORT}) a JOIN ({_LONG}) b ON substr(a.x, 1, 1) = substr(b.w, 1, 1)"
def _tokens(spark: SparkSession, d: str) -> DataFrame:
    """Words of part names against shortened and altered ones of the same first letter."""
    w = read(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("w")).distinct()
    c, n = F.col("w"), F.length("w")
    first, last = F.substring(c, 1, 1), c.substr(n, F.lit(1))
    forms = F.array(c, F.substring(c, 1, 2), first, F.concat(first, F.substring(c, 3, 1), last), F.concat(first, last), F.concat(c, c), F.concat(F.replace(c, F.lit("e"), F.lit("a")), F.lit("s")), F.concat(first, F.lit("7")))
    x = w.select(F.explode(forms).alias("x")).distinct().withColumn("f", F.substring("x", 1, 1))
    return x.join(w.select(c.alias("y"), first.alias("f")), "f").drop("f")


@C.add("token_abbreviations", "x:s y:s short:b", f"SELECT x, y, {_ABB('x', 'y')} AS short FROM ({_TOKENS})")
def _(spark, d):
    return _tokens(spark, d).select("x", "y", R.abbreviates(F.col("x"), F.col("y")).alias("short"))


@C.add("token_similarity", "x:s y:s sim:d", f"SELECT x, y, {_SIM('x', 'y')} AS sim FROM ({_TOKENS})")
def _(spark, d):
    return _tokens(spark, d).select("x", "y", R.similarity("x", "y").alias("sim"))


def _vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """(word, n) of the words of part names and of the records' names."""
    from kindred.operators.lexicon import vocabulary

    parts = read(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("word"))
    return vocabulary(parts.unionByName(records(spark, d).select(F.explode(name_toks()).alias("word"))))


@C.add("segment_words", "host:s parts:s")
def _(spark, d):
    """All labels of all domains in the pages' URLs and run-together part names, cut by the whole vocabulary."""
    p = read(spark, d, "pages").select(F.explode(F.flatten(F.transform(N.domains(F.col("url")), lambda x: F.split(x, "[.-]")))).alias("token"))
    run = read(spark, d, "part").select(F.explode(F.array(F.replace("p_name", F.lit(" "), F.lit("")), F.concat(F.replace("p_name", F.lit(" "), F.lit("")), F.lit("com")))).alias("token"))
    return R.segmented(p.unionByName(run), _vocabulary(spark, d)).select(F.col("token").alias("host"), joined("parts").alias("parts"))


@C.add("normalize_web_names", "p_partkey:i n_core:s n_full:s")
def _(spark, d):
    """Part names run together as web addresses and handles, taken apart by the vocabulary."""
    k, n = F.pmod("p_partkey", F.lit(3)), F.replace("p_name", F.lit(" "), F.lit(""))
    web = F.when(k == 0, F.concat(F.lit("www."), n, F.lit(".com"))).when(k == 1, F.concat(F.lit("@"), n, F.lit(" Ltd"))).otherwise(F.col("p_name"))
    r = read(spark, d, "part").select("p_partkey", web.alias("name"), F.lit("").alias("addr"))
    r = R.normalized(r, key="p_partkey", vocabulary=_vocabulary(spark, d))
    return r.select("p_partkey", joined("n_core").alias("n_core"), joined("n_full").alias("n_full"))


@C.add("fold_any_script", "s:s folded:s")
def _(spark, d):
    """Names with marks and in Indic script, folded; the latter made of the records' own ids and inline words."""
    t = read(spark, d, "nation").select(F.concat(F.col("n_name"), F.lit(" प्राइवेट लिमिटेड Straße Œuvre")).alias("s"))
    return t.select("s", R.fold_any("s").alias("folded"))
