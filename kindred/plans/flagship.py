"""One query end to end: records to blocked pairs, closed-form scores, exclusivity, expected-F0.5 choice, id lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions import normalize as N
from kindred.operators import blocking, decision
from kindred.plans.decisions import CLAIMS, VALS
from kindred.plans.texts import ADDR_SQL, NAME_SQL, REC, WEIGHTED, sizes
from kindred.sources.files import id_lists
from kindred.sources.tables import records


def resolve(spark: SparkSession, d: str, k: int = 5) -> DataFrame:
    """(s1, matched_entity_ids) of every anchor of the records made of ``documents``.

    Name and address tokens are joined once; the k best pool records of an anchor compete with the mean of both cosines as
    probability. Records whose tokens are all too common meet those of the very same tokens. A pool record goes to the anchor
    with the best claim.
    """
    r = records(spark, d)
    toks = F.concat(N.tokens(N.fold_latin(F.col("name"))), F.transform(N.tokens(N.clean_address(F.col("addr"))), lambda w: F.concat(F.lit("@"), w)))
    pairs = blocking.best_and_copies(r, toks, sizes(spark, d), k)
    scored = pairs.select("s1", "cand", F.least(F.lit(0.999), F.greatest(F.lit(0.0), F.col("score"))).alias("p"))
    chosen = decision.run_policy(scored, "hard")
    anchors = r.where("src = 'S1'").select(F.col("doc_id").alias("s1"))
    return id_lists(anchors, chosen, [-F.col("q")])


_TOKENS = f"SELECT cty AS part, CASE WHEN src = 'S1' THEN 0 ELSE 1 END AS side, doc_id AS id, unnest(list_concat({NAME_SQL}, list_transform({ADDR_SQL}, lambda w: '@' || w))) AS tok FROM ({REC})"
_LEFT = "SELECT part, side, id, list(tok ORDER BY tok) AS toks FROM t WHERE id NOT IN (SELECT id FROM w) GROUP BY part, side, id"
#: The same in SQL: blocking, copies of records without a rare token, the five best, the best claim of a record, the set of the
#: largest expected F0.5, one owner, lists.
ORACLE = f"""WITH t AS MATERIALIZED ({_TOKENS}), w AS MATERIALIZED ({WEIGHTED('SELECT * FROM t')}), l AS MATERIALIZED ({_LEFT}),
found AS (SELECT * FROM (SELECT a.id AS s1, b.id AS cand, round(sum(a.w * b.w), 9) AS score FROM w a JOIN w b ON a.part = b.part AND a.tok = b.tok AND a.side = 0 AND b.side = 1 GROUP BY ALL) WHERE score > 1e-9 UNION ALL SELECT a.id, b.id, 1.0 FROM l a JOIN l b ON a.part = b.part AND a.toks = b.toks AND a.side = 0 AND b.side = 1),
five AS MATERIALIZED (SELECT s1, cand, least(0.999, greatest(0.0, score)) AS p FROM found QUALIFY row_number() OVER (PARTITION BY s1 ORDER BY score DESC, cand) <= 5),
hard AS MATERIALIZED (SELECT s1, cand, CASE WHEN rk = 1 AND p > 0 THEN 1 / (1 + exp(-ln(c / (1 - c)))) ELSE 0 END AS p FROM (SELECT *, greatest(1e-7, least(1 - 1e-7, p)) AS c, row_number() OVER (PARTITION BY cand ORDER BY p DESC, s1) AS rk FROM five)),
q AS (SELECT * FROM ({VALS.replace(f'({CLAIMS})', 'hard')}, b AS (SELECT s1, k FROM v QUALIFY row_number() OVER (PARTITION BY s1 ORDER BY round(val, 9) DESC, k) = 1) SELECT r.s1, r.cand, r.p AS q FROM r JOIN b ON b.s1 = r.s1 AND r.i <= b.k QUALIFY row_number() OVER (PARTITION BY r.cand ORDER BY r.p DESC, r.s1) = 1))
SELECT d.doc_id AS s1, coalesce(ids, '') AS matched_entity_ids FROM ({REC}) d LEFT JOIN (SELECT s1, string_agg(cand::VARCHAR, ',' ORDER BY q DESC, cand) AS ids FROM q GROUP BY s1) m ON m.s1 = d.doc_id WHERE d.src = 'S1'"""
