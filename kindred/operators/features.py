"""Features of a pair of normalized records: string metrics, soft alignment, sets, numbers, rarity and flags.

Takes pairs (s1, cand) and normalized records (id, src, cty and the columns of ``records.normalized``), joins each side once and
adds all columns in one projection; metrics in Python see each distinct pair of strings of a batch once. What does not apply is
null: a_* and af_* where an address is empty, conflicts of numbers where a side has none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions import columns as X
from kindred.functions import normalize as N
from kindred.functions import records as R
from kindred.functions import strings as S
from kindred.operators.blocking import postal_agreement

FIELDS = ("src", "cty", "n_core", "n_full", "n_legal", "n_variants", "n_skel", "n_nums", "a_core", "a_full", "a_landmark", "a_nums", "a_postal")
#: Weight of a token without a known inverse document frequency.
DEFAULT_IDF = 8.0


def with_idf(normal: DataFrame, freq: DataFrame) -> DataFrame:
    """Adds n_w and a_w: the weights of n_core and a_core from (part, tok, idf), the largest of the part for unknown tokens.

    Words are exploded, joined by (part, word) and put back in order, so the table of frequencies may have any size.
    """
    out = normal
    top = freq.groupBy("part").agg(F.max("idf").alias("__top"))
    for tokens, to in (("n_core", "n_w"), ("a_core", "a_w")):
        e = normal.select("id", F.col("cty").alias("part"), F.posexplode(tokens).alias("__i", "tok"))
        e = e.join(freq.select("part", "tok", "idf"), ["part", "tok"], "left").join(top, "part", "left")
        w = e.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", F.coalesce("idf", "__top", F.lit(DEFAULT_IDF)).alias("w")))), lambda x: x["w"]).alias(to))
        out = out.join(w, "id", "left").withColumn(to, F.coalesce(to, F.array().cast("array<double>")))
    return out


def prefix_similarity(a: Column, b: Column) -> Column:
    n = F.least(F.length(a), F.length(b))
    same = F.size(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i <= n) & (a.substr(F.lit(1), i) == b.substr(F.lit(1), i))))
    return same / F.greatest(F.length(a), F.length(b), F.lit(1))


def legal_flags(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """(equal, conflict, one missing): 0 or 1, never null."""
    sa, sb = F.array_sort(F.array_distinct(a)), F.array_sort(F.array_distinct(b))
    both = (F.size(a) > 0) & (F.size(b) > 0)
    return (both & (sa == sb)).cast("int"), (both & ~F.arrays_overlap(a, b)).cast("int"), ((F.size(a) > 0) != (F.size(b) > 0)).cast("int")


def best_variant(pairs: DataFrame) -> DataFrame:
    """(s1, cand, n_var_sd): the best alignment of any pieces of two names, where a name has several; pieces weigh alike."""
    v = lambda c, core: F.when(F.size(c) > 0, c).otherwise(F.array(core))
    some = pairs.where((F.size("a.n_variants") > 0) | (F.size("b.n_variants") > 0))
    e = some.select("s1", "cand", F.explode(v(F.col("a.n_variants"), F.col("a.n_core"))).alias("x"), F.col("b").alias("b")).select("s1", "cand", "x", F.explode(v(F.col("b.n_variants"), F.col("b.n_core"))).alias("y"))
    one = lambda c: F.transform(c, lambda _: F.lit(1.0))
    return e.withColumn("al", R.align("x", "y", one(F.col("x")), one(F.col("y")), R.MOST_TOKENS)).groupBy("s1", "cand").agg(F.max("al.sd").alias("n_var_sd"))


def pair_features(pairs: DataFrame, normal: DataFrame) -> DataFrame:
    """``pairs`` and their features; ``normal`` has id, FIELDS, n_w and a_w."""
    side = lambda s, k: normal.select(F.col("id").alias(k), F.struct(*FIELDS, "n_w", "a_w").alias(s))
    p = pairs.join(side("a", "s1"), "s1").join(side("b", "cand"), "cand")
    text = lambda c: F.array_join(F.col(c), " ")
    p = p.withColumns({f"__{s}_{f}": text(f"{s}.{f}") for s in "ab" for f in ("n_core", "n_full", "a_core", "a_full")})
    p = p.withColumns({f"__{s}_j": F.concat_ws(" ", f"__{s}_n_core", f"__{s}_a_core") for s in "ab"})
    two = lambda f: (F.col(f"__a_{f}"), F.col(f"__b_{f}"))
    m = lambda name, f: S.metric(S.METRICS[name])(*two(f))
    lev = lambda f: 1 - F.levenshtein(*two(f)) / F.greatest(F.length(two(f)[0]), F.length(two(f)[1]), F.lit(1))
    bare = (F.length("__a_a_core") == 0) | (F.length("__b_a_core") == 0)
    bare_full = (F.length("__a_a_full") == 0) | (F.length("__b_a_full") == 0)
    addr = lambda c: F.when(~bare, c)
    full = lambda c: F.when(~bare_full, c)
    p = p.withColumns({"__na": R.align("a.n_core", "b.n_core", "a.n_w", "b.n_w", R.MOST_TOKENS), "__aa": R.align("a.a_core", "b.a_core", "a.a_w", "b.a_w", R.MOST_TOKENS)})
    u = lambda c: F.array_distinct(F.col(c))
    at = lambda c, i: F.get(c, i) if i >= 0 else F.get(c, F.size(c) - 1)
    eq, conf, miss = legal_flags(F.col("a.n_legal"), F.col("b.n_legal"))
    post_eq, post_conf = postal_agreement(F.col("a.a_postal"), F.col("b.a_postal"))
    both_nn = (F.size("a.n_nums") > 0) & (F.size("b.n_nums") > 0)
    both_an = (F.size("a.a_nums") > 0) & (F.size("b.a_nums") > 0)
    z = lambda c: F.size(c).cast("bigint")
    f = {
        "n_jw": m("jaro_winkler", "n_core"), "nf_jw": m("jaro_winkler", "n_full"), "a_jw": addr(m("jaro_winkler", "a_core")),
        "n_lev": lev("n_core"), "a_lev": addr(lev("a_core")), "n_ratio": m("indel_ratio", "n_core"),
        "n_tsort": m("token_sort_ratio", "n_core"), "a_tsort": addr(m("token_sort_ratio", "a_core")), "j_tsort": m("token_sort_ratio", "j"),
        "n_tset": m("token_set_ratio", "n_core"), "nf_tset": m("token_set_ratio", "n_full"), "a_tset": addr(m("token_set_ratio", "a_core")), "af_tset": full(m("token_set_ratio", "a_full")), "j_tset": m("token_set_ratio", "j"),
        "n_partial": m("partial_ratio", "n_core"), "a_partial": addr(m("partial_ratio", "a_core")), "af_partial": full(m("partial_ratio", "a_full")),
        "n_lcs": m("lcs_similarity", "n_core"), "a_lcs": addr(m("lcs_similarity", "a_core")), "n_prefix": prefix_similarity(*two("n_core")),
        **{f"n_{k}": F.col(f"__na.{k}") for k in ("sd", "cov_a", "cov_b", "mu_a", "mu_b", "sh_max", "sh_min", "idf_a", "idf_b")},
        **{f"a_{k}": F.col(f"__aa.{k}") for k in ("sd", "cov_a", "cov_b", "mu_a", "mu_b", "sh_max")},
        "legal_eq": eq, "legal_conf": conf, "legal_miss1": miss, "acronym": N.acronym(F.col("a.n_core"), F.col("b.n_core")).cast("int"), "skel_jacc": X.jaccard(u("a.n_skel"), u("b.n_skel")),
        "nnum_eq": F.when(both_nn, F.arrays_overlap("a.n_nums", "b.n_nums").cast("int")), "nnum_conf": F.when(both_nn, (~F.arrays_overlap("a.n_nums", "b.n_nums")).cast("int")),
        "n_first_eq": F.coalesce((at("a.n_core", 0) == at("b.n_core", 0)).cast("int"), F.lit(0)), "n_first_sim": R.similarity(at("a.n_core", 0), at("b.n_core", 0)), "n_last_sim": R.similarity(at("a.n_core", -1), at("b.n_core", -1)),
        "a_ovl": addr(X.overlap(u("a.a_core"), u("b.a_core"))), "a_cont_a": addr(X.containment(u("a.a_core"), u("b.a_core"))), "a_cont_b": addr(X.containment(u("b.a_core"), u("a.a_core"))),
        "lm_cross": F.greatest(X.containment(u("a.a_landmark"), u("b.a_full")), X.containment(u("b.a_landmark"), u("a.a_full"))),
        "num_jacc": F.when(both_an, X.jaccard(F.col("a.a_nums"), F.col("b.a_nums"))), "num_first_eq": F.when(both_an, (F.get("a.a_nums", F.lit(0)) == F.get("b.a_nums", F.lit(0))).cast("int")),
        "num_conf": F.when(both_an, (~F.arrays_overlap("a.a_nums", "b.a_nums")).cast("int")), "num_shared": z(F.array_intersect("a.a_nums", "b.a_nums")),
        "post_eq2": post_eq.cast("int"), "post_conf2": post_conf.cast("int"), "post_miss1": ((F.size("a.a_postal") > 0) != (F.size("b.a_postal") > 0)).cast("int"),
        "name_in_addr_a": X.containment(u("a.n_core"), u("b.a_full")), "name_in_addr_b": X.containment(u("b.n_core"), u("a.a_full")),
        "ntok_n_a": z("a.n_core"), "ntok_n_b": z("b.n_core"), "ntok_a_a": z("a.a_core"), "ntok_a_b": z("b.a_core"), "a_empty_a": (F.size("a.a_core") == 0).cast("int"), "a_empty_b": (F.size("b.a_core") == 0).cast("int"),
        "is_s3": (F.col("b.src") == "S3").cast("int"), "same_cty": F.col("a.cty").eqNullSafe(F.col("b.cty")).cast("int"), "n_cands": F.count("*").over(Window.partitionBy("s1")),
    }
    out = p.select(*pairs.columns, *[c.alias(k) for k, c in f.items()])
    v = best_variant(p)
    out = out.join(v, ["s1", "cand"], "left")
    return out.withColumn("n_var_gain", F.greatest(F.col("n_var_sd") - F.col("n_sd"), F.lit(0.0)))


def attach(features: DataFrame, union: DataFrame, cosines: dict[str, DataFrame], rarity: DataFrame) -> DataFrame:
    """Adds provenance (blocking.union), exact cosines by name (s1, cand, cos) and log counts of both sides' names and addresses (id, n_pool, n_s1, a_all)."""
    out = features.join(union, ["s1", "cand"], "left")
    for name, c in cosines.items():
        out = out.join(c.withColumnRenamed("cos", f"cos_{name}"), ["s1", "cand"], "left").fillna(0.0, [f"cos_{name}"])
    for side, key in (("a", "s1"), ("b", "cand")):
        out = out.join(rarity.select(F.col("id").alias(key), *[F.col(c).alias(f"{c}_{side}") for c in ("n_pool", "n_s1", "a_all")]), key, "left")
    return out
