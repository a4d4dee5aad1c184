"""The channels of blocking: token tables, searches forward and back, one union with provenance, and the meta-blocker over it.

Every channel searches a table of weights by token. Blocks of records hold all tables, so one product of blocks with blocks serves all
searches, forward and back, and one more the cosines of what they found (``packs``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions import normalize as N
from kindred.operators import blocking, calibration, models, packs
from kindred.operators.ranking import grouped_rank
from kindred.sources.shared import table


@dataclass(frozen=True)
class Channel:
    """A search: by which tokens, how many to keep, from the pool's side or not, and for all records or only those without an address."""

    tokens: str
    depth: int
    back: bool = False
    bare: bool = False


#: The channels by name. keys: joined, sorted and initial forms of a name; name, skel, addr, joint: words with what
#: blocking makes of them; house: house number and locality.
CHANNELS = {
    "c1": Channel("keys", 10),
    "c2": Channel("name", 15),
    "c3": Channel("skel", 10),
    "c4": Channel("addr", 10),
    "c5": Channel("joint", 20),
    "c6": Channel("joint", 5, back=True),
    "c7": Channel("house", 10),
    "c8": Channel("name", 25, back=True, bare=True),
    "c9": Channel("name", 5, back=True),
}
#: Cosines of a pair by the token tables: characters, words and skeletons of names, characters and words of addresses, both together.
COSINES = {"n_cos_c": "name_chars", "n_cos_w": "name", "n_cos_s": "skel", "a_cos_c": "addr_chars", "a_cos_w": "addr", "j_cos_c": "joint"}
#: Places of the token tables, in the order of ``token_columns``.
TABLES = {k: i for i, k in enumerate(("keys", "name", "skel", "addr", "joint", "house", "name_chars", "addr_chars"))}


def token_columns(name: Column, addr: Column) -> dict[str, Column]:
    """The tokens of each table, from a record's canonical name and address tokens."""
    return {
        "keys": N.shared_keys(name),
        "name": N.name_tokens(name),
        "skel": F.transform(name, N.skeleton),
        "addr": N.address_tokens(addr),
        "joint": F.concat(name, F.transform(addr, lambda w: F.concat(F.lit("@"), w))),
        "house": N.house_locality(addr, N.numbers(addr)),
        "name_chars": F.concat(N.char_ngrams(name, 3), N.char_ngrams(name, 4)),
        "addr_chars": F.concat(N.char_ngrams(addr, 3), N.char_ngrams(addr, 4)),
    }


def weight_tables(records: DataFrame, name: str = "nt", addr: str = "at") -> DataFrame | dict[str, DataFrame]:
    """The weights of every token table in blocks, written; ``records`` has cty, src, doc_id and canonical tokens of name and address.
    Where an id is repeated or null its tokens must be put together first: then a table by row of each."""
    sizes = records.groupBy(F.col("cty").alias("part")).agg(F.count("*").alias("n"))
    toks = token_columns(F.col(name), F.col(addr))
    if not records.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count():
        return packs.blocks(records, [toks[k] for k in TABLES], F.size(addr) == 0, sizes, blocking.pruned)
    out = {}
    for key in TABLES:
        t = table(blocking.token_table(records, toks[key]), f"tokens-{key}")
        out[key] = table(blocking.weighted(t, blocking.pruned(blocking.frequencies(t, sizes))), f"weights-{key}")
    return out


def hits(weights: DataFrame | dict[str, DataFrame], bare: DataFrame, channels: dict[str, Channel] | None = None) -> DataFrame:
    """(s1, cand, channel, score, rank) of every channel; ``bare`` (cand) are the pool's records without an address, which blocks flag."""
    channels = CHANNELS if channels is None else channels
    if isinstance(weights, DataFrame):
        found = packs.search(weights, {i: packs.Search(TABLES[c.tokens], c.depth, c.back, c.bare) for i, c in enumerate(channels.values())})
        return found.select("s1", "cand", F.get(F.array(*[F.lit(c) for c in channels]), F.col("channel")).alias("channel"), "score", "rank")
    scores = {k: table(blocking.cosines(weights[k]), f"scores-{k}") for k in dict.fromkeys(c.tokens for c in channels.values())}
    out = None
    for name, c in channels.items():
        s = scores[c.tokens]
        s = s.join(bare, "cand", "left_semi") if c.bare else s
        top = blocking.top_reverse(s, c.depth) if c.back else blocking.top_forward(s, c.depth)
        part = top.select("s1", "cand", F.lit(name).alias("channel"), "score", "rank")
        out = part if out is None else out.unionByName(part)
    return out


def union(found: DataFrame, channels: dict[str, Channel] | None = None) -> DataFrame:
    """One row for each pair, with s_ and k_ of each channel and n_ch."""
    return blocking.union(found, {k: c.depth for k, c in (CHANNELS if channels is None else channels).items()})


def with_cosines(pairs: DataFrame, weights: DataFrame | dict[str, DataFrame]) -> DataFrame:
    """``pairs``, each once, and the COSINES."""
    if isinstance(weights, DataFrame):
        found = packs.cosines(weights, pairs, {name: TABLES[key] for name, key in COSINES.items()})
        return found if pairs.columns == ["s1", "cand"] else pairs.join(found, ["s1", "cand"])
    for name, key in COSINES.items():
        pairs = pairs.join(blocking.exact_cosines(pairs, weights[key]).withColumnRenamed("cos", name), ["s1", "cand"])
    return pairs


def with_postal(pairs: DataFrame, codes: DataFrame) -> DataFrame:
    """``pairs`` and post_eq, post_conf, from (id, codes)."""
    at = lambda k, to: codes.select(F.col("id").alias(k), F.col("codes").alias(to))
    eq, conf = blocking.postal_agreement(F.col("__x"), F.col("__y"))
    p = pairs.join(at("s1", "__x"), "s1").join(at("cand", "__y"), "cand")
    return p.withColumns({"post_eq": eq.cast("int"), "post_conf": conf.cast("int")}).drop("__x", "__y")


#: What the meta-blocker sees of a pair.
META = [f"{x}_{c}" for x in "sk" for c in CHANNELS] + ["n_ch", *COSINES, "post_eq", "post_conf"]


def meta_scores(pairs: DataFrame, y: str, fold: str, k: int, rounds: int = 20, depth: int = 5) -> tuple[DataFrame, list]:
    """``pairs`` and meta: the probability of a match by a boosted model of META alone, out of fold; and the folds' models for new pairs."""
    return models.out_of_fold(pairs, META, y, fold, k, "meta", rounds=rounds, depth=depth, stop=True)


def meta_select(pairs: DataFrame, top_keep: int, cap: int, ratio: float, y: str = "y") -> DataFrame:
    """The candidates that go on: the first ``top_keep`` of an anchor by meta and those at the threshold that keeps ``ratio`` of all true
    pairs, ``cap`` at most."""
    tau = calibration.choose_tau(pairs, top_keep, cap, ratio, y, "meta")
    r = grouped_rank(pairs, "s1", "meta", "cand", "__rank").crossJoin(F.broadcast(tau))
    return r.where(((F.col("__rank") <= top_keep) | (F.col("meta") >= F.col("tau"))) & (F.col("__rank") <= cap)).drop("__rank", "tau")
