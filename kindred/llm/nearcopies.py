"""SimHash near-dedup by five words and a Jaccard similarity of 0.8 or more; belongs to the pipeline.

Two texts are near copies if the sets of their runs of SHINGLE words have a Jaccard similarity of LEAST or more. Texts of the
very same set are one node. Nodes get a SimHash fingerprint of their set and go through the trie self-join of ``simhash``; each of
its links is a candidate. But at a similarity of 0.8 fingerprints differ in eight to ten bits on average, of which that join's
budget of four finds about one pair in ten, and a budget as wide as that leaves a trie nothing to prune. So further candidates come from BANDS bands of ROWS
minima of random hashes: nodes that agree on a band share its bucket, and a pair of similarity s is missed with
probability (1 - s^ROWS)^BANDS, 5e-6 at 0.8 and less above. Nothing is taken for a copy without having been verified on the
sets themselves.

Verification needs not all pairs, only the same components. First each member of a bucket is compared with the bucket's
smallest, which is linear, as are the trie's links, a forest. Buckets whose members are in one component then are done; in the
others each member is compared with those outside its own component until one is left, so that no pair of a bucket that could
join two components goes untested.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm import simhash
from kindred.llm.common import ship, table
from kindred.llm.graph import components
from kindred.llm.simhash import SEED

SHINGLE = 5
LEAST = 0.8
BANDS, ROWS = 40, 6
#: Shingles that are hashed at a time, and rows to which what is compared with one node is dealt.
AT_ONCE = 1024
DEALS = 16
#: Members of a block of a bucket, and members outside its largest component that may meet each block of that.
BLOCK, MOST_OTHERS = 256, 2048

_random = np.random.default_rng(SEED)
_TIMES = _random.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = _random.integers(1, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of a text's runs of SHINGLE words, of all its words if they are fewer; none without words."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and the six ASCII spaces only
    runs = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False)) if len(words) >= SHINGLE else [b" ".join(words)] if words else []
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in runs), dtype=np.uint64))


def buckets(h: np.ndarray) -> np.ndarray:
    """One bucket for each band of a set of shingles; none for an empty set."""
    if not len(h):
        return np.zeros(0, np.int64)
    low = np.full(BANDS * ROWS, ~np.uint64(0))
    for i in range(0, len(h), AT_ONCE):
        x = h[i : i + AT_ONCE, None] * _TIMES
        x ^= x >> np.uint64(32)
        np.minimum(low, x.min(axis=0), out=low)
    x = low * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x = (x.reshape(BANDS, ROWS) * _FOLD).sum(axis=1, dtype=np.uint64)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


def _key(h: np.ndarray) -> str:
    return xxhash.xxh3_128_hexdigest(h.tobytes())


def _prints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        sets = [shingles(t) for t in b["text"]]
        prints = np.array([simhash.majority(h) for h in sets], np.uint64).view(np.int64)
        yield pd.DataFrame({"doc_id": b["doc_id"], "key": [_key(h) for h in sets], "fp": prints, "buckets": [buckets(h) for h in sets]})


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (node, key, text) -> the sets of those whose key is the text's; an id that is repeated may bring other texts."""
    for b in batches:
        sets = [(n, h.view(np.int64)) for n, k, t in zip(b["node"], b["key"], b["text"], strict=True) if _key(h := shingles(t)) == k]
        yield pd.DataFrame(sets, columns=["node", "hashes"])


def similar(a: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Which of ``sets`` (sorted, distinct) have a Jaccard similarity of LEAST or more to ``a``."""
    sizes = np.array([len(s) for s in sets])
    at = np.concatenate(sets)
    place = np.minimum(np.searchsorted(a, at), len(a) - 1)
    both = np.add.reduceat(a[place] == at, np.concatenate([[0], np.cumsum(sizes)[:-1]]), dtype=np.int64)
    return both >= LEAST * (sizes + len(a) - both) - 1e-9


def joins(node: np.ndarray, part: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Edges between nodes of one bucket that join all its parts which any pair of it can join."""
    part, out = part.copy(), []
    for i in range(len(node)):
        others = np.flatnonzero(part != part[i])
        if not len(others):
            break
        for j in others[similar(sets[i], [sets[k] for k in others])]:
            if part[j] != part[i]:
                out.append((int(node[i]), int(node[j])))
                part[part == part[j]] = part[i]
    return out


def _joined(b: pd.DataFrame) -> pd.DataFrame:
    edges = joins(b["node"].to_numpy(), b["part"].to_numpy(), [np.asarray(h, np.int64).view(np.uint64) for h in b["hashes"]])
    return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``docs`` (doc_id bigint not null, text): its nodes (node, key, doc_id, its least), and edges (a, b) that connect the nodes of near copies."""
    ship(docs.sparkSession)
    prints = table(docs.mapInPandas(_prints, "doc_id bigint, key string, fp bigint, buckets array<bigint>"), "prints")
    each = prints.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("fp").alias("fp"), F.first("buckets").alias("buckets"))
    each = table(each.withColumn("node", F.monotonically_increasing_id()), "nodes")
    dealt = each.select("node", F.explode("buckets").alias("bucket"))
    shared = table(dealt.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("low")).where("n > 1"), "buckets")
    members = table(dealt.join(shared, "bucket"), "members")

    # candidates: the trie's links between fingerprints, nodes of one fingerprint, and members of a bucket with its smallest
    alike = each.where(F.size("buckets") > 0).groupBy("fp").agg(F.min("node").alias("doc_id"), F.count("*").alias("n"))
    alike = table(alike, "alike")
    same = each.where(F.size("buckets") > 0).join(alike.where("n > 1").select("fp", F.col("doc_id").alias("a")), "fp").where("node <> a").select("a", F.col("node").alias("b"))
    deal = F.pmod(F.xxhash64("b"), F.lit(DEALS)).alias("deal")
    pairs = members.where("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b")).unionByName(same).unionByName(simhash.links(alike.select("fp", "doc_id")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    star = table(pairs.distinct().select("a", "b", deal), "stars")

    # texts and sets are shuffled and merged whatever their number, so that this grows as the input does
    ends = star.select(F.col("a").alias("node")).unionByName(star.select(F.col("b").alias("node"))).distinct()
    some = table(each.join(ends, "node").select(F.col("doc_id").alias("__id"), "node", "key"), "some")
    texts = docs.join(some.hint("merge"), F.col("doc_id") == F.col("__id")).select("node", "key", "text")
    sets = table(texts.mapInPandas(_sets, "node bigint, hashes array<bigint>"), "sets")
    if sets.groupBy("node").count().where("count > 1").limit(1).count():  # repeated rows of one id and text
        sets = table(sets.dropDuplicates(["node"]), "sets-once")

    hub = star.select("a", "deal").distinct().join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")).hint("merge"), "a")
    pairs = star.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")).hint("merge"), "b").join(hub.hint("merge"), ["a", "deal"])
    both = F.size(F.array_intersect("x", "y"))
    edges = table(pairs.where(both >= LEAST * (F.size("x") + F.size("y") - both) - F.lit(1e-9)).select("a", "b"), "edges")

    parts = table(components(edges), "parts")
    held = members.join(parts, "node", "left").select("bucket", "n", "node", F.coalesce("component", "node").alias("part"))
    # a bucket of two is settled by its only pair; buckets of the same members are looked at once
    open_ = held.where("n > 2").groupBy("bucket").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.count("*").alias("m"), F.expr("bit_xor(xxhash64(node))").alias("x"), F.sum(F.col("node").cast("decimal(38,0)")).alias("s"))
    open_ = table(open_.where("p < q").groupBy("m", "x", "s").agg(F.min("bucket").alias("bucket")).select("bucket"), "open")
    if open_.limit(1).count():
        # what a bucket's largest component is joined by are its other members: these meet its blocks, each of its nodes in one;
        # where they are very many themselves, every pair of blocks of the bucket meets in a task of its own
        sizes = held.join(open_, "bucket").groupBy("bucket", "part").agg(F.count("*").alias("k"))
        main = sizes.groupBy("bucket").agg(F.max(F.struct("k", "part")).alias("m"), F.sum("k").alias("all")).select("bucket", F.col("m.part").alias("main"), F.col("m.k").alias("n_main"), (F.col("all") - F.col("m.k")).alias("others"))
        block = lambda n: F.pmod(F.xxhash64("node"), F.ceil(n / BLOCK).cast("int")).cast("int")
        upto = lambda n: F.sequence(F.lit(0), F.ceil(n / BLOCK).cast("int") - 1)
        own = block(F.col("n_main"))
        few = F.when(F.col("part") == F.col("main"), F.array(F.struct(own.alias("i"), own.alias("j")))).otherwise(F.transform(upto(F.col("n_main")), lambda x: F.struct(x.alias("i"), x.alias("j"))))
        every = F.transform(upto(F.col("n")), lambda x: F.struct(F.least(block(F.col("n")), x).alias("i"), F.greatest(block(F.col("n")), x).alias("j")))
        rest = held.join(table(main, "mains"), "bucket").withColumn("at", F.explode(F.when(F.col("others") <= MOST_OTHERS, few).otherwise(every)))
        rest = rest.join(sets.hint("merge"), "node").select("bucket", "at.i", "at.j", "node", "part", "hashes")
        edges = edges.unionByName(table(rest.groupBy("bucket", "i", "j").applyInPandas(_joined, "a bigint, b bigint"), "more"))
    return each.select("node", "key", "doc_id"), edges


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` less all but the document of the smallest id of each group that near copies lead to, same columns.

    Null and empty texts are copies of one another. Of rows of equal id one stays, if it is the smallest of any of its texts' groups;
    rows of a null id are in no group and stay. No row meets another by its group: only the groups' smallest ids are gathered.
    """
    d = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text")).where("doc_id is not null")
    each, edges = links(d)
    found = table(components(edges), "groups")
    kept = each.join(found, "node", "left").groupBy(F.coalesce("component", "node").alias("c")).agg(F.min("doc_id").alias("doc_id"))
    return simhash.kept_only(docs, kept.select("doc_id"), doc_id)
