"""SimHash near-duplicates by a binary trie self-join.

Fingerprints are 64 bits wide. Two that differ in at most four bits agree on one of five blocks of bits at least, so the
trie is built five times, each time with another block as its first levels, and only pairs under one node of that depth
are traversed: the error budget is still whole there. A crowded node is dealt out once more in the same way by five
blocks of the bits below it. Under each node the sorted fingerprints are a binary trie; pairs of its nodes go down
together, a pair that takes different branches adds one differing bit, and a pair beyond the budget is dropped.

What a node finds leaves it as a spanning forest, not as all pairs, so very large groups of copies cost rows in
proportion. Exact copies share one fingerprint and go through the join once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import parts, ship, table
from kindred.llm.graph import components

BITS = 64
BUDGET = 4
SHINGLE = 4
SEED = 42
#: First bit and width of the five blocks, counted from the highest bit, and how many fingerprints make a node crowded.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
CROWDED = 2048
#: A pair of nodes with at most so many pairs of fingerprints is compared outright; so many pairs at a time.
LEAF = 64
AT_ONCE = 2_000_000

_TOP = np.uint64(1) << np.uint64(63)


def majority(h: np.ndarray) -> int:
    """The fingerprint of shingles' hashes as an unsigned integer: each bit's majority."""
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(h), 65536):
        ones += np.unpackbits(h[i : i + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprint(text: str | None) -> int:
    """The fingerprint of a text as an unsigned integer: of the hashes of all its shingles, each bit's majority."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and the six ASCII spaces only
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = iter([b" ".join(words)])
        n = 1
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False))
        n = len(words) - SHINGLE + 1
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(s, SEED) for s in shingles), dtype=">u8", count=n))


def _fingerprints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        f = np.array([fingerprint(t) for t in b["text"]], dtype=np.uint64)
        yield pd.DataFrame({"doc_id": b["doc_id"], "fp": f.view(np.int64)})


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint's bits as a signed integer."""
    ship(docs.sparkSession)
    return docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInPandas(_fingerprints, "doc_id bigint, fp bigint")


def _pairs(a: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs within BUDGET bits in the ranges [lo, hi) of ``a``, each range sorted by itself."""
    node = (lo, hi, lo, hi, np.zeros(len(lo), np.int64))
    depth = 0
    held: list[tuple[np.ndarray, ...]] = []

    def compare(leaves: list[tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        la, ha, lb, hb, _ = (np.concatenate(x) for x in zip(*leaves, strict=True))
        size = (ha - la) * (hb - lb)
        ends = np.cumsum(size)
        start = 0
        while start < len(size):
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + AT_ONCE, "right")))
            sl = slice(start, stop)
            n = size[sl]
            which = np.repeat(np.arange(start, stop), n)
            k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            wide = (hb - lb)[which]
            i, j = la[which] + k // wide, lb[which] + k % wide
            near = (i < j) & (np.bitwise_count(a[i] ^ a[j]) <= BUDGET)
            yield i[near], j[near]
            start = stop

    while len(node[0]):
        la, ha, lb, hb, acc = node
        leaf = ((ha - la) * (hb - lb) <= LEAF) | (depth >= BITS)
        if leaf.any():
            held.append(tuple(x[leaf] for x in node))
            if sum(len(x[0]) for x in held) > 200_000:
                yield from compare(held)
                held = []
        la, ha, lb, hb, acc = (x[~leaf] for x in node)
        if not len(la):
            break
        bit = _TOP >> np.uint64(depth)
        # where a range's upper half begins: its keys share all bits above, so the bit is sorted in it
        run = np.concatenate([[0], np.cumsum((a & bit) == 0)])
        ma, mb = la + run[ha] - run[la], lb + run[hb] - run[lb]
        self_ = (la == lb) & (ha == hb)
        cross = ~self_
        out = [
            (la, ma, lb, mb, acc),
            (ma, ha, mb, hb, acc),
            (la, ma, mb, hb, acc + 1),
            (ma[cross], ha[cross], lb[cross], mb[cross], acc[cross] + 1),
        ]
        node = tuple(np.concatenate(x) for x in zip(*out, strict=True))
        live = (node[4] <= BUDGET) & (node[1] > node[0]) & (node[3] > node[2])
        node = tuple(x[live] for x in node)
        depth += 1
    if held:
        yield from compare(held)


def forest(fp: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, root) that link fingerprints of equal ``node`` within the budget, as a forest of stars; sorted by (node, fp)."""
    n = len(fp)
    edge = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    lo, hi = edge, np.concatenate([edge[1:], [n]])
    some = hi - lo > 1
    root = np.arange(n)
    for i, j in _pairs(fp, lo[some], hi[some]):
        while True:
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = root[root]
                if np.array_equal(up, root):
                    break
                root = up
    at = np.flatnonzero(root != np.arange(n))
    return at, root[at]


def _linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (node, fp, doc_id) sorted by node -> edges (a, b); a node's rows may span batches."""
    rest: list[pd.DataFrame] = []

    def links(b: pd.DataFrame) -> pd.DataFrame:
        f = b["fp"].to_numpy().view(np.uint64)
        order = np.lexsort((f, b["node"].to_numpy()))
        at, root = forest(f[order], b["node"].to_numpy()[order])
        d = b["doc_id"].to_numpy()[order]
        return pd.DataFrame({"a": d[at], "b": d[root]})

    for b in batches:
        if not len(b):
            continue
        rest.append(b)
        if sum(map(len, rest)) < 20_000 and len(rest) < 8 or b["node"].iloc[0] == b["node"].iloc[-1] == rest[0]["node"].iloc[0]:
            continue
        whole = pd.concat(rest, ignore_index=True)
        end = int(np.searchsorted(whole["node"].to_numpy(), whole["node"].iloc[-1], "left"))
        if end:
            yield links(whole.iloc[:end])
        rest = [whole.iloc[end:]]
    if rest:
        yield links(pd.concat(rest, ignore_index=True))


def _block(fp: Column, start: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, BITS - start - width).bitwiseAND(F.lit((1 << width) - 1))


def _below(first: int) -> list[tuple[int, int]]:
    """The five blocks of the bits outside block ``first`` (as two pieces at most they would cut; so by bits in order)."""
    bits = [x for i, (s, w) in enumerate(BLOCKS) if i != first for x in range(s, s + w)]
    cut = [round(k * len(bits) / 5) for k in range(6)]
    return [bits[a:b] for a, b in zip(cut, cut[1:], strict=False)]


def _gather(fp: Column, bits: list[int]) -> Column:
    """The given bits of a fingerprint as one integer, run by run."""
    out, k = None, 0
    while k < len(bits):
        m = k
        while m + 1 < len(bits) and bits[m + 1] == bits[m] + 1:
            m += 1
        piece = F.shiftleft(_block(fp, bits[k], m - k + 1), len(bits) - 1 - m)
        out = piece if out is None else out.bitwiseOR(piece)
        k = m + 1
    return out


def links(prints: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the same classes as all links of ``prints`` (fp, doc_id; one row for each fingerprint)."""
    spark = prints.sparkSession
    fp = F.col("fp")
    nodes = F.array(*[F.shiftleft(_block(fp, s, w), 3).bitwiseOR(F.lit(i).cast("long")) for i, (s, w) in enumerate(BLOCKS)])
    first = prints.select("fp", "doc_id", F.explode(nodes).alias("node"))
    crowded = table(first.groupBy("node").count().where(F.col("count") > CROWDED).select("node"), "crowded")
    if crowded.limit(1).count():
        mark = crowded.withColumn("much", F.lit(True))
        first = first.join(mark, "node", "left")
        deals = None
        for i in range(len(BLOCKS)):
            five = F.array(*[F.shiftleft(_gather(fp, bits), 3).bitwiseOR(F.lit(k + 1).cast("long")) for k, bits in enumerate(_below(i))])
            deals = F.when(F.col("node").bitwiseAND(F.lit(7)) == i, five) if deals is None else deals.when(F.col("node").bitwiseAND(F.lit(7)) == i, five)
        sub = F.explode(F.when(F.col("much"), deals).otherwise(F.array(F.lit(0).cast("long"))))
        # 16 bits of node and at most 14 of the blocks below it
        first = first.withColumn("sub", sub).select("fp", "doc_id", F.shiftleft("node", 20).bitwiseOR(F.col("sub")).alias("node"))
    dealt = first.repartition(parts(spark), "node").sortWithinPartitions("node")
    return dealt.mapInPandas(_linked, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row: fingerprint in 16 hexadecimal digits, component_id the smallest doc_id reachable.

    A null or empty text has fingerprint zero and is linked like any other. Rows of equal id each get a row; an id that
    is null is in no component (component_id null). Other columns are not read. An empty table gives none.
    """
    return _labelled(table(fingerprints(docs, doc_id, text), "fingerprints"))


def _labelled(prints: DataFrame) -> DataFrame:
    each = table(prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "distinct")
    edges = table(links(each.where("doc_id is not null")), "links")
    found = components(edges.select("a", "b")).withColumnRenamed("node", "doc_id")
    label = each.join(found, "doc_id", "left").select("fp", F.coalesce("component", "doc_id").alias("component_id"))
    d = prints.join(label, "fp", "left")
    return d.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` less all but the document of the smallest id of each component, same columns. Of rows of equal id one stays;
    rows of a null id are in no component and stay."""
    labelled = _labelled(table(fingerprints(docs, doc_id, text), "fingerprints"))
    return kept_only(docs, labelled.where("doc_id = component_id").select("doc_id"), doc_id)


def kept_only(docs: DataFrame, kept: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id is one of ``kept`` (doc_id), one for each, and those without an id, same columns.

    Of rows of equal id that of the least text stays, and of equal texts that of the least JSON of all columns.
    """
    id_ = F.col(f"`{doc_id}`")
    kept = table(kept.select(F.col("doc_id").alias("__id")).distinct(), "kept")
    left = docs.join(kept, id_ == F.col("__id"), "left_semi").unionByName(docs.where(id_.isNull()))
    again = table(docs.where(id_.isNotNull()).groupBy(id_.alias("__id")).count().where("count > 1").select("__id"), "repeated")
    if not again.limit(1).count():
        return left
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    order = F.struct(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in docs.columns if docs.schema[c].dataType.simpleString() == "string"], F.to_json(row))
    once = left.join(again, id_ == F.col("__id"), "left_semi").groupBy(id_.alias("__id")).agg(F.min_by(row, order).alias("__row")).select("__row.*")
    return left.join(again, id_ == F.col("__id"), "left_anti").unionByName(once)
