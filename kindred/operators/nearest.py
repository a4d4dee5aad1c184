"""The best pool records of each anchor by the dot product of token weights, without a table of all pairs.

Two records meet in as many rows as they share tokens, which is far more than the input. So records are packed: a block of
anchors is one row of arrays, a block of the pool one row of its postings in the order of their tokens. All pairs of
blocks meet in a cartesian product, which shuffles nothing, and a Python worker sums a pair of blocks up and keeps the best of each
anchor. All products are summed: nothing is cut but what can't be among the best.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions.columns import smooth_idf
from kindred.functions.ship import ship
from kindred.sources.shared import table

#: Postings of a block of anchors and of the pool; products and sums held at once by a worker.
ANCHORS, POOL, PRODUCTS, CELLS = 500_000, 1_000_000, 500_000, 4_000_000
#: Tokens of a row of the vocabulary.
VOCABULARY = 250_000
#: Sums are kept for all of a block's records while these are at most so many times the products, else products are sorted.
DENSE = 64
#: Scores are rounded to so many parts of one, so that noise decides no tie, and larger than one part.
PARTS = 1e9
ROWS_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"

_BLOCK = "names array<string>, part binary, ids binary, at binary, toks binary, which binary, w binary"
_FOUND = "part string, s1 bigint, cand bigint, score double"


def _packed(side: int, rows: list[pa.RecordBatch], queries: int) -> pa.RecordBatch:
    """One block: its records by id, and their weights by record (queries) or by token (the others)."""
    t = pa.Table.from_batches(rows).combine_chunks()
    by = t.column("part").combine_chunks().dictionary_encode()
    by = by.combine_chunks() if isinstance(by, pa.ChunkedArray) else by
    ids, toks = t.column("id").to_numpy(), t.column("toks").combine_chunks()
    n = np.diff(toks.offsets.to_numpy())
    tok, w = (toks.flatten().field(k).to_numpy(zero_copy_only=False) for k in ("h", "w"))
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), np.int32)
    place[order] = np.arange(len(ids), dtype=np.int32)
    return _block(side, by.dictionary.to_pylist(), by.indices.to_numpy()[order], ids[order], np.repeat(place, n), tok, w, queries)


def _block(side: int, names: list[str], part: np.ndarray, ids: np.ndarray, rec: np.ndarray, tok: np.ndarray, w: np.ndarray, queries: int) -> pa.RecordBatch:
    """Of records in the order of their ids, and postings (record, token, weight)."""
    if side == queries:
        o = np.argsort(rec, kind="stable")
        kinds, which = np.unique(tok[o], return_inverse=True)
        at, which, w = np.concatenate([[0], np.cumsum(np.bincount(rec, minlength=len(ids)))]), which.astype(np.int32), w[o]
    else:
        o = np.argsort(tok, kind="stable")
        kinds, first = np.unique(tok[o], return_index=True)
        at, which, w = np.append(first, len(tok)), rec[o].astype(np.int32), w[o]
    return _row(side, names, (part.astype(np.int32), ids, at.astype(np.int64), kinds, which, w))


def _row(side: int, names: list[str], arrays: tuple, cols: tuple[str, ...] = ("part", "ids", "at", "toks", "which", "w")) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([names], pa.list_(pa.string())), *[pa.array([x.tobytes()], pa.binary()) for x in arrays], pa.array([side], pa.int32())], ["names", *cols, "side"])


def _packer(queries: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {0: [], 1: []}, {0: 0, 1: 0}
        for b in batches:
            sides = b.column(b.schema.get_field_index("side")).to_numpy()
            for s in (0, 1):
                x = b.filter(pa.array(sides == s))
                if x.num_rows:
                    held[s].append(x)
                    size[s] += len(x.column(x.schema.get_field_index("toks")).flatten())
                if size[s] >= (ANCHORS if s == queries else POOL):
                    yield _packed(s, held[s], queries)
                    held[s], size[s] = [], 0
        for s in (0, 1):
            if held[s]:
                yield _packed(s, held[s], queries)

    return pack


def _best(rec: np.ndarray, col: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each record, by rounded score and then by place, which is that of the id."""
    v = np.floor(v * PARTS + 0.5)
    keep = v > 1
    rec, col, v = rec[keep], col[keep], v[keep]
    o = np.lexsort((col, -v, rec))
    rec, col, v = rec[o], col[o], v[o]
    first = np.flatnonzero(np.diff(rec, prepend=-1))
    rank = np.arange(len(rec)) - np.repeat(first, np.diff(np.append(first, len(rec))))
    return rec[rank < k], col[rank < k], v[rank < k] / PARTS


def _pick(rec: np.ndarray, col: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_best``, of rows in the order of their records: what can't be among a record's k best is left out first."""
    keep, first = np.ones(len(rec), bool), np.flatnonzero(np.diff(rec, prepend=-1))
    for a, b in zip(first, np.append(first[1:], len(rec)), strict=True):
        if b - a > 4 * k:
            x = v[a:b]
            keep[a:b] = x >= np.partition(x, b - a - k)[b - a - k] - 2 / PARTS
    return _best(rec[keep], col[keep], v[keep], k)


def sums(at: np.ndarray, toks: np.ndarray, which: np.ndarray, w: np.ndarray, at2: np.ndarray, toks2: np.ndarray, rec2: np.ndarray, w2: np.ndarray, n: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor, record, score) of the k best of ``n`` records for each anchor, by places in their blocks."""
    if not len(toks2) or not len(toks):
        return
    found = np.minimum(np.searchsorted(toks2, toks), len(toks2) - 1)
    lens = np.where(toks2[found] == toks, at2[found + 1] - at2[found], 0)
    start, many = at2[found][which], lens[which]
    upto = np.concatenate([[0], np.cumsum(many)])
    ends = upto[at]

    def products(a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of postings a to b: the number of each product's posting, the record and the product."""
        c = many[a:b]
        place = np.arange(upto[b] - upto[a]) + np.repeat(start[a:b] - (upto[a:b] - upto[a]), c)
        return c, rec2[place], np.repeat(w[a:b], c) * w2[place]

    i, most = 0, max(1, CELLS // n)
    while i < len(at) - 1:
        j = max(i + 1, min(int(np.searchsorted(ends, ends[i] + PRODUCTS, "right")) - 1, i + most))
        total = int(ends[j] - ends[i])
        if total > PRODUCTS:  # one anchor, piece by piece
            row, a = np.zeros(n), int(at[i])
            while a < at[j]:
                b = max(a + 1, min(int(np.searchsorted(upto, upto[a] + PRODUCTS, "right")) - 1, int(at[j])))
                _, rec, v = products(a, b)
                row += np.bincount(rec, v, n)
                a = b
            col = np.flatnonzero(row)
            yield _pick(np.full(len(col), i), col, row[col], k)
        elif total:
            if (j - i) * n > DENSE * total:  # few products an anchor: more anchors at once
                j = max(j, int(np.searchsorted(ends, ends[i] + PRODUCTS, "right")) - 1)
            c, rec, v = products(int(at[i]), int(at[j]))
            cell = np.repeat(np.repeat(np.arange(j - i), np.diff(at[i : j + 1])), c) * n + rec
            if (j - i) * n <= min(CELLS + n, DENSE * len(cell)):
                total = np.bincount(cell, v, (j - i) * n)
                if len(cell) < len(total) // 2:  # cells that were met, each once: that of the last product
                    last = np.empty(len(total), np.int32)
                    last[cell] = np.arange(len(cell), dtype=np.int32)
                    cell = cell[last[cell] == np.arange(len(cell), dtype=np.int32)]
                else:
                    cell = np.flatnonzero(total)
                rec, col, v = cell // n, cell % n, total[cell]
            else:
                o = np.argsort(cell, kind="stable")
                cell, v = cell[o], v[o]
                first = np.flatnonzero(np.diff(cell, prepend=-1))
                rec, col, v = cell[first] // n, cell[first] % n, np.add.reduceat(v, first)
            yield _pick(rec + i, col, v, k)
        i = j


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records (part, side, id, toks: hashes) in blocks of distinct tokens and their counts by record."""
    held, size = {0: [], 1: []}, {0: 0, 1: 0}

    def out(side: int) -> pa.RecordBatch:
        t = pa.Table.from_batches(held[side]).combine_chunks()
        by = t.column("part").combine_chunks().dictionary_encode()
        ids, toks = t.column("id").to_numpy(), t.column("toks").combine_chunks()
        kinds, inv = np.unique(toks.flatten().to_numpy(), return_inverse=True)
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        cell, tf = np.unique(np.repeat(place, np.diff(toks.offsets.to_numpy())) * max(1, len(kinds)) + inv, return_counts=True)
        rec, which = cell // max(1, len(kinds)), cell % max(1, len(kinds))
        at = np.concatenate([[0], np.cumsum(np.bincount(rec, minlength=len(ids)))]).astype(np.int64)
        held[side], size[side] = [], 0
        return _row(side, by.dictionary.to_pylist(), (by.indices.to_numpy()[order].astype(np.int32), ids[order], at, kinds, which.astype(np.int32), tf.astype(np.int32)))

    for b in batches:
        sides = b.column(b.schema.get_field_index("side")).to_numpy()
        for s in (0, 1):
            x = b.filter(pa.array(sides == s))
            if x.num_rows:
                held[s].append(x)
                size[s] += len(x.column(x.schema.get_field_index("toks")).flatten())
            if size[s] >= POOL:
                yield out(s)
    for s in (0, 1):
        if held[s]:
            yield out(s)


def _kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of such blocks: (part, tok, df) of each distinct token; a hash is of one part's token."""
    for b in batches:
        for i in range(b.num_rows):
            get = lambda c, t: np.frombuffer(b.column(c)[i].as_buffer(), t)  # noqa: B023, E731
            toks, which, at = get("toks", np.int64), get("which", np.int32), get("at", np.int64)
            part = np.empty(len(toks), np.int32)
            part[which] = np.repeat(get("part", np.int32), np.diff(at))
            names = pa.DictionaryArray.from_arrays(pa.array(part), pa.array(b.column("names")[i].as_py(), pa.string())).cast(pa.string())
            yield pa.RecordBatch.from_arrays([names, pa.array(toks), pa.array(np.bincount(which, minlength=len(toks)))], ["part", "tok", "df"])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tok, idf) in rows of sorted arrays."""

    def out(t: pa.Table) -> pa.RecordBatch:
        tok, idf = t.column("tok").to_numpy(), t.column("idf").to_numpy()
        o = np.argsort(tok)
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (tok[o], idf[o])], ["tok", "idf"])

    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= VOCABULARY:
            yield out(pa.Table.from_batches(held))
            held, n = [], 0
    if n:
        yield out(pa.Table.from_batches(held))


def _weigher(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block with all of the vocabulary, row by row: the block with the weights of the tokens that are in it."""
    key, block, idf = None, None, None
    bare_type = pa.list_(pa.struct([("part", pa.string()), ("id", pa.int64()), ("h", pa.string())]))

    def done() -> pa.RecordBatch:
        names, side, part, ids, at, toks, which, tf = block
        rec, seen = np.repeat(np.arange(len(ids)), np.diff(at)), idf[which] > 0
        r, tok, w = rec[seen], toks[which[seen]], np.log(1.0 + tf[seen]) * idf[which[seen]]
        w = w / np.sqrt(np.bincount(r, w * w, len(ids)))[r]
        none = np.flatnonzero((np.bincount(r, minlength=len(ids)) == 0) & (np.diff(at) > 0))
        bare = [{"part": names[part[x]], "id": int(ids[x]), "h": hashlib.sha256(toks[which[at[x] : at[x + 1]]].tobytes() + tf[at[x] : at[x + 1]].tobytes()).hexdigest()} for x in none]
        b = _block(side, names, part, ids, r, tok, w, 0)
        return pa.RecordBatch.from_arrays([*b.columns, pa.array([bare], bare_type)], [*b.schema.names, "bare"])

    for b in batches:
        for i in range(b.num_rows):
            get = lambda c, t: np.frombuffer(b.column(c)[i].as_buffer(), t)  # noqa: B023, E731
            if (k := b.column("key")[i].as_py()) != key:
                if block is not None:
                    yield done()
                key = k
                block = (b.column("names")[i].as_py(), b.column("side")[i].as_py(), *[get(c, t).copy() for c, t in (("part", np.int32), ("ids", np.int64), ("at", np.int64), ("toks", np.int64), ("which", np.int32), ("w", np.int32))])
                idf = np.zeros(len(block[5]))
            tok, x = get("tok", np.int64), get("idf", np.float64)
            if len(tok):
                at = np.minimum(np.searchsorted(tok, block[5]), len(tok) - 1)
                idf = np.where(tok[at] == block[5], x[at], idf)
    if block is not None:
        yield done()


def _searcher(k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                get = lambda c, t: np.frombuffer(b.column(c)[i].as_buffer(), t)  # noqa: B023, E731
                names = np.array(b.column("names")[i].as_py(), object)
                part, ids, ids2 = get("part", np.int32), get("ids", np.int64), get("ids2", np.int64)
                a = [get(c, t) for c, t in (("at", np.int64), ("toks", np.int64), ("which", np.int32), ("w", np.float64))]
                p = [get(c, t) for c, t in (("at2", np.int64), ("toks2", np.int64), ("which2", np.int32), ("w2", np.float64))]
                for rec, col, v in sums(*a, *p, len(ids2), k):
                    yield pa.RecordBatch.from_arrays([pa.array(names[part[rec]], pa.string()), pa.array(ids[rec]), pa.array(ids2[col]), pa.array(v)], ["part", "s1", "cand", "score"])

    return search


def blocks(w: DataFrame, rows: int, queries: int = 0) -> DataFrame:
    """``w`` (part, side, id, tok, w) in blocks, written; ``rows``: how many it has at most, ``queries``: the side that searches."""
    ship()
    n = max(w.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / POOL))
    tok = F.struct(F.xxhash64("part", "tok").alias("h"), "w")
    r = w.groupBy("part", "side", "id").agg(F.collect_list(tok).alias("toks")).withColumn("side", F.col("side").cast("int"))
    return table(r.coalesce(n).mapInArrow(_packer(queries), f"{_BLOCK}, side int"), "blocks", by="side")


def record_blocks(records: DataFrame, toks: Column, sizes: DataFrame, pruned: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The blocks of ``records`` (cty, src, doc_id; each id once), written, without a row for each token of a record; beside the weights,
    ``bare``: (part, id, h) of records of which no token is left, h alike for the same tokens.

    Tokens are held as 64 bits of hash, of part and token. Counts by block are summed to those of all records; ``pruned`` leaves the
    tokens (part, tok, df, n, idf) that count; each block meets the whole vocabulary. ``sizes``: (part, n).
    """
    ship()
    spark = records.sparkSession
    r = records.where("cty is not null").select(F.col("cty").alias("part"), (F.col("src") != "S1").cast("int").alias("side"), F.col("doc_id").cast("bigint").alias("id"), F.coalesce(toks, F.array().cast("array<string>")).alias("t"))
    r = r.select("part", "side", "id", F.transform(F.filter("t", lambda x: x.isNotNull()), lambda x: F.xxhash64("part", x)).alias("toks"))
    counted = table(r.mapInArrow(_counted, f"{_BLOCK}, side int").withColumn("key", F.expr("uuid()")), "counted")
    df = counted.mapInArrow(_kinds, "part string, tok bigint, df bigint").groupBy("part", "tok").agg(F.sum("df").alias("df"))
    f = pruned(df.join(F.broadcast(sizes), "part").withColumn("idf", smooth_idf(F.col("n"), F.col("df"))))
    f = table(f.select("tok", "idf"), "vocabulary")
    none = spark.range(1).select(F.lit(b"").alias("tok"), F.lit(b"").alias("idf"))  # a block meets one row at least
    words = table(f.mapInArrow(_chunks, "tok binary, idf binary"), "chunks").unionByName(none).coalesce(1)
    return _by_row(lambda: table(counted.hint("shuffle_replicate_nl").crossJoin(words).mapInArrow(_weigher, f"{_BLOCK}, side int, bare array<struct<part:string,id:bigint,h:string>>"), "blocks", by="side"), spark)


def _by_row(f: Callable[[], DataFrame], spark: SparkSession) -> DataFrame:
    """``f()`` with one row in a batch: a row is a block, or a pair of blocks. Rows of a product's inner side are held on disk beyond a few."""
    conf = {ROWS_CONF: "1", "spark.sql.cartesianProductExec.buffer.in.memory.threshold": "16"}
    was = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        return f()
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def nearest(packed: DataFrame, k: int, queries: int = 0) -> DataFrame:
    """(part, s1, cand, score) of ``blocks``, written: for each record of the side ``queries`` its k best of the other side and a few more;
    ties go to smaller ids. s1 is the anchor and cand the pool record whichever side searches."""
    spark = packed.sparkSession
    side = lambda s, to: packed.where(F.col("side") == s).select(*[F.col(c).alias(c + to) for c in ("names", "part", "ids", "at", "toks", "which", "w")])
    pairs = side(queries, "").hint("shuffle_replicate_nl").crossJoin(side(1 - queries, "2").drop("names2", "part2"))
    found = _by_row(lambda: table(pairs.mapInArrow(_searcher(k), _FOUND), "nearest"), spark)
    return found if queries == 0 else found.select("part", F.col("cand").alias("s1"), F.col("s1").alias("cand"), "score")
