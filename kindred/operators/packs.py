"""Several searches and exact cosines over the same records, without a row for each token or for each pair that meets.

A block holds some records of one side with their weights in every table of tokens. Pairs of blocks meet in a cartesian
product, once for all searches, forward and back, and once for the cosines of the pairs that were found. All products are summed
(``nearest.sums``): nothing is cut but what can't be among the best.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions.columns import smooth_idf
from kindred.functions.ship import ship
from kindred.operators import nearest
from kindred.sources.shared import table

#: Tokens and records of a block, which is full when it has as many or more, and tokens that a record is taken to have.
TOKENS, RECORDS, USUAL = 500_000, 10_000, 128
#: Tokens that a batch adds to a block at once, but for a single record with more.
ADDED = 1_500_000

_LISTS = ("at", "toks", "which", "w")
_TYPES = {"part": np.int32, "ids": np.int64, "flags": np.int8, "at": np.int64, "toks": np.int64, "which": np.int32, "w": np.float64, "tf": np.int32}
_ARRAYS = "names array<string>, part binary, ids binary, flags binary, at array<binary>, toks array<binary>, which array<binary>, w array<binary>, side int"


@dataclass(frozen=True)
class Search:
    """By which table, how many, whether pool records search anchors, and whether only flagged records search."""

    at: int
    depth: int
    back: bool = False
    flagged: bool = False


def _row(side: int, names: list[str], part: np.ndarray, ids: np.ndarray, flags: np.ndarray, tables: list[tuple]) -> pa.RecordBatch:
    one = [pa.array([x.tobytes()], pa.binary()) for x in (part.astype(np.int32), ids.astype(np.int64), flags.astype(np.int8))]
    many = [pa.array([[t[i].tobytes() for t in tables]], pa.list_(pa.binary())) for i in range(4)]
    return pa.RecordBatch.from_arrays([pa.array([names], pa.list_(pa.string())), *one, *many, pa.array([side], pa.int32())], ["names", "part", "ids", "flags", *_LISTS, "side"])


class _Block:
    """A row of a batch as arrays; ``w`` are counts (tf) before they are weighed. ``to`` ends its columns' names."""

    def __init__(self, b: pa.RecordBatch, i: int, weights: str = "w", to: str = ""):
        one = lambda c: np.frombuffer(b.column(c + to)[i].as_buffer(), _TYPES[c])
        many = lambda c, t: [np.frombuffer(x.as_buffer(), t) for x in b.column(c + to)[i]]
        self.part, self.ids, self.flags = one("part"), one("ids"), one("flags")
        self.tables = list(zip(many("at", np.int64), many("toks", np.int64), many("which", np.int32), many("w", _TYPES[weights]), strict=True))


def _pieces(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch's records, in pieces of ADDED tokens at most or of one record."""
    toks = b.column("toks")
    upto, i = toks.values.offsets.to_numpy()[toks.offsets.to_numpy()], 0
    while i < b.num_rows:
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + ADDED, "right")) - 1)
        yield b.slice(i, j - i)
        i = j


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records (part, side, id, flag, toks: hashes by table) in blocks: each table's distinct tokens, and places of tokens and counts by record."""
    held, size, rows = {0: [], 1: []}, {0: 0, 1: 0}, {0: 0, 1: 0}

    def out(side: int) -> pa.RecordBatch:
        t = pa.Table.from_batches(held[side]).combine_chunks()
        held[side], size[side], rows[side] = [], 0, 0
        one = lambda c: t.column(c).combine_chunks()
        by, ids, flags, toks = one("part").dictionary_encode(), one("id").to_numpy(), one("flag").to_numpy(), one("toks")
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        inner = toks.flatten()
        n, values = np.diff(inner.offsets.to_numpy()), inner.flatten().to_numpy()
        many = len(inner) // len(ids)
        which_table, rec = np.tile(np.arange(many), len(ids)), np.repeat(place, many)
        tabs, recs, tables = np.repeat(which_table, n), np.repeat(rec, n), []
        for k in range(many):
            mine = tabs == k
            kinds, inv = np.unique(values[mine], return_inverse=True)
            cell, tf = np.unique(recs[mine] * max(1, len(kinds)) + inv, return_counts=True)
            at = np.concatenate([[0], np.cumsum(np.bincount(cell // max(1, len(kinds)), minlength=len(ids)))])
            tables.append((at.astype(np.int64), kinds.astype(np.int64), (cell % max(1, len(kinds))).astype(np.int32), tf.astype(np.int32)))
        return _row(side, by.dictionary.to_pylist(), by.indices.to_numpy()[order], ids[order], flags[order], tables)

    for b in batches:
        sides = b.column(b.schema.get_field_index("side")).to_numpy()
        for s in (0, 1):
            for x in _pieces(b.filter(pa.array(sides == s))):
                held[s].append(x)
                rows[s] += x.num_rows
                size[s] += len(x.column(x.schema.get_field_index("toks")).flatten().flatten())
                if size[s] >= TOKENS or rows[s] >= RECORDS:
                    yield out(s)
    for s in (0, 1):
        if held[s]:
            yield out(s)


def _kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, tok, df) of each distinct token of a block; a hash is of one table's and part's token."""
    for b in batches:
        for i in range(b.num_rows):
            x, names = _Block(b, i, "tf"), pa.array(b.column("names")[i].as_py(), pa.string())
            for at, toks, which, _ in x.tables:
                part = np.empty(len(toks), np.int32)
                part[which] = np.repeat(x.part, np.diff(at))
                by = pa.DictionaryArray.from_arrays(pa.array(part), names).cast(pa.string())
                yield pa.RecordBatch.from_arrays([by, pa.array(toks), pa.array(np.bincount(which, minlength=len(toks)))], ["part", "tok", "df"])


def _weigher(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block with all of the vocabulary, row by row: the block with the weights of the tokens that are in it."""
    key, block, head, idf = None, None, None, []

    def done() -> pa.RecordBatch:
        tables = []
        for (at, toks, which, tf), x in zip(block.tables, idf, strict=True):
            rec, seen = np.repeat(np.arange(len(block.ids)), np.diff(at)), x[which] > 0
            rec, which, w = rec[seen], which[seen], np.log(1.0 + tf[seen]) * x[which[seen]]
            w = w / np.sqrt(np.bincount(rec, w * w, len(block.ids)))[rec]
            place = np.cumsum(x > 0) - 1
            tables.append((np.concatenate([[0], np.cumsum(np.bincount(rec, minlength=len(block.ids)))]).astype(np.int64), toks[x > 0], place[which].astype(np.int32), w))
        row = _row(head[1], head[0], block.part, block.ids, block.flags, tables)
        return pa.RecordBatch.from_arrays([*row.columns, pa.array([key], pa.int64())], [*row.schema.names, "key"])

    for b in batches:
        for i in range(b.num_rows):
            if (k := b.column("key")[i].as_py()) != key:
                if block is not None:
                    yield done()
                key, head, block = k, (b.column("names")[i].as_py(), b.column("side")[i].as_py()), _Block(b, i, "tf")
                idf = [np.zeros(len(t[1])) for t in block.tables]
            tok, x = (np.frombuffer(b.column(c)[i].as_buffer(), t) for c, t in (("tok", np.int64), ("idf", np.float64)))
            if len(tok):
                for t, (_, toks, _, _) in enumerate(block.tables):
                    at = np.minimum(np.searchsorted(tok, toks), len(tok) - 1)
                    idf[t] = np.where(tok[at] == toks, x[at], idf[t])
    if block is not None:
        yield done()


def blocks(records: DataFrame, tables: list[Column], flag: Column, sizes: DataFrame, pruned: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``records`` (cty, src, doc_id; each id once) in blocks, written, with ``key``; ``sizes``: (part, n), ``pruned`` leaves the tokens that count."""
    spark = records.sparkSession
    ship(spark)
    r = records.where("cty is not null").withColumn("__side", (F.col("src") != "S1").cast("int"))
    present = lambda t: F.filter(F.coalesce(t, F.array().cast("array<string>")), lambda x: x.isNotNull())
    hashed = lambda i, t: F.transform(present(t), lambda x: F.xxhash64(F.lit(i), "cty", x))
    r = r.select(F.col("cty").alias("part"), F.col("__side").alias("side"), F.col("doc_id").cast("bigint").alias("id"), F.coalesce(flag, F.lit(False)).cast("tinyint").alias("flag"), F.array(*[hashed(i, t) for i, t in enumerate(tables)]).alias("toks"))
    n = max(spark.sparkContext.defaultParallelism, math.ceil(records.count() * USUAL / TOKENS))
    counted = table(r.coalesce(n).mapInArrow(_counted, _ARRAYS).withColumn("key", F.monotonically_increasing_id()), "counted")
    df = counted.mapInArrow(_kinds, "part string, tok bigint, df bigint").groupBy("part", "tok").agg(F.sum("df").alias("df"))
    f = pruned(df.join(sizes, "part").withColumn("idf", smooth_idf(F.col("n"), F.col("df"))))
    words = table(table(f.select("tok", "idf"), "vocabulary").mapInArrow(nearest._chunks, "tok binary, idf binary"), "chunks")
    none = spark.range(1).select(F.lit(b"").alias("tok"), F.lit(b"").alias("idf"))  # a block meets one row at least
    pairs = counted.hint("shuffle_replicate_nl").crossJoin(words.unionByName(none).coalesce(1))
    return nearest._by_row(lambda: table(pairs.mapInArrow(_weigher, f"{_ARRAYS}, key bigint"), "blocks", by="side"), spark)


def _by_token(t: tuple) -> tuple:
    """A table by record as postings: first places of tokens, tokens, records, weights."""
    at, toks, which, w = t
    o = np.argsort(which, kind="stable")
    first = np.concatenate([[0], np.cumsum(np.bincount(which, minlength=len(toks)))])
    return first, toks, np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))[o], w[o]


def _only(t: tuple, keep: np.ndarray) -> tuple:
    """The table with no tokens for records that aren't kept."""
    at, toks, which, w = t
    n = np.where(keep, np.diff(at), 0)
    mine = np.repeat(keep, np.diff(at))
    return np.concatenate([[0], np.cumsum(n)]), toks, which[mine], w[mine]


def _searcher(searches: dict[int, Search]):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                a, p = _Block(b, i), _Block(b, i, to="2")
                posted: dict[tuple, tuple] = {}
                for c, s in searches.items():
                    mine, other = (p, a) if s.back else (a, p)
                    if s.flagged and not mine.flags.any():
                        continue
                    if (s.at, s.back) not in posted:
                        posted[s.at, s.back] = _by_token(other.tables[s.at])
                    t = _only(mine.tables[s.at], mine.flags > 0) if s.flagged else mine.tables[s.at]
                    for rec, col, v in nearest.sums(*t, *posted[s.at, s.back], len(other.ids), s.depth):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rec), c, np.int32)), pa.array(mine.ids[rec]), pa.array(other.ids[col]), pa.array(v)], ["channel", "by", "other", "score"])

    return search


def _side(packed: DataFrame, side: int, to: str) -> DataFrame:
    return packed.where(F.col("side") == side).select(*[F.col(c).alias(c + to) for c in ("part", "ids", "flags", *_LISTS, "key")])


def search(packed: DataFrame, searches: dict[int, Search]) -> DataFrame:
    """(channel, s1, cand, score, rank) of the best that each of ``searches``, by its number, finds; ties go to smaller ids."""
    pairs = _side(packed, 0, "").hint("shuffle_replicate_nl").crossJoin(_side(packed, 1, "2"))
    found = nearest._by_row(lambda: table(pairs.mapInArrow(_searcher(searches), "channel int, by bigint, other bigint, score double"), "found"), packed.sparkSession)
    back = F.col("channel").isin([c for c, s in searches.items() if s.back])
    depth = F.element_at(F.create_map(*[F.lit(x) for c, s in searches.items() for x in (c, s.depth)]), F.col("channel"))
    r = F.row_number().over(Window.partitionBy("channel", "by").orderBy(F.col("score").desc(), "other"))
    most = max(s.depth for s in searches.values())
    top = found.withColumn("rank", r.cast("bigint")).where((F.col("rank") <= most) & (F.col("rank") <= depth))
    return top.select("channel", F.when(back, F.col("other")).otherwise(F.col("by")).alias("s1"), F.when(back, F.col("by")).otherwise(F.col("other")).alias("cand"), "score", "rank")


def _dots(tables: list[int]):
    """For each pair of a row's list: the dot products of its records in ``tables``."""

    def of(a: tuple, p: tuple, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """``x``: places in ``a``, in order, ``y``: in ``p``."""
        (at, toks, which, w), (at2, toks2, which2, w2) = a, p
        out = np.zeros(len(x))
        if not len(toks) or not len(toks2):
            return out
        found = np.minimum(np.searchsorted(toks, toks2), len(toks) - 1)
        same = np.where(toks[found] == toks2, found, len(toks))[which2]  # place in ``a``'s kinds of each posting of ``p``
        row, first = np.zeros(len(toks) + 1), np.flatnonzero(np.diff(x, prepend=-1))
        for i, j in zip(first, np.append(first[1:], len(x)), strict=True):
            mine = slice(at[x[i]], at[x[i] + 1])
            row[which[mine]] = w[mine]
            n = at2[y[i:j] + 1] - at2[y[i:j]]
            upto = np.cumsum(n)
            place = np.arange(upto[-1]) + np.repeat(at2[y[i:j]] - (upto - n), n)
            out[i:j] = np.bincount(np.repeat(np.arange(j - i), n), row[same[place]] * w2[place], j - i)
            row[which[mine]] = 0
        return out

    def dots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                a, p = _Block(b, i), _Block(b, i, to="2")
                s1, cand = (b.column("pairs").flatten().field(c).to_numpy() for c in ("s1", "cand"))
                o = np.argsort(s1, kind="stable")
                s1, cand = s1[o], cand[o]
                x, y = np.searchsorted(a.ids, s1), np.searchsorted(p.ids, cand)
                yield pa.RecordBatch.from_arrays([pa.array(s1), pa.array(cand), *[pa.array(of(a.tables[t], p.tables[t], x, y)) for t in tables]], ["s1", "cand", *[f"c{t}" for t in tables]])

    return dots


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, key, side) of each record."""
    for b in batches:
        for i in range(b.num_rows):
            ids = np.frombuffer(b.column("ids")[i].as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids), *[pa.array(np.full(len(ids), b.column(c)[i].as_py(), t)) for c, t in (("key", np.int64), ("side", np.int32))]], ["id", "key", "side"])


def cosines(packed: DataFrame, pairs: DataFrame, tables: dict[str, int]) -> DataFrame:
    """(s1, cand) of ``pairs``, each once, and for each name of ``tables`` their exact cosine in that table, written.

    A pair goes to the list of its two blocks; lists and blocks meet in a product that shuffles neither.
    """
    spark = packed.sparkSession
    at = table(packed.select("ids", "key", "side").mapInArrow(_places, "id bigint, key bigint, side int"), "places")
    of = lambda s, id_, key: at.where(F.col("side") == s).select(F.col("id").alias(id_), F.col("key").alias(key))
    p = pairs.select("s1", "cand").join(of(0, "s1", "ka"), "s1").join(of(1, "cand", "kp"), "cand")
    lists = table(p.groupBy("ka", "kp").agg(F.collect_list(F.struct("s1", "cand")).alias("pairs")), "lists")
    met = lists.hint("shuffle_replicate_nl").join(_side(packed, 0, ""), F.col("ka") == F.col("key")).drop("key", "ka")
    met = met.hint("shuffle_replicate_nl").join(_side(packed, 1, "2"), F.col("kp") == F.col("key2")).drop("key2", "kp")
    schema = "s1 bigint, cand bigint, " + ", ".join(f"c{t} double" for t in tables.values())
    out = nearest._by_row(lambda: table(met.mapInArrow(_dots(list(tables.values())), schema), "cosines"), spark)
    return out.select("s1", "cand", *[F.col(f"c{t}").alias(n) for n, t in tables.items()])
