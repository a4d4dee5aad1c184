"""Nearest neighbours by cosine: score-aware (anisotropic) four-bit quantisation, table scans, exact reranking.

Training. On at most TRAIN_ROWS rows, those of the least hashes of the id, k-means gives cells, and for each pair of dimensions 16
centres quantise what a vector leaves after its cell's centre. The loss of a residual r of x is |r|^2 + (ETA - 1) (r.x)^2 /
|x|^2: an error along x moves the inner products with x's neighbours, so it costs ETA times as much as one across.
Codes and centres are chosen for that loss, by coordinate descent and by weighted least squares.

Index. Every vector that takes part is put in its cell and encoded, two codes a byte. Of more than KEEP rows with the very same
vector only those of the smallest ids can be among five nearest with ties to smaller ids; these are the index's entries
for that vector. Crowded cells are cut into blocks of bounded size.

Search. Each query goes to its nearest cells (all, unless a smaller share is asked for) in blocks of queries; a block of queries meets a block of codes in one task,
adds up table entries by byte, keeps the SHORTLIST best with all ties, and reranks those on the original vectors in
double precision. A query's best of all blocks are its result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.common import ship, table

TRAIN_ROWS = 16_384
CENTRES = 16
#: Rows for each cell, cells at most, rows of a block of codes, and queries of a block of queries.
CELL_ROWS, MAX_CELLS, BLOCK_ROWS, BLOCK_QUERIES = 1024, 256, 8192, 1024
SHORTLIST = 256
#: Share of the cells that a query scans, the nearest first. Vectors without clusters need all: half the cells find 80 to 93 % here.
PROBED = 1.0
NEAREST = 5
KEEP = NEAREST + 1
#: Cosine above which scores matter, from which the weight of parallel error follows: (d - 1) T^2 / (1 - T^2).
THRESHOLD = 0.2


def taking_part(v: Column) -> Column:
    """Whether a vector has only finite components and is not zero."""
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def scaled(x: np.ndarray) -> np.ndarray:
    """Each row in double precision, times the power of two that brings its largest component to [0.5, 1): the cosine stays the
    same to the last bit, and no square of any vector overflows or vanishes."""
    x = x.astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _assign(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(axis=1) / 2
    return np.concatenate([(x[i : i + 4096] @ centres.T - half).argmax(axis=1) for i in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    r = np.random.default_rng(seed)
    different = np.unique(x, axis=0)
    c = different[r.permutation(len(different))[:k]].copy()
    if len(c) < k:
        c = np.concatenate([c, np.zeros((k - len(c), x.shape[1]), x.dtype)])
    for _ in range(rounds):
        a = _assign(x, c)
        n = np.bincount(a, minlength=k)
        s = np.zeros_like(c)
        np.add.at(s, a, x)
        c = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], c).astype(np.float32)
    return c


class Quantiser:
    """Cells and the centres of each pair of dimensions."""

    def __init__(self, x: np.ndarray, cells: int):
        x = self.padded(unit(x))
        d = x.shape[1]
        self.eta = max(1.0, (d - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
        self.cells = kmeans(x, cells)
        at = _assign(x, self.cells)
        left = x - self.cells[at]
        # a cell's residuals count in units of their own size, so that a cell of near copies takes no centres from the others
        size = np.bincount(at, minlength=cells)
        self.scale = np.sqrt(np.bincount(at, weights=(left**2).sum(axis=1), minlength=cells) / np.maximum(size, 1)).astype(np.float32)
        self.scale[self.scale < 1e-6] = 1
        left /= self.scale[at, None]
        self.books = np.stack([kmeans(np.ascontiguousarray(left[:, i : i + 2]), CENTRES) for i in range(0, d, 2)])
        for _ in range(3):
            self._refit(x, left, self._codes(x, left))

    @staticmethod
    def padded(x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, -x.shape[1] % 4))) if x.shape[1] % 4 else x

    def _codes(self, x: np.ndarray, left: np.ndarray, sweeps: int = 2) -> np.ndarray:
        n, m = len(x), self.books.shape[0]
        r, u = left.reshape(n, m, 2), x.reshape(n, m, 2)
        codes = np.stack([_assign(np.ascontiguousarray(r[:, j]), self.books[j]) for j in range(m)], axis=1)
        along = sum(((r[:, j] - self.books[j][codes[:, j]]) * u[:, j]).sum(axis=1) for j in range(m))
        for _ in range(sweeps):
            for j in range(m):
                e = r[:, j, None, :] - self.books[j][None]
                part = (e * u[:, j, None, :]).sum(axis=2)
                rest = along - part[np.arange(n), codes[:, j]]
                loss = (e**2).sum(axis=2) + (self.eta - 1) * (rest[:, None] + part) ** 2
                codes[:, j] = loss.argmin(axis=1)
                along = rest + part[np.arange(n), codes[:, j]]
        return codes

    def _refit(self, x: np.ndarray, left: np.ndarray, codes: np.ndarray) -> None:
        n, m = codes.shape
        r, u = left.reshape(n, m, 2), x.reshape(n, m, 2)
        along = sum(((r[:, j] - self.books[j][codes[:, j]]) * u[:, j]).sum(axis=1) for j in range(m))
        for j in range(m):
            for k in range(CENTRES):
                i = np.flatnonzero(codes[:, j] == k)
                if not len(i):
                    continue
                uj, rj = u[i, j], r[i, j]
                rest = along[i] - ((rj - self.books[j][k]) * uj).sum(axis=1)
                # minimise |r - c|^2 + (eta - 1) (rest + (r - c).u)^2 over c
                w = self.eta - 1
                a = len(i) * np.eye(2) + w * uj.T @ uj
                b = rj.sum(axis=0) + w * (uj * (rest + (rj * uj).sum(axis=1))[:, None]).sum(axis=0)
                c = np.linalg.solve(a, b).astype(np.float32)
                along[i] = rest + ((rj - c) * uj).sum(axis=1)
                self.books[j][k] = c

    def cell(self, x: np.ndarray) -> np.ndarray:
        return _assign(self.padded(unit(x)), self.cells)

    def encode(self, x: np.ndarray, cell: int) -> np.ndarray:
        """Two codes a byte: (rows, pairs of pairs of dimensions)."""
        x = self.padded(unit(x))
        c = self._codes(x, (x - self.cells[cell]) / self.scale[cell]).astype(np.uint8)
        return c[:, 0::2] | (c[:, 1::2] << 4)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Inner products of each query with what a byte of a code stands for, in a cell's units: (queries, bytes, 256)."""
        q = self.padded(unit(q))
        one = np.einsum("qmd,mkd->qmk", q.reshape(len(q), -1, 2), self.books)
        return (one[:, 0::2, None, :] + one[:, 1::2, :, None]).reshape(len(q), -1, 256)


def _cells_of(model: Quantiser, probes: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            x = np.stack(b["v"].to_numpy())
            if probes == 1:
                yield b.assign(cell=model.cell(x).astype(np.int32))
            else:
                s = model.padded(unit(x)) @ model.cells.T
                near = np.argsort(-s, axis=1, kind="stable")[:, :probes]
                i = np.repeat(np.arange(len(b)), near.shape[1])
                yield b.iloc[i].assign(cell=near.ravel().astype(np.int32))

    return run


def _code_block(model: Quantiser):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        x = np.stack(pdf["v"].to_numpy())
        codes = model.encode(x, int(pdf["cell"].iloc[0]))
        return pd.DataFrame([(int(pdf["cell"].iloc[0]), int(pdf["block"].iloc[0]), pdf["id"].to_numpy().tobytes(), codes.tobytes(), np.ascontiguousarray(x).tobytes())], columns=["cell", "block", "ids", "codes", "vectors"])

    return run


def _query_block(pdf: pd.DataFrame) -> pd.DataFrame:
    x = np.stack(pdf["v"].to_numpy())
    return pd.DataFrame([(int(pdf["cell"].iloc[0]), int(pdf["qblock"].iloc[0]), pdf["id"].to_numpy().tobytes(), np.ascontiguousarray(x).tobytes())], columns=["cell", "qblock", "qids", "qvectors"])


def scan(model: Quantiser, kind: np.dtype, ids: bytes, codes: bytes, vectors: bytes, qids: bytes, qvectors: bytes) -> Iterator[tuple[int, int, float]]:
    """(query, id, cosine) of the best of one block of codes for each query of one block of queries."""
    cand, qs = np.frombuffer(ids, np.int64), np.frombuffer(qids, np.int64)
    x, q = np.frombuffer(vectors, kind).reshape(len(cand), -1), np.frombuffer(qvectors, kind).reshape(len(qs), -1)
    c = np.frombuffer(codes, np.uint8).reshape(len(cand), -1)
    exact, exact_q = scaled(x), scaled(q)
    norm = np.sqrt((exact**2).sum(axis=1))
    for s in range(0, len(qs), 64):
        t = model.tables(q[s : s + 64])
        guess = np.zeros((t.shape[0], len(cand)), np.float32)
        for j in range(c.shape[1]):
            guess += t[:, j][:, c[:, j]]
        for k, g in enumerate(guess):
            me, v = qs[s + k], exact_q[s + k]
            least = np.partition(g, len(g) - 1 - SHORTLIST)[len(g) - 1 - SHORTLIST] if len(g) > SHORTLIST + 1 else -np.inf
            i = np.flatnonzero((g >= least) & (cand != me))
            score = (exact[i] * v).sum(axis=1) / (norm[i] * np.sqrt((v * v).sum()))
            best = np.lexsort((cand[i], -score))[:NEAREST]
            yield from zip([int(me)] * len(best), cand[i[best]].tolist(), score[best].tolist(), strict=True)


def _searched(model: Quantiser, kind: np.dtype):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                yield pd.DataFrame(list(scan(model, kind, r.ids, r.codes, r.vectors, r.qids, r.qvectors)), columns=["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, every: int = 50, probed: float = PROBED, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every`` its NEAREST rows by cosine, ties to smaller ids.

    Rows with a null id or a vector that is null, zero, holds a null or non-finite component, or isn't of the usual length
    (the commonest of the training rows) take no part. Repeated rows count once; a row is no neighbour of its own id. A
    query without candidates has no rows; an empty table gives none. Other columns are not read.
    """
    spark = vectors.sparkSession
    ship(spark)
    v = vectors.select(F.col(f"`{vec_id}`").cast("bigint").alias("id"), F.col(f"`{embedding}`").alias("v")).where(F.col("id").isNotNull() & taking_part(F.col("v")))
    element = v.schema["v"].dataType.elementType.simpleString()
    kind = np.dtype(np.float32 if element == "float" else np.float64)
    v = v.select("id", F.col("v").cast(f"array<{'float' if element == 'float' else 'double'}>").alias("v"))
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    n = v.count()
    share = min(1.0, 1.5 * TRAIN_ROWS / max(n, 1))
    rank = F.pmod(F.xxhash64("id"), F.lit(1 << 20))
    # the rows of the least hashes, out of some more than enough
    chosen = v.where(rank < F.lit(int(share * (1 << 20)) + 1)).orderBy(rank, "id", "v").limit(TRAIN_ROWS).select("v").toPandas()["v"]
    if not len(chosen):
        return empty
    lengths = chosen.map(len)
    d = int(lengths.mode().iloc[0])
    v = v.where(F.size("v") == d)
    model = Quantiser(np.stack(chosen[lengths == d].to_numpy()), max(1, min(MAX_CELLS, n // CELL_ROWS)))
    k = len(model.cells)
    probes = max(1, min(k, round(probed * k)))

    # one entry for each row, and of rows of one vector those of the KEEP smallest ids
    order = Window.partitionBy("v").orderBy("id")
    entries = v.distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= KEEP).drop("n")
    shape = f"id bigint, v array<{'float' if kind == np.float32 else 'double'}>, cell int"
    entries = table(entries.mapInPandas(_cells_of(model, 1), shape), "entries")
    queries = table(v.where(F.pmod("id", F.lit(every)) == 0).distinct().mapInPandas(_cells_of(model, probes) if k > 1 else _cells_of(model, 1), shape), "queries")
    # counts by cell: MAX_CELLS rows at most
    sizes = dict(entries.groupBy("cell").count().collect())
    asked = dict(queries.groupBy("cell").count().collect())
    cells = [(c, -(-sizes[c] // BLOCK_ROWS), -(-asked[c] // BLOCK_QUERIES)) for c in sizes if c in asked]
    if not cells:
        return empty
    plan = F.broadcast(spark.createDataFrame(cells, "cell int, blocks int, qblocks int"))
    at = lambda col: F.pmod(F.xxhash64("id"), F.col(col)).cast("int")
    code = entries.join(plan, "cell").withColumn("block", at("blocks")).select("id", "v", "cell", "block").groupBy("cell", "block").applyInPandas(_code_block(model), "cell int, block int, ids binary, codes binary, vectors binary")
    ask = queries.join(plan, "cell").withColumn("qblock", at("qblocks")).select("id", "v", "cell", "qblock").groupBy("cell", "qblock").applyInPandas(_query_block, "cell int, qblock int, qids binary, qvectors binary")
    code = code.join(plan, "cell").withColumn("qblock", F.explode(F.sequence(F.lit(0), F.col("qblocks") - 1))).drop("blocks", "qblocks")
    found = code.join(ask, ["cell", "qblock"]).select("ids", "codes", "vectors", "qids", "qvectors").mapInPandas(_searched(model, kind), "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= NEAREST).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
