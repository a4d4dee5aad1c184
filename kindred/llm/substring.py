"""Substring dedup by seed and extend: words of passages that an earlier document has too are removed.

Seeds. Every run of SEED words is hashed, and of the REACH + 1 runs inside each window of LENGTH words the one of the least hash
(the first of several) is the window's anchor (winnowing): equal windows have equal anchors at equal places. Places where
two documents have one anchor are joined; no other can lie in a repeat.

Extension. A joined place carries the REACH words on either side of its anchor, as far as windows about it go. The places of one
anchor are matched on ever other splits of the extension, some words to the left and the rest to the right: those that
agree word by word share a window, and each learns of the first document (smallest id, then place) that has it. So places of
one anchor are compared as classes, not in pairs, and a passage of a third of all documents is a class like any other.
An anchor of more than HOT places is extended before it is joined: its places go out once for each window, dealt by the window.

Windows that an earlier document has and that follow one another join to maximal repeats; words that they cover go. ``repeats``
returns them: where one earlier document has all windows of a stretch in a row, the stretch is a repeat of that document.

Documents are dealt by a hash of their id to parts of bounded size. Parts exchange packed arrays, not rows: first the
distinct anchors of a part, by anchor; then joined places, equal ones once, by anchor or window. The answers are arrays in the
order of what was asked. All steps are one plan: if an executor is lost, Spark makes its pieces anew.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import parts, ship

LENGTH = 13
SEED = 7
#: Words by which an anchor is extended to a window, on both sides together.
REACH = LENGTH - SEED
#: Places of an anchor beyond which they are extended to whole windows before they are joined.
HOT = 1 << 12
#: Odd multiplier by which runs of word hashes are combined.
TIMES = np.uint64(0x9E3779B97F4A7C15)
CACHE_WORDS = 150_000
#: Bytes of text of a part, on average.
PART_BYTES = 5_000_000
#: Ranges of the exchange for each partition. A task holds one at a time, but parts send as many pieces as there are ranges.
RANGES = 1
#: Parts up to which their numbers are listed in the plan.
LISTED = 100_000


class _Hashes(dict):
    """Word -> 64-bit hash, kept for as long as there is room."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 7)
        return h


_hashes = _Hashes()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return h ^ (h >> np.uint64(27))


def _combined(*columns: np.ndarray) -> np.ndarray:
    """One hash of each row of the columns."""
    out = np.zeros(len(columns[0]), np.uint64)
    for x in columns:
        out = out * TIMES + x
    return _mix(out)


def _split(text: str | None) -> list[bytes]:
    return (text or "").encode().split()  # bytes part at the six ASCII spaces only


#: A joined place: its anchor, its document and where in it the anchor begins, the greatest and least number of words by which a
#: window about it goes to the left, and the words on either side of the anchor, those that no window reaches being 0.
PLACE = np.dtype([("anchor", "<u8"), ("doc", "<i8"), ("at", "<i4"), ("most", "u1"), ("least", "u1"), ("words", "<u8", (2 * REACH,))])


class Part:
    """The words of some documents in one row: their hashes, and the places of the anchors of all windows."""

    def __init__(self, docs: pd.DataFrame, keep: bool = False):
        hashed = []
        self.words: list[list[bytes]] = []
        for t in docs["text"]:
            words = _split(t)
            hashed.append(np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words)))
            if keep:
                self.words.append(words)
        self.size = np.array([len(x) for x in hashed], np.int64)
        self.ids = docs["doc_id"].to_numpy(np.int64)
        self.w = w = np.concatenate(hashed) if hashed else np.zeros(0, np.uint64)
        self.end = np.cumsum(self.size)
        n = max(0, len(w) - LENGTH + 1)
        seeds = _combined(*[w[i : len(w) - SEED + 1 + i] for i in range(SEED)]) if len(w) >= SEED else np.zeros(0, np.uint64)
        least, to = seeds[:n].copy(), np.zeros(n, np.int64)
        for i in range(1, REACH + 1):
            x = seeds[i : i + n]
            better = x < least
            least[better], to[better] = x[better], i
        windows = np.maximum(self.size - LENGTH + 1, 0)
        doc = np.repeat(np.arange(len(windows)), windows)
        start = np.arange(len(doc)) + np.repeat(self.end - self.size - (np.cumsum(windows) - windows), windows)
        place = start + to[start]
        # windows that follow one another and have their anchor in one place
        new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])])) if len(place) else np.zeros(0, np.int64)
        last = np.concatenate([new[1:], [len(place)]]).astype(np.int64) - 1
        self.place, self.doc = place[new], doc[new]
        self.most, self.least = self.place - start[new], self.place - start[last] if len(new) else self.place
        # mixed once more: least hashes are small numbers, and ranges of them would be uneven
        self.anchor = _mix(seeds[self.place])

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct anchors in order, whether two of the documents have one, and how many places."""
        order = np.argsort(self.anchor, kind="stable")
        a, d = self.anchor[order], self.ids[self.doc[order]]
        if not len(a):
            return a, np.zeros(0, bool), np.zeros(0, np.int64)
        new = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        return a[new], np.minimum.reduceat(d, new) != np.maximum.reduceat(d, new), np.diff(np.concatenate([new, [len(a)]]))

    def joined(self, anchors: np.ndarray, shared: np.ndarray, hot: np.ndarray) -> Joined:
        """The places of shared anchors, those of hot ones once for each window."""
        at = np.searchsorted(anchors, self.anchor)
        some = np.flatnonzero(shared[at]) if len(anchors) else np.zeros(0, np.int64)
        much = hot[at[some]] if len(anchors) else np.zeros(0, bool)
        whole, split = some[~much], some[much]
        each = (self.most - self.least + 1)[split]
        most = np.repeat(self.most[split], each) - (np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each))
        i = np.concatenate([whole, np.repeat(split, each)])
        most, least = np.concatenate([self.most[whole], most]), np.concatenate([self.least[whole], most])
        r = np.zeros(len(i), PLACE)
        place = self.place[i]
        r["anchor"], r["doc"], r["most"], r["least"] = self.anchor[i], self.ids[self.doc[i]], most, least
        r["at"] = place - (self.end - self.size)[self.doc[i]]
        for k in range(1, REACH + 1):
            left, right = most >= k, least <= REACH - k
            r["words"][left, REACH - k] = self.w[place[left] - k]
            r["words"][right, REACH + k - 1] = self.w[place[right] + SEED - 1 + k]
        # equal places are sent once: dealt by the anchor, of hot ones by all words of the window
        words = _combined(*r["words"].T, most.astype(np.uint64) << np.uint64(8) | least.astype(np.uint64))
        route = np.concatenate([r["anchor"][: len(whole)], _combined(r["anchor"][len(whole) :], words[len(whole) :])])
        order = np.lexsort((r["at"], r["doc"], words, r["anchor"], route))
        s = r[order]
        new = np.concatenate([[True], (s["anchor"][1:] != s["anchor"][:-1]) | (s["words"][1:] != s["words"][:-1]).any(axis=1) | (s["most"][1:] != s["most"][:-1]) | (s["least"][1:] != s["least"][:-1])]) if len(s) else np.zeros(0, bool)
        of = np.empty(len(s), np.int64)
        of[order] = np.cumsum(new) - 1
        return Joined(s[new], route[order][new], of, r, place)


@dataclass(slots=True)
class Joined:
    """Distinct places in the order of their route; and of each place of the part its distinct one, itself, and its word's number."""

    distinct: np.ndarray
    route: np.ndarray
    of: np.ndarray
    all: np.ndarray
    place: np.ndarray

    def repeated(self, answers: np.ndarray, firsts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """The first words of the windows that an earlier document has, in order, and (document, place) there if ``firsts`` are
        known. ``answers``: bit i of a distinct place is set if that is so of the window i words to the left of it."""
        first, r = self.distinct[self.of], self.all
        nearer = first["doc"] < r["doc"]  # an equal place in this part
        starts, others = [], []
        for o in range(REACH + 1):
            valid = (r["least"] <= o) & (o <= r["most"])
            bit = (answers[self.of] >> np.uint8(o) & np.uint8(1)).astype(bool)
            hit = np.flatnonzero(valid & (nearer | bit))
            starts.append(self.place[hit] - o)
            if firsts is not None:
                others.append(firsts[self.of[hit], o])
        start = np.concatenate(starts)
        order = np.argsort(start, kind="stable")
        return start[order], np.concatenate(others)[order] if firsts is not None else None


def settled(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of joined places: by bits which of their windows have an earlier document, and (document, place) of each window's first.

    For each number of words to the left, places of one anchor agree if these and the rest to the right are the same words.
    Candidates are found by a hash of them and compared word by word with the first of their class.
    """
    bits, firsts = np.zeros(len(r), np.uint8), np.zeros((len(r), REACH + 1, 2), np.int64)
    for o in range(REACH + 1):
        i = np.flatnonzero((r["least"] <= o) & (o <= r["most"]))
        if not len(i):
            continue
        x = r[i]
        words = x["words"][:, REACH - o : 2 * REACH - o]
        order = np.lexsort((x["at"], x["doc"], _combined(x["anchor"], *words.T)))
        for exact in (False, True):
            if exact:
                order = np.lexsort((x["at"], x["doc"], *words.T, x["anchor"]))
            s, w = x[order], words[order]
            differ = (s["anchor"][1:] != s["anchor"][:-1]) | (w[1:] != w[:-1]).any(axis=1)
            new = np.flatnonzero(np.concatenate([[True], differ]))
            # no class is torn unless a hash stands for different words, which then are told apart by sorting them
            if exact or len(np.unique(_combined(s["anchor"][new], *w[new].T))) == len(new):
                break
        head = np.repeat(new, np.diff(np.concatenate([new, [len(s)]])))
        bits[i[order]] |= (s["doc"][head] < s["doc"]).astype(np.uint8) << np.uint8(o)
        firsts[i[order], o, 0], firsts[i[order], o, 1] = s["doc"][head], s["at"][head].astype(np.int64) - o
    return bits, firsts


def _cuts(values: np.ndarray, n: int) -> np.ndarray:
    """Where the exchange cuts sorted hashes: n equal ranges of the upper 32 bits, so n + 1 places."""
    return np.searchsorted(((values >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32), np.arange(n + 1))


def dealt(n: int, times: int = 1) -> np.ndarray:
    """``times`` integers for each of n partitions that Spark's hash (Murmur3 of 4 bytes, seed 42) puts there: entry i goes to i % n."""
    m, rotl = 0xFFFFFFFF, lambda x, r: (x << r | x >> (32 - r)) & 0xFFFFFFFF
    got: list[np.ndarray] = [np.zeros(0, np.int64)] * 2
    size = 4 * n * times + 64
    while True:
        x = np.arange(size, dtype=np.int64)
        k = rotl(x * 0xCC9E2D51 & m, 15) * 0x1B873593 & m
        h = (rotl(k ^ 42, 13) * 5 + 0xE6546B64 & m) ^ 4
        h = (h ^ h >> 16) * 0x85EBCA6B & m
        h = (h ^ h >> 13) * 0xC2B2AE35 & m
        h ^= h >> 16
        p = np.where(h >= 1 << 31, h - (1 << 32), h) % n
        order = np.argsort(p, kind="stable")
        counts = np.bincount(p, minlength=n)
        if counts.min() >= times:
            begin = np.cumsum(counts) - counts
            got = [order[begin + t] for t in range(times)]
            return np.concatenate(got)
        size *= 2


class Exchange:
    """Ranges of hashes, ``times`` of them for each of n partitions, with the key by which Spark deals each to its partition."""

    def __init__(self, n: int, times: int = 1):
        self.n, self.keys = n * times, dealt(n, times).tolist()
        self.range = {k: i for i, k in enumerate(self.keys)}

    def pieces(self, values: np.ndarray) -> Iterator[tuple[int, slice]]:
        cuts = _cuts(values, self.n)
        return ((self.keys[i], slice(a, b)) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a)

    def together(self, to: pd.Series, blobs: pd.Series, values: np.ndarray, kind: np.dtype, width: int = 1, bits: bool = False) -> np.ndarray:
        """The answers about a part's sorted entries, put together from those of the ranges; 0 where there is none."""
        cuts = _cuts(values, self.n)
        out = np.zeros(len(values) * width, bool if bits else kind)
        for t, blob in zip(to, blobs, strict=True):
            i = self.range[int(t)]
            a, b = cuts[i] * width, cuts[i + 1] * width
            out[a:b] = np.unpackbits(np.frombuffer(blob, np.uint8), count=b - a) if bits else np.frombuffer(blob, kind)
        return out


def _part_anchors(x: Exchange):
    """A part's documents -> its distinct anchors, marked where two of its documents have one, and the number of their places."""

    def run(docs: pd.DataFrame) -> pd.DataFrame:
        a, twice, n = Part(docs).anchors()
        part = int(docs["part"].iloc[0])
        n = np.minimum(n, 65535).astype("<u2")
        return pd.DataFrame([(to, part, a[s].tobytes(), np.packbits(twice[s]).tobytes(), n[s].tobytes()) for to, s in x.pieces(a)], columns=["to", "part", "blob", "twice", "places"])

    return run


def _shared_anchors(pdf: pd.DataFrame) -> pd.DataFrame:
    """All parts' anchors of one range -> to each part, which of its anchors two documents have, and which are hot."""
    each = [np.frombuffer(b, np.uint64) for b in pdf["blob"]]
    a = np.concatenate(each)
    twice = np.concatenate([np.unpackbits(np.frombuffer(t, np.uint8), count=len(x)) for x, t in zip(each, pdf["twice"], strict=True)]).astype(bool)
    places = np.concatenate([np.frombuffer(b, "<u2") for b in pdf["places"]]).astype(np.int64)
    known, of, parts_ = np.unique(a, return_inverse=True, return_counts=True)
    shared = (parts_ > 1) | (np.bincount(of[twice], minlength=len(known)) > 0)
    hot = np.bincount(of, weights=places, minlength=len(known)) > HOT
    ends, to = np.cumsum([len(x) for x in each]), int(pdf["to"].iloc[0])
    rows = []
    for p, x, e in zip(pdf["part"], each, ends, strict=True):
        hit, much = shared[of[e - len(x) : e]], hot[of[e - len(x) : e]]
        if hit.any():
            rows.append((int(p), to, np.packbits(hit).tobytes(), np.packbits(much).tobytes() if much.any() else None))
    return pd.DataFrame(rows, columns=["part", "to", "bits", "more"])


def _joined(x: Exchange, docs: pd.DataFrame, hits: pd.DataFrame, keep: bool = False) -> tuple[Part, Joined]:
    part = Part(docs, keep)
    a, *_ = part.anchors()
    much = hits[hits["more"].notna()]
    return part, part.joined(a, x.together(hits["to"], hits["bits"], a, np.dtype(bool), bits=True), x.together(much["to"], much["more"], a, np.dtype(bool), bits=True))


def _part_places(x: Exchange):
    """A part's documents and which of their anchors are shared -> its distinct joined places."""

    def run(docs: pd.DataFrame, hits: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(docs) and len(hits):
            j = _joined(x, docs, hits)[1]
            name = int(docs["part"].iloc[0])
            rows = [(to, name, j.distinct[s].tobytes()) for to, s in x.pieces(j.route)]
        return pd.DataFrame(rows, columns=["to", "part", "blob"])

    return run


def _settled(with_firsts: bool):
    """All parts' joined places of one range -> to each part, which of their windows an earlier document has, and the first that has."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        each = [np.frombuffer(b, PLACE) for b in pdf["blob"]]
        bits, firsts = settled(np.concatenate(each))
        ends, to = np.cumsum([len(x) for x in each]), int(pdf["to"].iloc[0])
        rows = [(int(p), to, bits[e - len(x) : e].tobytes(), firsts[e - len(x) : e].tobytes() if with_firsts else None) for p, x, e in zip(pdf["part"], each, ends, strict=True)]
        return pd.DataFrame(rows, columns=["part", "to", "bits", "more"])

    return run


def _windows(x: Exchange, docs: pd.DataFrame, hits: pd.DataFrame, with_firsts: bool = False, keep: bool = False) -> tuple[Part, np.ndarray, np.ndarray | None]:
    """A part, the first words of its repeated windows, and (document, place) of the first that has each."""
    about = hits[hits["step"] == 1] if len(hits) else hits
    if not len(about):
        return Part(docs, keep), np.zeros(0, np.int64), np.zeros((0, 2), np.int64)
    part, j = _joined(x, docs, about, keep)
    said = hits[hits["step"] == 2]
    firsts = x.together(said["to"], said["more"], j.route, np.dtype("<i8"), 2 * (REACH + 1)).reshape(-1, REACH + 1, 2) if with_firsts else None
    return part, *j.repeated(x.together(said["to"], said["bits"], j.route, np.dtype("u1")), firsts)


def stretches(starts: np.ndarray, others: np.ndarray | None = None, end: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(first places, numbers) of the maximal runs of windows that follow one another; given ``others`` (document, place) and the
    documents' ends, of windows that do so there, too, in one document."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    apart = starts[1:] != starts[:-1] + 1
    if others is not None:
        doc = np.searchsorted(end, starts, "right")
        apart |= (others[1:, 0] != others[:-1, 0]) | (others[1:, 1] != others[:-1, 1] + 1) | (doc[1:] != doc[:-1])
    new = np.flatnonzero(np.concatenate([[True], apart]))
    return new, np.diff(np.concatenate([new, [len(starts)]]))


def _kept(x: Exchange, with_text: bool):
    """A part's documents and the answers about its anchors and places -> what is left of each document."""

    def run(docs: pd.DataFrame, hits: pd.DataFrame) -> pd.DataFrame:
        part, starts, _ = _windows(x, docs, hits, keep=True)
        first, n = stretches(starts)
        covers = np.zeros(len(part.w) + 1, np.int64)
        np.add.at(covers, starts[first], 1)
        np.add.at(covers, starts[first] + n - 1 + LENGTH, -1)
        gone = np.cumsum(covers)[:-1] > 0
        rows = []
        for i, words, n_words, end in zip(docs["doc_id"], part.words, part.size.tolist(), part.end.tolist(), strict=True):
            cut = gone[end - n_words : end]
            some = int(cut.sum())
            kept = b" ".join([w for w, x in zip(words, cut.tolist(), strict=True) if not x] if some else words)
            rows.append((i, n_words, some, hashlib.sha256(kept).hexdigest(), *([kept.decode()] if with_text else [])))
        return pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept_sha256", *(["kept_text"] if with_text else [])])

    return run


def _repeats(x: Exchange):
    def run(docs: pd.DataFrame, hits: pd.DataFrame) -> pd.DataFrame:
        part, starts, others = _windows(x, docs, hits, True)
        first, n = stretches(starts, others, part.end)
        doc = np.searchsorted(part.end, starts[first], "right")
        return pd.DataFrame({"doc_id": part.ids[doc], "start": starts[first] - (part.end - part.size)[doc], "length": n - 1 + LENGTH, "other_id": others[first, 0], "other_start": others[first, 1]})

    return run


def _exchanged(docs: DataFrame, doc_id: str, text: str, with_firsts: bool) -> tuple[Exchange, DataFrame, DataFrame, DataFrame]:
    """(exchange, all rows, those with an id dealt to parts, the answers for each part)."""
    spark = docs.sparkSession
    ship(spark)
    n = parts(spark)
    x = Exchange(n, RANGES)
    d = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    total = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    times = max(1, round(total / n / PART_BYTES))
    number = F.pmod(F.xxhash64("doc_id"), F.lit(n * times)).cast("int")
    if n * times <= LISTED:  # names that spread evenly; a great many parts do so by any name
        number = F.get(F.split(F.lit(",".join(map(str, dealt(n, times).tolist()))), ",").cast("array<int>"), number)
    own = d.where("doc_id is not null").withColumn("part", number).repartition(n, "part")
    asked = own.groupBy("part").applyInPandas(_part_anchors(x), "to int, part int, blob binary, twice binary, places binary")
    shared = asked.groupBy("to").applyInPandas(_shared_anchors, "part int, to int, bits binary, more binary")
    places = own.groupBy("part").cogroup(shared.groupBy("part")).applyInPandas(_part_places(x), "to int, part int, blob binary")
    firsts = places.groupBy("to").applyInPandas(_settled(with_firsts), "part int, to int, bits binary, more binary")
    return x, d, own, shared.withColumn("step", F.lit(1)).unionByName(firsts.withColumn("step", F.lit(2)))


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, length, other_id, other_start): the maximal repeats of LENGTH words or more, places in words from 0.

    A row is a stretch of windows that follow one another and that the same earlier document, the first that has each (smallest id,
    then place), has in a row, too; stretches of one document may overlap. Rows of null ids have none; of equal ids none
    of each other. An empty table gives none.
    """
    x, _, own, answers = _exchanged(docs, doc_id, text, True)
    return own.groupBy("part").cogroup(answers.groupBy("part")).applyInPandas(_repeats(x), "doc_id bigint, start bigint, length bigint, other_id bigint, other_start bigint")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept_text]) of every row.

    Null and empty texts have no words, and texts of fewer than LENGTH words lose none. Rows of equal id are one document:
    they take no words from each other. Rows whose id is null are not read by the others and lose nothing. Other columns
    are not read. An empty table gives none.
    """
    x, d, own, answers = _exchanged(docs, doc_id, text, False)
    out = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * keep_text
    left = own.groupBy("part").cogroup(answers.groupBy("part")).applyInPandas(_kept(x, keep_text), out)
    return left.unionByName(d.where("doc_id is null").mapInPandas(_untouched(x, keep_text), out))


def _untouched(x: Exchange, with_text: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keep = _kept(x, with_text)
        for b in batches:
            yield keep(b.assign(doc_id=0), pd.DataFrame()).assign(doc_id=None).astype({"doc_id": "Int64"})

    return run
