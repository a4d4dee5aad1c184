"""BPE encoding and decoding with a tokenization automaton.

Construction. Begin with one state and an arc to it for every byte: any byte string, one token a byte. Then take the
merges in rank order; the gadget for a merge (a, b) -> c changes the automaton so that it accepts the same texts with a b
replaced by c: the state that a's arcs enter loses its arc b, and wherever an arc a leaves, an arc c is added that enters
the state b's arcs entered. Since all arcs of one label enter one state, the state after a token is named by the token,
and what is left of a state is which tokens may leave it. After all merges an arc t leaves state s exactly if the two
stand side by side in some correct encoding, and of all ways to cut a word into tokens just one is a path. The gadgets are
kept in order, one row each (left part, right part, rank); which arcs leave a state follows from them, the youngest first.

Arcs are spelled out byte by byte and the automaton is made deterministic: a state of the table is the set of arcs that can
be under way after the bytes so far, each as the token it leaves and the node it has reached in the trie of labels. As
just one path spells any string, at most one arc ends with each byte: that token is the state's output. A table of all states
would have no end worth having (the plain one, states by tokens, has 2.5 billion cells), so rows are compiled when a byte
first leads to them and kept; a table that grows beyond a bound starts anew.

Encoding makes one transition a byte over the words that the pre-tokenizer's pattern cuts, and never steps back; the
tokens of the path are read from the outputs, from the word's end. Decoding emits the byte labels of the arcs. A
word's path is kept for as long as the bounded cache holds it.
"""

from __future__ import annotations

import hashlib
import json
import sys
from array import array
from collections.abc import Iterator
from itertools import accumulate, chain
from operator import getitem

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import ship

#: The pre-tokenizer's pattern of byte-level BPE, and the bytes that stand for themselves in its vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN_BYTES = (*range(33, 127), *range(161, 173), *range(174, 256))
#: Words of a generation of a worker's cache, which keeps two; transitions that the table may have, after which it starts anew; and
#: known arcs likewise. A worker takes some 250 MB with it, half of it with half.
CACHE = 400_000
#: Where the number of an arc under way keeps the token it leaves, plus one, above its node in the trie.
LEFT = 32
#: Bytes of ids after which a worker hands over what it has.
HELD_BYTES = 4 << 20
#: A word longer than this is not kept.
CACHE_BYTES = 64


def byte_letters() -> dict[str, int]:
    """Letter of the vocabulary -> byte: plain bytes are themselves, the others follow from code point 256 on."""
    others = [b for b in range(256) if b not in set(PLAIN_BYTES)]
    return {chr(b): b for b in PLAIN_BYTES} | {chr(256 + i): b for i, b in enumerate(others)}


class _Row(dict):
    """A state: byte -> the next state, compiled when it is first asked for; the arcs under way in it, and the token whose arc ends in it."""

    __slots__ = ("automaton", "size", "token", "under_way")

    def __init__(self, automaton: Automaton, under_way: tuple[int, ...], token: int):
        super().__init__()
        self.automaton, self.under_way, self.token = automaton, under_way, token
        self.size = automaton.sizes[token] if token >= 0 else 0

    def __missing__(self, byte: int) -> _Row:
        return self.automaton._compile(self, byte)


class Automaton:
    """The tokenization automaton of one tokenizer file (the ``tokenizers`` library's JSON, byte-level BPE)."""

    def __init__(self, path: str, cache: int = CACHE):
        self.cache = cache
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        letters = byte_letters()
        as_bytes = lambda s: bytes(letters[x] for x in s)
        added = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
        vocab = {k: v for k, v in model["model"]["vocab"].items() if k not in added}
        n = max([*vocab.values(), *added.values()]) + 1
        self.labels: list[bytes] = [b""] * n
        for k, v in vocab.items():
            self.labels[v] = as_bytes(k)
        self.special = {s: i for s, i in added.items()}
        for s, i in added.items():
            self.labels[i] = s.encode()
        self.by_label = {self.labels[v]: v for v in vocab.values()}
        # one gadget a row: rank of a token (0: a byte, from the start), its parts, and the rank at which a pair of tokens merges
        self.rank = [0] * n
        self.left = list(range(n))
        self.right = list(range(n))
        self.merged: dict[int, int] = {}
        self.n = n
        for r, m in enumerate(model["model"]["merges"], 1):
            a, b = (vocab[x] for x in (m.split(" ") if isinstance(m, str) else m))
            c = self.by_label[self.labels[a] + self.labels[b]]
            if self.merged.setdefault(a * n + b, r) == r and not self.rank[c]:
                self.rank[c], self.left[c], self.right[c] = r, a, b
        self.arcs: dict[int, bool] = {}
        # labels that no text leads to are no arcs of the first state
        self.by_label = {x: t for x, t in self.by_label.items() if self.arc(-1, t)}
        # the trie of labels: (node, byte) -> node, and the token that ends in a node
        self.down: dict[int, int] = {}
        self.token: list[int] = [-1]
        for x, t in self.by_label.items():
            node = 0
            for byte in x:
                after = self.down.get(node << 8 | byte)
                if after is None:
                    after = self.down[node << 8 | byte] = len(self.token)
                    self.token.append(-1)
                node = after
            self.token[node] = t
        self.sizes = [len(x) for x in self.labels]
        self._clear()
        self.pattern = regex.compile(PATTERN)
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.words = _Paths(self)

    def _meet(self, a: int, b: int, limit: int) -> bool:
        """Whether tokens a and b stay side by side through all merges of a rank below ``limit``, running the gadgets backwards."""
        rank, left, right, merged, n = self.rank, self.left, self.right, self.merged, self.n
        while merged.get(a * n + b, limit) >= limit:
            ra, rb = rank[a], rank[b]
            if ra > rb:
                limit, a = ra, right[a]  # the state after a began as a copy of that after its right part
            elif rb:
                limit, b = rb + 1, left[b]  # the arc b was put wherever the arc of its left part was, unless that merge took it
            else:
                return True  # two bytes, side by side from the start
        return False

    def arc(self, s: int, t: int) -> bool:
        """Whether, after all gadgets, an arc t leaves the state after s; s is -1 for the first state."""
        key = s * self.n + t
        known = self.arcs.get(key)
        if known is None:
            if len(self.arcs) >= self.cache:
                self.arcs.clear()
            if s >= 0:
                known = self._meet(s, t, 1 << 62)
            else:
                known = not self.rank[t] or self._meet(self.left[t], self.right[t], self.rank[t]) and self.arc(-1, self.left[t]) and self.arc(-1, self.right[t])
            self.arcs[key] = known
        return known

    def _clear(self) -> None:
        """Start the table anew, with the row of the state before the first byte: under way from it are the arcs of the first state."""
        self.start = _Row(self, (0,), -1)
        self.states = {(0, -1): self.start}
        self.cells = 0

    def _compile(self, row: _Row, byte: int) -> _Row:
        """The transition from ``row`` by ``byte``: every arc under way goes on in the trie; the one that ends is put out,
        and the arcs that leave it are under way."""
        down, token, under_way, ends = self.down, self.token, [], -1
        for arc in row.under_way:
            s, node = (arc >> LEFT) - 1, arc & ((1 << LEFT) - 1)
            after = down.get(node << 8 | byte)
            if after is not None:
                under_way.append((s + 1) << LEFT | after)
                t = token[after]
                if t >= 0 and (s < 0 or self.arc(s, t)):
                    ends = t
        if ends >= 0:
            under_way.append((ends + 1) << LEFT)
        key = (*under_way, ends)
        to = self.states.get(key)
        if to is None:
            to = self.states[key] = _Row(self, key[:-1], ends)
        row[byte] = to
        self.cells += 1
        return to

    def path(self, word: bytes) -> list[int]:
        """The labels of the only path that spells ``word``: one transition a byte, then the outputs from its end."""
        if self.cells > self.cache:
            self._clear()
        rows = list(accumulate(word, getitem, initial=self.start))
        labels, at = [], len(word)
        while at:
            row = rows[at]
            labels.append(row.token)
            at -= row.size
        return labels[::-1]

    def encode(self, text: str) -> bytes:
        """The ids of ``text`` as little-endian unsigned 32-bit integers."""
        pieces = [text] if self.cut is None or not any(s in text for s in self.special) else self.cut.split(text)
        word = self.words.__getitem__
        if len(pieces) == 1:
            return b"".join(map(word, self.pattern.findall(text)))
        return b"".join(chain.from_iterable([self.special[p].to_bytes(4, "little")] if p in self.special else map(word, self.pattern.findall(p)) for p in pieces))

    def decode(self, ids: bytes) -> str:
        """The text that the arcs of ``ids`` spell; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.labels.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def _packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class _Paths(dict):
    """Word -> its ids in bytes. What a full generation held is still found in the next and moves on when it is used."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton
        self.old: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            raw = word.encode()
            ids = _packed(self.automaton.path(raw))
            if len(raw) > CACHE_BYTES:
                return ids
        if len(self) >= self.automaton.cache:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids


_automata: dict[tuple[str, int], Automaton] = {}


def automaton(path: str, cache: int = CACHE) -> Automaton:
    """The automaton of a tokenizer file, built once in each process."""
    if (path, cache) not in _automata:
        _automata[path, cache] = Automaton(path, cache)
    return _automata[path, cache]


def _encoded(path: str, keep: bool, cache: int):
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if keep else [])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = automaton(path, cache)
        for b in batches:
            rows, held = [], 0
            for i, text in zip(b["doc_id"], b["text"], strict=True):
                ids = a.encode(text or "")
                rows.append((i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(a.decode(ids).encode()).hexdigest(), *([np.frombuffer(ids, "<i4")] if keep else [])))
                held += len(ids) * keep
                if held > HELD_BYTES:
                    yield pd.DataFrame(rows, columns=names)
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=names)

    return run


def tokenize(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False, cache: int = CACHE) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) of every row, with the tokenizer file at path ``tokenizer``.

    Null and empty texts have no tokens. Rows are independent: repeated rows give repeated results, other columns are not
    read, and an empty table gives none. The path must be readable on the executors. ``cache`` is what a worker keeps; less takes
    less memory and more time.
    """
    ship(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInPandas(_encoded(tokenizer, keep_ids, cache), f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids)
