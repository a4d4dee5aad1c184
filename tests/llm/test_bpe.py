"""The tokenization automaton."""

import hashlib
import json

import numpy as np

from hypothesis import given, settings
from hypothesis import strategies as st

from kindred.llm import bpe, queries


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=40), st.lists(st.sampled_from(["the", "in", "ing", "a", "aa", "aaaa", "  ", " ", "\n", "'s", "<|endoftext|>", "é", "世界", "12", "==", "🙂"]), max_size=15).map("".join)))
def test_bpe_is_the_library(tokenizer, s):
    a = bpe.automaton(queries.tokenizer_path())
    want = tokenizer.encode(s, add_special_tokens=False).ids
    got = a.encode(s)
    assert np.frombuffer(got, "<u4").tolist() == want
    assert a.decode(got) == tokenizer.decode(want, skip_special_tokens=False) == s


def test_gadgets_of_a_small_automaton(tmp_path):
    """All paths of the automaton: just one spells each string, and it is what merging by rank gives."""
    letters = {chr(b) if b in bpe.PLAIN_BYTES else None: b for b in range(256)}
    alphabet = list(bpe.byte_letters())
    merges = [("a", "a"), ("a", "b"), ("aa", "b"), ("b", "a"), ("ab", "ab"), ("aa", "aa"), ("b", "b")]
    vocab = {x: i for i, x in enumerate([*alphabet, *dict.fromkeys(a + b for a, b in merges)])}
    assert letters
    (tmp_path / "t.json").write_text(json.dumps({"added_tokens": [], "model": {"vocab": vocab, "merges": [" ".join(m) for m in merges]}}))
    auto = bpe.Automaton(str(tmp_path / "t.json"))
    name = {v: k for k, v in vocab.items()}

    def merged(word):
        w = list(word)
        while True:
            ranks = [(merges.index(p), i) for i, p in enumerate(zip(w, w[1:], strict=False)) if p in merges]
            if not ranks:
                return w
            r, _ = min(ranks)
            i, out = 0, []
            while i < len(w):
                if i + 1 < len(w) and (w[i], w[i + 1]) == merges[r]:
                    out.append(w[i] + w[i + 1])
                    i += 2
                else:
                    out.append(w[i])
                    i += 1
            w = out

    for n in range(1, 9):
        for k in range(2**n):
            word = "".join("ab"[k >> j & 1] for j in range(n))
            assert [name[t] for t in auto.path(word.encode())] == merged(word)


def test_bpe_makes_one_transition_a_byte(tokenizer, monkeypatch):
    a = bpe.Automaton(queries.tokenizer_path())
    compiled = []
    plain = bpe.Automaton._compile
    monkeypatch.setattr(bpe.Automaton, "_compile", lambda self, row, byte: (compiled.append((row.under_way, row.token, byte)), plain(self, row, byte))[1])
    words = [w.encode() for w in (" internationalisation", "thethethe", "xqzzv", "世界世界", "aaaaaaaaaaaaaaaaa", " ", "\n\n\n")]
    for w in words:
        a.path(w)
    assert len(compiled) == len(set(compiled)) == a.cells <= sum(map(len, words))
    compiled.clear()
    for w in words:
        row = a.start
        for byte in w:
            row = row[byte]  # one row of the table for each byte, and no other
        assert row.token == a.path(w)[-1]
    assert not compiled
    b = bpe.Automaton(queries.tokenizer_path(), cache=5)  # a table that starts anew all the time gives the same
    assert [b.path(w) for w in words] == [a.path(w) for w in words] == [tokenizer.encode(w.decode(), add_special_tokens=False).ids for w in words]


def test_bpe_query(docs, empty, tokenizer):
    got = {r["doc_id"]: r for r in bpe.tokenize(docs, queries.tokenizer_path(), keep_ids=True).collect()}
    for r in docs.collect():
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids
        g = got[r["doc_id"]]
        assert g["ids"] == ids and g["n_tokens"] == len(ids) and g["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and g["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    assert bpe.tokenize(empty, queries.tokenizer_path()).count() == 0
