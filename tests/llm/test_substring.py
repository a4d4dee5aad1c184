"""Substring dedup and maximal repeats."""

import random

import pytest
from helpers import WORD, brute_repeats, by, prose
from pyspark.sql import functions as F

from kindred.llm import substring


def test_repeats(docs, empty):
    assert by(substring.remove_repeats(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == brute_repeats([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert substring.remove_repeats(empty).count() == 0


def test_repeats_of_random_pieces(spark):
    r = random.Random(4)
    pieces = [prose(r.randint(8, 30), k)[:-1] for k in range(12)]
    rows = [(i, " ".join(r.choice(pieces) for _ in range(r.randint(0, 6)))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert by(substring.remove_repeats(df), "doc_id", "n_words", "n_removed", "kept_sha256") == brute_repeats(rows)
    # the same where every anchor that two places have counts as hot, and by the repeats themselves
    covered = {i: set() for i, _ in rows}
    words = {i: t.split() for i, t in rows}
    for x in substring.repeats(df).collect():
        assert x["length"] >= 13 and x["other_id"] < x["doc_id"]
        a, b = x["start"], x["other_start"]
        assert words[x["doc_id"]][a : a + x["length"]] == words[x["other_id"]][b : b + x["length"]]
        covered[x["doc_id"]].update(range(a, a + x["length"]))
    assert sorted((i, len(c)) for i, c in covered.items()) == sorted((i, k) for i, _, k, _ in brute_repeats(rows))
    null = spark.createDataFrame([(None, pieces[0]), (1, pieces[0])], "doc_id long, text string")
    assert {x["n_removed"] for x in substring.remove_repeats(null).collect()} == {0}


def brute_firsts(rows):
    """The first (id, place) of every window, and the stretches of windows whose firsts follow one another."""
    words = {i: WORD.findall(t or "") for i, t in rows}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][k : k + 13]), (i, k))
    out = []
    for i, w in words.items():
        last = None
        for k in range(len(w) - 12):
            d, at = first[tuple(w[k : k + 13])]
            if d == i:
                last = None
            elif last and last[3] == d and last[4] + last[2] - 12 == at:
                last[2] += 1
            else:
                last = [i, k, 13, d, at]
                out.append(last)
    return sorted(map(tuple, out))


@pytest.mark.parametrize("hot", [False, True])
def test_maximal_repeats_and_hot_anchors(hot):
    """The steps of the exchange on two parts and one range, against brute force; hot anchors go out as whole windows."""
    import pandas as pd

    r = random.Random(8)
    pieces = [prose(r.randint(3, 40), k)[:-1] for k in range(9)]
    rows = [(i, " ".join(r.choice(pieces) for _ in range(r.randint(0, 7)))) for i in range(60)]
    x = substring.Exchange(1)
    halves = [pd.DataFrame(rows[k::2], columns=["doc_id", "text"]).assign(part=k) for k in (0, 1)]
    old, substring.HOT = substring.HOT, 1 if hot else substring.HOT
    try:
        shared = substring._shared_anchors(pd.concat([substring._part_anchors(x)(h) for h in halves]))
    finally:
        substring.HOT = old
    assert bool(shared["more"].notna().any()) == hot
    places = pd.concat([substring._part_places(x)(h, shared[shared["part"] == k]) for k, h in enumerate(halves)])
    answers = pd.concat([shared.assign(step=1), substring._settled(True)(places).assign(step=2)])
    got, left = [], []
    for k, h in enumerate(halves):
        mine = answers[answers["part"] == k]
        got += [tuple(t) for t in substring._repeats(x)(h, mine).itertuples(index=False)]
        left += [tuple(t) for t in substring._kept(x, False)(h, mine).itertuples(index=False)]
    assert sorted(got) == brute_firsts(rows)
    assert sorted(left, key=str) == brute_repeats(rows)


def test_ranges_have_partitions_of_their_own(spark):
    for n, times in ((1, 1), (7, 3), (211, 1)):
        keys = substring.dealt(n, times).tolist()
        df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "to int, i int").repartition(n, "to").select("i", F.spark_partition_id().alias("p"))
        assert len(set(keys)) == n * times and all(r["p"] == r["i"] % n for r in df.collect())
