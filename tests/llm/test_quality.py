"""Quality rules."""

from helpers import brute_quality, by, prose

from kindred.llm import quality


def test_quality(docs, empty):
    got = quality.with_quality(docs)
    assert got.columns.count("kept") == 1 and quality.with_quality(empty).count() == 0 == quality.clean(empty).count()
    want = sorted(((r["doc_id"], *brute_quality(r["text"])) for r in docs.collect()), key=str)
    assert by(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
    kept = {r["doc_id"]: r["kept"] for r in got.collect()}
    assert kept[4] and kept[7] and not kept[0] and not kept[8] and not kept[9]
    clean = quality.clean(docs).collect()
    assert {r["doc_id"] for r in clean} == {k for k, v in kept.items() if v} and {(r["kept"], r["n_words"]) for r in clean} == {("clash", "clash")}
    assert quality.clean(docs).columns == docs.columns


def test_quality_lines(spark):
    good = prose(60, 5)
    d = spark.createDataFrame([(1, good + "\nHome | About | Contact | Login\n© All rights reserved.\nCLICK!! HERE!! NOW!!")], "doc_id int, text string")
    assert quality.clean(d).first()["text"] == good
    bare = spark.createDataFrame([(1, prose(60, 6)[:-1]), (2, "\n".join(prose(8, k)[:-1] for k in range(9))), (3, prose(60, 6))], "doc_id int, text string")
    assert [r["doc_id"] for r in quality.clean(bare).collect()] == [3]
    long = "Privacy policy, cookie policy: " + prose(60, 7) + " All rights reserved."
    rows = [(1, long, 1, 2), (2, prose(200, 8) + " Our privacy policy.", 3, 4)]
    odd = spark.createDataFrame(rows, "doc_id int, text string, __w int, __row int")
    got = {r["doc_id"]: r for r in quality.with_quality(odd).collect()}
    assert got[1]["n_bad_lines"] == 1 and got[2]["n_bad_lines"] == 0 and (got[2]["__w"], got[2]["__row"]) == (3, 4)
