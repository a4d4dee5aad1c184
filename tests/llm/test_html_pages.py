"""Main text of pages: round trips, the table, the training rows."""

import re

from pyspark.sql import functions as F

from kindred.llm import htmltext, queries


def test_html(spark):
    page = """<html><head><title>t</title><script>var a = "</p>";</script></head><body><nav><a href=x>Home</a></nav><div class="cookie-notice">We use cookies on this site to make it better.</div>
    <article><h1>Tom &amp; Jerry</h1><p>First   paragraph of the <b>article</b> with some words, and a <a href="x>y">link</a>.<p>Short.</p></article>
    <aside>A side note that is long enough to be taken for a paragraph of text.</aside><div id="comments"><p>Nice article, I liked it a lot, thank you.</p></div><footer>&copy; x</footer></body></html>"""
    want = "Tom & Jerry\nFirst paragraph of the article with some words, and a link.\nShort."
    rows = [(1, "u", page), (2, "u", None), (3, None, ""), (4, "u", "<"), (5, "u", "<p>" + "word, " * 50_000), (1, "u", page), (6, "u", "<script>never closed"), (7, "u", "<!-- open")]
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))).collect()}
    assert got[1] == (want, len(want)) and got[2] == got[3] == got[6] == got[7] == ("", 0)
    assert got[5][1] == len("word, " * 50_000) - 1
    assert htmltext.extract(spark.createDataFrame(rows[:0], "page_id long, url string, html string")).count() == 0


def test_html_odd_markup():
    text = "A paragraph of text that has words enough to be one, and more."
    odd = [
        f"<article><p title=it's>{text}<p data-x=\"a>b\">{text}</article>",
        f"<head><meta x><article><p>{text}</p><button>Buy</button><p>{text}</p><select><option>x</select></article>",
        f"<article><p>{text}</p><svg><text>no</text></svg><p class=y'>{text}",
        f"<ARTICLE><P>{text}</P><!-- <p>no</p> --><P>{text}</P><object></ARTICLE>",
    ]
    for page in odd:
        assert htmltext.main_text(page) == f"{text}\n{text}"


def test_html_tree_on_held_out_pages():
    """Grown on all training pages but one, it must label the blocks of that one."""
    lines = [x for x in htmltext.TRAINING.split("\n") if x.strip()]
    right = total = 0
    for i in range(len(lines)):
        old = htmltext.TRAINING
        try:
            htmltext.TRAINING = "\n".join(lines[:i] + lines[i + 1 :])
            tree = htmltext.grow(*htmltext.training_rows())
            htmltext.TRAINING = lines[i]
            xs, ys = htmltext.training_rows()
        finally:
            htmltext.TRAINING = old
        right += sum(htmltext.decide(tree, x) == y for x, y in zip(xs, ys, strict=True))
        total += len(ys)
    assert right >= 0.9 * total


def test_html_of_the_pages_table(spark, data):
    got = {r["page_id"]: r["text"] for r in queries.op5_html_text(spark, data).collect()}
    import html as H

    for r in spark.read.parquet(f"{data}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.DOTALL)[1]
        parts = [" ".join(H.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>|<br>(?=<p>)", inner)]
        assert got[r["page_id"]] == "\n".join(x for x in parts if x)
