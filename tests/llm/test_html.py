"""Main text of pages: zones, neighbours, odd and very long markup."""

import time

import pytest

from kindred.llm import htmltext

TEXT = "A paragraph of text that has words enough to be one, and more of them."
P = f"<p>{TEXT}</p>"


@pytest.mark.parametrize(
    "page",
    [
        f"<article><div class='hero banner'>{P}</div></article>",
        f"<div class='most-popular-article'>{P}</div>",
        f"<article class='legal'>{P}</article>",
        f'<article class="post comments-open">{P}</article>',
        f'<main class="has-share">{P}</main>',
        f'<body><form id="aspnetForm"><div><article>{P}</article></div></form></body>',
        f"<table><tr><td class='sidebar'>A side note that is long enough to be a paragraph of its own.<td>{TEXT}</table>",
        f"<article>{P}</article><ol class=comment-list><li><article class='comment-body'>{P}</article></ol>",
        f"<article>{P}<div hidden>{P}</div><aside>{P}</aside></article>",
        f"<div class=advertBox>{P}</div><main>{P}</main><div id=cookie-banner>{P}</div>",
    ],
)
def test_the_article_and_nothing_else(page):
    assert htmltext.main_text(page) == TEXT


def test_wrappers_headings_links_and_inline_adverts():
    assert htmltext.main_text(f'<div class="layout with-sidebar"><h2>Title here</h2>{P}{P}</div>') == f"Title here\n{TEXT}\n{TEXT}"
    assert htmltext.main_text(f"<article>{P}<p><a href=x>See the list of links</a></p>{P}</article>") == f"{TEXT}\nSee the list of links\n{TEXT}"
    assert htmltext.main_text(f"<h1>Title</h1>{P}<h2>Next</h2><p>One.</p>{P}") == f"Title\n{TEXT}\nNext\nOne.\n{TEXT}"
    assert htmltext.main_text(f"<article><p>{TEXT} <span class='advert'>Buy <span>now</span> cheap</span> So.</p></article>") == f"{TEXT} So."


def test_the_tree_asks_about_neighbours():
    def features(tree):
        return set() if isinstance(tree, int) else {htmltext.FEATURES[tree[0]]} | features(tree[2]) | features(tree[3])

    tree = htmltext.grow(*htmltext.training_rows())
    assert features(tree) & {"words_before", "density_before", "words_after", "density_after"}
    block = (0.0, 0.0, 0.0, 3, 1.0)
    assert htmltext.decide(tree, (*block, 4, 1.0, 5, 1.0)) == 0
    long, one = " ".join([TEXT] * 4), "<p><a href=x>two linked words, of some</a> five</p>"
    assert htmltext.main_text(f"<p>{long}</p>{one}<p>{long}</p>").count("\n") == 2 and "linked" not in htmltext.main_text("<p><a href=x>One two three</a></p>" * 3 + one + "<p><a href=x>One two three</a></p>" * 3)


@pytest.mark.parametrize("piece", ["<svg>", "<a ", '<a x=">"', "<div class=ad>", "<td>", "<li><ul><div>", "<!--", "<p a='", "<", "&amp;", "<script>", "</div>", "<select>"])
def test_a_megabyte_of_odd_markup_takes_linear_time(piece):
    page = piece * (1_000_000 // len(piece))
    start = time.process_time()
    htmltext.main_text(page)
    assert time.process_time() - start < 5


def test_tags_that_never_end():
    assert htmltext.main_text("<p>Some text before it <b") == "Some text before it"
    assert htmltext.main_text(f'<article>{P}<a href="x>y</a>{P}</article>').startswith(TEXT)
    assert htmltext.main_text("1 < 2 and 3 <4") == "1 < 2 and 3 <4"
    assert htmltext.main_text("<!-->Seen<!-- not seen --> again") == "Seen again"
