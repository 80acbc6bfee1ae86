"""Main text of pages: blocks, the field against all paths, unseen layouts."""

import itertools
import math
import time

import numpy as np
import pytest

from argusframe.llm import pages


def texts(source):
    return [b.text for b in pages.read(source).blocks]


@pytest.mark.parametrize("source, want", [
    ("", []), ("  \n", []), ("plain  text\n here", ["plain text here"]),
    ("<p>a<p>b<br>c</p>d", ["a", "b c", "d"]),
    ("<p><b>one.<br><p>two</b> three</p>", ["one.", "two three"]),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", ["a", "b", "c", "d"]),
    ("x &lt;y&gt; &amp;amp; &eacute;&#x41;&#66; &nosuch; &copy z", ["x <y> &amp; éAB &nosuch; © z"]),
    ("a&nbsp;b&#160;&#10;c", ["a b c"]),
    ("<script>var t='</p><p>no';</script>yes<style>p{}</style><!-- <p>no --><title>no</title>", ["yes"]),
    ("a < b and c<d <3", ["a < b and c"]),
    ('<p title="a>b">text</p><a href=x>l</a>', ["text", "l"]),
    ("<div>open <span>never closed", ["open never closed"]),
    ("<p>kept<script>no end", ["kept"]), ("<p>kept<!-- no end", ["kept"]), ("<p>kept<a href='no end", ["kept"]),
    ("<!-->a<!--->b<!doctype x><?php y ?>c", ["abc"]),
    ("<table><tr><td>1<td>2<tr><td>3</table>", ["1", "2", "3"]),
    ("<select><option>x</select><button>go</button><p>t", ["t"]),
    ("<P>UPPER</P><DIV CLASS=x>mixed</div>", ["UPPER", "mixed"]), ("</p></div>late", ["late"]),
])
def test_blocks(source, want):
    assert texts(source) == want


def test_ancestors_and_links():
    page = pages.read('<div class="postBody"><p>see <a href=x>here</a></p><aside id=side-bar>x</aside></div>')
    one, two = page.blocks
    assert pages.ancestry(page, one.node) == ["tag p", "is post", "is body"]
    assert "is side" in pages.ancestry(page, two.node) and "tag p" not in pages.ancestry(page, two.node)
    assert one.linked == pytest.approx(0.5) and two.linked == 0


@pytest.mark.parametrize("piece", ["<a '", "<div>", "<!--", "</p>", "<script>", "&#", "<li>", '<a ">', "<td>", "< "])
def test_time_is_linear_in_broken_pages(piece):
    start = time.process_time()
    pages.read(piece * 60000)
    assert time.process_time() - start < 5


def test_viterbi_and_forward_backward_against_all_paths():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 7):
        score, t = rng.normal(size=n), rng.normal(size=(2, 2, 2))
        same = rng.integers(0, 2, n)
        weight = {}
        for path in itertools.product((0, 1), repeat=n):
            s = sum(x for x, y in zip(score, path, strict=True) if y)
            weight[path] = s + sum(t[same[i], path[i - 1], path[i]] for i in range(1, n))
        assert tuple(pages.viterbi(score.tolist(), same.tolist(), t)) == max(weight, key=weight.get)
        z = math.log(sum(map(math.exp, weight.values())))
        padded = np.zeros((2, n + 3))
        padded[0, :n] = score
        more = np.zeros((2, n + 3), np.int64)
        more[0, :n] = same
        total, chance, moves = pages.expectations(padded, more, np.array([n, 1]), t)
        assert total[0] == pytest.approx(z)
        for i in range(n):
            want = sum(math.exp(w - z) for p, w in weight.items() if p[i])
            assert chance[0, i] == pytest.approx(want)
        want = np.zeros((2, 2, 2))
        for p, w in weight.items():
            for i in range(1, n):
                want[same[i], p[i - 1], p[i]] += math.exp(w - z)
        assert moves == pytest.approx(want)


STORY = [
    "A bridge over the river", "The old bridge was closed on Monday after cracks had been found in two of its pillars.",
    "Engineers said that repairs would take until spring, and that ferries would run in the meantime.",
    "No one was hurt.", "Shops on the far side fear for their business, as most of their customers come on foot.",
]


def story(tag="p"):
    return f"<h1>{STORY[0]}</h1>" + "".join(f"<{tag}>{x}</{tag}>" for x in STORY[1:])


UNSEEN = {
    "article": f"<nav><a href=/>Home</a></nav><article>{story()}</article><footer>© 2020 Paper</footer>",
    "content": '<div id="top-header"><p>The Paper</p></div><ul class="main-menu"><li><a href=/>Home</a><li><a href=/b>World</a></ul>'
    f'<div class="cookie-banner"><p>We use cookies. <a href=/c>More</a></p></div><div id="content">{story()}</div>'
    '<div class="sidebar"><h3>Most read</h3><ul><li><a href=/1>A storm is coming to the coast tonight</a></ul></div>'
    '<form class="newsletter"><p>Get our letter</p></form><div id="footer"><p>© The Paper. All rights reserved.</p></div>',
    "comments": f'<main><div class="post-content">{story()}</div><section id="comments"><h3>2 comments</h3>'
    '<div class="comment"><p>I walked there every day and I will miss it very much, to be honest.</p></div>'
    '<div class="comment"><p>Why did nobody look at the pillars before?</p></div></section></main><footer><p>Imprint</p></footer>',
    "advert": '<header><p>Town News</p><nav><a href=/>Start</a></nav></header><article>' + story()[:-4].replace(
        "<p>No one", '<div class="advert"><p>Buy two shoes and pay for one, only this week!</p></div><p>No one') + "</p></article>"
    '<aside><p>Related: <a href=/2>the ferry of old times</a></p></aside><footer>Terms</footer>',
    "section": f'<div class="wrapper"><div class="navbar"><a href=/>Home</a> <a href=/x>Away</a></div><section class="story">{story()}</section>'
    '<div class="social-share"><a href=/s>Share</a></div><div class="copyright">© 2021</div></div>',
}


@pytest.fixture(scope="module")
def model(spark):
    return pages.fit(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))


@pytest.mark.parametrize("kind", list(UNSEEN))
def test_layouts_that_were_never_seen(model, kind):
    assert pages.main_text(UNSEEN[kind], model) == "\n".join(STORY)


def test_whole_table_gives_the_marked_articles(spark):
    """Held-out pages: sf0.01 by a field of its own sample; the mark itself says what is right."""
    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {}
    for r in table.collect():
        page = pages.read(r["html"])
        want[r["page_id"]] = "\n".join(b.text for b, y in zip(page.blocks, pages.labels(page), strict=True) if y)
    got = pages.extract(table).collect()
    assert {r["page_id"]: r["text"] for r in got} == want and len(got) == len(want)
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_most_blocks_of_other_layouts_are_right(model):
    """Layouts drawn anew around articles of other pages."""
    import random

    rng = random.Random(99)
    main = [("h1", STORY[0]), *(("p", x) for x in STORY[1:])]
    wrong = total = 0
    for _ in range(300):
        source, y = pages._layout(rng, main, ["A line of another page that stands here.", "Short one"])
        page = pages.read(source)
        got = pages.viterbi(pages.emissions(page, model), pages.alike(page), model.transition)
        wrong += sum(a != b for a, b in zip(got, y, strict=True))
        total += len(y)
    assert wrong < 0.05 * total


def test_page_edges(spark):
    schema = "page_id long, url string, html string, text string, n_chars int, whole string"
    rows = [
        (1, "u", None), (2, None, ""), (None, "u", "<article><p>One two three, four.</p></article>"),
        (3, "u", "<article>" + "<p>word after word, and more words.</p>" * 20000 + "</article>"),
        (4, "u", "<nav><a href=/>x</a></nav>"), (4, "u", "<nav><a href=/>x</a></nav>"), (5, "u", "<div>" * 50000 + "deep"),
    ]
    table = spark.createDataFrame([(*r, "t", 1, "w") for r in rows], schema)
    got = pages.extract(table).collect()
    assert len(got) == 7 and got[0].asDict().keys() == {"page_id", "url", "text", "n_chars"}
    by_id = {r["page_id"]: r for r in got}
    assert by_id[1]["text"] == by_id[2]["text"] == by_id[4]["text"] == ""
    assert by_id[None]["text"] == "One two three, four." and by_id[3]["text"].count("\n") == 19999
    assert pages.extract(table.where("false")).collect() == []
    assert pages.extract(table.where("page_id = 1")).collect()[0]["n_chars"] == 0
