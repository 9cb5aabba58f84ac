from __future__ import annotations

import random
import time

import pytest

from backdate.llm.main_text import best_container, extract_main_text, main_text, read

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var x="<p>no</p>";</script></head><body>
<header><p>Site name and a long claim that is no part of the article at all</p></header><nav><ul><li><a href=/>Home</a></ul></nav>
<div class="ad box">Buy this</div><div class="content c{n}"><h1>Title {n}</h1><p>First &amp; <b>bold</b>
 text.<p>Second &#233;&nbsp;one<br>line<ul><li>item</ul><aside>see also</aside><form><p>mail</p></form></div>
<section class="comments"><p>{comment}</p></section><footer>end</footer></body></html>"""
TEXT = "Title {n}\nFirst & bold text.\nSecond é one line\nitem"


def pages(spark, rows):
    kind = "page_id long, url string, html string, host string, path string, text string, v_host string"
    return spark.createDataFrame([(*r, "h", "p", "t", "v") for r in rows], kind)


def extracted(spark, rows):
    return {r.page_id: r for r in extract_main_text(pages(spark, rows)).collect()}


def test_host_consensus_beats_a_page_with_long_comments(spark):
    rows = [(i, f"http://a.org/{i}", PAGE.format(n=i, comment="short")) for i in range(6)]
    # On its own, this page's longest container would be another.
    other = PAGE.format(n=6, comment="x").replace('<div class="ad box">Buy this</div>', "<div class=teaser><p>" + "words " * 200 + "</p></div>")
    assert best_container(read(other)[1])[0].path.endswith("div.teaser")
    got = extracted(spark, [*rows, (6, "http://a.org/6", other)])
    for i in range(7):
        assert got[i].text == TEXT.format(n=i), i
        assert got[i].n_chars == len(got[i].text)


def test_pages_without_the_host_path_use_their_own(spark):
    rows = [(i, "http://b.org/x", PAGE.format(n=i, comment="c")) for i in range(3)]
    got = extracted(spark, [*rows, (9, "http://b.org/y", "<html><body><main><p>All other</p></main>")])
    assert got[9].text == "All other"


@pytest.mark.parametrize(("html", "text"), [
    ("", ""), ("plain &lt;b&gt;", "plain <b>"), ("<p>a<p>b", "a\nb"), ("<p>a <i>b</i>c</p> d", "a bc\nd"), ("<script>x", ""),
    ("<p title='a>b'>q</p>", "q"), ("<!-- <p>no</p> --><p>yes", "yes"), ("<div>" * 4000 + "deep", "deep"), ("</div></p>x", "x"),
    ("<p hidden>no</p><p>yes</p>", "yes"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"), ("<pre>a\n  b</pre>", "a b"),
    ("<p>a  b​c</p>", "a b​c"), ("<br>", ""), ("a<b", "a<b"), ("<article><header><h1>T</h1></header><p>x</p></article>", "T\nx"),
])
def test_single_pages(html, text):
    assert main_text(html, None) == text


def test_odd_rows_and_empty_tables(spark):
    long = "<article>" + "<p>word word</p>" * 20_000 + "</article>"
    rows = [(1, None, None), (2, "http://c.org/", ""), (None, "no host", "<p>x</p>"), (3, "http://c.org/", long), (3, "http://c.org/", long)]
    df = extract_main_text(pages(spark, rows))
    got = [(r.page_id, r.url, r.text, r.n_chars) for r in df.collect()]
    assert sorted(got, key=str) == sorted([
        (1, None, "", 0), (2, "http://c.org/", "", 0), (None, "no host", "x", 1),
        *[(3, "http://c.org/", "\n".join(["word word"] * 20_000), 200_000 - 1)] * 2,
    ], key=str)
    assert extract_main_text(pages(spark, rows).where("false")).count() == 0


LONG = "A sentence of the article, and then one more of it. " * 6
FIRST = LONG.strip()


@pytest.mark.parametrize(("body", "text"), [
    # Names that speak of other things, or only might.
    (f'<div class="content has-sidebar"><p>{LONG}</p></div>', FIRST),
    (f'<div class="page no-sidebar"><div class="post no-comments"><p>{LONG}</p></div></div>', FIRST),
    (f'<article><div class="post no-comments"><p>{LONG}</p></div></article>', FIRST),
    (f'<div class="elementor-widget elementor-widget-text"><p>{LONG}</p></div>', FIRST),
    (f'<div class="elementor-widget-text"><p>{LONG}</p></div>' * 3, "\n".join([FIRST] * 3)),
    (f'<div id="left-side"><p>{LONG}</p></div>', FIRST),
    (f'<form id=aspnetForm><div><p>{LONG}</p></div><div class="site-footer"><p>{LONG}</p></div></form>', FIRST),
    (f'<p>{LONG}</p><form><p>Subscribe to our letter</p></form>', FIRST),
    (f'<div data-id="menu" title="hidden"><p>{LONG}</p></div>', FIRST),
    # Articles in several parts.
    (f'<article><div class=lead><p>{LONG[:52]}</p></div><div class=body><p>{LONG}</p></div></article>', LONG[:52].strip() + "\n" + FIRST),
    (f'<div class=story><div class=lead><p>{LONG}</p></div><div class=body><p>{LONG}</p></div></div>', FIRST + "\n" + FIRST),
    (f'<div class=story><p>Before.</p><div class=quote><p>{LONG}</p><p>{LONG}</p></div><p>{LONG}</p></div>',
     f"Before.\n{FIRST}\n{FIRST}\n{FIRST}"),
    # Quotes that are not closed.
    (f'<p>before <a href="x>link</a> after</p><p>{LONG}</p>', "before link after\n" + FIRST),
    (f"<p>it is <a href=x'>here</a></p><p title='a > b'>{LONG}</p>", "it is here\n" + FIRST),
    # Reader comments, however long.
    (f'<div class=post><p>{LONG}</p></div><div><h3>3 comments</h3><ol class=commentlist>{"<li><p>" + LONG + "</p></li>" * 9}</ol></div>', FIRST),
    (f'<article><p>{LONG}</p><section class="comments"><article class=comment-body><p>{LONG * 3}</p></article></section></article>', FIRST),
    # Noise that is surely named goes, also where nothing else stands.
    ('<div class="ad">Buy this</div><div class="cookie-banner"><p>We use cookies</p></div>', ""),
    (f'<div class="masthead"><main><p>{LONG}</p></main></div>', FIRST),
    (f'<p>{LONG}</p><p style="display: none">secret</p>', FIRST),
])
def test_layouts(body, text):
    page = f"<html><body><nav><a href=/>Home</a></nav>{body}<footer>end</footer></body></html>"
    assert main_text(page, None) == text


@pytest.mark.parametrize("unit", [
    '<a x="y ', "<a x='y\" ", '<a x=">" ', "<div>", "<b><div></div>", "</x>", "<div></x>", "<ul><li>", "<p><b>", "<!-- <p>", "<", "=\"", "<a = ",
    "<table><tr><td>", "<a x=\">", "<script>", "<title>x",
])
def test_long_malformed_pages_take_time_in_proportion(unit):
    page = "<p>start</p>" + unit * (1_000_000 // len(unit)) + "<p>end</p>"
    start = time.process_time()
    path = best_container(read(page)[1])
    main_text(page, path[0].path if path else None)
    assert time.process_time() - start < 15


def test_random_articles_come_out_whole():
    """Every block of the article and no other, whatever wraps it and stands around it."""
    rng = random.Random(7)

    def words(n):
        return " ".join(rng.choice(("alpha", "bêta", "gamma", "delta", "eps")) + str(rng.randrange(1000)) for _ in range(n))

    for _ in range(150):
        blocks = [words(rng.randrange(8, 60)) for _ in range(rng.randrange(2, 9))]
        parts = []
        for block in blocks:
            tag = rng.choice(("p", "p", "p", "h2", "blockquote", "pre"))
            marked = block.replace(" ", " <b>", 1) + "</b>" if rng.random() < 0.3 else block
            part = f"<{tag}>{marked}" + ("" if tag == "p" and rng.random() < 0.3 else f"</{tag}>")
            parts.append(f"<div class=part{rng.randrange(9)}>{part}</div>" if rng.random() < 0.3 else part)
        article = "".join(parts)
        for _ in range(rng.randrange(4)):
            article = rng.choice(("<article>{}</article>", "<div class='content has-menu'>{}</div>", "<section>{}</section>",
                                  "<form id=all>{}</form>", "<div class='my-widget'>{}</div>")).format(article)
        noise = [
            f"<nav><ul><li><a href=/>{words(3)}</a></ul></nav>", f"<div class='ad'><p>{words(30)}</p></div>",
            f"<aside><p>{words(40)}</p></aside>", f"<div id=comments><h3>Comments</h3><p>{words(90)}</p></div>",
            f"<footer><p>{words(20)}</p></footer>", f"<div class='related-posts'><p>{words(20)}</p></div>", f"<script>'<p>{words(9)}'</script>",
        ]
        rng.shuffle(noise)
        cut = rng.randrange(len(noise))
        page = f"<html><body>{''.join(noise[:cut])}<div>{article}</div>{''.join(noise[cut:])}</body></html>"
        assert main_text(page, None).split("\n") == blocks, page
