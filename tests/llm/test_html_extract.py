import random
import time

import pytest
from pyspark.sql import functions as F

from postalloom.llm import html_extract as H
from tests.llm.common_rows import documents
from tests.llm.common_rows import pages as odd_pages

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var x="</p>";</script></head><body class="home post-12">
<div id="wrap"><header class="site-header"><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice"><p>We use cookies.</p></div>
<div class="layout"><div class="main-content"><h1>Title &amp; more</h1><p>First   para with a <a href=x>link</a> and <b>bold
words</b>, long enough.</p><p>Second &#233;&nbsp;x<ul><li>one<li>two</ul><form><p>Sign up</p></form><div class="ad">Buy</div><script>if(a<b)w("<p>no</p>")</script></div>
<aside>Aside</aside><div class="sidebar"><p>A sidebar with rather a lot of text in it, more than one would like to see here, really.</p></div></div>
<section id="comments"><p>A reader's comment that is longer than the article itself, so that only its place tells what it is. Much longer, in fact, and it goes on.</p></section>
<footer>Footer</footer></div></body></html>"""
TEXT = "Title & more\nFirst para with a link and bold words, long enough.\nSecond é x\none\ntwo"


def test_article_without_boilerplate():
    assert H.vote(PAGE)[0] == ("html/body.home.post-#/div/div.layout/div.main-content", True)
    assert H.extract(PAGE, None) == TEXT


@pytest.mark.parametrize(
    ("source", "text"),
    [
        (None, ""), ("", ""), ("plain &lt; text", "plain < text"), ("<p>a<p>b<div>c", "a\nb\nc"), ("<article><p>abc</p><di", "abc"), ("<article><p>x &am", "x &am"),
        ("<article><!-- a <p>b</p> --><p>c</p></article>", "c"), ("<article><p>a<br>b</p></article>", "a\nb"), ("<article><p>a<p>b</p></p></b>c</article>", "a\nb\nc"),
        ("<main><header><h1>T</h1></header><p>x</p><footer>f</footer></main>", "T\nx"), ("<article hidden>no</article><article><p>yes</p></article>", "yes"), ("<article>" + "<div>" * 3000 + "deep", "deep"),
        ("<p title='a>b' data-x=\"<p>\">q</p>", "q"), ("<article><p>1 < 2 & 3 > 2</p></article>", "1 < 2 & 3 > 2"),
    ],
)
def test_odd_pages(source, text):
    assert H.extract(source, []) == text


def test_the_host_decides_where_a_page_alone_would_be_wrong(spark):
    usual = "<body><div class='story-7'><p>" + "The story of the day. " * 20 + "</p></div><div class='box'><p>Short box.</p></div></body>"
    odd = "<body><div class='story-8'><p>" + "A short story. " * 6 + "</p></div><div class='box'><p>" + "A box with much text. " * 7 + "</p></div></body>"
    rows = [(i, "http://h.example/%d" % i, usual) for i in range(9)] + [(9, "http://h.example/9", odd), (10, "http://other.example/1", odd), (11, None, usual), (12, "http://h.example/x", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("row", F.lit("r"))
    text = {r["page_id"]: r["text"] for r in H.extracted(pages).collect()}
    assert text[9].startswith("A short story.") and "box" not in text[9]
    assert text[0].startswith("The story") and text[11] == text[0] and text[12] == "" and text[10]


def test_many_hosts_take_the_salted_way(spark, monkeypatch):
    pages = spark.createDataFrame([(i, f"http://h{i % 4}.example/{i}", PAGE) for i in range(40)], "page_id long, url string, html string")
    want = sorted(map(tuple, H.extracted(pages).collect()))
    monkeypatch.setattr(H, "MOST_BROADCAST", 1)
    assert sorted(map(tuple, H.extracted(pages).collect())) == want and {w[2] for w in want} == {TEXT}


def test_empty_table(spark):
    assert H.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


LONG, CLOSE = " ".join(f"word{i}" for i in range(128)), " ".join(f"close{i}" for i in range(12))


@pytest.mark.parametrize(
    ("source", "text"),
    [
        (f"<div class=c><div class=a>{LONG}</div><div class=b>{CLOSE}</div></div>", f"{LONG}\n{CLOSE}"),
        (f"<body><section>{LONG}</section><section>{CLOSE}</section></body>", f"{LONG}\n{CLOSE}"),
        (f"<article><p>{LONG}</p><div class='more'><p>{CLOSE}</p></div><div class='side'>{CLOSE}</div></article>", f"{LONG}\n{CLOSE}\n{CLOSE}"),
        (f"<article><p>{LONG}</p><div class='more'><a href=x>{CLOSE}</a></div></article>", LONG),
        (f"<div class=content><p>{LONG}</p><div class=more><p>{CLOSE}</p></div></div><div class=more>{CLOSE}</div>", f"{LONG}\n{CLOSE}"),
        (f"<div class=post><h1>A title</h1><div class=post-body>{LONG}</div></div>", f"A title\n{LONG}"),
        (f"<div class=content><div class=lead>{CLOSE}</div><div class=text>{LONG}</div></div>", f"{CLOSE}\n{LONG}"),
        (f"<div class='has-sidebar'><article><p>{LONG}</p></article><div class=sidebar>{CLOSE}</div></div>", LONG),
        (f"<section id=comments><article class=comment>{CLOSE}</article></section><div>{LONG}</div>", LONG),
        (f"<div>{LONG}</div><div><a href=1>Home</a> <a href=2>News and more of them</a></div><div>\u00a9 2020 Somebody who owns all of this. All rights reserved.</div>", LONG),
        (f"<table><tr><td class=nav><a href=1>Home</a><td>{LONG}<td>{CLOSE}</table>", f"{LONG}\n{CLOSE}"),
        (f"<article><p>{LONG}</p><div class='discussion'><p>{CLOSE}</p></div><footer>f</footer><aside>a</aside><div class='share'>s</div></article>", f"{LONG}\n{CLOSE}"),
        (f"<main><article>{LONG}</article><div>{LONG} {CLOSE}</div></main>", f"{LONG}\n{LONG} {CLOSE}"),
    ],
)
def test_no_block_of_an_article_is_lost(source, text):
    assert H.extract(source, None) == text
    own = [p for p, inside in H.vote(source) if inside]
    assert H.extract(source, own, [p for p, inside in H.vote(source) if not inside]) == text


FRAMES = {
    "tag": "<body><header>Site</header><nav><a href=1>Home</a></nav><article>{}</article><aside>Aside text</aside><footer>Foot</footer></body>",
    "class": "<body><div class='site-header'>Site <a href=1>Home</a></div><div id=wrap><div class='post-{n} entry'>{}</div><div class=sidebar><p>Side text that goes on and on for a while.</p></div></div><div id=footer>Foot</div></body>",
    "role": "<body><div role=navigation>Nav</div><div role=main>{}</div><div class='cookie-consent'><p>We use cookies on this site, as all do.</p></div></body>",
    "table": "<body><table><tr><td class=menu><a href=1>Home</a><td>{}<td class=ads>Buy this now</table><div class=comments><p>I have read all of it and I do not agree.</p></div></body>",
    "bare": "<body>{}<script>var a='<p>';</script><form>Search <input></form></body>",
}


@pytest.mark.parametrize("frame", FRAMES)
def test_templates(spark, frame):
    """Articles of every length in frames of all kinds: what goes in comes out, alone and by the host."""
    r = random.Random(frame)
    sentence = lambda: " ".join(f"w{r.randrange(500)}" for _ in range(r.randint(8, 30))).capitalize() + "."
    pages, want = [], {}
    for i in range(30):
        parts, lines = [], []
        for _ in range(r.randint(2, 12)):
            kind, x, y = r.choice("pphlbdsq"), sentence(), sentence()
            if kind == "p":
                parts.append(f"<p>{x}\n <b>{y}</b>" + r.choice(["", "</p>"]))
                lines.append(f"{x} {y}")
            elif kind == "h":
                parts.append(f"<h2 class='header'>{x}</h2>")
                lines.append(x)
            elif kind == "l":
                parts.append(f"<ul><li>{x}<li>{y} &amp; <a href=u>z</a></ul>")
                lines += [x, f"{y} & z"]
            elif kind == "b":
                parts.append(f"<p>{x}<br>{y}</p>")
                lines += [x, y]
            elif kind == "d":
                parts.append(f"<div class='text-{i}'><p>{x}</p></div>")
                lines.append(x)
            elif kind == "s":
                parts.append(f"<section><p>{x}</p><div class=share>Tell all</div></section>")
                lines.append(x)
            else:
                parts.append(f"<blockquote>{x}</blockquote><!-- {y} -->")
                lines.append(x)
        pages.append((i, f"https://{frame}.example/{i}", FRAMES[frame].replace("{n}", str(i)).replace("{}", "".join(parts))))
        want[i] = "\n".join(lines)
    for i, _, source in pages:
        assert H.extract(source, None) == want[i]
    found = {x["page_id"]: x["text"] for x in H.extracted(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert found == want


@pytest.mark.parametrize("piece", ["<div>x ", "<b>x", "<p>x<div>", '<a "', "<a <b ", "<table><tr><td>x", "<li>x", "</b><b>", "<div class='more'>x ", "<div><p class=more>y</p>", "&amp;", "<!--", "<a href='"])
def test_hostile_pages_take_linear_time(piece):
    took = []
    for size in (100_000, 400_000):
        source, began = piece * (size // len(piece)), time.process_time()
        H.vote(source)
        H.extract(source, ["body/div", "div/div"], ["div/p.more"])
        took.append(time.process_time() - began)
    assert took[1] < 9 * max(took[0], 0.1)


def test_deep_nesting_keeps_all_text():
    assert H.extract("<div>x " * 4000, None).split() == ["x"] * 4000


def test_hosts(spark):
    urls = [None, "", "http://A.Example:80/x", "https://u:p@b.example?q", "c.example/x", "http://d.example#y", "HTTP://E.example"]
    rows = spark.createDataFrame(list(enumerate(urls)), "i int, url string").select("i", H.host_of(F.col("url")).alias("h")).collect()
    assert [r["h"] for r in sorted(rows)] == ["", "", "a.example", "b.example", "", "d.example", "e.example"]


def test_mixed_templates_of_a_host_lose_nothing(spark):
    one = "<body><div class=story>{}</div></body>"
    two = "<body><div class=story>{}</div><div class=part2>{}</div></body>"
    texts = [" ".join(f"t{i}w{j}" for j in range(60)) for i in range(12)]
    rows = [(i, f"http://h.example/{i}", one.format(texts[i])) for i in range(9)] + [(i, f"http://h.example/{i}", two.format(texts[i], texts[i + 1])) for i in (9, 10)]
    found = {r["page_id"]: r["text"] for r in H.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {i: texts[i] for i in range(9)} | {i: f"{texts[i]}\n{texts[i + 1]}" for i in (9, 10)}


def test_clashing_columns_and_repeats(spark):
    rows = [(1, "http://a/1", PAGE, "keep", "h", "t")] * 3 + [(2, None, None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, row string, host string, text string")
    done = H.extracted(pages)
    assert done.columns == ["page_id", "url", "row", "host", "text"]
    assert sorted(tuple(r) for r in done.where("page_id = 1").collect()) == [(1, "http://a/1", "keep", "h", TEXT)] * 3
    assert done.where("page_id = 2").first()["text"] == ""


def test_odd_rows(spark):
    given = odd_pages(spark)
    done = H.extracted(given)
    assert done.columns == ["page_id", "url", "row", "host", "taken", "items", "own", "text"]
    rows = done.collect()
    assert len(rows) == given.count() and sum(r["page_id"] == 3 for r in rows) == 3
    by_id = {r["page_id"]: r["text"] for r in rows if r["page_id"] is not None}
    for i, t, *_ in documents():
        if i not in (None, 3, 5, 12):
            assert by_id[i] == " ".join((t or "").split()), i
