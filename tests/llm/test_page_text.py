"""Main texts against plain versions: markup by a standard parser, subsequences by a table, nearest pages by sorting."""

import html as H
import random
import re
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from quillon.llm import page_text, queries
from quillon.llm.page_text import ARTICLE, FRAME, NO_TEXT, common, page_lines

from ..conftest import SF


class Plain(HTMLParser):
    """Text of article elements, by the standard library."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.out = 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        self.out.append(" " if tag in ("p", "h1", "br", "div", "article") else "")

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        self.out.append(" " if tag in ("p", "h1", "div", "article") else "")

    def handle_data(self, data):
        if self.depth:
            self.out.append(data)


def plain(html):
    p = Plain()
    p.feed(html)
    p.close()
    return " ".join("".join(p.out).split())


def test_query_on_whole_pages(spark):
    rows = queries.queries()["op12_page_text"](spark, SF).collect()
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(rows) == len(pages) and rows[0].asDict().keys() == {"page_id", "url", "text", "n_chars"}
    for r in rows:
        assert r["text"] == plain(pages[r["page_id"]]["html"]) and r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


CASES = {
    "<p>a <b>bold</b>  &amp;\n c&nbsp;d</p>": "a bold & c d",
    "<article><h1>T</h1><p>one<p>two<br>three</article>": "T one two three",
    "<nav>menu</nav><article>body</article><footer>end</footer>": "body",
    "<div class='ad'>buy</div><p>text</p>": "text",
    "<article>a<aside>side</aside>b<div class='comments'><p>said</p></div>c</article>": "a b c",
    "<div class='has-sidebar'><article>kept</article></div>": "kept",
    "<section id=comments><article class=comment>no</article></section><p>yes": "yes",
    "<article><p>x<script>var t='</p>';</script>y</p></article>": "xy",
    "<article>a<!-- <p>no</p> -->b</article>": "ab",
    "<article><header><h1>Title</h1></header>t<footer>tags</footer></article>": "Title t",
    "<article>1 < 2 &lt;b&gt; &#65;&#x42; &eacute;</article>": "1 < 2 <b> AB é",
    "<article><p title='a > b'>q</p></article>": "q",
    "<article><ul><li>one<li>two</ul></article>": "one two",
    "<main>whole<form>f</form></main><p>frame": "whole",
    "<article></article><p>open": "open",
    "<title>no</title>text": "text",
    "<style>p{}</style><script>x": "",
    "<div role=navigation>n</div>t": "t",
    "<article>cut <b": "cut",
    "<article><b>x<p>y</b>z</p></article>w": "x yz",
    "<TABLE><TR><TD>a<TD>b</TABLE>": "a b",
    "": "",
    "no markup at all": "no markup at all",
}


@pytest.mark.parametrize("html", CASES)
def test_markup(html):
    texts, kinds = page_lines(html)
    wanted = ARTICLE if ARTICLE in kinds else FRAME
    assert " ".join(t for t, k in zip(texts, kinds, strict=True) if k == wanted) == CASES[html]


def test_long_and_broken_markup():
    assert page_lines("<div>" * 20_000 + "deep" + "</span>" * 20_000)[0] == ["deep"]
    assert page_lines("<p>" + "w " * 500_000)[0] == [("w " * 500_000).strip()]
    assert page_lines("<b>x" * 20_000) == (["x" * 20_000], [FRAME])
    rng = random.Random(5)
    for _ in range(300):
        page_lines("".join(rng.choice(["<p>", "</p>", "<div class=ad>", "</div>", "<article>", "</article>", "<", ">", "'", '"', "a ", "&amp", "<!--", "-->", "<li>", "<br/>", "<script>", "</script>", "=x", "<b", "</b>"]) for _ in range(40)))


def plain_common(a, b):
    n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            n[i + 1][j + 1] = n[i][j] + 1 if x == y else max(n[i][j + 1], n[i + 1][j])
    return n[-1][-1]


def test_common_subsequences():
    rng = random.Random(7)
    for k in range(400):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(14))] for _ in range(2))
        both = common(a, b)
        assert all(a[i] == b[j] for i, j in both) and len(both) == plain_common(a, b)
        assert both == sorted(both) and len({i for i, _ in both}) == len({j for _, j in both}) == len(both)
        halves = page_text._common(a, b, most_bits=k % 9)
        assert all(a[i] == b[j] for i, j in halves) and len(halves) == plain_common(a, b) and halves == sorted(halves)
    many = [rng.randrange(50) for _ in range(3000)]
    assert len(common(many, many[::2])) == 1500


def plain_differenced(pages):
    """Texts of pages (id, host, path, lines) without an article, by sorting the pages of each host."""
    hosts, out = {}, {}
    for _, host, path, lines in pages:
        if host:
            key = (host, tuple(lines))
            hosts.setdefault(host, {})
            hosts[host][key] = min(path, hosts[host].get(key, path))
    gone = {}
    for frames in hosts.values():
        # Ties of one path stand in the order of digests; the test has none.
        order = sorted(frames, key=lambda k: frames[k])
        for at, key in enumerate(order):
            sides = [order[k] if 0 <= k < len(order) else None for k in (at - 1, at + 1)]

            def near(o, key=key, frames=frames):
                if o is None:
                    return -1
                n = 0
                for x, y in zip(frames[key].split("/"), frames[o].split("/"), strict=False):
                    if x != y:
                        break
                    n += 1
                return n

            if near(sides[0]) < near(sides[1]):
                sides.reverse()
            for other in sides:
                if other is None:
                    continue
                both = common(list(key[1]), list(other[1]))
                sizes = [sum(map(len, k[1])) for k in (key, other)]
                if sum(len(key[1][i]) for i, _ in both) >= page_text.COPY * min(sizes):
                    continue
                gone[key] = {i for i, _ in both}
                break
    for i, host, _, lines in pages:
        out[i] = " ".join(t for k, t in enumerate(lines) if k not in gone.get((host, tuple(lines)), ()))
    return out


def test_differences_of_nearest_pages(spark):
    rng = random.Random(11)
    pages = []
    for i in range(240):
        host = ["", "hot.example.com", "hot.example.com", f"h{i % 7}.org"][i % 4]
        own = [f"own line {i} {k} y" + "x" * rng.randrange(40) for k in range(rng.randrange(1, 6))]
        lines = [f"Welcome to {host or 'us'}", "Read our guides", *own, "Share this", f"Contact {host or 'us'}"] if i % 5 else own
        if i % 11 == 0:
            lines = pages[-1][3] if pages else lines
        pages.append((i, host, f"/{'abc'[i % 3]}/{i % 13}/{i}", lines))
    rows = [(i, f"https://{h.upper()}{p}?q#z" if h else None, "".join(f"<p>{H.escape(t)}</p>" for t in lines)) for i, h, p, lines in pages]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    expected = plain_differenced(pages)
    out = {r["page_id"]: r["text"] for r in page_text.main_text(df).collect()}
    assert out == expected
    assert any("Welcome" not in t for t in out.values()) and "Welcome" in out[4]


def test_copies_keep_their_text(spark):
    text = "".join(f"<p>{'paragraph ' * 20}{k}</p>" for k in range(9))
    rows = [(1, "http://a.org/x/1", text), (2, "http://a.org/x/2", text), (3, "http://a.org/x/3", text + "<p>new</p>"), (4, "http://b.org/", text)]
    out = page_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r["text"].startswith("paragraph") and r["text"].count("paragraph") == 180 for r in out)


def test_odd_rows_and_names(spark):
    rows = [(1, None, None, "a"), (2, "", "", "b"), (None, "no scheme", "<p>x", "c"), (4, "http://", "<p>y", None), (4, "http://", "<p>y", None), (5, "http://h/p", "<article>" + "z " * 200_000, "d")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").withColumn("_host", F.lit(1)).withColumn("_open", F.lit(2)).withColumn("a.b", F.lit(3))
    out = page_text.main_text(df)
    assert out.columns == ["page_id", "url", "_host", "_open", "a.b", "text", "n_chars"]
    assert sorted((r["page_id"] or 0, r["text"][:5], r["n_chars"]) for r in out.collect()) == [(0, "x", 1), (1, "", 0), (2, "", 0), (4, "y", 1), (4, "y", 1), (5, "z z z", 399_999)]
    assert page_text.main_text(df.limit(0)).count() == 0


def test_kinds():
    assert page_lines("<nav>a</nav><p>b</p><article>c</article>")[1] == [NO_TEXT, FRAME, ARTICLE]
    assert re.fullmatch(r"\w+", page_lines("<p>b</p>")[0][0])
