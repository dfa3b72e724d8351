"""Main text of made-up pages in several layouts, each with the text that a reader would call the article."""

import html
import random
import re

import pytest

from chronofold.llm import main_text
from common import odd_rows

WORDS = "alder birch cedar dogwood elder fir ginkgo hazel ivy juniper kauri larch maple".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + ("," if rng.random() < 0.1 else "") for _ in range(n)).capitalize() + "."


def chrome(rng):
    links = "".join(f'<li><a href="/{w}">{w} {w}</a></li>' for w in rng.choices(WORDS, k=6))
    return {
        "nav": f"<nav><ul>{links}</ul></nav>",
        "menu": f'<div class="main-menu"><ul>{links}</ul></div>',
        "header": "<header><h2>The Daily Tree</h2><p>All the trees, all the time, every day.</p></header>",
        "cookie": f'<div id="cookie-notice" role="dialog"><p>{prose(rng, 30)}</p><button>Accept</button></div>',
        "ad": f'<div class="ad">{prose(rng, 12)}</div>',
        "sponsor": f'<section class="sponsored-box"><p>{prose(rng, 40)}</p></section>',
        "sidebar": f'<aside><h3>Also</h3><p>{prose(rng, 25)}</p></aside>',
        "side": f'<div class="sidebar left"><p>{prose(rng, 60)}</p><p>{prose(rng, 20)}</p></div>',
        "form": f'<form><label>Mail</label><p>{prose(rng, 10)}</p><input><textarea>some, words</textarea></form>',
        "script": '<script>var t = "</p><p>not, text";</script><style>p{color:red}</style><noscript><p>Turn it on, please.</p></noscript>',
        "comments": f'<section id="comments"><h2>Comments</h2><article class="comment"><p>{prose(rng, 80)}</p></article><article class="comment"><p>{prose(rng, 90)}</p></article></section>',
        "replies": f'<ol class="commentlist"><li>{prose(rng, 70)}</li><li>{prose(rng, 70)}</li></ol>',
        "related": f'<div class="related"><article><p>{prose(rng, 15)}</p></article></div>',
        "links": f"<ul>{links}</ul>",
        "footer": f"<footer>&copy; trees &middot; {prose(rng, 12)}</footer>",
        "hidden": f'<div style="display: none"><p>{prose(rng, 50)}</p></div><p hidden>{prose(rng, 30)}</p>',
        "comment": "<!-- <p>not text, either</p> -->",
    }


def body(rng):
    """(html, lines) of an article's inside."""
    title = prose(rng, 5)
    parts, lines = [f"<h1>{title}</h1>"], [title]
    for _ in range(rng.randrange(2, 9)):
        kind, text = rng.choice(["p", "p", "p", "open", "h2", "ul", "quote", "table", "inline", "entities", "figure"]), prose(rng, rng.randrange(4, 90))
        if kind == "p":
            parts.append(f"<p>{text}</p>\n")
            lines.append(text)
        elif kind == "open":
            other = prose(rng, 20)
            parts.append(f"<p><b>{text}<br>\n<p>{other}")
            lines += [text, other]
        elif kind == "h2":
            parts.append(f"<h2>{text[:30]}</h2><p>{text}</p>")
            lines += [text[:30].strip(), text]
        elif kind == "ul":
            items = [prose(rng, 9) for _ in range(3)]
            parts.append("<ul>" + "".join(f"<li>{i}" for i in items) + "</ul>")
            lines += items
        elif kind == "quote":
            parts.append(f"<blockquote>{text}</blockquote>")
            lines.append(text)
        elif kind == "table":
            cells = [prose(rng, 4) for _ in range(4)]
            parts.append(f"<table><tr><td>{cells[0]}<td>{cells[1]}<tr><td>{cells[2]}</td><td>{cells[3]}</td></tr></table>")
            lines += cells
        elif kind == "inline":
            parts.append(f'<p>{text} <a href="/x">one\n\t link</a> and <em>so</em>on&nbsp;.</p>')
            lines.append(f"{text} one link and soon .")
        elif kind == "entities":
            parts.append(f"<p>{text} a &lt;b&gt; &amp;amp; &#8217;&#x2F;&mdash;&eacute; 1 < 2</p>")
            lines.append(f"{text} a <b> &amp; ’/—é 1 < 2")
        else:
            parts.append(f'<figure><img src="a"><figcaption>{text}</figcaption></figure>')
            lines.append(text)
    return "".join(parts), lines


LAYOUTS = {
    "article": "<body>{before}<article>{inside}</article>{after}</body></html>",
    "main": '<body class="has-sidebar">{before}<div id="page"><main><article class="post">{inside}{within}</article>{after}</main></div>',
    "divs": '<body>{before}<div id="wrap"><div class="content">{inside}{within}</div>{after}</div>',
    "role": '<body>{before}<div role="main" class="entry">{inside}</div>{after}',
    "sidebar-named": '<body>{before}<div class="layout-sidebar"><article>{inside}</article></div>{after}',
}


@pytest.mark.parametrize("layout", sorted(LAYOUTS))
def test_layouts(layout):
    for seed in range(150):
        rng = random.Random(f"{layout}{seed}")
        inside, lines = body(rng)
        named = chrome(rng)
        within = rng.choice([v for k, v in named.items() if k != "header"])  # an article's own header has its title
        pieces = list(named.values())
        rng.shuffle(pieces)
        cut = rng.randrange(len(pieces))
        page = "<!DOCTYPE html><html><head><meta charset=utf-8><title>Not, this</title></head>" + LAYOUTS[layout].format(
            before="".join(pieces[:cut]), after="".join(pieces[cut:]), inside=inside, within=within
        )
        assert main_text.main_text(page) == "\n".join(lines), (seed, page)


def test_sections_of_one_article_stay_together():
    long, short = "Many words, many commas, and more. " * 40, "A short end."
    page = f'<div id="top"><div class="part"><p>{long}</p><p>{long}</p></div><div class="part"><p>{short}</p></div></div><div class="footer"><p>{long}</p></div>'
    assert main_text.main_text(page).split("\n")[-1] == short
    page = f"<article><section><p>{long}</p></section><section><p>{short}</p></section></article>"
    assert main_text.main_text(page) == f"{long.strip()}\n{short}"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""), ("   \n ", ""), ("just text", "just text"), ("<nav>menu</nav>", ""), ("<p>a<p>b", "a\nb"), ("a<br>b", "a b"), ("<article></article>", ""),
        ("<head><title>t</title><p>body, early", "body, early"), ("<div><p>x</div>y.", "x\ny."), ("</p></div>z", "z"), ("a < b &", "a < b &"), ("<b><i>x</b></i> y", "x y"),
        ("<article><p>one<script>if (a < b) {}</script> two</p></article>", "one two"), ("<pre>a\n  b</pre>", "a b"), ("&#0;&#xD800;x", "��x"),
    ],
)
def test_small_pages(page, text):
    assert main_text.main_text(page) == text


def test_deep_and_long_pages():
    deep = "<div>" * 20000 + "<p>deep, deep down</p>"
    assert main_text.main_text(deep) == "deep, deep down"
    line = "word, " * 50
    assert main_text.main_text("<article>" + f"<p>{line}</p>" * 3000 + "</article>").count("\n") == 2999


def test_odd_rows(spark):
    rows = odd_rows(spark).selectExpr("doc_id as page_id", "key as url", "text as html", "score", "b as text")
    found = main_text.extract(rows).collect()
    assert len(found) == rows.count() and all(r["n_chars"] == len(r["text"]) for r in found)
    expected = sorted((str(r["page_id"]), " ".join((r["html"] or "").split())) for r in rows.collect())
    assert sorted((str(r["page_id"]), r["text"]) for r in found) == expected
    assert main_text.extract(rows.filter("false")).count() == 0


def test_given_pages(spark, directory):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{directory}/pages.parquet").collect()}
    for r in main_text.extract(spark.read.parquet(f"{directory}/pages.parquet")).collect():
        inside = re.search("<article>(.*)</article>", pages[r["page_id"]], re.DOTALL).group(1)
        lines = (" ".join(html.unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split("</?(?:h1|p)>", inside))
        assert r["text"] == "\n".join(x for x in lines if x)
