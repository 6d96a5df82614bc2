"""The page parser on deep, unclosed and random pages, and what it reports."""

import random
import time

import pandas as pd
import pytest
from pyspark.sql import Observation

from botqa.sources import pages as PG

N = 100_000


@pytest.mark.parametrize("tag", ["p", "li", "td", "tr", "option", "div", "span", "table", "button"])
def test_open_tags_without_end(tag):
    t0 = time.perf_counter()
    text, _ = PG.extract_page("<body>" + "".join(f"<{tag}>{i}" for i in range(N)))
    assert text.split("\n") == [str(i) for i in range(N)]
    text, _ = PG.extract_page("<main>start" + f"<{tag}>" * N + "deep" + "</x>" * N + f"</{tag}>" * (2 * N) + "</main>after")
    assert text.split("\n")[:2] == ["start", "deep"]
    assert time.perf_counter() - t0 < 30


def test_implied_ends():
    for html, text in [("<article><ul><li>a<li>b<ul><li>c<li>d</ul>e<li>f</ul>g</article>h", "a\nb\nc\nd\ne\nf\ng"),
                       ("<div id=content><p>a<p>b<div>c</div>d</div><p>e", "a\nb\nc\nd"),
                       ("<div id=content><p>a<table><tr><td>b<td>c<tr><td>d</table>e</div>f", "a\nb\nc\nd\ne"),
                       ("<nav><p>x<li>y</nav><article>a<p>b</article>", "a\nb"),
                       ("<table><tr><td><article>a</td><td>b</article></table>", "a"),
                       ("<div class=content><dl><dt>a<dd>b<dt>c<dd>d</dl>e</div>f", "a\nb\nc\nd\ne"),
                       ("<div class=content><select><option>a<option>b<optgroup><option>c</select>d</div>e", "a\nb\nc\nd"),
                       ("<article>a<table><tr><td>b</div>c</article>d</td></tr></table>e</article>f", "a\nb\nc\nd\ne"),
                       ("<title>T</title><p>a", "a"), ("<head><title>T</title><p>a<p>b", "a\nb"), ("<head><title>T</title>text", "text"),
                       ("<article/>a</article>b", "a"), ("<body>a</p></li></td>b", "a\nb")]:
        assert PG.extract_page(html)[0] == text, html


BLOCKS = ["div", "p", "ul", "table", "nav", "section"]


def _tree(rng, depth, words, phrasing=False):
    """Children of an element: texts and (tag, children), no two texts in a row."""
    out = []
    for _ in range(rng.randint(0, 4)):
        if (depth == 0 or rng.random() < 0.4) and out and isinstance(out[-1], str):
            continue
        if (depth == 0 or rng.random() < 0.4) and not (out and isinstance(out[-1], str)):
            words.append(f"w{len(words)}")
            out.append(words[-1])
            continue
        tag = "span" if phrasing else rng.choice([*BLOCKS, "span", "article"])
        if tag == "ul":
            kids = [("li", _tree(rng, depth - 1, words)) for _ in range(rng.randint(1, 3))]
        elif tag == "table":
            kids = [("tr", [("td", _tree(rng, depth - 1, words)) for _ in range(rng.randint(1, 3))]) for _ in range(rng.randint(1, 3))]
        else:
            kids = _tree(rng, max(0, depth - 1), words, tag in ("p", "span"))
        out.append((tag, kids))
    return out


def _html(rng, kids):
    """Writes a tree, leaving out end tags that HTML lets one leave out."""
    out = []
    for i, ch in enumerate(kids):
        if isinstance(ch, str):
            out.append(f" {ch} ")
            continue
        after = kids[i + 1] if i + 1 < len(kids) else None
        follows = after is None or not isinstance(after, str) and after[0] in (*BLOCKS, "article")
        may = ch[0] in ("li", "td", "tr") or ch[0] == "p" and follows and after is not None
        out.append(f"<{ch[0]}>{_html(rng, ch[1])}" + ("" if may and rng.random() < 0.7 else f"</{ch[0]}>"))
    return "".join(out)


def _plain(kids):
    return [x for ch in kids for x in ([ch] if isinstance(ch, str) else [] if ch[0] == "nav" else _plain(ch[1]))]


def _first_article(kids):
    for ch in kids:
        if not isinstance(ch, str) and ch[0] != "nav":
            found = ch[1] if ch[0] == "article" else _first_article(ch[1])
            if found is not None:
                return found
    return None


def test_random_trees():
    rng, articles = random.Random(7), 0
    for _ in range(400):
        kids = _tree(rng, 5, [])
        article = _first_article(kids)
        articles += article is not None
        assert PG.extract_page(f"<html><body>{_html(rng, kids)}</body></html>")[0].split() == _plain(kids if article is None else article), _html(rng, kids)
    assert articles > 50


def test_a_page_that_fails_is_a_row(monkeypatch):
    whole = PG.extract_page
    monkeypatch.setattr(PG, "extract_page", lambda html: whole(html) if html != "bad" else 1 / 0)
    got = pd.concat(PG._extract_batches(iter([pd.DataFrame({"page_id": [1, 2, 3], "url": ["a", "b", "c"], "html": ["<p>x", "bad", None]})])))
    assert got.text.tolist() == ["x", None, None] and got.error.tolist() == [None, "ZeroDivisionError: division by zero", None]


def test_outcomes_are_counted_in_the_same_pass(spark):
    html = ["<main>" + "word " * 30, "<main>short", "", None, "<body><p>" + "unclosed <p> " * 50_000]
    df = spark.createDataFrame([(i, f"u{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    seen = Observation()
    assert sorted(r.page_id for r in PG.page_documents(df, observation=seen).collect()) == [0, 4]
    assert seen.get == {"pages": 5, "document": 2, "short": 1, "no_text": 2, "error": 0}
    assert {r.outcome: r.n for r in PG.page_outcome(PG.extract_pages(df)).groupBy("outcome").count().withColumnRenamed("count", "n").collect()} == {
        "document": 2, "short": 1, "no_text": 2}


def test_listed_urls_are_counted_in_the_join(spark):
    urls = spark.createDataFrame([("u0",), ("u1",), ("u1",), ("gone",), (None,)], "url string")
    pages = spark.createDataFrame([(0, "u0"), (1, "u1"), (2, "other")], "page_id long, url string")
    seen = Observation()
    rows = PG.fetch_listed(urls, pages, seen).collect()
    assert sorted(str((r.url, r.page_id, r.fetched)) for r in rows) == sorted(map(str, [
        ("u0", 0, True), ("u1", 1, True), ("u1", 1, True), ("gone", None, False), (None, None, False)]))
    assert seen.get == {"listed": 5, "found": 3, "missing": 2}
