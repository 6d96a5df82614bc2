"""Web pages -> documents (SRC-08..SRC-10, U-02 with S-01..S-05).

HTML parsing is the one per-row step Spark has no built-in for; it runs as
an Arrow-batched ``mapInPandas`` over the pages table (stdlib ``html.parser``),
every other step — length filter, truncation, title fallback, URL building,
joins — is native column work.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import first_truthy, nullif_empty

# FIXED VALUES — page extraction
DROP_TAGS = {"nav", "footer", "header", "script", "style", "aside", "iframe", "noscript"}
VOID_TAGS = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
             "source", "track", "wbr"}
HEAD_TAGS = {"head", "title", "meta", "link", "base"}
MAX_PAGE_CHARS = 5000
MIN_PAGE_CHARS = 50
TRUNCATION_MARK = "...[truncated]"


# FIXED VALUES — the end tags that HTML implies. A start tag ends the open elements
# named here (the innermost, with all inside it) unless a boundary lies between.
_P_ENDERS = ("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer "
             "form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul").split()
CELL_BOUNDARY = ("table", "td", "th", "caption", "template", "object", "marquee", "button")
IMPLIED_ENDS: dict[str, list[tuple[tuple[str, ...], tuple[str, ...]]]] = {
    **{tag: [(("p",), CELL_BOUNDARY)] for tag in _P_ENDERS},
    "li": [(("li",), ("ul", "ol", "menu", *CELL_BOUNDARY)), (("p",), CELL_BOUNDARY)],
    "dt": [(("dd", "dt"), ("dl", *CELL_BOUNDARY)), (("p",), CELL_BOUNDARY)],
    "dd": [(("dd", "dt"), ("dl", *CELL_BOUNDARY)), (("p",), CELL_BOUNDARY)],
    "td": [(("td", "th"), ("tr", "table", "template"))],
    "th": [(("td", "th"), ("tr", "table", "template"))],
    "tr": [(("tr", "caption", "colgroup"), ("table", "template"))],
    **{tag: [(("tbody", "thead", "tfoot", "caption", "colgroup"), ("table", "template"))] for tag in ("tbody", "thead", "tfoot")},
    "option": [(("option",), ("select", "datalist", "optgroup"))],
    "optgroup": [(("optgroup", "option"), ("select",))],
    "rt": [(("rt", "rp"), ("ruby",))], "rp": [(("rt", "rp"), ("ruby",))],
    "button": [(("button",), ("table", "td", "th", "caption", "template", "object", "marquee"))],
}
#: Any other start tag ends an open head.
HEAD_CONTENT = {"html", "head", "title", "meta", "link", "base", "script", "style", "noscript", "template"}
#: An end tag ends its element only if none of these was opened inside it since.
END_BOUNDARY = {"p": CELL_BOUNDARY, "li": ("ul", "ol", "menu", *CELL_BOUNDARY), "dd": ("dl", *CELL_BOUNDARY), "dt": ("dl", *CELL_BOUNDARY),
                "td": ("table", "template"), "th": ("table", "template"), "tr": ("table", "template"),
                "tbody": ("table", "template"), "thead": ("table", "template"), "tfoot": ("table", "template"),
                "table": ("template",), "template": (), "html": (), "body": ("template",)}
DEFAULT_BOUNDARY = ("table", "td", "th", "caption", "template", "object", "marquee")


class _Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag, attrs):
        self.tag, self.attrs, self.children = tag, attrs, []


class _TreeBuilder(HTMLParser):
    """Builds the tree with a stack of open elements.

    ``places`` holds the stack positions of each tag's open elements, so the
    innermost one and the boundaries above it are found without walking the
    stack: a page costs time in proportion to its tags, however deep they nest.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("#root", {})
        self.open = [self.root]
        self.places: dict[str, list[int]] = {}

    def _innermost(self, tags, boundary):
        """Stack position of the innermost open element of ``tags`` with no boundary inside it; 0 if there is none."""
        at = max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)
        return at if all(not self.places.get(b) or b in tags or self.places[b][-1] < at for b in boundary) else 0

    def _close_from(self, at):
        while len(self.open) > at:
            self.places[self.open.pop().tag].pop()

    def _push(self, node):
        self.places.setdefault(node.tag, []).append(len(self.open))
        self.open.append(node)

    def handle_starttag(self, tag, attrs):
        if self.places.get("head") and tag not in HEAD_CONTENT:
            self._close_from(self.places["head"][-1])
        for tags, boundary in IMPLIED_ENDS.get(tag, ()):
            at = self._innermost(tags, boundary)
            if at:
                self._close_from(at)
        node = _Node(tag, dict(attrs))
        self.open[-1].children.append(node)
        if tag not in VOID_TAGS:
            self._push(node)

    def handle_startendtag(self, tag, attrs):
        """``<x/>``: as in HTML, the slash only counts for void elements."""
        self.handle_starttag(tag, attrs)
        if tag in self.CDATA_CONTENT_ELEMENTS:
            self.set_cdata_mode(tag)

    def handle_endtag(self, tag):
        at = self._innermost((tag,), END_BOUNDARY.get(tag, DEFAULT_BOUNDARY))
        if at:
            self._close_from(at)

    def parse_marked_section(self, i, report=1):
        """``<![...``: a comment up to the next ``>``, as in HTML parsers (html.parser
        raises where it doesn't know the section, or skips to its ``]>``)."""
        return self.parse_bogus_comment(i, report)

    def handle_data(self, data):
        if self.open[-1].tag == "head" and data.strip():
            self._close_from(len(self.open) - 1)
        self.open[-1].children.append(data)


def _walk(node):
    """Pre-order walk (elements and texts) that never enters dropped subtrees (S-01)."""
    rest = [iter(node.children)]
    while rest:
        for ch in rest[-1]:
            if isinstance(ch, str):
                yield ch
            elif ch.tag not in DROP_TAGS:
                yield ch
                rest.append(iter(ch.children))
                break
        else:
            rest.pop()


def _classes(node):
    return (node.attrs.get("class") or "").split()


# S-02, first rule first
_MAIN_RULES = (lambda n: n.tag == "main", lambda n: n.tag == "article", lambda n: n.attrs.get("id") == "content",
               lambda n: "content" in _classes(n), lambda n: "main-content" in _classes(n), lambda n: n.tag == "body")


def _main_node(root):
    """S-02: main -> article -> #content -> .content -> .main-content -> body."""
    first = {}
    for n in _walk(root):
        if not isinstance(n, str):
            for i, rule in enumerate(_MAIN_RULES):
                if i not in first and rule(n):
                    first[i] = n
    return first[min(first)] if first else _implied_body(root)


def _implied_body(root):
    """The body an HTML parser adds where the tag is missing: all but the head's
    elements; None for a page without any."""
    rest = [ch for ch in root.children if not (isinstance(ch, str) and not ch.strip())]
    if not rest:
        return None
    body = _Node("body", {})
    for ch in rest:
        inner = ch.children if isinstance(ch, _Node) and ch.tag == "html" else [ch]
        body.children += [x for x in inner if isinstance(x, str) or x.tag not in HEAD_TAGS]
    return body


def _texts(node):
    """The stripped, non-empty texts under ``node``."""
    return [s for ch in _walk(node) if isinstance(ch, str) and (s := ch.strip())]


def extract_page(html: str | None) -> tuple[str | None, str | None]:
    """(main text, title) of one page; (None, title) when there is no main node."""
    if html is None:
        return None, None
    b = _TreeBuilder()
    b.feed(html)
    b.close()
    titled = next((n for n in _walk(b.root) if not isinstance(n, str) and n.tag == "title"), None)
    title = None if titled is None else "".join(_texts(titled))
    main = _main_node(b.root)
    if main is None:
        return None, title
    text = "\n".join(_texts(main))                      # S-03
    text = re.sub(r"\n{3,}", "\n\n", text)
    text = re.sub(r" {2,}", " ", text)
    return text.strip(), title


def _extract_batches(it):
    """Pages of an Arrow batch; a page that the parser can't take becomes a row with
    ``error`` and no text, and the others go on."""
    import pandas as pd
    for pdf in it:
        rows = []
        for html in pdf["html"]:
            try:
                rows.append((*extract_page(html), None))
            except Exception as e:  # any fault of one page is that page's row
                rows.append((None, None, f"{type(e).__name__}: {e}"[:500]))
        text, title, error = zip(*rows, strict=True) if rows else ((), (), ())
        yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": pd.Series(text, dtype=object),
                            "title": pd.Series(title, dtype=object), "error": pd.Series(error, dtype=object)})


def extract_pages(pages: DataFrame) -> DataFrame:
    """U-02: (page_id, url, html) -> (page_id, url, text, title, error), Arrow batches."""
    return pages.select("page_id", "url", "html").mapInPandas(
        _extract_batches, "page_id long, url string, text string, title string, error string")


def page_outcome(extracted: DataFrame) -> DataFrame:
    """What became of each page (``outcome``): ``document``; ``error`` (the parser failed),
    ``no_text`` (no html, or no main node) or ``short`` (S-04)."""
    return extracted.withColumn("outcome", F.when(F.col("error").isNotNull(), "error").when(F.col("text").isNull(), "no_text")
                                .when(F.length("text") < MIN_PAGE_CHARS, "short").otherwise("document"))


def page_documents(pages: DataFrame, source_type: str = "SCRAPED_EXTERNAL",
                   max_length: int = MAX_PAGE_CHARS, observation: Observation | None = None) -> DataFrame:
    """SRC-08 with S-04/S-05: documents from pages; text under 50 chars is
    dropped, longer than ``max_length`` is cut and marked; the section is
    the page title, or the url when the title is missing or empty.

    ``observation`` gets the number of pages of each outcome, counted in the pass
    that makes the documents."""
    ex = page_outcome(extract_pages(pages))
    if observation is not None:
        ex = ex.observe(observation, F.count("*").alias("pages"),
                        *[F.count_if(F.col("outcome") == o).alias(o) for o in ("document", "short", "no_text", "error")])
    ex = ex.where("outcome = 'document'")
    content = F.when(F.length("text") > max_length,
                     F.concat(F.substring("text", 1, max_length), F.lit(TRUNCATION_MARK))).otherwise(F.col("text"))
    return ex.select("page_id", F.col("url").alias("source"), content.alias("content"),
                     F.lit(source_type).alias("source_type"),
                     F.coalesce(nullif_empty(F.col("title")), F.col("url")).alias("section"),
                     F.length(content).alias("content_length"), F.lit(False).alias("is_synthetic"))


def site_urls(sites: DataFrame) -> DataFrame:
    """SRC-09: (site, base_url, paths array) -> one URL per path, base without trailing '/'."""
    return sites.select("site", F.explode("paths").alias("path"), "base_url").select(
        "site", "path", F.concat(F.regexp_replace("base_url", "/+$", ""), F.col("path")).alias("url"))


def fetch_listed(urls: DataFrame, pages: DataFrame, observation: Observation | None = None) -> DataFrame:
    """SRC-10: listed URLs with their fetched pages, each listed url at least once;
    ``fetched`` tells whether there is a page.  ``observation`` gets the numbers
    of listed, found and missing rows, counted in the same pass."""
    there, got = F.col("_fetched").isNotNull(), pages.withColumn("_fetched", F.lit(True))
    joined = urls.join(got, "url", "left").withColumn("fetched", there).drop("_fetched")
    if observation is not None:
        joined = joined.observe(observation, F.count("*").alias("listed"), F.count_if("fetched").alias("found"),
                                F.count_if(~F.col("fetched")).alias("missing"))
    return joined


def first_id(meta_json, keys=("id", "document_id", "file_id", "path")):
    """S-13: first truthy of several JSON keys (``a or b or c``)."""
    return first_truthy(*[F.get_json_object(meta_json, f"$.{k}") for k in keys])
