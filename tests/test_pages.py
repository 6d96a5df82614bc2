"""HTML extraction branches (S-01..S-05) not present in the driver's pages."""

from botqa.sources.pages import extract_page, page_documents


def test_main_node_precedence_and_dropped_tags():
    body = ("<html><head><title> My Title </title><style>p{}</style></head><body>"
            "<header>HEAD</header><nav>NAV</nav><div class='x content'>content div</div>"
            "<main><p>Main   text</p><aside>ASIDE</aside><iframe>IF</iframe><noscript>NS</noscript>"
            "<script>var s='</p>';</script><p>second  line</p></main><footer>FOOT</footer></body></html>")
    text, title = extract_page(body)
    assert title == "My Title"          # get_text(strip=True)
    assert text == "Main text\nsecond line"


def test_fallbacks():
    assert extract_page("<body><div id='content'>A</div><p>B</p></body>")[0] == "A"
    assert extract_page("<body><div class='main-content'>M</div></body>")[0] == "M"
    assert extract_page("<body><p>only body</p></body>")[0] == "only body"
    assert extract_page("<p>no body tag</p>")[0] == "no body tag"
    assert extract_page("<html><head><title>T</title></head><p>a</p><p>b</p></html>") == ("a\nb", "T")
    assert extract_page("<title>T</title>plain <b>text</b>") == ("plain\ntext", "T")
    assert extract_page("")[0] is None and extract_page(" \n")[0] is None
    assert extract_page("<body><main><p>x</p><p>&amp;&lt;</p></main></body>")[0] == "x\n&<"


def test_page_documents_filter_truncate_title(spark):
    long_text = "word " * 2000
    pages = spark.createDataFrame([
        (1, "http://a/1", "<html><head><title></title></head><body><main>" + long_text + "</main></body></html>"),
        (2, "http://a/2", "<html><body><main>too short</main></body></html>"),
        (3, "http://a/3", "<html><head><title>T3</title></head><body><article>" + "x" * 60 + "</article></body></html>"),
    ], "page_id long, url string, html string")
    docs = {r.page_id: r for r in page_documents(pages).collect()}
    assert set(docs) == {1, 3}
    assert docs[1].content.endswith("...[truncated]") and len(docs[1].content) == 5000 + len("...[truncated]")
    assert docs[1].section == "http://a/1"           # empty title -> url
    assert docs[3].section == "T3"
