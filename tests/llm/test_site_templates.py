from spanloom.llm import site_templates as S

MENU = '<nav><a href="/">Home</a><a href="/b">B</a></nav>'
BOX = "<div class='box17'><b>Follow us</b> on the network</div>"


def page(body, extra=""):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{MENU}{extra}{body}<footer>&copy; x</footer></body></html>"


def text_of(html, template=frozenset()):
    return S.page_text(html, template)


def test_blocks_references_and_spaces():
    html = page("<article><h1>A &amp; B</h1><p>One  <b>two</b>th&uuml;r\n<br>x</p><p><i>open<p>last&nbsp;&#65;&amp</article>")
    assert text_of(html) == "A & B One twothür x open last A&"


def test_named_parts_go():
    body = (
        "<header><h2>Site</h2></header><div class='cookie-notice'>We use</div><main><article><h1>T</h1><p>Text.</p><aside>side</aside>"
        "<div id='comments'><article class='comment'>I think</article></div><form><input value=x>Send</form><!-- p --><p hidden>no</p>"
        "<section class='with-ads-free'><p>more</p></section></article></main>"
    )
    assert text_of(page(body)) == "T Text."


def test_page_without_article():
    assert text_of("<body><div class=menu>m</div><div id=body><p>One<p>Two<ul><li>a<li>b</ul></div></body>") == "One Two a b"
    assert text_of("plain text <b>only") == "plain text only"


def test_broken_pages():
    assert text_of("") == "" and text_of(None) == ""
    assert text_of("<article><p>a <script>if (1 < 2) {'</p>'}</script>b</p><p") == "a b"
    assert text_of("<article><p>a</p></artic") == "a"
    assert text_of("<p title='x>y'>1 < 2</p>") == "1 < 2"
    assert text_of("<div>" * 20_000 + "deep") == "deep"


def pages(spark):
    rows = [(i, f"https://Site.example/p{i}", page(f"<article><h1>Head {i}</h1>{BOX}<p>Text {i} here.</p><p>Yes.</p></article>", f"<div><p>Banner text of all</p></div>")) for i in range(20)]
    rows += [(100 + i, f"https://other.example/p{i}", page(f"<article><h1>Other {i}</h1>{BOX if i == 0 else ''}<p>Yes.</p></article>")) for i in range(20)]
    rows += [(200, None, None), (201, "x", ""), (202, "https://one.example/", page("<article><p>Alone</p></article>"))]
    rows += [(300 + i, "https://same.example/a", page("<article><h1>Same</h1><p>Copy.</p></article>")) for i in range(30)]
    return spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, host string")


def test_templates_are_found_by_host(spark):
    got = {r.page_id: (r.text, r.n_chars) for r in S.extract(pages(spark)).collect()}
    assert len(got) == 73
    assert got[3] == ("Head 3 Text 3 here. Yes.", 24)
    assert got[100][0] == "Other 0 Follow us on the network Yes." and got[101][0] == "Other 1 Yes."
    assert got[200] == ("", 0) and got[201] == ("", 0) and got[202][0] == "Alone"
    assert all(got[300 + i][0] == "Same Copy." for i in range(30))
    assert S.extract(pages(spark).limit(0)).count() == 0


def test_counts_match_brute_force(spark):
    table = pages(spark).select("page_id", "html")
    keyed = table.selectExpr("'h' AS host", "html")
    keys = S.templates(keyed, 5, 0.1).first()["keys"]
    seen, n = {}, 0
    for r in table.collect():
        elements = S.walk(S.parse(r.html or ""))
        S.hash_subtrees(elements)
        n += 1
        for k in {e.key for e in elements if e.tag and not e.holds and e.children and e.tag not in S.INLINE}:
            seen[k] = seen.get(k, 0) + 1
    assert sorted(keys) == sorted(k for k, c in seen.items() if c >= 5 and c >= 0.1 * n)


def test_articles_of_the_tables(spark):
    import html
    import re

    from tests.compare import DATA

    table = spark.read.parquet(f"{DATA}/sf0.01/pages.parquet")
    for r in S.extract(table).join(table.select("page_id", "html"), "page_id").collect():
        body = re.sub(r"<[^>]*\Z", "", re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1])
        assert r.text == " ".join(html.unescape(re.sub(r"<[^>]+>", " ", body)).split())


def test_names_alone_delete_nothing_of_an_article():
    parts = (
        '<section id="discussion"><p>We discuss.</p></section><h2 id="related-work">Related work</h2><p class="reply">The minister\'s reply.</p>'
        '<div class="share-price-table">Price 12</div><blockquote class="comment">As they said.</blockquote><div class="sharing-economy"><p>On sharing.</p></div>'
    )
    assert text_of(page(f"<article><h1>T</h1><p>Intro text.</p>{parts}</article>")) == (
        "T Intro text. We discuss. Related work The minister's reply. Price 12 As they said. On sharing."
    )


def test_named_blocks_of_an_article_go_by_structure():
    long = "words of the article " * 40
    parts = (
        '<div class="share"><a href=x>Mail</a> <a href=y>Post</a></div><div class="related"><h3>More</h3><ul><li><a href=z>Another story of the day</a></ul></div>'
        '<div class="newsletter"><form><input></form>Join us</div><ul class="comment-list"><li class="comment">Nice</li><li class="comment">No</li></ul>'
        f'<div class="ad-slot">{"Buy this. " * 30}</div><div class="comments"><p>First!</p></div>'
    )
    assert text_of(page(f"<article><h1>T</h1><p>{long}</p>{parts}<p>End.</p></article>")) == f"T {long}End."


def test_headings_outside_the_article():
    assert text_of('<body><div class="masthead"><h1>Site name</h1></div><div><p>Body text.</p></div></body>') == "Body text."
    assert text_of("<main><h1>Title</h1><div class=menu>m</div><article><p>Text.</p></article></main>") == "Title Text."
    assert text_of("<main><h1>Site</h1><article><h1>Title</h1><p>Text.</p></article></main>") == "Title Text."


def test_recurring_heading_of_the_site(spark):
    rows = [(i, f"//h/{i}", f"<body><div class=top><h1>Daily News</h1></div><div><h1>Story {i}</h1><p>Text {i}.</p></div></body>") for i in range(12)]
    got = S.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r.text == f"Story {r.page_id} Text {r.page_id}." for r in got)


def test_stray_tags_take_linear_time():
    import time

    start = time.time()
    for body in ("<div>" * 50_000 + "</span>" * 50_000, "<div>" * 50_000 + "<li>" * 50_000, "<b>" * 50_000 + "<hr>" * 50_000, "<span><table>" + "<div>" * 50_000 + "</span>" * 50_000):
        S.parse(body)
    assert time.time() - start < 4
