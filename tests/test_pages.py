import pytest
from pyspark.sql import functions as F

from vacanta.functions import markup
from vacanta.operators import pages

LONG = "word " * 120


def texts_of(spark, url, *htmls):
    df = spark.createDataFrame([(i, url, h) for i, h in enumerate(htmls)], "page_id bigint, url string, html string")
    return [r.text for r in pages.pages_to_text(df).orderBy("page_id").collect()]


@pytest.mark.parametrize("html, want", [
    ("<p>a</p><p>b</p>", "a\n\nb"),
    ("<div>a</div><div>b<br>c</div>", "a\nb\nc"),
    ("a  b\n c<script>x</script><style>y</style>", "a b c"),
    ("<ul><li>a<li>b</ul>", "a\nb"),
    ("<p>a<p>b<b>c", "a\n\nbc"),
    ("<pre>a\n  b</pre>", "a\n  b"),
    ("<table><tr><td>a</td> <td>b</td></tr><tr><td>c</td></tr></table>", "a\tb\nc"),
    ("a<br><br>b", "a\n\nb"),
    ("&lt;a&gt; &amp; b", "<a> & b"),
    ("x</div></span> y <p", "x y"),
    ("<b>a<p>b</b>c</p>d", "a\n\nbc\n\nd"),
    ("a<!-- x > y -->b<!-->c<!doctype x>d<?php e ?>f", "abcdf"),
    ("a < b <3 c</ x>d", "a < b <3 cd"),
    ("<p title='a>b'>c<p title=it's>d<img alt=\"x", "c\n\nd"),
    ("<script>if (a</b>c) '</p>'</SCRIPT >x<title>&lt;</title>", "x"),
    ("<DIV>a</DIV>\r\nb\rc", "a\nb c"),
    ("x<script>never closed <p>y", "x"),
])
def test_rendered(html, want):
    assert markup.rendered(markup.parse(html)[0]) == want


def test_text_content_keeps_scripts_unless_dropped():
    root, _ = markup.parse("<div>a<script>b</script><p class='x similar y'>c</p><!-- d --></div>")
    assert markup.text_content(root) == "abc"
    drop = [markup.compile_selector(s) for s in ("script", '[class*="similar"]')]
    assert markup.text_content(root, drop) == "a"
    root, _ = markup.parse("<title>&lt;t&gt;</title><style>p>a &lt;{}</style>")
    assert markup.text_content(root) == "<t>p>a &lt;{}"


def test_attributes():
    assert markup.attributes(" class='a b' ID=x data-x=\"&quot;\" class=late checked src = /y/z?q=1&amp;r") == {
        "class": "a b", "id": "x", "data-x": '"', "src": "/y/z?q=1&r",
    }
    root, _ = markup.parse("<p " + "a'" * 50000 + ">x")
    assert markup.text_content(root) == "x"


@pytest.mark.parametrize("selector, found", [
    ("h1", "1"), (".k", "2"), ("p.k", "3"), ('[class*="long-name"]', "4"), ('[id*="sent"]', "5"), ("main section", "6"),
    ("h1.k", None), ("section main", None),
])
def test_selectors(selector, found):
    _, nodes = markup.parse(
        "<h1>1</h1><div class='a k'>2</div><p class=k>3</p><i class='x_long-name_y'>4</i><i id='consent'>5</i>"
        "<section>0</section><main><div><section>6</section></div></main>"
    )
    node = markup.first(nodes, markup.compile_selector(selector))
    assert (markup.text_content(node) if node else None) == found


def test_wellfound(spark):
    page = (
        "<body><h1> Dev </h1><div class='x salary'>none</div><div class='compensation'>$1</div>"
        "<div class='job_location'>Oslo</div><main><div class='JobDescription'>short</div>"
        "<section><nav>n</nav>%s<footer>f</footer></section></main></body>" % LONG
    )
    untitled = "<body><h1>%s</h1><i class='JobTitle'>Ops</i><main>m<script>s</script></main></body>" % ("t" * 150)
    got = texts_of(spark, "https://wellfound.com/jobs/1", page, untitled, "<body>x</body>")
    # The first selector fails its test, the next one passes.
    assert got[0] == "JOB TITLE: Dev\n\nCOMPENSATION: $1\n\nLOCATION: Oslo\n\nDESCRIPTION:\n" + LONG.strip()
    assert got[1] == "JOB TITLE: Ops\n\nDESCRIPTION:\nm"
    assert got[2] == "DESCRIPTION:"


@pytest.mark.parametrize("size, used", [(500, False), (501, True)])
def test_wellfound_description_length(spark, size, used):
    page = f"<body><main><i>pre </i><div class='description'>{'d' * size}</div></main></body>"
    (got,) = texts_of(spark, "https://wellfound.com/jobs/1", page)
    assert got == "DESCRIPTION:\n" + ("" if used else "pre ") + "d" * size


def test_linkedin(spark):
    page = (
        "<body><h1 class='topcard__title'>Dev</h1><a class='topcard__flavor'>ACME</a>"
        "<span class='topcard__flavor--bullet'>10 applicants</span>"
        "<span class='top-card-layout__second-subline'>Oslo</span>"
        "<div class='description__text'><button>more</button>%s</div></body>" % ("e" * 201)
    )
    short = "<body><div class='description__text'>%s</div><article><aside>x</aside>art</article></body>" % ("e" * 200)
    got = texts_of(spark, "https://linkedin.com/jobs/view/1", page, short)
    assert got[0] == "JOB TITLE: Dev\n\nCOMPANY: ACME\n\nLOCATION: Oslo\n\nDESCRIPTION:\n" + "e" * 201
    assert got[1] == "DESCRIPTION:\nart"


def test_rocketship(spark):
    page = "<body><nav>n</nav>Dev job<p>Similar Jobs</p>x Discover 100,000+ Remote Jobs</body>"
    assert texts_of(spark, "https://remoterocketship.com/company/a", page, "<body>Similar Jobs a\nb</body>") == [
        "Dev job", "b",
    ]


def test_generic_page_is_not_cleaned(spark):
    assert texts_of(spark, "https://x.example/", "<body><p>a {b}</p>Similar Jobs c</body>") == ["a {b}\n\nSimilar Jobs c"]


def test_board_links(spark):
    frame = "<iframe></iframe><iframe src='https://boards.greenhouse.io/embed?for=acme'></iframe>"
    df = spark.createDataFrame(
        [(1, "https://x.example/?gh_jid=5", frame), (2, "https://x.example/?gh_jid=6", ""),
         (3, "https://boards.greenhouse.io/beta/jobs/7", frame), (4, "https://x.example/", frame)],
        "page_id bigint, url string, html string",
    )
    got = [tuple(r) for r in pages.board_links(df).select("page_id", "job_id", "board_token").orderBy("page_id").collect()]
    assert got == [(1, "5", "acme"), (2, "6", None), (3, "7", "beta")]


def test_board_text(spark):
    df = spark.createDataFrame(
        [("Dev", "&lt;p&gt;x", ("",), None, "u", None), ("Ops", "<p>a</p><p>b</p>", ("Oslo",), [("A",), (None,)], "v", "w")],
        "title string, content string, location struct<name:string>, departments array<struct<name:string>>, "
        "absolute_url string, updated_at string",
    )
    got = {r.title: r.text for r in pages.board_text(df).collect()}
    assert got["Dev"] == (
        "\nJOB TITLE: Dev\n\nLOCATION: Not specified\n\nDEPARTMENT: Not specified\n\nDESCRIPTION:\n<p>x\n\n"
        "URL: u\nUPDATED: \nSOURCE: Greenhouse API\n"
    )
    assert "LOCATION: Oslo\n\nDEPARTMENT: A, \n\nDESCRIPTION:\nab\n" in got["Ops"]


def test_envelope_and_first_capture(spark):
    df = spark.createDataFrame(
        [(1, 5, "linkedin", "late and longer"), (1, 2, "linkedin", "a😀"), (2, 9, "other", "b")],
        "capture_id bigint, ts bigint, site string, text string",
    ).withColumns({"url": F.lit("https://x"), "page_title": F.lit("t")})
    first = pages.first_capture(df)
    rows = {r.capture_id: r for r in pages.capture_envelope(first).collect()}
    assert rows[1].text == "\nURL: https://x\nSOURCE: LinkedIn (Scraped)\n\na😀\n" and rows[1].contentLength == 3
    assert "SOURCE: Generic (Scraped)" in rows[2].text and rows[2].title == "t"
    done = spark.createDataFrame([(500,), (501,)], "n bigint").select(pages.is_complete(F.col("n"))).collect()
    assert [r[0] for r in done] == [False, True]


def test_parsing_time_grows_with_the_page():
    import time

    from vacanta.functions import markup

    def seconds(html):
        best = 9e9
        for _ in range(3):
            start = time.process_time()
            root, nodes = markup.parse(html)
            markup.rendered(root)
            markup.first(nodes, markup.compile_selector("article span"))
            best = min(best, time.process_time() - start)
        return best

    for piece in ("<div>", "<div></span>", "<li><ul>", "<b><div></b>", "<table><tr><td><p>"):
        assert seconds(piece * 16000) < 12 * seconds(piece * 2000) + 0.2, piece
