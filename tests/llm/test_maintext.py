"""Main text: markup read as browsers do, templates counted per host, nothing else dropped."""

import pytest
from pyspark.sql import functions as F

from lodeframe.llm import maintext
from lodeframe.llm.maintext import Page

CASES = [
    ("", ""),
    ("no markup at all", "no markup at all"),
    ("<article><h1>A &amp; B</h1><p>one<p>two <b>three</article>", "A & B\none\ntwo three"),
    ("<article><p>a&nbsp;b\n\t c<br>d</p></article>", "a b c d"),
    ("<article><p>&amp;lt;x&amp;gt; &#233; &eacute &unknown;</p></article>", "&lt;x&gt; é é &unknown;"),
    ("<body><nav>menu</nav><article><p>x</p></article><footer>f</footer></body>", "x"),
    ("<article><p>x</p><script>var t='</p></article>';</script><style>p{}</style><p>y</p></article>", "x\ny"),
    ("<article><p>x<!-- <p>no</p> -->y</p></article>", "xy"),
    ("<article><p>x</p><!-- never closed <p>y</p></article>", "x"),
    ("<article><p>a < b and c > d</p></article>", "a < b and c > d"),
    ("<article><p title='1 > 0'>x</p><p title=\"unclosed>y</p></article>", "x\ny"),
    ("<div class='ad'>buy</div><div class='headline'>Title</div><p>x</p>", "Title\nx"),
    ("<article><div class='cookie-notice'>c</div><p>x</p><aside>s</aside><form>f<input>g</form></article>", "x"),
    ("<article><header><h1>T</h1><div>by me</div></header><p>x</p></article><header><h1>Site</h1></header>", "T\nx"),
    ("<main><p>x</p></main><p>y</p>", "x"),
    ("<main><article><p>x</p></article></main><section class='comments'><article><p>no</p></article></section>", "x"),
    ("<article><p>x</p><section id='comments'><article class='comment'><p>me too</p></article></section></article>", "x"),
    ("<article><ul><li>a<li>b<ul><li>c</ul></ul><table><tr><td>1<td>2<tr><td>3</table></article>", "a\nb\nc\n1 2\n3"),
    ("<article><p>x</b></i></p></div>y</article>z", "x\ny"),
    ("<ARTICLE><P>x</P></ARTICLE>", "x"),
    ("<article><p>x</p></article><article><p>y</p></article>", "x\ny"),
    ("<article><pre>a\n  b</pre><p hidden>no</p><p>c</p></article>", "a b\nc"),
    ("<article><p>one</p>loose <i>text</i><p>two</p></article>", "one\nloose text\ntwo"),
]


@pytest.mark.parametrize(("source", "text"), CASES)
def test_markup(source, text):
    assert "\n".join(Page(source).blocks()) == text


def test_long_and_broken_pages_take_linear_time():
    for unit in ('<a title="', "<p>", "<!--", "</x>", "<div>", "<p><b>", "&amp", "<"):
        Page(unit * 50_000).blocks()


def test_subtree_hashes_see_tags_attributes_and_text_but_not_white_space():
    one = lambda s: set(Page(f"<body>{s}</body>").subtrees())
    assert one("<div>a  b<p>c</p></div>") == one("<div>a\nb<p> c</p></div>")
    others = ["<div>a b<p>d</p></div>", "<div class=x>a b<p>c</p></div>", "<ul>a b<p>c</p></ul>", "<div>a b<b>c</b></div>"]
    for other in others:
        assert one("<div>a b<p>c</p></div>").isdisjoint(one(other) - one("<p>c</p>"))


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def site(n, host="h.example", banner="<div>Sale on Monday</div>", own="text {i}"):
    return [(i, f"https://{host}/{i}", f"<body>{banner}<div><p>{own.format(i=i)}</p></div></body>") for i in range(n)]


def test_what_recurs_on_a_host_is_deleted_and_elsewhere_kept(spark):
    rows = site(12) + [(100, "https://other.example/", site(1)[0][2]), (101, None, site(1)[0][2]), (102, "https://h.example/x", None)]
    got = {r[0]: r[1] for r in maintext.extract(pages(spark, rows), "page_id").select("page_id", "text").collect()}
    assert all(got[i] == f"text {i}" for i in range(12))
    assert got[100] == got[101] == "Sale on Monday\ntext 0" and got[102] == ""


def test_copies_of_a_page_make_no_template(spark):
    rows = site(12, own="the same")
    got = {r[0] for r in maintext.extract(pages(spark, rows), "page_id").select("text").collect()}
    assert got == {"Sale on Monday\nthe same"}


def test_sentences_that_articles_share_stay(spark):
    rows = [(i, "http://a.example/", f"<article><div>Follow us</div><p>All rights.</p><p>{i}</p></article>") for i in range(20)]
    got = {r[0]: r[1] for r in maintext.extract(pages(spark, rows), "page_id").select("page_id", "text").collect()}
    assert got == {i: f"All rights.\n{i}" for i in range(20)}


def test_counts_are_those_of_a_plain_count(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = {tuple(r) for r in maintext.templates(table, least=2, share=0.0).collect()}
    seen, host = {}, maintext.host_of(F.col("url")).alias("h")
    for r in table.select(host, "html").collect():
        page = Page(r["html"] or "")
        for h in page.subtrees():
            seen.setdefault((r["h"], h), set()).add("\n".join(page.blocks()))
    assert found == {k for k, v in seen.items() if len(v) >= 2 and k[0]} and found


def test_other_limit_same_rows_repeated_rows_and_names(spark):
    rows = site(12) + [(3, *site(12)[3][1:])]
    df = pages(spark, rows).withColumn("host", F.lit("clash")).withColumn("h", F.lit(1))
    wide = sorted(tuple(r) for r in maintext.extract(df, "page_id", "host", "h").collect())
    assert wide == sorted(tuple(r) for r in maintext.extract(df, "page_id", "host", "h", limit=0).collect())
    assert len(wide) == 13 and wide[0][1:3] == ("clash", 1)
    with pytest.raises(ValueError):
        maintext.extract(df.withColumn("text", F.lit("")), "text")
    assert maintext.extract(df.limit(0), "page_id").collect() == []
