from pyspark.sql import functions as F

from wardspark.llm.tag_paths import extract, main_text

PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t="</p>no";</script></head><body class="page">
<header class="site"><a href="/">Home no</a></header><nav><ul><li>no</li></ul></nav><div class="ad">no no no no no, no.</div><!-- no <p>no</p> -->
<article><header><h1>Title &amp; more</h1></header><p><b>First&nbsp;paragraph,
 with   <i>in</i>line<br>and a break.<br><p>Second &lt;p&gt; one, a little longer than the first; with marks.<div class="comments"><p>no: a reader's remark, long enough to look like content, no.</p></div>
<blockquote>Quoted text, as well.</blockquote><ul><li>item one<li>item two</ul><table><tr><td>cell a<td>cell b</table>Tail text 1 < 2.</article>
<aside><p>no, sidebar text with marks, and more.</p></aside><form><label>no</label><textarea>no</textarea></form><div id="cookie-notice">no, we use.</div><footer><p>&copy; no</p></footer></body></html>"""
TEXT = (
    "Title & more First paragraph, with inline and a break. Second <p> one, a little longer than the first; with marks. Quoted text, as well. item one item two cell a cell b Tail text 1 < 2.")


def test_article_without_what_surrounds_it():
    assert main_text(PAGE) == TEXT


def test_awkward_pages():
    assert main_text(None) == main_text("") == main_text("<nav>menu</nav>") == main_text("<!-- open") == main_text("<script>x") == ""
    assert main_text("plain text only") == "plain text only"
    assert main_text("<p>cut <a href='x") == "cut"
    assert main_text("<article>" + "<p>Some words, here.</p>" * 3000 + "</article>").count("Some words, here.") == 3000
    assert main_text("<article>" + "<b><i>" * 2000 + "deep, text." + "</article>") == "deep, text."


def test_test_pages(spark, sf_dir):
    """The test pages hold one article each; everything in it is wanted, nothing else."""
    import html
    import re

    for row in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        inside = re.search(r"(?s)<article>(.*?)</article>", row.html)[1]
        assert main_text(row.html) == re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", inside))).strip()


def test_table(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", "")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x")).withColumn("n_chars", F.lit(1))
    found = sorted(map(tuple, extract(table).collect()), key=repr)
    assert found == sorted([(1, "u", TEXT, len(TEXT))] * 2 + [(2, None, "", 0), (None, "v", "", 0)], key=repr)
    assert extract(table.limit(0)).count() == 0
