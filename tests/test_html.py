from pyspark.sql import functions as F

from versify.functions import html as H
from versify.functions.rhyme import pattern_signature
from versify.plans.catalog import page_links


def _one(spark, html, column):
    return spark.createDataFrame([(html,)], "html string").select(column).first()[0]


def test_style_belongs_to_its_own_paragraph(spark):
    verse = '<p style="margin-left:1.50cm;text-indent:0.25cm">{}</p>'
    page = "".join(verse.format(w) for w in ("uno", "due", "tre", "quattro"))
    assert _one(spark, page, H.paragraphs(F.col("html"), H.VERSE_STYLE_RE)) == ["uno", "due", "tre", "quattro"]
    apart = '<p style="margin-left:1.50cm">a</p><p style="text-indent:0.25cm">b</p>'
    assert _one(spark, apart, H.paragraphs(F.col("html"), H.VERSE_STYLE_RE)) == []
    single = "<p class=v style='margin-left:1.50cm;text-indent:0.25cm'>c<br>d</p>"
    assert _one(spark, single, H.paragraph_texts(H.paragraphs(F.col("html"), H.VERSE_STYLE_RE))) == ["c\nd"]


def test_references_and_hidden_parts(spark):
    page = "<style>p{}</style><script>var t='</p><p>no</p>';</script><!-- <p>no</p> --><p>perch&eacute; &#232; l&rsquo;ora &#x2014; &amp;lt; &copy;</p>"
    assert _one(spark, page, H.paragraph_texts(H.paragraphs(F.col("html")))) == ["perch\u00e9 \u00e8 l\u2019ora \u2014 &lt; \u00a9"]


def test_title_from_lists(spark):
    nested = "<ul><li>Raccolta<ul><li>Canto . Terzo<sup>2</sup></li></ul></li></ul>"
    assert _one(spark, nested, H.title_from_list(F.col("html"))) == "Canto. Terzo2"
    tagged = "<ul><li><b>Canto</b> . Terzo</li></ul>"  # the blank before the dot goes with the tag
    assert _one(spark, tagged, H.title_from_list(F.col("html"))) is None


def test_links_are_filtered_before_they_are_counted(spark):
    page = "<a href=x>1</a><a class='k' href='a/b'>2</a><a href=\"nope\">3</a><A HREF=\"c/d\">4</A><a href=e/f>5</a>"
    df = spark.createDataFrame([(1, page), (2, "")], "page_id long, html string")
    got = lambda **k: [(r["page_id"], r["link_no"], r["href"]) for r in page_links(df, **k).collect()]
    assert got() == [(1, 0, "a/b"), (1, 1, "c/d"), (1, 2, "e/f")]
    assert got(skip=1) == [(1, 1, "c/d"), (1, 2, "e/f")]
    assert got(skip=1, limit=1) == [(1, 1, "c/d")]


def test_scheme_of_many_rhymes(spark):
    symbols = [str(i) for i in range(300)] + ["0", "299"]
    df = spark.createDataFrame([(symbols,)], "s array<string>")
    want = "".join(chr(65 + i) for i in range(300)) + "A" + chr(65 + 299)
    assert df.select(pattern_signature(F.col("s"))).first()[0] == want


def test_container_ends_at_its_own_end_tag(spark):
    page = '<div id="other"><a href="/no"></a></div><p><DIV class=x id=\'post\'>a<div id="post">b<div></div></div><a href="/yes">c</a></DIV>d<div id="post">e</div>'
    body = H.container(F.col("html"), "post")
    assert _one(spark, page, body) == "<DIV class=x id='post'>a<div id=\"post\">b<div></div></div><a href=\"/yes\">c</a>"
    assert _one(spark, page, H.links(body)) == ["/yes"]
    assert _one(spark, '<div id="post">a<div>b</div>', body) == '<div id="post">a<div>b</div>'  # not closed
    assert _one(spark, '<div id="posted">a</div><divider id="post"></divider>', body) is None and _one(spark, "", body) is None
    assert _one(spark, '<!-- <div id="post"> --><div id=post>a</div>', body) == "<div id=post>a"


def test_urls_without_a_scheme_and_in_any_script(spark):
    want = {"//host/x?q": "https://host/x", "/x#a": "https:///x", "http://a.it/_à.HTM": "https://a.it/__à.HTM", "HTTP://a/_P1.htm?x=1": "https://a/__P1.HTM", "": "https://", "ftp:x": "https:x"}
    rows = spark.createDataFrame([(u,) for u in want], "url string").select("url", H.normalize_url(F.col("url")).alias("u")).collect()
    assert {r.url: r.u for r in rows} == want
