import poems
from pyspark.sql import functions as F

from versify.functions import text as X
from versify.functions.html import normalize_url, paragraph_texts, safe_filename
from versify.operators.rhyme_tags import tag_rhymes
from versify.sources.io import read_text_corpus


def test_clean_text(spark):
    out = spark.createDataFrame([(poems.DIRTY,)], "text string").select(X.clean_text(F.col("text"))).first()[0]
    assert "ä" not in out and "[" not in out and "]" not in out and "(34)" not in out
    assert "..." in out and "«sera»" in out and "\xa0" not in out


def test_layout_and_merged_lines(spark):
    lines = [f"riga {i}" for i in range(14)]
    df = spark.createDataFrame([(lines,)], "l array<string>")
    out = df.select(X.format_structure(F.col("l"))).first()[0]
    assert [len(b.split("\n")) for b in out.split("\n\n")] == [4, 4, 3, 3]
    long = "Questa riga è molto lunga e contiene una virgola, Poi continua ancora per molte parole"
    df = spark.createDataFrame([(long,)], "t string")
    out = df.select(X.fix_merged_lines(F.col("t"))).first()[0]
    assert out.split("\n") == ["Questa riga è molto lunga e contiene una virgola,", "Poi continua ancora per molte parole"]


def test_file_to_tagged_markup(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "07. la riva.txt").write_text(poems.UNTAGGED, encoding="utf-8")
    files = read_text_corpus(spark, str(tmp_path / "in"))
    lines = files.select(tag_rhymes(X.markup(F.col("text"), F.col("stem")))).first()[0].strip().split("\n")
    assert (lines[0], lines[-1]) == ("<SONNET>", "<END>")
    assert "<TITLE>07. la riva</TITLE>" in lines
    assert lines.count("<STANZA>") == 3
    assert [line[7] for line in lines if line.startswith("<RHYME_")] == list("ABBAABBACDCDCD")


def test_special_chars_and_prefix_strip(spark):
    t = "<SONNET>\n<RHYME_A> iva | Apre la riva\n<END>"
    df = spark.createDataFrame([(t,)], "t string")
    chars = df.select(X.to_special_chars(F.col("t"))).first()[0]
    assert chars == "¶\nⒶ iva | Apre la riva\n§"
    stripped = spark.createDataFrame([(chars,)], "t string").select(X.strip_char_rhyme_prefix(F.col("t"))).first()[0]
    assert stripped == "¶\nApre la riva\n§"


def test_html_paragraph_and_names(spark):
    p = 'Primo verso<sup>1<br></sup> secondo &amp; verso<br>terzo'
    df = spark.createDataFrame([(p, "http://x.org/a/_ABC.htm?q=1#f", "a/b: c?")], "p string, u string, t string")
    r = df.select(paragraph_texts(F.array("p"))[0].alias("p"), normalize_url(F.col("u")).alias("u"),
                  safe_filename(F.col("t"), F.lit(False)).alias("f")).first()
    assert r["p"] == "Primo verso\nsecondo & verso\nterzo"
    assert r["u"] == "https://x.org/a/__ABC.HTM"
    assert r["f"] == "[CHECK] a-b -  c.txt"


def test_page_titles_and_style_filter(spark):
    from versify.functions.html import VERSE_STYLE_RE, page_title, paragraphs

    pages = [
        ("<html><p>Intro</p><p>12. Titolo<sup>1</sup> del  sonetto</p></html>", "http://x/a"),
        ("<ul><li>Sonetto . Primo</li><li><ul><li>x</li></ul></li></ul>", "http://x/b"),
        ("<p>niente</p>", "http://x/c"),
    ]
    df = spark.createDataFrame(pages, "html string, url string")
    got = [r[0] for r in df.select(page_title(F.col("html"), F.col("url"))).collect()]
    assert got == ["12. Titolo del sonetto", "Sonetto. Primo", "Unknown_Title_http://x/c"]
    styled = '<p style="margin-left:1.50cm;text-indent:0.25cm">verso uno<br>verso due</p><p>nota</p>'
    one = spark.createDataFrame([(styled,)], "html string")
    assert one.select(F.size(paragraphs(F.col("html"), VERSE_STYLE_RE))).first()[0] == 1
    assert one.select(F.size(paragraphs(F.col("html")))).first()[0] == 2


def test_safe_filename_is_nfc(spark):
    from versify.functions.html import safe_filename

    decomposed = "Pieta\u0300: e/o"  # 'a' + combining grave accent
    df = spark.createDataFrame([(decomposed,)], "t string")
    assert df.select(safe_filename(F.col("t"), F.lit(True))).first()[0] == "Piet\u00e0 -  e-o.txt"
