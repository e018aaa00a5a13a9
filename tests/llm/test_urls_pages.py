import math
import time

import pytest

from versify.llm import site_style, url_filter

RULED = [
    ("http://a.net/x", "a.net", "/x", "net/", "block"),
    ("https://EXAMPLE.net/en/1?q=1", "example.net", "/en/1", "example.net/en/", "allow"),
    ("https://m.example.net/en", "m.example.net", "/en", "net/", "block"),
    ("http://www.example.com/de/7#t", "www.example.com", "/de/7", "example.com/de/", "block"),
    ("http://q.org/fr/2", "q.org", "/fr/2", "org/fr/", "allow"),
    ("http://anet/x", "anet", "/x", None, "allow"),
    ("http://b.net", "b.net", "", None, "allow"),
    ("ftp://c.net?x/y", "c.net", "", None, "allow"),
    ("no scheme", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("", "", "", None, "allow"),
]


def test_rules(spark):
    rows = [(i, u, "x") for i, (u, *_) in enumerate(RULED)] * 2
    got = url_filter.url_verdicts(spark.createDataFrame(rows, "page_id long, url string, host string")).collect()
    assert len(got) == 2 * len(RULED)
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == RULED[r["page_id"]][1:]
    assert url_filter.url_verdicts(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_model_learns_characters(spark):
    good = [f"https://news{i % 7}.garden.org/en/story-{i}" for i in range(300)]
    bad = [f"https://casino-win{i % 5}.org/en/slot-{i}" for i in range(80)]
    new = ["https://casinowinner.org/en/slot-3", "https://newsgarden.org/en/story-5"]
    df = spark.createDataFrame(list(enumerate(good + bad + new)), "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.url_verdicts(df, rules=(), terms=("casino",)).collect()}
    assert {got[i] for i in range(300)} == {"allow"} and {got[i] for i in range(300, 380)} == {"block"}
    assert (got[380], got[381]) == ("block", "allow")


def test_models_against_a_plain_witten_bell(spark):
    """Every context's probabilities, from the definition; they sum to 1 over the alphabet."""
    rows = [("^ab", 2, 1), ("bab", 3, 0), ("^a", 1, 4), ("abc", 5, 2), ("^b", 0, 3), ("bcb", 1, 1), ("abb", 0, 2), ("c", 1, 0)]
    grams = spark.createDataFrame(rows, "gram string, yes long, no long")
    got = {r["gram"]: r["ratio"] for r in url_filter.markov_log_ratios(grams, 2).collect()}

    def model(of):
        def chance(context, last):
            ends = [(g[-1], r[of]) for r in rows for g in [r[0]] if len(g) > len(context) and g[:-1].endswith(context)]
            n, kinds = sum(c for _, c in ends), len({x for x, c in ends if c})
            low = chance(context[1:], last) if context else 1 / url_filter.ALPHABET
            return (sum(c for x, c in ends if x == last) + kinds * low) / (n + kinds) if n else low

        return chance

    yes, no = model(1), model(2)
    assert got.keys() == {r[0][-k:] for r in rows for k in (1, 2, 3) if len(r[0]) >= k}
    for gram, ratio in got.items():
        assert abs(ratio - math.log(yes(gram[:-1], gram[-1]) / no(gram[:-1], gram[-1]))) < 1e-9
    letters = [chr(33 + i) for i in range(url_filter.ALPHABET)]
    for chance in (yes, no):
        for context in ("", "a", "ab", "b", "^", "^a"):
            assert abs(sum(chance(context, x) for x in letters) - 1) < 1e-9


def page(article, boiler="", title="t"):
    return f"<html><head><title>{title}</title><style>p{{}}</style></head><body><nav><ul><li><a href='/x'>menu</a></li></ul></nav>{boiler}<article><h1>{title}</h1>{article}</article><footer>&copy; us</footer>"


def test_article_text(spark):
    odd = "<p>a&nbsp;b\n c &lt;d&gt;<br>e<p><b>f <i>g</b><p></p><div class='ad'>buy</div><form><p>mail</p></form><script>if(a<b){'</p>'}</script><!-- <p>no --><section class=comments><p>me too</p></section><p>last"
    assert site_style.main_text(page(odd, title="T &amp; U"), frozenset()) == "T & U\na b c <d> e\nf g\nlast"
    assert site_style.main_text("<div><p>one</p>two</div><header>h</header>", frozenset()) == "one\ntwo"
    for broken in ("", "<", "<p", "<!--", "</p>", "<p>x<scr", "a < b > c", "<script>x", "<a href='<p>'>t</a>"):
        site_style.main_text(broken, frozenset())


def test_style_tree_finds_unnamed_boilerplate(spark):
    rows = [(i, f"http://h.org/{i}", f"<div class='q7'>Hot deals today</div><div class='body'><p>own text {i} of this page</p></div><div class='z'>Seen {i} times</div>") for i in range(30)]
    rows += [(99, "http://one.org/", "<div class='q7'>Hot deals today</div><p>alone</p>"), (100, None, None), (101, "http://h.org/0", rows[0][2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS host", "'y' AS low")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in site_style.extract_text(df).collect()}
    assert len(got) == len(rows)
    assert got[5] == ("own text 5 of this page\nSeen 5 times", 36)
    assert got[99][0] == "Hot deals today\nalone"  # one page tells nothing about its site
    assert got[100] == ("", 0) and got[101] == got[0]
    assert site_style.extract_text(df.limit(0)).count() == 0


def test_copies_count_as_one_page(spark):
    same = "<div class='top'>Hot deals today</div><div class='body'><p>the one article</p></div>"
    other = "<div class='top'>Hot deals today</div><div class='body'><p>article %d</p></div>"
    rows = [(i, f"http://copies.org/{i}", same) for i in range(6)]  # six rows, one page: the tree says nothing
    rows += [(10 + i, f"http://mixed.org/{i}", other % min(i, 5)) for i in range(40)]  # 35 rows of one page and five others
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {r["page_id"]: r["text"] for r in site_style.extract_text(df).collect()}
    assert {got[i] for i in range(6)} == {"Hot deals today\nthe one article"}
    assert all(got[10 + i] == f"article {min(i, 5)}" for i in range(40))


def test_names_do_not_decide_alone():
    text = lambda html, low=(): site_style.main_text(html, frozenset(low))
    body = "<nav>menu</nav><article><h1>T</h1><p>long text of the article</p></article><div class='comments'><p>me too</p></div>"
    for wrapper in ("<div class='page has-sidebar'>", "<div class='content no-comments'>", "<form id='search-form' action='/'>", "<div class='widget'>", "<div class='widget'><form id=f>"):
        assert text(wrapper + body) == "T\nlong text of the article", wrapper
    assert text("<form id=f><nav>menu</nav><h1>T</h1><div class=entry><p>long text of the page</p></div></form>") == "T\nlong text of the page"
    main = "<div class='entry-content'><p>long text of the page, without a mark</p></div>"
    assert text(main + "<article class='comment-body'><p>me too</p></article>") == "long text of the page, without a mark"
    assert text(main + "<section class='related'><article class='card'><p>other</p></article></section>") == "long text of the page, without a mark"
    assert text(main + "<section class='related'>" + "<article class='card'><p>other</p></article>" * 3 + "</section>") == "long text of the page, without a mark"
    assert "long text" in text(main + "<div class='more'><article><p>one</p></article><article><p>two</p></article></div>")
    assert text("<article class='post category-legal'><p>text</p></article><div>aside</div>") == "text"
    assert text("<div class='sidebar'><nav>menu</nav>x</div><article><p>text</p></article>") == "text"
    assert text("<div class='comments'><p>a comment longer than the text</p><form>reply</form></div><p>text</p>") == "text"
    assert text("<div class='q'>Hot deals of today</div><form id=f><h1>T</h1><p>text</p></form>", ["div.q"]) == "T\ntext"


def test_missing_end_tags_lose_no_text():
    text = lambda html: site_style.main_text(html, frozenset())
    assert text("<html><head><title>t</title><body><p>text") == "text"
    assert text("<html><head><title>t</title><meta charset=utf-8><script>x</script><link rel=a href=b><p>text") == "text"
    assert text("<head><title>t</title><style>p{}</style></head><p>text") == "text"
    for cut in ("<select><option>", "<svg viewBox='0 0 1 1'><path d='M0 0'>", "<object data=x>", "<math><mi>", "<iframe src=x>", "<noscript>", "<template>"):
        assert text(f"<p>one{cut}<p>two") == "one\ntwo", cut
    assert text("<p>one<svg><path d=x><p>two<svg><path></svg><p>three") == "one\ntwo\nthree"
    assert text("<p>a<select><option>x<option>y</select>b<svg><title>t</title><foreignObject><p>in</p></foreignObject></svg>c<object><p>old</p></object>d") == "abcd"
    assert text("<p>one</p><script>if (a) { '<p>' }<p>two") == "one"


@pytest.mark.parametrize("source", ["<a x " * 100_000, "<svg x>" * 50_000, '<a x="' * 100_000 + ">", "</script " * 50_000, "<script>" * 50_000, "<div>" * 1_000 + "</p>" * 50_000, "<p a='\">" * 50_000])
def test_broken_pages_are_read_in_one_pass(source):
    start = time.process_time()
    site_style.Page(source)
    assert time.process_time() - start < 5
