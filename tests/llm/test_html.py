from pyspark.sql import functions as F

from logloom.llm.html import extract_text, main_text

LONG = "This sentence, which is long enough, belongs to the article; it has marks. " * 3
PARTS = """<header><a href="/">Home</a><p>Site, with a long line of words, and marks. And more.</p></header>
<nav><ul><li><a href="/a">One</a></li><li>Two</li></ul></nav>
<div class="cookie-notice">We use cookies, really, and ask you to accept them all. Thanks.</div>
<div id="sidebar"><p>Side story, long enough to look like text, with marks.</p></div>
<form><label>Name</label><input name="x"><button>Send</button></form>
<aside>Aside, aside.</aside><div class="ad">Buy now, it is cheap.</div>"""


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p {{}}</style></head><body>{body}</body></html>"


def test_article_without_the_rest():
    text = main_text(page(f"""{PARTS}<article><h1>Head &amp; line</h1><p>{LONG}</p><p>Short.</p>
<script>var x = "<p>no</p>";</script><ul><li>first</li><li>second</li></ul>
<blockquote>{LONG}</blockquote></article>
<section class="comments"><div class="comment"><p>{LONG} says a reader.</p></div></section>
<footer>&copy; 2024, all rights.</footer>"""))
    assert text == "\n\n".join(["Head & line", LONG.strip(), "Short.", "first", "second", LONG.strip()])


def test_article_without_its_tag():
    text = main_text(page(f'{PARTS}<div class="content"><h1>Title</h1><div class="body"><p>{LONG}</p><p>{LONG}</p>'
                          f'<p>End.</p></div></div><footer>Foot</footer>'))
    assert LONG.strip() in text and text.endswith("End.") and "cookies" not in text and "Foot" not in text


def test_white_space_references_and_broken_markup():
    text = main_text("<body><article><p>a\n  b&nbsp;c &lt;d&gt; &#233;<br>e<p><b>bold\t<i>it</b>alic</i><!-- <p>x</p> -->"
                     "<p title='a > b'>last &amp")
    assert text == "a b c <d> é e\n\nbold italic\n\nlast &"


def test_plain_text_and_odd_pages(spark):
    assert main_text("no markup, at all") == "no markup, at all"
    rows = [(1, None), (2, ""), (3, "<p></p>"), (4, "<script>only()"), (5, "<article><p>x</p></article>")] * 2
    docs = spark.createDataFrame(rows, "page_id long, html string").withColumn("text", F.lit(1)).withColumn(
        "n_chars", F.lit("old"))
    got = extract_text(docs).collect()
    assert len(got) == 10 and {(r["page_id"], r["text"], r["n_chars"]) for r in got} == {
        (1, "", 0), (2, "", 0), (3, "", 0), (4, "", 0), (5, "x", 1)}
    assert extract_text(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_a_long_page_is_whole():
    body = "".join(f"<p>{LONG} {i}</p>" for i in range(3000))
    assert main_text(page(f"<article>{body}</article>")).count("\n\n") == 2999


def test_all_sibling_parts_are_kept():
    sections = f"<section><p>{LONG * 2}</p></section><section><p>{LONG}</p></section>"
    whole = (LONG * 2).strip() + "\n\n" + LONG.strip()
    assert main_text(page(f'{PARTS}<div id="content">{sections}</div><footer>Foot</footer>')) == whole
    parts = f"<article><p>{LONG * 3}</p></article><article><p>{LONG}</p></article>"
    assert main_text(page(f"{PARTS}<main>{parts}</main>")) == (LONG * 3).strip() + "\n\n" + LONG.strip()


def test_the_heading_outside_the_body_is_kept():
    text = main_text(page(f'{PARTS}<div class="content"><h1>Title</h1><div class="body"><p>{LONG}</p><p>{LONG}</p>'
                          f'<p>End.</p></div></div><footer>Foot</footer>'))
    assert text == "\n\n".join(["Title", LONG.strip(), LONG.strip(), "End."])


def test_labels_do_not_delete_most_of_a_page():
    for name in ("has-sidebar", "with-comments", "no-ads", "search-widget"):
        text = main_text(page(f'<nav>Menu</nav><div class="{name}"><p>{LONG}</p><p>{LONG}</p></div>'))
        assert text == f"{LONG.strip()}\n\n{LONG.strip()}"
