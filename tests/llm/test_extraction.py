import random

import pytest

from plywise.llm import extraction

LONG = "The committee met on Tuesday to discuss the plans for the new bridge over the river, and heard from several residents. "
PARAS = [LONG * 3, "Short.", LONG * 2 + "Caf&eacute; &amp; b&#233;b&#xe9; &lt;tag&gt; it&rsquo;s", LONG * 4]
TEXT = [" ".join((LONG * 3).split()), "Short.", " ".join((LONG * 2).split()) + " Café & bébé <tag> it’s", " ".join((LONG * 4).split())]
NAV = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">All news of the day</a></li></ul></nav>'
FOOT = "<footer>&copy; someone &middot; " + LONG + "</footer>"
BODY = "<h1>A  title\nhere</h1>" + "".join(f"<p>{p}</p>" for p in PARAS)
WANT = "\n".join(["A title here", *TEXT])


@pytest.mark.parametrize("page", [
    f"<html><body>{NAV}<article>{BODY}</article>{FOOT}</body></html>",
    f"<html><body>{NAV}<div id=content><div class='post'>{BODY}</div></div><div class='sidebar'><p>{LONG * 9}</p></div>{FOOT}</body></html>",
    f"<body><div class=\"cookie-notice\">{LONG}</div><header><h2>Site</h2>{NAV}</header><main><div>{BODY}</div></main>"
    f"<section id='comments'><p>{LONG * 8}</p></section>{FOOT}",
    f"<div><ul><li><a href=1>One link to a page</a><li><a href=2>Another link to a page</a><li><a href=3>Third</a></ul></div><div>{BODY.replace('</p>', '')}</div>",
    f"<article><script>var a = '<p>no</p>';</script><style>p{{}}</style>{BODY}<form>Name <input></form><aside>{LONG}</aside><div class=comments>{LONG}</div></article>",
    f"<ARTICLE>{BODY.replace('<p>', '<P class=x>').replace('</p>', '<BR></P>')}</ARTICLE><!-- <p>{LONG}</p> -->{FOOT}",
    f"<article>{BODY}",
    f"<body>{NAV}<div role='main'><article>{BODY}</article></div><div role=complementary>{LONG * 3}</div>",
])
def test_templates(page):
    assert extraction.extracted(page) == WANT


def test_blocks_and_inline_elements():
    page = "<article><p>one <b>two</b><i>three</i>  four<br>five</p>six<ul><li>a<li>b <a href=x>c</a></ul><table><tr><td>t1<td>t2</table><p><b>open<p>next</article>"
    assert extraction.extracted(page) == "one twothree four five\nsix\na\nb c\nt1\nt2\nopen\nnext"


def test_odd_pages_do_not_fail():
    assert [extraction.extracted(x) for x in ("", "   ", "plain text", "<", "<p", "</p>", "<!--", "<script>x", "a<b", "<a href='", "&amp")] == [
        "", "", "plain text", "<", "", "", "", "", "a", "", "&"]
    rng = random.Random(1)
    parts = ["<p>", "</p>", "<b>", "</div>", "<div class=ad>", "<li>", "text ", "&lt;", "<td>", "</table>", "<a href=\"x", "'", ">", "<!-- ", "-->", "<br/>"]
    for _ in range(300):
        extraction.extracted("".join(rng.choices(parts, k=rng.randint(0, 60))))
    deep = "<b>" * 50_000 + "word " + "<p>" * 20_000 + LONG
    assert "Tuesday" in extraction.extracted(deep)
    assert len(extraction.extracted(f"<article>{('<p>' + LONG) * 5000}</article>").split("\n")) == 5000


def test_query_on_rows(spark, tmp_path):
    page = f"<html><body>{NAV}<article>{BODY}</article>{FOOT}</body></html>"
    rows = [(1, "http://a.b/", page, "x", 1), (1, "http://a.b/", page, "x", 1), (2, None, None, "x", 1), (None, "u", "", "x", 1), (3, "u", "<footer>only</footer>", "x", 1)]
    spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = extraction.op3_extraction(spark, str(tmp_path)).collect()
    assert sorted(map(str, got)) == sorted(f"Row(page_id={i}, url={u!r}, text={t!r}, n_chars={len(t)})" for i, u, t in [
        (1, "http://a.b/", WANT), (1, "http://a.b/", WANT), (2, None, ""), (None, "u", ""), (3, "u", "")])
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/none/pages.parquet")
    assert extraction.op3_extraction(spark, f"{tmp_path}/none").count() == 0


@pytest.mark.parametrize("attributes", [
    'style="overflow:hidden"', 'title="hidden gems"', 'data-hidden="false"', "data-x='a hidden b'", 'class="content no-sidebar"', 'class="post has-comments"',
    'class="case-notice"', 'id="legal-text"', 'class="related-work"', 'class="without-ads"', 'class="noSidebar"', 'aria-hidden="false"'])
def test_attributes_that_drop_nothing(attributes):
    assert extraction.extracted(f"<body>{NAV}<article><div {attributes}>{BODY}</div></article>{FOOT}</body>") == WANT
    part = f"<div {attributes}><p>{LONG}</p></div>"
    assert extraction.extracted(f"<body>{NAV}<article>{BODY}{part}</article></body>") == WANT + "\n" + " ".join(LONG.split())


@pytest.mark.parametrize("attributes", [
    "hidden", "HIDDEN=''", 'style="a" hidden', 'class="cookie-notice"', 'class="sidebar-left"', "id=comments-area", 'class="x navBar"', 'class="ad-300x250"',
    'class="related-posts"', 'role="navigation"', 'aria-hidden="true"'])
def test_attributes_that_drop(attributes):
    assert extraction.extracted(f"<body><article>{BODY}<div {attributes}><p>{LONG}</p></div></article></body>") == WANT


def test_class_never_drops_most_of_the_text():
    assert extraction.extracted(f"<body>{NAV}<div class='content sidebar'>{BODY}</div><div class=ads>{LONG}</div></body>") == WANT


def nested(page):
    chosen = extraction._main(extraction.tree(page))
    ids = {id(n) for n in chosen}
    for n in chosen:
        up = n.parent
        while up is not None:
            if id(up) in ids:
                return True
            up = up.parent
    return False


@pytest.mark.parametrize("inside", ["<p>{}</p>", "<article><p>{}</p></article>", "<div><p>{}</p></div>", "{}", "<p>{}<p>{}", "<div>{}</div><div>{}</div>", "<b>{}</b>"])
def test_no_text_is_written_twice(inside):
    words = " ".join(LONG.split())
    page = f"<html><body>{inside.replace('{}', LONG)}</body></html>"
    assert extraction.extracted(page).replace("\n", " ").count(words) == inside.count("{}")
    assert not nested(page)


def test_no_chosen_node_holds_another():
    rng = random.Random(2)
    parts = ["<p>", "</p>", "<div>", "</div>", "<b>", "</b>", "<article>", "</article>", "<ul><li>", "</ul>", LONG, "word ", "<a href=x>link</a>", "<form>", "</form>", "<table><tr><td>", "</table>"]
    for _ in range(2000):
        assert not nested("<body>" + "".join(rng.choices(parts, k=rng.randint(1, 40))))


def test_a_form_around_the_page_keeps_its_text():
    assert extraction.extracted(f"<body><form action=x>{NAV}<div>{BODY}</div><input name=q><button>Go</button></form>{FOOT}</body>") == WANT
    assert extraction.extracted(f"<body>{NAV}<div>{BODY}<form><label>Name</label><input><p>{LONG}</p></form></div></body>") == WANT


def test_formulas_and_labels_of_an_article_stay():
    page = f"<article>{BODY}<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p><fieldset><legend>Box</legend>in a box</fieldset><p><label>a label</label></p></article>"
    assert extraction.extracted(page) == WANT + "\nso x=2 holds\nBox\nin a box\na label"


def test_raw_elements_without_an_end_are_read_once():
    import time

    for tag in ("iframe", "noscript", "xmp", "noembed"):
        page = f"<article><p>{LONG}</p>" + f"<{tag}>" * (1_000_000 // (len(tag) + 2)) + "</article>"
        started = time.perf_counter()
        extraction.extracted(page)
        assert time.perf_counter() - started < 5
