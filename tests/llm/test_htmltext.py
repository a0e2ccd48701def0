"""Main text: hand-made pages, plain cutting of simple articles, odd markup, odd tables."""

import html
import re
import time

import pytest
from evisite.llm import htmltext
from evisite.llm.htmltext import label, main_text, scan
from evisite.llm.registry import op11_two_pass_main_text

SF = "/root/testdata/sf0.01"
PROSE = "The water of the river was cold in the morning, and they went to the other side with the boat. " * 3


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("<p></p>  <div> </div>", ""),
        ("Plain text only.", "Plain text only."),
        ("<body><nav><a href=x>Home</a></nav><article><h1>Be.</h1><p>Be. Er.</article><footer>&copy; me</footer>", "Be.\nBe. Er."),
        ("<article><p>a &amp; b &lt;c&gt; &eacute;&#233;&#xe9; &amp x</p></article>", "a & b <c> ééé & x"),
        ("<article><p>one\n\t two&nbsp; three</p> <p>four</article>", "one two three\nfour"),
        ("<article><p>kept<script>var t='</p>';</script> on<style>p{}</style><!-- <p>no</p> --></p></article>", "kept on"),
        ("<article><p>text<div class='ad'>Buy now</div><p>more</p><div id='comments'><p>" + PROSE + "</p></div></article>", "text\nmore"),
        ("<article><header><h1>Title</h1></header><p>Body.</p></article>", "Title\nBody."),
        ("<header><h1>Site</h1></header><main><p>Body.</p></main>", "Body."),
        ("<article><p>x</p><form><p>Sign up</p><input value='<p>'></form><aside>side</aside><p>y</p></article>", "x\ny"),
        ("<article><p>x</p><article class='comment'><p>" + PROSE + "</p></article></article>", "x"),
        ("<article><p>5 < 6 and a<b>bold</b></p></article>", "5 < 6 and abold"),
        ('<article><p title="a > b">x</p><p hidden>gone</p><p style="display: none">gone</p></article>', "x"),
        ("<article><p>before<br>after<br><br>next</p></article>", "before after\nnext"),
        ("<article><p>kept</p></article><p>" + PROSE + "</p>", "kept"),
        ("<article><ul><li class=ad>no<li>yes<li>too</ul></article>", "yes\ntoo"),
        ("<article><p>a<!--> b<!---> c<!-- never ends <p>d", "a b c"),
        ("<article><p>a<p class='x", "a"),
        ("<article><p>a<script>never ends <p>b", "a"),
        ("<body class='has-sidebar'><div class='no-comments'><p>" + PROSE + "</p></div>", PROSE.strip()),
        ("<article><p>x</p><ol class='commentlist'><li>" + PROSE + "</ol><div id='AdSlot3'>buy</div><div class='commentary'>y</div></article>", "x\ny"),
        ("<div class='page-header'><p>Site</p></div><div id=content><p>Short.</p><p>" + PROSE + "</p><p>End.</p></div><div class=sidebar>" + PROSE + "</div>", "Short.\n" + PROSE.strip() + "\nEnd."),
        ("<header><p>Site name</p></header><nav>a</nav><h1>Title</h1><p>" + PROSE + "</p><section class='reader-comments'><p>" + PROSE + "</p></section>", "Title\n" + PROSE.strip()),
    ],
)
def test_pages(page, text):
    assert main_text(page) == text


def test_two_passes_without_an_article():
    """Density and links decide long blocks; short ones take the label of their nearest decided neighbours."""
    menu = "<div><a href=a>One</a> <a href=b>Two</a></div>"
    junk = "<p>" + "zzx qqv kkw " * 12 + "</p>"
    page = f"{menu}<p>Short one.</p>{menu}<h2>Heading</h2><p>{PROSE}</p><p>Short two.</p><p>{PROSE}</p>{junk}<p>Short three.</p>{menu}<p>&copy; 2001 us</p>"
    blocks = label(scan(page))
    assert [b.label for b in blocks] == ["bad", "bad", "bad", "good", "good", "good", "good", "bad", "bad", "bad", "bad"]
    assert main_text(page) == "\n".join(["Heading", PROSE.strip(), "Short two.", PROSE.strip()])


def _plain(page: str) -> str:
    """The article of the simple pages of the tables, cut by patterns."""
    body = page[page.find("<article>") + 9 : page.find("</article>")]
    parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>", body)]
    return "\n".join(x for x in parts if x)


def test_whole_table(spark):
    """The query equals plain cutting on every page."""
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = op11_two_pass_main_text(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, _plain(pages[r.page_id].html), len(r.text))


def test_pages_without_article_marks(spark):
    """The same pages with the article's tag taken away: whatever comes out is text of the article, and most of it comes out."""
    got = want = both = 0
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        whole = _plain(r.html).split("\n")
        found = main_text(re.sub("<(/?)(article|nav|footer)>", r"<\1div>", r.html)).split("\n")
        got, want, both = got + len(found), want + len(whole), both + sum(min(found.count(x), whole.count(x)) for x in set(whole))
    assert both >= 0.98 * got and both >= 0.85 * want


def test_linear_time():
    """Unclosed tags, quotes, comments and long texts in time that grows with the page."""
    for page in ("<b>" * 200_000 + "</i>" * 200_000, "<a =\"" * 200_000, "<!-" * 300_000, "<p><b>" * 100_000, "<table>" + "<b>" * 50_000 + "<div></div>" * 50_000, "<li>x" * 100_000, "<article><p>" + "word " * 500_000):
        began = time.time()
        main_text(page)
        assert time.time() - began < 12


def test_odd_tables(spark):
    """Nulls in any column, repeated rows, clashing extra columns, an empty table."""
    schema = "page_id long, url string, html string, text string, n_chars string"
    rows = [(1, "u", "<p>a b</p>", "other", "x"), (1, "u", "<p>a b</p>", "other", "x"), (None, None, None, None, None), (2, None, "", "t", "n")]
    got = sorted(map(tuple, htmltext.extract(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(1, "u", "a b", 3), (1, "u", "a b", 3), (None, None, "", 0), (2, None, "", 0)], key=str)
    assert htmltext.extract(spark.createDataFrame([], schema)).count() == 0
