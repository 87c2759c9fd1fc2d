import html as entities
import re

from pyspark.sql import functions as F

from tarmac.llm import html_extract as H

SHELL = '<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- ad --><div class="ad">Buy {0}</div>{1}<footer>&copy; host {0}</footer></body></html>'


def test_main_text():
    page = SHELL.format(1, "<article><h1>Head &amp; more</h1><p><b>Bold<br><p>One\n two&nbsp;three &lt;b&gt;</p><p></p><ul><li>a<li>b</ul><div class='comments'><p>nice!</p></div><form><p>name</p></form><aside>x</aside></article>")
    assert H.main_text(page) == "Head & more\nBold\nOne two three <b>\na\nb"
    for blank in (None, "", "   ", "<p", "<!-- x", "<script>", "<nav><p>only menu</p></nav>"):
        assert H.main_text(blank) == "", blank


def test_page_without_article():
    page = "<html><body><div id='menu'>home</div><div class='body'><p>first long paragraph of text</p><p>second one</p></div><div class='side'><p>other</p></div></body></html>"
    assert H.main_text(page) == "first long paragraph of text\nsecond one"


def test_template_text_is_left_out(spark):
    widget = "<div><span>Read this on our app</span><span>Tap here</span><span>Now</span></div>"
    pages = [(i, f"http://h.example/{i}", SHELL.format(i, f"<article><h1>Title {i}</h1>{widget}<p>Body {i} words</p></article>")) for i in range(12)]
    pages += [(100, None, None), (101, "bad url", ""), (0, "http://h.example/0", pages[0][2]), (None, "http://x.example", "<article>z</article>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = H.extract(df).collect()
    assert len(got) == len(pages)
    text = {r.page_id: r.text for r in got}
    assert [text[i] for i in range(12)] == [f"Title {i}\nBody {i} words" for i in range(12)] and text[100] == text[101] == "" and text[None] == "z"
    assert all(r.n_chars == len(r.text) for r in got) and H.extract(df.where("false")).count() == 0


def test_copies_of_a_page_keep_their_text(spark):
    copy = SHELL.format(1, "<article><h1>Same</h1><p>Same body</p></article>")
    df = spark.createDataFrame([(i, f"http://h.example/{i}", copy) for i in range(30)], "page_id long, url string, html string")
    assert {r.text for r in H.extract(df).collect()} == {"Same\nSame body"}


def plain(page):
    """A reading of the driver's pages by their one layout: headline and paragraphs of the article."""
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:h1|p|br)[^>]*>", body)
    texts = [re.sub(r"\s+", " ", entities.unescape(re.sub(r"</?b>", "", b))).strip() for b in blocks]
    return "\n".join(t for t in texts if t)


def test_driver_pages(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in H.op8_html_extraction(spark, sf).collect():
        assert r.text == plain(pages[r.page_id])


def test_page_without_article_keeps_all_slots():
    """Titles above the body, sibling containers, and paragraphs that begin with an inline element."""
    assert H.main_text("<body><div class=post><h1>Title</h1><div class=body><p>long text of the body</p></div></div></body>") == "Title\nlong text of the body"
    assert H.main_text("<body><section class=s1><p>one</p></section><section class=s2><p>two, longer</p></section></body>") == "one\ntwo, longer"
    assert H.main_text("<body><div><p><b>a</b> first</p><p><b>b</b> second</p><p>plain</p></div></body>") == "a first\nb second\nplain"


def test_prose_repeated_over_a_host_without_article(spark):
    pages = [(i, f"http://h.example/{i}", f"<body><div class=x><p>Install our app</p><p>Now in stores</p><p>And more</p></div><div class=y><p>Own text {i}</p></div></body>") for i in range(6)]
    got = H.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: f"Own text {i}" for i in range(6)}


def test_names_dont_shut_what_holds_the_main_text():
    assert H.main_text("<html><body class='page has-sidebar sidebar'><article><p>text</p></article></body></html>") == "text"
    assert H.main_text("<body><div class='sidebar'><main><p>text</p></main></div></body>") == "text"
    assert H.main_text("<article><div class='post-header'><h1>Head</h1></div><h2 id='side-effects'>Effects</h2><section id='recommendations'><p>rest</p></section></article>") == "Head\nEffects\nrest"
    assert H.main_text("<body><article><p>text</p></article><div class='related'><article><p>teaser</p></article></div></body>") == "text"
    named = "<article><div class='notice'><p>kept</p></div></article>"
    assert H.main_text(named) == "" and H.main_text(named, {1: H.TEXT}) == "kept"


def tagless(i, comments, related=3):
    """A page of a site whose tags and names say nothing: menu, teasers and comments are plain divs."""
    menu = "".join(f"<div class=m{j}><span>Menu {j}</span></div>" for j in range(5))
    links = "".join(f"<div class=r><i class=rt>Teaser {i * 7 + j}</i><div class=rx>Read what else {i} {j}</div></div>" for j in range(related + i % 2))
    body = "".join(f"<p>Paragraph {j} of page {i} with a good many words that stand nowhere else {i * j}.</p>" for j in range(4 + i % 3))
    said = "".join(f"<div class=k><span class=w>Reader {i}{j}</span><div class=s>I think that {i} and {j} are right.</div></div>" for j in range(comments))
    return f"<html><body><div class=a1>{menu}</div><div class=b2><div class=c3><div class=h>Headline {i}</div>{body}</div><div class=d4>{said}</div></div><div class=e5>{links}</div><div class=f6>Imprint of all</div></body></html>"


def article(i):
    return "\n".join([f"Headline {i}", *(f"Paragraph {j} of page {i} with a good many words that stand nowhere else {i * j}." for j in range(4 + i % 3))])


def test_pages_without_semantic_tags_or_names(spark):
    """The classes alone find the article: menu, teasers, comments and imprint go. Without them they would stay."""
    pages = [(i, f"http://plain.example/{i}", tagless(i, 2 + i % 4)) for i in range(12)]
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {i: article(i) for i in range(12)}
    assert all(x in H.main_text(pages[0][2]) for x in ("Menu 1", "Teaser", "Reader", "Imprint"))


def test_templates_are_ordered_and_nested(spark):
    """Tokens of equal counts in changing order form no class; records are marked, the frame and its texts as well."""
    pages = [(i, f"http://t.example/{i}", tagless(i, 2 + i % 4)) for i in range(8)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    part = {t["token"]: t["part"] for t in H.host_templates(df).first().template}
    open_ = lambda path: part.get(H.token_hash("open", path))
    assert open_("html/body/div.b2/div.c3") == H.FRAME and open_("html/body/div.b2/div.d4/div.k") == open_("html/body/div.e5/div.r") == H.RECORD
    assert part[H.token_hash("text", "html/body/div.f6", "Imprint of all")] == H.TEXT and open_("html/body/div.b2/div.c3/p") is None
    swapped = [(i, f"http://s.example/{i}", "<div class=x>" + "".join(sorted(["<u>a</u>", "<q>b</q>", "<s>c</s>"], reverse=i % 2 == 0)) + "</div>") for i in range(8)]
    swapped = [(i, u, h + f"<p>{i}</p>") for i, u, h in swapped]
    assert H.host_templates(spark.createDataFrame(swapped, "page_id long, url string, html string")).count() == 0


def test_repeated_divs_that_are_all_the_text_stay(spark):
    pages = [(i, f"http://d.example/{i}", "<body><div class=z>" + "".join(f"<div class=x><em class=y>Word {i} {j}</em></div>" for j in range(3 + i % 2)) + "</div></body>") for i in range(6)]
    got = H.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: "\n".join(f"Word {i} {j}" for j in range(3 + i % 2)) for i in range(6)}


def test_many_templates_meet_pages_by_host(spark, monkeypatch):
    pages = [(i, f"http://plain{i % 2}.example/{i}", tagless(i, 2 + i % 4)) for i in range(16)]
    monkeypatch.setattr(H, "BROADCAST_BYTES", 0)
    got = H.extract(spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("template", F.lit("mine"))).collect()
    assert {r.page_id: r.text for r in got} == {i: article(i) for i in range(16)}
