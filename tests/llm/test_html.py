"""HTML extraction against what an independent parser finds in the articles, and on odd markup."""

import random
from html.parser import HTMLParser

import pyarrow.parquet as pq
import pytest

from deltaloom.llm import html_crf as H
from deltaloom.llm.html_pages import NAMES

PAGES = "/root/testdata/sf0.01/pages.parquet"
BLOCK = {"p", "h1", "h2", "h3", "li", "ul", "div", "article", "td", "tr", "table", "blockquote", "pre", "body", "html", "nav", "footer"}


class Article(HTMLParser):
    """Blocks inside of <article>, cut at every block tag."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks, self.now = 0, [], []

    def cut(self):
        text = " ".join("".join(self.now).split())
        if text:
            self.blocks.append(text)
        self.now = []

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.inside += 1
        elif tag == "br":
            self.now.append(" ")
        if tag in BLOCK:
            self.cut()

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.cut()
        if tag == "article":
            self.inside -= 1

    def handle_data(self, data):
        if self.inside:
            self.now.append(data)


def by_parser(page: str) -> str:
    p = Article()
    p.feed(page)
    p.close()
    p.cut()
    return "\n\n".join(p.blocks)


def test_whole_table_of_pages(spark):
    want = {r["page_id"]: by_parser(r["html"]) for r in pq.read_table(PAGES).to_pylist()}
    got = {r["page_id"]: r for r in H.extract(spark.read.parquet(PAGES)).collect()}
    assert got.keys() == want.keys()
    assert {i for i in want if got[i]["text"] != want[i]} == set()
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def extract(*pages: str) -> list[str]:
    model = H.default_model()
    parsed = [model.blocks(p) for p in pages]
    keep, out, at = model.main_blocks(parsed), [], 0
    for blocks in parsed:
        out.append("\n\n".join(b.text for b, k in zip(blocks, keep[at : at + len(blocks)], strict=True) if k))
        at += len(blocks)
    return out


BODY = "<p>Long enough to be an article, this paragraph says a thing or two about rivers, boats and the weather of last year.</p>"


@pytest.mark.parametrize(
    "around",
    [
        "<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li></ul></nav>{}",
        "{}<footer>© 2024 Somebody. All rights reserved.</footer>",
        "<div class='cookie-notice'>We use cookies. <button>Accept</button></div>{}",
        "{}<div class='comments'><h3>2 comments</h3><p>Nice read, thanks.</p><p>I do not agree.</p></div>",
        "<header class='site-header'><a href='/'>The Daily</a></header>{}<aside class='sidebar'><h3>Popular</h3><ul><li><a href='/x'>One</a></li></ul></aside>",
        "{}<form><label>Name</label><input><textarea>text</textarea><button>Send</button></form>",
        "<div class='ad'>Buy now and save</div>{}<script>var a = '<p>no</p>';</script><style>p{{}}</style><noscript>on</noscript>",
    ],
)
def test_boilerplate_is_left_out(around):
    page = "<html><body>" + around.format(f"<article><h1>A title</h1>{BODY * 3}</article>") + "</body></html>"
    text = " ".join(BODY[3:-4].split())
    assert extract(page) == ["\n\n".join(["A title", text, text, text])]


def test_references_white_space_and_breaks():
    [text] = extract("<article><h1>Fish &amp; chips</h1><p>caf&eacute; &#8212;  a\n\t b<br>c &lt;i&gt; " + "x " * 40 + "</p>" + BODY + "</article>")
    assert text.startswith("Fish & chips\n\ncafé — a b c <i> x x")


def test_odd_markup_does_not_raise(spark):
    odd = ["", None, "<", "<p", "<!--", "<script>", "plain text only", "</p></div>", "<p>" * 3000, "<div " + "a" * 100_000, "&" * 1000, "<p title='>' \"x>y</p>", "\x00<p>퟿</p>", "<li>a<li>b<td>c<tr>d", "<a" * 2000]
    pages = spark.createDataFrame([(i, "u", h, "clash") for i, h in enumerate(odd)], "page_id bigint, url string, html string, text string")
    got = H.extract(pages).orderBy("page_id").collect()
    assert len(got) == len(odd) and got[0]["text"] == got[1]["text"] == "" and all(r["n_chars"] == len(r["text"]) for r in got)
    assert H.extract(pages.limit(0)).count() == 0


def test_very_long_page():
    page = "<article>" + "<p>word one two three four five six seven eight.</p>" * 20_000 + "</article>"
    assert extract(page)[0].count("\n\n") == 19_999


def all_text(page: str) -> list[str]:
    return [b.text for b in H.blocks_of(page)]


def test_depth_has_no_cap():
    for depth in (10, 300, 1000, 20_000):
        page = f"<nav><a href='/'>Home</a></nav><article><h1>A title</h1>{'<div>' * depth}{BODY}{'</div>' * depth}{BODY * 2}</article><footer>All rights reserved.</footer>"
        text = BODY[3:-4]
        assert extract(page) == ["\n\n".join(["A title", text, text, text])]
    many = "".join(f"<div class='n{i}'>word {i} " for i in range(20_000)) + "</section>" * 20_000
    blocks = H.default_model().blocks("<article>" + many + "</article>")
    assert len(blocks) == 20_000 and "under=article" in blocks[-1].path


def test_every_feature_counts():
    names = " ".join(n for kind in ("main", "menu", "side", "ad", "footer", "comments") for n in NAMES[kind])
    m = H.default_model()
    [rows] = m.rows([m.blocks(f"<div class='{names}'><section id='x'><p>Some text.</p></section></div>")])
    assert (rows > 0).sum() > 40


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p>Energy is <math><mi>E</mi></math> as known</p>", ["Energy is E as known"]),
        ("<p>a <svg><text>b</text></svg> <object>c</object><noscript>d</noscript></p>", ["a b c"]),
        ("<p>code: <xmp><b>x</b> &amp;</xmp> end</p>", ["code: <b>x</b> &amp; end"]),
        ('<p title="abc>First text</p><p>Second</p>', ["First text", "Second"]),
        ("<p>It's <b title='x>bold</b> here</p>", ["It's bold here"]),
        ('<p title="a > b">Text</p>', ["Text"]),
        ("<p>one <i>two</i><template>no</template><iframe>no</iframe></p>", ["one two"]),
        ("<p>a < b and c > d</p>", ["a < b and c > d"]),
    ],
)
def test_text_and_markup(page, text):
    assert all_text(page) == text


@pytest.mark.parametrize("seed", range(30))
def test_blocks_of_broken_markup_are_those_of_a_parser(seed):
    r = random.Random(seed)
    tags = ["p", "div", "li", "ul", "b", "i", "span", "h2", "td", "tr", "table", "blockquote", "br"]
    parts = []
    for _ in range(200):
        parts.append(r.choice([f"<{r.choice(tags)}>", f"</{r.choice(tags)}>", f"<{r.choice(tags)} class='a b' title=\"x > y\">", "word ", "two words ", "caf&eacute; ", "\n", "<!-- no -->"]))
    page = "".join(parts).replace("</br>", "")
    assert "\n\n".join(all_text(page)) == by_parser(f"<article>{page}")
