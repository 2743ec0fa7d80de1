import html
import re
import time

import numpy as np

from quillspark.llm import html_extract, queries
from quillspark.llm.html_extract import BLOCK, CLOSES, RAW, VOID

SF = "/root/testdata/sf0.001"


def plain_tree(page):
    """(tag, children...) of tags and texts, by climbing over all open elements for each tag."""
    root = ["#root"]
    open_ = [root]
    for m in re.finditer(r"<(/?)([a-z0-9]+)>|([^<]+)", page):
        if m[3]:
            open_[-1].append(m[3])
            continue
        tags = [x[0] for x in open_]
        if m[1]:
            if m[2] in tags[1:]:
                del open_[len(tags) - 1 - tags[::-1].index(m[2]) :]
            continue
        closed, limit = CLOSES.get(m[2], ((), ()))
        last = None
        for at in range(len(open_) - 1, 0, -1):
            if tags[at] in limit:
                break
            if tags[at] in closed:
                last = at
        if last:
            del open_[last:]
        node = [m[2]]
        open_[-1].append(node)
        if m[2] not in VOID:
            open_.append(node)
    return root


def tree(node):
    return [node.tag, *[x if isinstance(x, str) else tree(x) for x in node.items]]


def test_trees_of_random_tags_are_those_of_the_plain_version():
    rng = np.random.default_rng(31)
    tags = sorted((BLOCK | VOID | {"b", "i", "span", "a", "option", "select", "unknown"}) - RAW)
    for _ in range(1500):
        few = [tags[i] for i in rng.integers(0, len(tags), 6)] + ["p", "li", "ul", "td", "tr", "table", "div"]
        page = "".join(["<{}>", "</{}>", "text"][rng.integers(0, 3)].format(few[rng.integers(0, len(few))]) for _ in range(rng.integers(1, 60)))
        assert tree(html_extract.parse(page)) == plain_tree(page), page


def test_time_follows_the_length_of_deep_and_broken_pages():
    for unit, rest in (("<b>", "</i>"), ("<span>", "<p>x"), ("<div><header>", "</main>"), ("<ul><li>", "<li>y"), ("<a \">", "<b '"), ("<table><tr>", "<td>z"), ("<!--", "x"), ("<", "a"), ("&amp;", "<br>")):
        page = unit * 60_000 + rest * 60_000
        began = time.process_time()
        html_extract.extract(page)
        assert time.process_time() - began < 8, unit


def plain_article(page):
    """The article's blocks, of the one form that the table's pages have."""
    inside = re.search(r"(?s)<article>(.*?)(?:</article>|<footer>|\Z)", page or "")
    blocks = re.split(r"</?(?:p|h1|div|article|ul|li|br)(?:\s[^>]*)?/?>", re.sub(r"(?s)<!--.*?-->", "", inside[1])) if inside else []
    said = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks]
    return " ".join(b for b in said if b)


def test_query_gives_the_articles_of_the_table(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r["page_id"]: r for r in queries.op3_html_main_text(spark, SF).collect()}
    assert {i: (r["url"], r["text"], r["n_chars"]) for i, r in got.items()} == {
        i: (p["url"], plain_article(p["html"]), len(plain_article(p["html"]))) for i, p in pages.items()
    }


def test_empty_tables_long_pages_and_clashing_columns(spark):
    schema = "page_id long, url string, html string, text string, n_chars string, _id string, score string"
    long = "<html><body><article>" + "".join(f"<p>Paragraph {i}, with words, and commas.</p>" for i in range(40_000)) + "</article>"
    rows = [(1, "u", long, "t", "n", "i", "s"), (None, None, None, None, None, None, None), (1, "u", long, "t", "n", "i", "s")]
    frame = spark.createDataFrame(rows, schema)
    got = html_extract.extract_pages(frame).collect()
    assert [r["n_chars"] for r in got] == [len(plain_article(long)), 0, len(plain_article(long))] and got[0]["text"] == plain_article(long)
    assert html_extract.extract_pages(frame.limit(0)).count() == 0


def paragraphs(n, word="words"):
    return "".join(f"<p>Paragraph {i} of the article, with {word} enough, and commas, to be read as prose by all.</p>" for i in range(n))


def test_names_that_hold_the_article_are_no_noise():
    article = html_extract.extract(f"<body><div>{paragraphs(8)}</div></body>")[0]
    assert article.count("Paragraph") == 8
    menu = "<nav><a href=x>Home</a></nav><div class='sidebar'><p>Short advice, beside.</p></div>"
    for names in ("content with-sidebar", "post no-sidebar", "entry-content has-share", "post-with-comments", "read-more-target", "story notice-board", "article-body", "pageWithSidebar", "notice"):
        page = f"<html><body>{menu}<div class=\"{names}\">{paragraphs(8)}</div><div class='site-footer'>All rights</div></body></html>"
        assert html_extract.extract(page)[0] == article, names
    page = f"<body>{menu}<div class='content-area has-sidebar'><article>{paragraphs(8)}</article></div></body>"
    assert html_extract.extract(page)[0] == article


def test_an_articles_own_header_and_short_paragraphs_stay():
    page = f"<body><article><div class='entry-header'><h1>The title</h1></div>{paragraphs(4)}<div class='share-buttons'>Share this</div></article></body>"
    got = html_extract.extract(page)[0]
    assert got.startswith("The title Paragraph 0") and "Share" not in got
    page = f"<body><div id=main><p>A short one.</p><div>{paragraphs(6)}</div><p><a href=x>Next page</a></p></div></body>"
    got = html_extract.extract(page)[0]
    assert got.startswith("A short one. Paragraph 0") and "Next page" not in got


def test_noise_goes_also_where_it_is_long():
    for names in ("comments", "comment-list", "post-comments", "id-disqus"):
        page = f"<body><div class='post'>{paragraphs(5)}</div><div class='{names}'>{paragraphs(9, 'opinions')}</div></body>"
        got = html_extract.extract(page)[0]
        assert "opinions" not in got and got.count("Paragraph") == 5, names
    for names in ("sidebar", "related-posts", "newsletter-signup", "cookieBanner", "ad-slot", "site-header"):
        page = f"<body><div class='post'>{paragraphs(5)}</div><div class='{names}'>{paragraphs(2, 'noise')}</div></body>"
        assert "noise" not in html_extract.extract(page)[0], names


def test_tags_without_an_end_take_a_time_that_follows_the_page():
    for unit in ("<script", "<a", "<div x=", "<p/"):
        page = "<p>text, and more of it, to be kept.</p>" + unit * (1_000_000 // len(unit))
        began = time.process_time()
        html_extract.extract(page)
        assert time.process_time() - began < 8, unit
