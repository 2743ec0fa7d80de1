"""Main text of web pages by tree scoring.

Paragraphs pass points for their length and commas to their ancestors, each level up a smaller part;
a container's points are discounted by its link density. The best container and those of its
siblings that read like it are kept.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import ship

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td "
    "tfoot th thead tr ul".split()
)
PARAGRAPH = frozenset("p pre blockquote td dd li div section article main h2 h3 h4".split())
#: A start tag of the first closes an open one of the second, up to the nearest of the third.
CLOSES = {
    **{t: (frozenset({"p"}), frozenset("article body div li main section td th".split())) for t in BLOCK - {"br", "body", "html"}},
    "li": (frozenset({"li", "p"}), frozenset({"ul", "ol", "menu"})),
    "dt": (frozenset({"dt", "dd", "p"}), frozenset({"dl"})), "dd": (frozenset({"dt", "dd", "p"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th", "p"}), frozenset({"table"})),
    "td": (frozenset({"td", "th", "p"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th", "p"}), frozenset({"tr", "table"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
}
DROPPED = frozenset("nav aside footer form button select option input label fieldset svg canvas object embed audio video dialog menu head".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
#: Words of a class or id by which an element may be no part of the article.
NOISE = frozenset(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner popup modal "
    "overlay cookie cookies consent gdpr notice notices alert warning disclaimer newsletter subscribe subscription signup "
    "login share sharing social follow related recommended recommendations trending popular more breadcrumb breadcrumbs "
    "menu nav navbar navigation sidebar side aside widget widgets footer foot header masthead topbar toolbar "
    "pager pagination paging tags toc skip".split()
)
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies discussion reviews".split())
#: A name with one of these says what an element has or lacks, not what it is.
ABOUT = frozenset("with without no not has have is hide hides show shows target toggle".split())
#: Of a name with one of these, a header is the article's own.
CONTENT = frozenset("article entry post story content main body text".split())
#: How sure a name is, and the share of the page's words beyond links from which on its element is kept all the same.
KEPT_FROM = {1: 0.5, 2: 0.9}
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>")
ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
#: How a sentence ends: an empty text ends so, too, and adds nothing.
ENDS = (*".!?:;…。！？\"'”’»)", "")
PARTS = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z0-9]+")


class Node:
    __slots__ = ("tag", "parent", "items", "suspect", "noise", "score", "chars", "linked")

    def __init__(self, tag: str, parent: Node | None, suspect: int = 0) -> None:
        self.tag, self.parent, self.items, self.suspect, self.noise = tag, parent, [], suspect, suspect == 3
        self.score, self.chars, self.linked = 0.0, 0, 0


class Open:
    """The elements open at a place of the page, from the root down, and where those of each tag are."""

    def __init__(self, root: Node) -> None:
        self.line = [root]
        self.places: dict[str, list[int]] = {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.line))
        self.line.append(node)

    def cut(self, depth: int) -> None:
        """Closes all from ``depth`` on."""
        while len(self.line) > depth:
            self.places[self.line.pop().tag].pop()

    def deepest(self, tag: str) -> int:
        """Depth of the last open element of a tag; 0: none."""
        found = self.places.get(tag)
        return found[-1] if found else 0

    def first_below(self, tags: frozenset[str], limits: frozenset[str]) -> int:
        """Depth of the first open element of ``tags`` below the last one of ``limits``; 0: none."""
        limit = max(map(self.deepest, limits))
        best = 0
        for tag in tags:
            found = self.places.get(tag)
            if found and found[-1] > limit:
                at = found[bisect_right(found, limit)]
                best = min(best or at, at)
        return best


def suspicion(tag: str, rest: str, above: Open) -> int:
    """0: nothing speaks against an element. 1: a part of a name, 2: a whole name or one of comments, 3: its tag, its
    role, or that it is hidden."""
    if tag in DROPPED:
        return 3
    inside = bool(above.deepest("article") or above.deepest("main"))
    if tag == "header":  # of the page, not of the article
        return 0 if inside else 3
    if not rest or "=" not in rest and "hidden" not in rest or tag in ("html", "body", "article", "main"):
        return 3 if tag == "article" and "comment" in rest.lower() else 0
    most = 0
    for m in ATTR.finditer(rest):
        name = m[1].lower()
        value = m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            for said in value.split():
                parts = [x.lower() for x in PARTS.findall(said)]
                if not ABOUT.isdisjoint(parts):
                    continue
                if not COMMENTS.isdisjoint(parts):
                    most = 2
                elif not NOISE.isdisjoint(parts) and not ("header" in parts and (inside or not CONTENT.isdisjoint(parts))):
                    most = max(most, 2 if len(parts) == 1 else 1)
        elif name == "role":
            if value.lower() in ROLES:
                return 3
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return 3
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return 3
    return most


def parse(page: str) -> Node:
    """A forgiving tree of a page: unknown, unclosed and stray tags are taken as browsers mostly do.
    Each tag is looked up among the open ones by its name, so time follows the page's length."""
    root = node = Node("#root", None)
    above = Open(root)
    at, end = 0, len(page)
    while at < end:
        cut = page.find("<", at)
        if cut < 0:
            cut = end
        if cut > at:
            node.items.append(page[at:cut])
        if cut == end:
            break
        at = cut
        if page.startswith("<!--", at):
            stop = page.find("-->", at + 4)
            at = end if stop < 0 else stop + 3
            continue
        following = page[at + 1 : at + 2]
        if following in ("!", "?"):
            stop = page.find(">", at)
            at = end if stop < 0 else stop + 1
            continue
        if not (following.isalpha() or following == "/"):
            node.items.append("<")
            at += 1
            continue
        m = TAG.match(page, at)
        if m is None:
            stop = page.find(">", at)
            at = end if stop < 0 else stop + 1  # a tag cut off by the page's end, or of no known form
            continue
        at = m.end()
        tag, rest = m[2].lower(), m[3]
        if m[1]:
            if depth := above.deepest(tag):
                above.cut(depth)
                node = above.line[-1]
            continue
        if tag in RAW:
            stop = re.compile(f"</{tag}", re.I).search(page, at)
            at = end if stop is None else page.find(">", stop.end()) + 1 or end
            continue
        if tag in CLOSES:
            if depth := above.first_below(*CLOSES[tag]):
                above.cut(depth)
                node = above.line[-1]
        child = Node(tag, node, suspicion(tag, rest, above))
        node.items.append(child)
        if tag not in VOID and not rest.endswith("/"):
            above.push(child)
            node = child
    return root


def in_order(root: Node) -> list[Node]:
    """The nodes in page order, noise and what it holds left out."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(x for x in reversed(node.items) if isinstance(x, Node) and not x.noise)
    return order


def count_text(order: list[Node]) -> None:
    """Fills in chars and linked."""
    for node in order:
        node.chars = node.linked = 0
    for node in reversed(order):
        own = "".join(x for x in node.items if isinstance(x, str))
        direct = len(" ".join(own.split()))
        node.chars += direct
        if node.tag == "a":
            node.linked = node.chars
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.linked += node.linked


def measure(root: Node) -> list[Node]:
    """Fills in chars, linked and score of what is no noise, in page order. A suspect is noise unless it holds so much
    of the page's words beyond links that there is no article without it."""
    order = in_order(root)
    count_text(order)
    words = max(root.chars - root.linked, 1)
    for node in order:
        node.noise = node.suspect > 0 and node.chars - node.linked < KEPT_FROM[node.suspect] * words
    order = in_order(root)
    count_text(order)
    for node in order:
        if node.tag not in PARAGRAPH:
            continue
        own = inline_text(node)
        if len(own) < 25:
            continue
        points = 1 + own.count(",") + own.count("，") + min(len(own) / 100, 3)
        # a paragraph gives to those above it; other blocks with text of their own have it themselves
        up, level = (node.parent, 0) if node.tag in ("p", "pre", "td", "li", "dd", "h2", "h3", "h4") else (node, 0)
        while up is not None and level < 4:
            up.score += points / (1, 2, 6, 9)[level]
            up, level = up.parent, level + 1
    for node in order:
        if node.tag in ("article", "main"):
            node.score += 25
        if node.chars:
            node.score *= 1 - node.linked / node.chars
    return order


def inline_text(node: Node) -> str:
    """The text of a block without that of blocks in it."""
    out, stack = [], list(reversed(node.items))
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif not x.noise and x.tag not in BLOCK:
            stack.extend(reversed(x.items))
        elif x.tag == "br":
            out.append(" ")
    return " ".join("".join(out).split())


def block_texts(node: Node) -> list[str]:
    """Texts of the blocks below a node in page order, references decoded and spaces made one."""
    blocks, run, stack = [], [], [node]
    while stack:
        x = stack.pop()
        if x is None:
            blocks.append("".join(run))
            run = []
        elif isinstance(x, str):
            run.append(html.unescape(x))
        elif not x.noise:
            if x.tag in BLOCK:
                stack.append(None)
                stack.extend(reversed(x.items))
                stack.append(None)
            else:
                stack.extend(reversed(x.items))
    blocks.append("".join(run))
    return [y for y in (" ".join(b.split()) for b in blocks) if y]


def extract(page: str | None) -> tuple[str, str, float]:
    """(text, tag of the best container, its score) of a page; empty for a page without any text."""
    if not page:
        return "", "", 0.0
    order = measure(parse(page))
    holders = [x for x in order if x.tag not in ("#root", "html") and (x.score > 0 or x.tag in ("article", "main"))]
    if not holders:
        holders = [x for x in order if x.tag == "body"] or order[:1]
    best = max(holders, key=lambda x: (x.score, x.chars))
    above = best.parent
    while above is not None:  # of an article that has it, the whole
        if above.tag in ("article", "main"):
            best = above
        above = above.parent
    kept = [best]
    if best.parent is not None and best.tag != "body":
        line = max(10.0, 0.2 * best.score)
        kept = []
        for x in best.parent.items:
            if x is best:
                kept.append(x)
            elif isinstance(x, Node) and not x.noise and x.tag not in ("header",):
                density = x.linked / x.chars if x.chars else 1.0
                like = x.score >= line and (best.tag not in ("article", "main") or x.tag == best.tag)
                said = density < 0.25 if x.chars > 80 else x.linked == 0 and inline_text(x)[-1:] in ENDS
                prose = x.tag == "p" and best.tag not in ("article", "main") and said
                if like or prose:
                    kept.append(x)
    return " ".join(y for x in kept for y in block_texts(x)), best.tag, float(best.score)


def extract_pages(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """One row per page: (id_col, url_col, text, n_chars, container, score), whole pages only.

    A null or empty page, and one of markup alone, has the empty text and n_chars 0. Null ids and
    urls stay null, repeated rows are pages of their own, an empty table gives an empty one, other
    columns are ignored. Tags that never close end with the page. Pages are read one by one, so
    memory follows the longest page; nothing is shuffled.
    """
    ship(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"))

    def run(batches):
        for batch in batches:
            found = [extract(x.as_py()) for x in batch.column(2)]
            yield pa.record_batch(
                [
                    batch.column(0), batch.column(1), pa.array([x[0] for x in found], pa.string()),
                    pa.array([len(x[0]) for x in found], pa.int64()), pa.array([x[1] for x in found], pa.string()),
                    pa.array([x[2] for x in found], pa.float64()),
                ],
                names=["_id", "_url", "text", "n_chars", "container", "score"],
            )

    kinds = [x.dataType.simpleString() for x in rows.schema]
    out = rows.mapInArrow(run, f"_id {kinds[0]}, _url {kinds[1]}, text string, n_chars long, container string, score double")
    return out.withColumnsRenamed({"_id": id_col, "_url": url_col})
