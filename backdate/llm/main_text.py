"""Main text of web pages by host consensus on where it lies.

Each page is read once into its containers: the text of all paragraphs below
them, less what is linked, scores them, and the best names the path of tags and
classes (digits taken out) that leads to it. Spark adds up the pages' votes per
host. Every page is then read again and gives the text under the host's winning
path, or, where it has no such container, under its own best one.

Left out wherever they stand: menus, the site's header, footers, sidebars,
scripts, styles, comments, hidden parts, and blocks whose class or id names an
advert, a notice, a menu or reader comments (with the heading above them). Forms
and blocks whose name only suggests such a thing stay where most of the page's
text is in them. A header inside a container belongs to it.

Defined results: NULL or empty html has an empty text; a page without a
paragraph has the text of its body; a page without host votes with others
without host; repeated rows each vote. Unclosed tags end with their parent.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from backdate.llm.common import stored

# HTML's own lists of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title template noscript iframe noembed noframes xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr main menu nav ol p pre section table ul".split()
)
LEFT_OUT = frozenset("nav aside footer script style noscript template iframe button select svg head menu dialog".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Parts of a class or id that name something else than the article ...
NAMES = re.compile(
    r"ads?|advert\w*|sponsor\w*|cookies?|consent|popup|modal|newsletter|subscribe|nav\w*|menu|breadcrumbs?|sidebar|footer|"
    r"comments?|commentlist|respond|replies|disqus|share|sharing|related|recommend\w*|login|signup|pagination|pager|masthead|toolbar"
)
# ... or often do; so do the names above next to words that are not of the following list.
PERHAPS = re.compile(r"promo\w*|banner|notice|alert|side|foot|social|widget|skip")
BESIDE = frozenset(
    "site main page top bottom left right primary secondary global box bar list area section block wrapper wrap container inner "
    "outer form links link buttons icons posts items unit slot message text body thread holder".split()
)
# A class that begins so tells what stands elsewhere, or does not.
ABOUT_OTHERS = frozenset("has have no not with without is hide show js".split())
COMMENTS = re.compile(r"comments?|commentlist|respond|replies|disqus")
ABOUT_COMMENTS = re.compile(r"\b(?:comments?|repl(?:y|ies)|responses?|discussion)\b", re.I)
BREAKS = re.compile(r"[-_]+")
NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
TAG_STEP = re.compile(r">|=\s*([\"'])")
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
HIDING = re.compile(r"display\s*:\s*none", re.I)
DIGITS = re.compile(r"\d+")
KEPT, WEAK, STRONG, ALWAYS = range(4)
# The share of a page's unlinked text that a container must hold to stand for all of it.
MOST = 0.75

TEXT_BLOCKS = frozenset("p pre blockquote h1 h2 h3 h4 h5 h6 li td dd dt figcaption".split())
WRAPS = frozenset("div section article main body form td".split())


class Node:
    __slots__ = ("tag", "step", "parent", "mark", "of_comments", "out", "block", "parts", "letters", "total", "holds")

    def __init__(self, tag: str, step: str, parent: Node | None, mark: int = KEPT, of_comments: bool = False):
        self.tag, self.step, self.parent, self.mark, self.of_comments = tag, step, parent, mark, of_comments
        self.out = False
        self.block = parent.block if tag in INLINE and parent is not None else self  # the nearest that is not inline
        self.parts: list = []  # strings and nodes
        self.letters = self.total = 0  # unlinked text of its own block, and of all blocks below and at it
        self.holds = KEPT  # ALWAYS with a main element below it, STRONG with an article

    @property
    def path(self) -> str:
        steps, at = [], self
        while at is not None:
            steps.append(at.step)
            at = at.parent
        return "".join(reversed(steps))


def _named(mark: str) -> tuple[int, bool]:
    """How surely a class or id names something else than the article, and whether reader comments."""
    level, comments = KEPT, False
    for token in mark.lower().split():
        parts = [x for x in BREAKS.split(token) if x and not x.isdigit()]
        if not parts or parts[0] in ABOUT_OTHERS:
            continue
        sure = [bool(NAMES.fullmatch(x)) for x in parts]
        perhaps = [bool(PERHAPS.fullmatch(x)) for x in parts]
        if any(sure) and all(a or b or x in BESIDE for a, b, x in zip(sure, perhaps, parts, strict=True)):
            level = STRONG
            comments |= any(COMMENTS.fullmatch(x) for x in parts)
        elif any(sure) or any(perhaps):
            level = max(level, WEAK)
    return level, comments


class Tags:
    """The tags of a page in order, found in one pass forward whatever is left open.

    A quote opens only after ``=``. Where one is never closed, a tag ends at its
    first ``>``, and so do all tags after one that would reach the page's end.
    """

    def __init__(self, page: str):
        self.page, self.quotes = page, True
        self.last = {c: page.rfind(c) for c in ">\"'"}

    def end(self, place: int) -> int:
        """The place of the ``>`` that closes a tag whose name ends at ``place``; -1 for none."""
        first = self.page.find(">", place) if place <= self.last[">"] else -1
        if first < 0 or not self.quotes:
            return first
        while m := TAG_STEP.search(self.page, place):
            if m[1] is None:
                return m.start()
            if m.end() > self.last[m[1]]:
                if m.end() <= self.last[">"]:
                    return self.page.find(">", m.end())
                break
            place = self.page.find(m[1], m.end()) + 1
        self.quotes = False
        return first

    def next(self, place: int) -> tuple[int, int, str, str | None, bool] | None:
        """Start and end of the next tag, its name, its attributes (None for a comment and the like), and whether it closes."""
        while (start := self.page.find("<", place)) >= 0:
            if self.page.startswith("<!--", start):
                close = self.page.find("-->", start + 2)
                return start, len(self.page) if close < 0 else close + 3, "", None, False
            if self.page[start + 1 : start + 2] in ("!", "?"):
                close = self.page.find(">", start)
                return start, len(self.page) if close < 0 else close + 1, "", None, False
            if m := NAME.match(self.page, start):
                close = self.end(m.end())
                if close < 0:
                    return None
                return start, close + 1, m[1].lower(), self.page[m.end() : close], self.page[start + 1] == "/"
            place = start + 1
        return None


def _look(tag: str, attributes: str, parent: Node) -> tuple[str, int, bool]:
    """A node's step in paths, how surely it is left out, and whether it holds reader comments."""
    kind, names, mark = "", "", ALWAYS if tag in LEFT_OUT else WEAK if tag == "form" else KEPT
    for a in ATTRIBUTE.finditer(attributes):
        value, name = a[2] or a[3] or a[4] or "", a[1].lower()
        if name == "class":
            kind = ".".join(sorted(set(DIGITS.sub("", value).lower().split())))
            names += " " + value
        elif name == "id":
            names += " " + value
        elif (
            name == "hidden" or name == "style" and HIDING.search(value)
            or name == "role" and value.lower() in ("navigation", "banner", "contentinfo", "complementary", "search")
        ):
            mark = ALWAYS
    if tag == "header" and parent.tag in ("", "html", "body"):
        mark = ALWAYS  # the site's; one inside a container belongs to the article
    comments = False
    if names and tag not in ("html", "body", "article", "main"):
        level, comments = _named(names)
        mark = max(mark, level)
    return f"/{tag}{'.' + kind if kind else ''}", mark, comments


def read(page: str) -> tuple[Node, list[Node]]:
    """The page's root and all its nodes in order, with what is left out marked."""
    root = Node("", "", None)
    nodes, at, place, end = [root], root, 0, len(page)
    opened: dict[str, int] = {}  # tags open at this place
    tags, lower = Tags(page), None

    def up(to: Node) -> Node:
        node = at
        while node is not to:
            opened[node.tag] -= 1
            node = node.parent
        return to

    while found := tags.next(place):
        start, stop, tag, attributes, closes = found
        if start > place:
            at.parts.append(page[place:start])
        place = stop
        if attributes is None:
            continue
        if closes:
            if opened.get(tag):
                node = at
                while node.tag != tag:
                    node = node.parent
                at = up(node.parent)
            continue
        if tag in CLOSES_P or tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            # An open paragraph or list item ends where the next block begins.
            node = at.block
            ends = ("p",) if tag in CLOSES_P else ("td", "th", "p") if tag in ("td", "th") else (tag, "p")
            while node.tag in ends and node.parent is not None:
                node = at = up(node.parent.block)
        step, mark, of_comments = _look(tag, attributes, at)
        node = Node(tag, step, at, mark, of_comments)
        at.parts.append(node)
        nodes.append(node)
        if tag in VOID or attributes.endswith("/") and tag not in INLINE and tag not in CLOSES_P:
            continue
        if tag in RAW:
            lower = lower or page.lower()
            close = lower.find("</" + tag, place)
            close = end if close < 0 else close
            if node.mark != ALWAYS and tag != "title":
                node.parts.append(page[place:close])
            place = lower.find(">", close)
            place = end if place < 0 else place + 1
            continue
        opened[tag] = opened.get(tag, 0) + 1
        at = node
    if place < end and page[place:].strip():
        at.parts.append(page[place:])
    _leave_out(nodes)
    return root, nodes


def _leave_out(nodes: list[Node]) -> None:
    """Mark what is left out, and add up the text of the rest.

    Elements that never hold the article go, and blocks so named, unless they hold
    the page's main element or (comments apart) an article. Forms and blocks that
    are perhaps so named go if they hold under half of the page's unlinked text,
    and only if all of them together leave half of it.
    """
    for node in reversed(nodes[1:]):
        below = max(node.holds, ALWAYS if node.tag == "main" else STRONG if node.tag == "article" else KEPT)
        node.parent.holds = max(node.parent.holds, below)
    previous: dict[int, Node] = {}  # of each node the last child so far that is not inline
    for node in nodes[1:]:
        named = node.mark == STRONG and not (node.holds == ALWAYS or node.holds == STRONG and not node.of_comments)
        node.out = node.parent.out or node.mark == ALWAYS or named
        heading = previous.get(id(node.parent))
        if named and node.of_comments and heading is not None and heading.tag in HEADINGS:
            heading.out |= bool(ABOUT_COMMENTS.search(text_of([heading])))
        if node.tag not in INLINE:
            previous[id(node.parent)] = node
    _add_up(nodes)
    whole = nodes[0].total
    weak = {id(n) for n in nodes if n.mark == WEAK and not n.out and 2 * n.total < whole}
    gone, inside = 0, set()
    for node in nodes[1:]:
        if id(node.parent) in inside or id(node) in weak:
            gone += node.total * (id(node.parent) not in inside)
            inside.add(id(node))
    if weak and 2 * (whole - gone) >= whole:
        for node in nodes[1:]:
            node.out |= id(node) in inside
        _add_up(nodes)


def _add_up(nodes: list[Node]) -> None:
    """Letters of blocks and what they hold below; what lies in a part that is left out is left out."""
    for node in nodes:
        node.out |= node.parent is not None and node.parent.out
        node.letters = 0
        if not node.out and (node.tag in TEXT_BLOCKS or node.tag in WRAPS or node.tag == ""):
            whole, linked = _letters(node)
            if 2 * linked < whole:
                node.letters = whole - linked
        node.total = node.letters
    for node in reversed(nodes[1:]):
        node.parent.total += node.total


def _flow(node: Node, blocks: list[list[str]]) -> None:
    """Add the node's text to the blocks; all but inline elements begin and end one."""
    # Explicit stack: pages may nest deeply.
    stack = [(node, 0)]
    while stack:
        at, i = stack.pop()
        if i == 0 and at.tag not in INLINE:
            blocks.append([])
        while i < len(at.parts):
            part = at.parts[i]
            i += 1
            if isinstance(part, str):
                blocks[-1].append(part)
            elif part.tag == "br":
                blocks[-1].append(" ")
            elif not part.out:
                stack.append((at, i))
                stack.append((part, 0))
                break
        else:
            if at.tag not in INLINE:
                blocks.append([])


def text_of(nodes: list[Node]) -> str:
    blocks: list[list[str]] = [[]]
    for node in nodes:
        _flow(node, blocks)
    lines = (" ".join(entities.unescape("".join(b)).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def _letters(node: Node) -> tuple[int, int]:
    """Letters of a block, and those of them in links."""
    whole = linked = 0
    stack = [(node, False)]
    while stack:
        at, link = stack.pop()
        for part in at.parts:
            if isinstance(part, str):
                n = len(part.strip())
                whole += n
                linked += n * link
            elif not part.out and part.tag in INLINE:
                stack.append((part, link or part.tag == "a"))
    return whole, linked


def best_container(nodes: list[Node]) -> tuple[Node, int] | None:
    """The container of the page's article, and its unlinked letters; None if the page has no container with text.

    The article, else the main element, that holds half of the page's unlinked
    text; otherwise the innermost container that holds most of it, so that an
    article in several parts is found by what contains them all.
    """
    root = nodes[0]
    for tag in ("article", "main"):
        held = max((n for n in nodes if n.tag == tag and not n.out), key=lambda n: n.total, default=None)
        if held is not None and held.total and 2 * held.total >= root.total:
            return held, held.total
    best, at = None, root
    while at is not None:
        if at.tag in WRAPS and at.total:
            best = at
        inner = (x for x in at.parts if isinstance(x, Node) and not x.out)
        at = max(inner, key=lambda n: n.total, default=None)
        if at is None or not at.total or at.total < MOST * root.total:
            break
    return (best, best.total) if best is not None else None


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths, scores = [], []
        for page in batch.column("html").to_pylist():
            found = best_container(read(page or "")[1])
            paths.append(found[0].path if found else None)
            scores.append(found[1] if found else 0)
        yield pa.RecordBatch.from_arrays(
            [batch.column("host"), pa.array(paths, pa.string()), pa.array(scores, pa.int64())], ["host", "path", "score"]
        )


def _under(nodes: list[Node], path: str) -> list[Node]:
    """The outermost nodes with this path that are not left out."""
    found, fits, inside = [], {id(nodes[0]): 0}, set()
    for node in nodes[1:]:
        if node.out or id(node.parent) in inside:
            inside.add(id(node))
            continue
        # So many characters of the path lead to the parent; no entry where they lead elsewhere.
        length = fits.get(id(node.parent))
        if length is None or not path.startswith(node.step, length):
            continue
        fits[id(node)] = length + len(node.step)
        if fits[id(node)] == len(path):
            found.append(node)
            inside.add(id(node))
    return found


def main_text(page: str, path: str | None) -> str:
    """The text below the nodes of ``path``, else below the page's own best container, else of all of it."""
    root, nodes = read(page)
    chosen = _under(nodes, path) if path is not None else []
    text = text_of(chosen)
    if not text:
        found = best_container(nodes)
        text = text_of([found[0] if found else root])
    return text


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page or "", path) for page, path in
                 zip(batch.column("html").to_pylist(), batch.column("path").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"]
        )


def host_paths(pages: DataFrame) -> DataFrame:
    """``v_host, path``: for each host the path with most votes, then most text, then first in order."""
    votes = pages.select("host", "html").mapInArrow(_votes, "host string, path string, score long")
    sums = votes.where("path is not null").groupBy("host", "path").agg(
        F.count(F.lit(1)).alias("votes"), F.sum("score").alias("score")
    )
    return sums.groupBy(F.col("host").alias("v_host")).agg(
        F.min_by("path", F.struct(-F.col("votes"), -F.col("score"), "path")).alias("path")
    )


def extract_main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages (page_id, url, html)``."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"://([^/?#]*)", 1))
    own = pages.select("page_id", "url", "html", host.alias("host"))
    paths = stored(host_paths(own))
    texts = own.join(paths, own["host"] == paths["v_host"], "left").select("page_id", "url", "html", "path").mapInArrow(
        _texts, "page_id long, url string, text string"
    )
    return texts.select("*", F.length("text").cast("long").alias("n_chars"))
