"""Main text of web pages by wrapper induction.

The pages of a host fall into layouts by the upper part of their trees, and each layout has a reference page.
A tree, its runs of like neighbours folded to one node, is aligned with the reference by simple tree
matching.  How many different pages of the layout have a text at an aligned node is counted over all pages of the host.
What recurs on nearly all pages that have the node is template, single members of runs included; what varies is a slot for content.
What remains of the article without template and parts that never are content (menus, forms, ...) is the main text.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import map_rows, pick

#: Different pages a template needs, and the share of those with the node on which its text is the same.
PAGES, SAME = 4, 0.9
#: Levels of a tree that tell its layout.
UPPER = 3
#: Bytes of all references and templates that go to every executor, if they measure as so few; otherwise they are joined.
SENT_BYTES = 32 << 20
#: Layouts a task holds references of before it hands them on.
HELD = 2_000

# fixed values of the markup language
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt",
          "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html",
          "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th",
          "thead", "tr", "ul"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}, "tbody": {"tr", "td", "th", "thead"}, "thead": {"tr", "td", "th"}}
SCOPES = {"table", "ul", "ol", "dl", "select", "html", "body", "article", "div", "section", "td", "th", "li", "dd"}
NEVER = RAW | {"head", "nav", "header", "footer", "aside", "form", "button", "select", "svg", "canvas", "object", "audio", "video",
               "menu", "dialog", "input", "fieldset"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"}
MARKS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments",
         "consent", "cookie", "cookies", "copyright", "disqus", "footer", "header", "login", "masthead", "menu", "modal", "nav",
         "navbar", "navigation", "newsletter", "notice", "notices", "pagination", "pager", "popup", "promo", "promotion", "related",
         "respond", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget"}

# elements that no name rules out, and parts of names that tell of a layout
OPEN = {"html", "body", "article", "main"}
LAYOUT = {"no", "has", "with", "without", "free"}
# elements that hold whole parts of a page, and marks that count on inline elements
HOLDERS = {"div", "section", "ul", "ol", "dl", "table", "center", "details", "figure", "blockquote"}
ADVERTS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored"}
# what repeats freely inside content; other siblings fold in runs longer than LONG only
REPEATED, LONG = {"p", "li", "a", "b", "i", "em", "strong", "span", "img", "br", "tr", "td", "th", "dt", "dd", "option", "code", "hr"}, 8
# nodes below are part of the one above when trees are aligned
DEEPEST = 60

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)


class Node:
    __slots__ = ("tag", "names", "children")

    def __init__(self, tag: str, names: str = ""):
        self.tag, self.names = tag, names
        self.children: list[Node | str] = []

    def texts(self) -> Iterator[str]:
        stack: list = [self]
        while stack:
            at = stack.pop()
            if isinstance(at, str):
                yield at
            else:
                stack += reversed(at.children)


def parse(page: str) -> Node:
    """The tree of a page; unclosed and stray tags are taken as browsers take the common cases."""
    root = Node("html")
    path = [root]
    at = 0
    while hit := TOKEN.search(page, at):
        if hit.start() > at:
            path[-1].children.append(page[at:hit.start()])
        at = hit.end()
        end, tag, rest = hit.groups()
        if not tag:
            continue
        tag = tag.lower()
        if end:
            found = next((k for k in range(len(path) - 1, 0, -1) if path[k].tag == tag), 0)
            if found:
                del path[found:]
            continue
        names = ""
        if rest:
            names = " ".join(f"{k.lower()}={a or b or c}" for k, a, b, c in ATTRIBUTE.findall(rest))
        node = Node(tag, names)
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = close.end() if close else len(page)
            path[-1].children.append(node)
            continue
        _close_implied(path, tag)
        path[-1].children.append(node)
        if tag not in VOID and not rest.endswith("/"):
            path.append(node)
    if at < len(page):
        path[-1].children.append(page[at:])
    return root


def _close_implied(path: list[Node], tag: str) -> None:
    """A block ends an open paragraph; a list item, cell or row ends the one before."""
    ended = CLOSES.get(tag, set())
    for k in range(len(path) - 1, 0, -1):
        if (tag in BLOCKS and path[k].tag == "p") or path[k].tag in ended:
            del path[k:]
            return _close_implied(path, tag)
        if path[k].tag in SCOPES:
            return None
    return None


def never(node: Node) -> bool:
    """Whether a node by its tag, role or names never is content."""
    return barred(node) or marked(node)


def barred(node: Node) -> bool:
    """By its tag or role, or hidden."""
    if node.tag in NEVER:
        return True
    if not node.names or node.tag in OPEN:
        return False
    for name in node.names.lower().split():
        kind, _, value = name.partition("=")
        if kind == "hidden" or (kind == "role" and value in ROLES):
            return True
    return False


def marked(node: Node) -> bool:
    """By a part of a class or id; ``no-sidebar``, ``ad-free`` and the like tell of the layout.

    Inline elements are part of a sentence unless they are adverts; of names of texts (``share-price``) only the last part counts.
    """
    if not node.names or node.tag in OPEN:
        return False
    for name in node.names.lower().split():
        kind, _, value = name.partition("=")
        if kind == "role":
            continue
        parts = re.split(r"[-_:]+", value or kind)
        found = MARKS & set(parts if node.tag in HOLDERS else parts[-1:])
        if found and not LAYOUT & set(parts) and (node.tag in BLOCKS or found & ADVERTS):
            return True
    return False


def blocks_below(node: Node) -> Iterator[Node]:
    """The nearest blocks below a node, in page order."""
    stack = [c for c in reversed(node.children) if not isinstance(c, str)]
    while stack:
        at = stack.pop()
        if at.tag in BLOCKS:
            yield at
        else:
            stack += [c for c in reversed(at.children) if not isinstance(c, str)]


class Fold:
    """A block with the blocks below it, like neighbours folded into one; references have no members."""

    __slots__ = ("key", "members", "children", "number")

    def __init__(self, members: list[Node], depth: int = 0):
        self.members = members
        self.key = members[0].tag, members[0].names
        self.children: list[Fold] = []
        if len(members) > 1 or depth >= DEEPEST:
            return
        runs: list[list[Node]] = []
        for child in blocks_below(members[0]):
            if runs and (runs[-1][0].tag, runs[-1][0].names) == (child.tag, child.names):
                runs[-1].append(child)
            else:
                runs.append([child])
        parts = [[r] if r[0].tag in REPEATED or len(r) > LONG else [[m] for m in r] for r in runs]
        self.children = [Fold(r, depth + 1) for part in parts for r in part]

    def skeleton(self) -> list:
        return [*self.key, [c.skeleton() for c in self.children]]

    def layout(self, levels: int = UPPER) -> list:
        """The kinds of nodes of the upper levels, however often each repeats."""
        below = {json.dumps(c.layout(levels - 1)) for c in self.children} if levels else ()
        return [*self.key, sorted(below)]


class Reference:
    """The skeleton of a page; its nodes are numbered from the top."""

    __slots__ = ("key", "children", "number")

    def __init__(self, skeleton: list, counter: list[int] | None = None):
        counter = counter or [0]
        self.key, self.number = tuple(skeleton[:2]), counter[0]
        counter[0] += 1
        self.children = [Reference(c, counter) for c in skeleton[2]]


def match(one: Reference, two: Fold) -> tuple[int, list[tuple[Reference, Fold]]]:
    """Simple tree matching: the most nodes that correspond, in order and below each other."""
    if one.key != two.key:
        return 0, []
    rows, columns = len(one.children), len(two.children)
    found = {(i, j): match(a, b) for i, a in enumerate(one.children) for j, b in enumerate(two.children) if a.key == b.key}
    best = [[0] * (columns + 1) for _ in range(rows + 1)]
    for i in range(rows):
        for j in range(columns):
            here = found.get((i, j), (0,))[0]
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + here)
    pairs, i, j = [(one, two)], rows, columns
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs += found[i, j][1]
    return best[rows][columns] + 1, pairs


def seek(start: Node, tag: str, deepest: bool = True) -> list[Node]:
    """The outermost nodes of a tag or role below ``start`` that are below the fewest marked nodes (or, on request, below none)."""
    out, stack = [], [(c, 0) for c in reversed(start.children) if not isinstance(c, str)]
    while stack:
        node, marks = stack.pop()
        if node.tag == tag or f"role={tag}" in node.names:
            out.append((marks, node))
        elif not barred(node):
            marks += marked(node)
            stack += [(c, marks) for c in reversed(node.children) if not isinstance(c, str)]
    least = min((marks for marks, _ in out), default=0) if deepest else 0
    return [node for marks, node in out if marks == least]


def shows(node: Node) -> bool:
    """Whether there is text outside the parts that never are content."""
    stack: list = list(node.children)
    while stack:
        at = stack.pop()
        if isinstance(at, str):
            if at.strip():
                return True
        elif not never(at):
            stack += at.children
    return False


def articles(root: Node) -> list[Node]:
    """The outermost nodes that hold the article: article elements in main ones, main or article elements, else the whole page.

    Articles beside a main element are teasers; those below a mark in it count if it has no other text.
    """
    mains = seek(root, "main")
    out = []
    for main in mains:
        out += seek(main, "article", False) or (not shows(main) and seek(main, "article")) or [main]
    return out or seek(root, "article") or [root]


def content(root: Node, template: set[int]) -> str:
    """Blocks in page order, one line each."""
    blocks, line = [], []

    def flush():
        text = " ".join(entities.unescape("".join(line)).split())
        line.clear()
        if text:
            blocks.append(text)

    stack: list = list(reversed(articles(root)))
    while stack:
        node = stack.pop()
        if node is None:
            flush()
        elif isinstance(node, str):
            line.append(node)
        elif node.tag in VOID:
            line.append(" ")
            if node.tag == "hr":
                flush()
        elif not never(node) and id(node) not in template:
            if node.tag in BLOCKS:
                flush()
                stack.append(None)
            stack += reversed(node.children)
        elif node.tag in BLOCKS:
            flush()
    flush()
    return "\n".join(blocks)


def short_hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - 2**63


class Page:
    """A parsed page with its layout and the text digest that tells copies."""

    def __init__(self, page: str):
        self.tree = parse(page)
        self.fold = Fold([self.tree])
        self.layout = short_hash(json.dumps(self.fold.layout()))
        self.digest = short_hash("\0".join(self.tree.texts()))

    def slots(self, reference: Reference) -> Iterator[tuple[int, int, Node]]:
        """Node number, text digest and node of every block without blocks below, or member of a run.

        Blocks that have no counterpart in the reference are known by the path of names that leads to them.
        """
        numbers = {id(other): mine.number for mine, other in match(reference, self.fold)[1]}
        stack = [(self.fold, "")]
        while stack:
            fold, path = stack.pop()
            path = f"{path}/{fold.key[0]} {fold.key[1]}"
            if fold.children:
                stack += [(c, path) for c in fold.children]
                continue
            number = numbers.get(id(fold), short_hash(path))
            for member in fold.members:
                text = " ".join("".join(member.texts()).split())
                if text:
                    yield number, short_hash(text), member


def induce(counted: Iterator[tuple[int, int, int]]) -> set[tuple[int, int]]:
    """Template texts of a layout, from ``(node, text, page)`` digests of all its pages."""
    different = set(counted)
    texts = Counter((node, text) for node, text, _ in different)
    there = Counter(node for node, _ in {(node, page) for node, _, page in different})
    return {(node, text) for (node, text), n in texts.items() if n >= max(PAGES, SAME * there[node])}


def dropped(page: Page, reference: Reference | None, fixed: set[tuple[int, int]]) -> set[int]:
    """Nodes of a page that are template."""
    if reference is None or not fixed:
        return set()
    return {id(node) for number, text, node in page.slots(reference) if (number, text) in fixed}


def extract(pages: list[str], use_template: bool = True) -> list[str]:
    """Main texts of pages of one host, in memory."""
    parsed = [Page(p) for p in pages]
    layouts = Counter(p.layout for p in parsed)
    out = []
    known: dict[int, tuple] = {}
    for page in parsed:
        if page.layout not in known:
            mine = [p for p in parsed if p.layout == page.layout]
            reference = Reference(min(mine, key=lambda p: (p.digest, json.dumps(p.fold.skeleton()))).fold.skeleton())
            usable = use_template and layouts[page.layout] >= PAGES
            fixed = induce((n, t, p.digest) for p in mine for n, t, _ in p.slots(reference)) if usable else set()
            known[page.layout] = reference, fixed
        out.append(content(page.tree, dropped(page, *known[page.layout])))
    return out


@lru_cache(maxsize=64)
def _references(described: str) -> dict[int, Reference]:
    return {r["layout"]: Reference(json.loads(r["skeleton"])) for r in json.loads(described)}


@lru_cache(maxsize=64)
def _fixed(described: str) -> dict[int, set[tuple[int, int]]]:
    found: dict[int, set[tuple[int, int]]] = {}
    for r in json.loads(described):
        found.setdefault(r["layout"], set()).add((r["node"], r["content"]))
    return found


def _by_host(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    return df.groupBy("host").agg(F.to_json(F.sort_array(F.collect_list(F.struct(*columns)))).alias(name))


def _map_with(rows: DataFrame, about: DataFrame, names: list[str], function: Callable, schema: str) -> DataFrame:
    """``function`` over rows and what is known of their hosts: sent to all executors if it measures as small, else joined."""
    size = about.agg(F.coalesce(F.sum(sum((F.coalesce(F.octet_length(n), F.lit(0)) for n in names), F.lit(100))), F.lit(0)).alias("n")).first().n
    if size > SENT_BYTES:
        joined = rows.join(about, "host", "left")
        return map_rows(joined.select(*rows.columns, *names), function, schema, 200)
    shared = rows.sparkSession.sparkContext.broadcast({r.host: tuple(r[n] for n in names) for r in about.select("host", *names).collect()})
    at, nothing = rows.columns.index("host"), (None,) * len(names)

    def run(source):
        known = shared.value
        return function((*row, *known.get(row[at], nothing)) for row in source)

    return map_rows(rows, run, schema, 200)


def references(rows: DataFrame) -> DataFrame:
    """``(host, refs)``: a reference page for every layout of a host that ``PAGES`` pages have."""
    def run(source):
        held: dict[tuple, list] = {}
        for host, html in source:
            page = Page(html or "")
            best = held.setdefault((host, page.layout), [0, None, None])
            best[0] += 1
            if best[1] is None or page.digest <= best[1]:
                skeleton = json.dumps(page.fold.skeleton())
                if best[1] is None or (page.digest, skeleton) < (best[1], best[2]):
                    best[1:] = page.digest, skeleton
            if len(held) >= HELD:
                yield from ((*key, *value) for key, value in held.items())
                held.clear()
        yield from ((*key, *value) for key, value in held.items())

    found = map_rows(rows.select("host", "html"), run, "host string, layout long, n long, digest long, skeleton string", 200)
    best = found.groupBy("host", "layout").agg(F.sum("n").alias("n"), F.min(F.struct("digest", "skeleton")).alias("best"))
    return _by_host(best.filter(F.col("n") >= PAGES).select("host", "layout", "best.skeleton"), ["layout", "skeleton"], "refs")


def templates(rows: DataFrame, refs: DataFrame) -> DataFrame:
    """``(host, fixed)``: the texts that are template at the nodes of each layout, counted over all different pages."""
    def run(source):
        for host, html, described in source:
            if described is None:
                continue
            page = Page(html or "")
            reference = _references(described).get(page.layout)
            if reference is not None:
                found = {(n, t) for n, t, _ in page.slots(reference)}
                for number in {n for n, _ in found}:
                    yield host, page.layout, number, None, page.digest
                for number, text in found:
                    yield host, page.layout, number, text, page.digest

    seen = _map_with(rows.select("host", "html"), refs, ["refs"], run, "host string, layout long, node long, content long, page long")
    counted = seen.distinct().groupBy("host", "layout", "node", "content").agg(F.count("*").alias("n"))
    counted = cut_lineage(counted.filter(F.col("n") >= PAGES))
    there = counted.filter("content IS NULL").select("host", "layout", "node", F.col("n").alias("there"))
    same = counted.filter("content IS NOT NULL").join(there, ["host", "layout", "node"]).filter(F.col("n") >= SAME * F.col("there"))
    return _by_host(same, ["layout", "node", "content"], "fixed")


def main_texts(df: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: ``(page_id, url, text, n_chars)``.

    Null html gives an empty text; pages without url or host form a host of their own; repeated rows
    stay, and copies of a page count as one where templates are induced.  Layouts of fewer than ``PAGES`` different pages have no template, there
    only tags and names of classes tell what is content.  Other columns are ignored; an empty table gives no rows.

    Pages are read three times and stay where they are: for references, for counts of texts at aligned
    nodes (whole numbers are shuffled, no texts), and to extract.
    """
    rows = pick(df, page_id=page_id, url=url, html=html)
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    rows = rows.withColumn("host", host)
    refs = cut_lineage(references(rows))
    about = cut_lineage(refs.join(templates(rows, refs), "host"))

    def run(source):
        for i, u, html, _, described, fixed in source:
            page = Page(html or "")
            known = (None, set()) if fixed is None else (
                _references(described).get(page.layout), _fixed(fixed).get(page.layout, set()))
            text = content(page.tree, dropped(page, *known))
            yield i, u, text, len(text)

    kind = df.schema[page_id].dataType.simpleString()
    return _map_with(rows, about, ["refs", "fixed"], run, f"page_id {kind}, url string, text string, n_chars long")
