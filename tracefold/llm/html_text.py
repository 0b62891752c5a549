"""HTML extraction by site template removal.

A page becomes a tree. Elements that are no article by HTML itself (menus, headers, footers, asides, forms, scripts, styles, their
roles) go, as do the two kinds that HTML has no element for, adverts and reader comments, where a class or id is theirs, unless such an element
holds most of the page's text; what lies in ``article`` or ``main`` is kept if there is such an element, else the body.

What is left is judged by recurrence on its host. Every subtree has two hashes: its content (tags, classes, ids and text) and its
shape (block elements with classes and ids, equal neighbours as one, no text). Spark counts both over the different page bodies of
each host, with the characters and the link characters under each shape. Deleted are

* contents on ``share`` of a host's bodies (``least`` at least);
* shapes on ``shape_share`` of the bodies whose characters are links for the most part (menus, lists of further pages), or
  whose texts come from a small pool (rotating notices), or, where the page has no article element, that hold a small share of the
  host's text over all pages and no heading (boxes beside the text).

Inside an article only containers are judged, and shapes only if they have a class or an id: a passage that authors repeat in
paragraphs is text, not template. Copies of a page count as one body, so a page that a site holds many times is no template.

Text: character references decoded, white space inside a block made one space, trimmed, blocks joined by one newline. ``br``
is white space.

Defined results: null or empty html, or a page without text, gives an empty text; broken markup is read as far as it goes
(open elements end with their parent); pages without a host share the empty host; repeated rows each get a result; an empty
table gives an empty table; other columns are not touched.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import listed, materialise, table
from .url_filter import host_of

#: Where a tag begins; a comment or another declaration has no name.
OPEN = re.compile(r"<(?:(!--|[!?])|(/?)([a-zA-Z][^\s/>]*))")
QUOTED = re.compile(r"""(?:[^>"']|"[^"]*"|'[^']*')*>""")
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
RAW = frozenset("script style textarea title noscript template xmp iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style noscript template head title nav footer aside form button select option textarea dialog menu iframe svg canvas object audio video input label".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
#: Classes and ids of adverts and reader comments, for which HTML has no element.
MARKS = frozenset("ad ads advert adverts advertisement comment comments".split())
#: Words that may follow such a mark in one name (``ad-slot``, ``comment_list``).
PARTS = frozenset("area banner block box container form item items list section slot thread unit wrap wrapper".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr label".split())
#: A start tag of the first kind ends an open element of the second.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("html body article main section div table ul ol dl td th blockquote form nav footer header aside".split())
CONTENT, HEADINGS = ("article", "main"), frozenset(("h1", "h2", "h3"))
CONTAINERS = frozenset("div section ul ol dl table figure details fieldset center header".split())
LEAVES = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre address".split())
WORDS = re.compile(r"[\s_-]+")


class Node:
    """named: dropped for its class or id alone."""

    __slots__ = ("children", "drop", "mark", "named", "tag")

    def __init__(self, tag: str, drop: bool = False, mark: str = "", named: bool = False) -> None:
        self.tag, self.drop, self.mark, self.named, self.children = tag, drop or named, mark, named and not drop, []


def is_mark(name: str) -> bool:
    """A class or id that is an advert's or a comment's, whole: not one that only mentions it (``has-comments``, ``ad-free``)."""
    first, *rest = WORDS.split(name)
    return first in MARKS and PARTS.issuperset(rest)


def told(tag: str, attributes: str, inside: bool) -> tuple[bool, str, bool]:
    """Whether an element is no article by itself, its class and id, and whether these alone say so."""
    drop, mark, named = tag in DROPPED or (tag == "header" and not inside), [], False
    for name, *values in ATTRIBUTE.findall(attributes) if attributes else ():
        value = next((v for v in values if v), "").lower()
        if name.lower() == "role":
            drop |= value.strip() in ROLES
        else:
            mark += sorted(value.split())
            named |= tag not in ("html", "body", "main") and any(map(is_mark, value.split()))
    return drop, " ".join(mark), named


def parse(page: str) -> Node:
    """The tree of a page, in time linear in it: open elements are found by name, and what never ends is looked for once.

    A comment that never ends hides the rest. A tag without a ``>`` is text. Once a quotation in a tag never ends, quotes hide no ``>`` any more.
    """
    root = Node("root")
    stack, at, n = [root], 0, len(page)
    depth = 0  # of open article and main elements
    where: dict[str, list[int]] = {}  # places of open elements in the stack, by name
    scopes: list[int] = []
    last, quotes, names = page.rfind(">") + 1, True, []

    def close(i: int) -> None:
        nonlocal depth
        for x in stack[i:]:
            depth -= x.tag in CONTENT
            where[x.tag].pop()
            if x.tag in SCOPE:
                scopes.pop()
        del stack[i:]

    def text(upto: int) -> None:
        if upto > at:
            stack[-1].children.append(page[at:upto])

    while at < n:
        m = OPEN.search(page, at)
        if m is None:
            text(n)
            break
        if m[1] == "!--":
            text(m.start())
            end = page.find("-->", m.end())
            at = n if end < 0 else end + 3
            continue
        if m.start() >= last:  # no tag ends from here on; only a comment may begin
            start = page.find("<!--", m.start())
            text(n if start < 0 else start)
            break
        end = QUOTED.match(page, m.end()) if quotes and m[3] else None
        if end is None:
            quotes = quotes and not m[3]
            close_at = page.find(">", m.end()) + 1
        else:
            close_at = end.end()
        text(m.start())
        attributes = page[m.end() : close_at - 1]
        at = close_at
        if m[3] is None:
            continue
        tag = m[3].lower()
        if m[2]:
            if where.get(tag):
                close(where[tag][-1])
            continue
        if tag not in INLINE and tag not in VOID:
            i = max((where[t][-1] for t in ENDS.get(tag, ("p",)) if where.get(t)), default=-1)
            if i >= (scopes[-1] if scopes else 0) and i > 0:
                close(i)
        node = Node(tag, *told(tag, attributes, depth > 0))
        if node.named:
            names.append(node)
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*/?>", re.I).search(page, at)
            at = end.end() if end else n
        elif tag not in VOID and not attributes.endswith("/"):
            where.setdefault(tag, []).append(len(stack))
            if tag in SCOPE:
                scopes.append(len(stack))
            stack.append(node)
            depth += tag in CONTENT
    if names:
        spare(root, names)
    return root


def spare(root: Node, names: list[Node]) -> None:
    """Keeps elements that only their class or id would drop, but that hold most of the page's text."""
    size: dict[int, int] = {}
    todo = [(root, False)]
    while todo:
        x, ready = todo.pop()
        if x.drop and not x.named:
            size[id(x)] = 0
        elif ready:
            size[id(x)] = sum(size[id(c)] if isinstance(c, Node) else len("".join(c.split())) for c in x.children)
        else:
            todo.append((x, True))
            todo.extend((c, False) for c in x.children if isinstance(c, Node))
    for x in names:
        if 2 * size.get(id(x), 0) > size[id(root)]:
            x.drop = False


def kept_roots(root: Node) -> tuple[list[Node], bool]:
    """The topmost article or main elements that are not dropped; without any, the whole page."""
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.drop:
            continue
        if node.tag in CONTENT:
            found.append(node)
        else:
            todo.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return (found, True) if found else ([root], False)


class Judged:
    """A subtree that recurrence may delete: hashes of its content and shape (0: not judged by shape), characters, those in links, whether it is a box."""

    __slots__ = ("box", "chars", "content", "links", "node", "shape")

    def __init__(self, node: Node, content: int, shape: int, chars: int, links: int, box: bool) -> None:
        self.node, self.content, self.shape, self.chars, self.links, self.box = node, content, shape, chars, links, box


def number(h) -> int:
    return int.from_bytes(h.digest(), "big", signed=True)


def digest(node: Node, article: bool, out: list[Judged]) -> tuple[bytes, int]:
    """Hash and characters of a subtree; out gets the judged elements below it that hold text. No recursion: pages may be deep."""
    judged = CONTAINERS if article else LEAVES
    done: dict[int, tuple[bytes, bytes, int, int, bool]] = {}  # content, shape, characters, in links, holds a heading
    todo = [(node, False)]
    while todo:
        x, ready = todo.pop()
        if x.drop:
            done[id(x)] = (b"", b"", 0, 0, False)
            continue
        if not ready:
            todo.append((x, True))
            todo.extend((c, False) for c in x.children if isinstance(c, Node))
            continue
        name = f"{x.tag} {x.mark}".encode("utf-8", "replace")
        h, g, before = hashlib.blake2b(name, digest_size=8), hashlib.blake2b(b"A" + name if article else b"O" + name, digest_size=8), None
        chars, links, heading = 0, 0, x.tag in HEADINGS
        for c in x.children:
            if isinstance(c, Node):
                part, shape, n, m, has = done.pop(id(c))
                chars, links, heading = chars + n, links + m, heading or has
                if shape and c.tag not in INLINE and shape != before:
                    g.update(shape)
                    before = shape
            else:
                words = " ".join(c.split())
                part = b"\x01" + words.encode("utf-8", "replace")
                chars += len(words)
            h.update(part)
        if x.tag == "a":
            links = chars
        done[id(x)] = (h.digest(), g.digest(), chars, links, heading)
        if chars and x.tag in judged and x is not node:
            by_shape = x.tag in CONTAINERS and (x.mark or (links and not article))
            out.append(Judged(x, number(h), number(g) if by_shape else 0, chars, links, bool(x.mark) and not article and not heading))
    return done[id(node)][0], done[id(node)][2]


def judged_subtrees(page: str) -> tuple[int, int, list[tuple[int, int]], list[tuple[int, int, int, int, bool]]]:
    """A hash of the page's kept body, its characters, the different (content, shape) of its subtrees, and (shape, times, characters, in links, box) of its shapes."""
    roots, article = kept_roots(parse(page))
    out: list[Judged] = []
    whole, chars = hashlib.blake2b(digest_size=8), 0
    for r in roots:
        part, n = digest(r, article, out)
        whole.update(part)
        chars += n
    shapes: dict[int, list] = {}
    for j in out:
        if j.shape:
            one = shapes.setdefault(j.shape, [0, 0, 0, True])
            one[0], one[1], one[2], one[3] = one[0] + 1, one[1] + j.chars, one[2] + j.links, one[3] and j.box
    return number(whole), chars, list({(j.content, j.shape) for j in out}), [(k, *v) for k, v in shapes.items()]


def extract(page: str | None, contents=(), shapes=()) -> str:
    """The text blocks of a page, without the subtrees whose hashes are in contents or shapes."""
    if not page:
        return ""
    roots, article = kept_roots(parse(page))
    if len(contents) or len(shapes):
        by_content, by_shape = frozenset(contents), frozenset(shapes)
        out: list[Judged] = []
        for r in roots:
            digest(r, article, out)
        for j in out:
            j.node.drop |= j.content in by_content or j.shape in by_shape
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        words = " ".join(html.unescape("".join(line)).split())
        if words:
            blocks.append(words)
        line.clear()

    todo: list[Node | str | None] = list(reversed(roots))
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            line.append(x)
        elif x.drop:
            if x.tag not in INLINE:
                flush()
        elif x.tag == "br":
            line.append(" ")
        else:
            if x.tag not in INLINE:
                flush()
                todo.append(None)
            todo.extend(reversed(x.children))
    flush()
    return "\n".join(blocks)


#: Hosts, and hashes, whose templates may be sent to every executor (they are counted first); more are joined by shuffle.
BROADCAST_ROWS, BROADCAST_HASHES = 20_000, 1 << 20
SUBTREES = "host string, body bigint, chars bigint, subtrees array<struct<content:bigint,shape:bigint>>, shapes array<struct<shape:bigint,times:bigint,chars:bigint,links:bigint,box:boolean>>"


def templates(pages: DataFrame, least: int = 5, share: float = 0.1, shape_share: float = 0.3) -> DataFrame:
    """(host, contents, shapes): hashes of each host's template subtrees. pages: host, html.

    A template is on a share of the bodies, so a host has at most 1 / share times as many as a body has subtrees on the average.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lo in range(0, len(frame), 200):
                part = frame.iloc[lo : lo + 200]
                rows = [judged_subtrees(p) for p in part["html"]]
                yield pd.DataFrame({
                    "host": part["host"].to_numpy(), "body": [r[0] for r in rows], "chars": [r[1] for r in rows],
                    "subtrees": listed([{"content": c, "shape": s} for c, s in r[2]] for r in rows),
                    "shapes": listed([dict(zip(("shape", "times", "chars", "links", "box"), x, strict=True)) for x in r[3]] for r in rows),
                })

    bodies = materialise(pages.where("length(html) > 0").mapInPandas(run, SUBTREES).dropDuplicates(["host", "body"]))
    of_host = bodies.groupBy("host").agg(F.count("*").alias("n"), F.sum("chars").alias("all_chars"))
    enough = lambda part: F.greatest(F.lit(least), F.ceil(part * F.col("n")))
    counted = bodies.select("host", F.explode("subtrees").alias("x")).groupBy("host", "x.shape", "x.content").agg(F.count("*").alias("c"))
    contents = counted.where(F.col("c") >= least).join(of_host, "host").where(F.col("c") >= enough(F.lit(share))).groupBy("host").agg(F.collect_set("content").alias("contents"))
    pool = counted.where("shape <> 0").groupBy("host", "shape").agg(F.count("*").alias("texts"))
    seen = bodies.select("host", F.explode("shapes").alias("x")).groupBy("host", "x.shape").agg(
        F.count("*").alias("c"), F.sum("x.times").alias("times"), F.sum("x.chars").alias("chars"), F.sum("x.links").alias("links"), F.min("x.box").alias("box")
    )
    seen = seen.where(F.col("c") >= least).join(of_host, "host").where(F.col("c") >= enough(F.lit(shape_share))).join(pool, ["host", "shape"])
    menu, rotating = F.col("links") >= 0.6 * F.col("chars"), (F.col("texts") <= 0.2 * F.col("times")) & (F.col("times") >= 2 * least)
    beside = F.col("box") & (F.col("chars") < 0.15 * F.col("all_chars"))
    shapes = seen.where(menu | rotating | beside).groupBy("host").agg(F.collect_set("shape").alias("shapes"))
    none = F.array().cast("array<bigint>")
    both = contents.join(shapes, "host", "full_outer")
    return both.select("host", F.coalesce("contents", none).alias("contents"), F.coalesce("shapes", none).alias("shapes"))


def extract_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", least: int = 5, share: float = 0.1, use_templates: bool = True) -> DataFrame:
    """pages with __text; without use_templates nothing is judged by recurrence."""
    wide = pages.withColumns({"__host": host_of(F.col(url_col)), "__html": F.col(html_col)})
    none = F.lit(None).cast("array<bigint>")
    if use_templates:
        bad = materialise(templates(wide.select(F.col("__host").alias("host"), F.col("__html").alias("html")), least, share))
        sizes = bad.agg(F.count("*").alias("hosts"), F.coalesce(F.sum(F.size("contents") + F.size("shapes")), F.lit(0)).alias("hashes")).first()
        small = sizes["hosts"] <= BROADCAST_ROWS and sizes["hashes"] <= BROADCAST_HASHES
        bad = bad.select(F.col("host").alias("__h"), F.col("contents").alias("__contents"), F.col("shapes").alias("__shapes"))
        wide = wide.join(F.broadcast(bad) if small else bad, F.col("__host") == F.col("__h"), "left").drop("__h")
    else:
        wide = wide.withColumns({"__contents": none, "__shapes": none})

    def plain(series: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for page, contents, shapes in series:
            yield listed(extract(p, () if c is None else c, () if s is None else s) for p, c, s in zip(page, contents, shapes, strict=True))

    wide = wide.withColumn("__text", F.pandas_udf(plain, "string").asNondeterministic()("__html", "__contents", "__shapes"))
    return wide.drop("__host", "__html", "__contents", "__shapes")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_text(pages).select("page_id", "url", F.col("__text").alias("text"), F.length("__text").cast("long").alias("n_chars"))
