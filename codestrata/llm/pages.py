"""Operator 10: main-text extraction by site style trees.

The pages of a host are merged into one style tree. A node is the path of an element: its tag and class or
id names, below those of its ancestors, whatever its place among its siblings and however deep. A node keeps how
its pages present it (the sequence of its children) and what they say in it (its own text and where its links and
images point). Its presentation's importance is the entropy of its shapes: 0 if all agree, 1 if all differ. Its
contents' is 1 less the mean, over what is said in it, of how evenly the pages repeat that: 0 if all pages say the
same, 1 if each says something else. A node's importance is the greater of both. Few pages tell little: what
n pages tell is mixed with ONE page's worth of importance 1, so hosts of two pages are judged and hosts of one are not.
A node below LEAST is unimportant, and a branch whose nodes are all unimportant is removed from the page.

Contents alone can't tell an advert or a menu that changes on every page from an article. So where tag, role, class
or id names suggest what the contract excludes (menus, page headers, footers, side bars, notices, adverts, forms,
reader comments), and outside the marked articles (or main parts) of a page that has some, a node is doubtful: what
it says doesn't count for it, only its shapes do, as menus and adverts change what they say and not how they look;
they are mixed with DOUBT pages' worth of importance 0, and to stay a branch must reach SURE in some node, below
which only further doubtful names are doubted. Names only bias this decision, which is the tree's: without the tree nothing is removed but scripts, styles and form controls. Names
never make html, body or main doubtful, nor, where every marked article of a page is below or in such a name or a
form, those with the fewest. Where the tree calls all of a marked article (or of an unmarked page) unimportant, as
on hosts that repeat one article, it says nothing of its branches but the doubtful ones.

The counts behind an entropy are grouped by (host, node, digest), so a host with any share of the pages is
spread over all tasks; what comes back to the pages is the list of each host's unimportant nodes, which grows
with the number of templates, not of pages. Pages meet it in a join by host, whose large partitions Spark splits.

Character references are decoded; white space inside a block becomes one space; blocks are joined in
page order by one space. A null or empty page, or one without main text, gives "". Repeated rows are pages
of their own. A null url is a host of its own. Long pages are read whole. Empty tables give no rows. Other columns
are ignored. Broken markup closes where browsers close it, nearly.
"""

from __future__ import annotations

import hashlib
import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator, Set
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table

LEAST = 0.34
ONE = 1
#: What a doubtful branch must reach, and how many pages' worth of importance 0 its shapes are mixed with.
SURE = 0.9
DOUBT = 8

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
ENDS_P = frozenset("address article aside blockquote details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table ul".split())
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "td": ("tr", "table"), "th": ("tr", "table"), "tr": ("table", "tbody", "thead", "tfoot"), "option": ("select",)}
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",), "option": ("option",)}

#: Elements whose text is never read: what isn't shown, and form controls.
MUTE_TAGS = frozenset("script style noscript template iframe svg head title button select option input textarea object embed".split())
#: Elements that seldom hold main text.
NOISE_TAGS = frozenset("nav footer aside form dialog menu".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar alertdialog".split())
#: Words of class and id names that say as much.
NOISE_NAMES = frozenset(
    "ad ads adv advert advertisement advertising adsense adbox adslot banner sponsor sponsored promo promotion promoted "
    "nav navbar navigation navi menu submenu breadcrumb breadcrumbs toc pagination pager footer sidebar sidenav aside widget "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay disclaimer "
    "comment comments commentlist disqus respond replies reply newsletter subscribe subscription signup login search searchform form "
    "share sharing social related recommended recommendations masthead topbar copyright".split()
)
KEEP_TAGS = frozenset(("article", "main"))
#: What no name makes noise.
WHOLE = frozenset(("html", "body", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|href|src)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
HOST = re.compile(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)")


def host_of(url: str | None) -> str:
    found = HOST.match(url or "")
    return found[1].lower() if found else ""


@dataclass
class Node:
    tag: str
    label: str
    #: The digest of its labels from the root on; an inline element shares its block's.
    path: int
    #: Its tag, role or names suggest that it is noise.
    noise: bool = False
    #: So do its names alone, or it is a form.
    soft: bool = False
    #: Noise, below noise, or outside the page's marked articles.
    doubt: bool = False
    target: str = ""
    children: list[Node | str] = field(default_factory=list)

    @property
    def block(self) -> bool:
        """Whether the style tree has it: inline elements are part of their block, unless their names say something."""
        return self.tag not in INLINE or self.noise


def _labels(tag: str, rest: str) -> tuple[str, bool, bool, str]:
    """The node's part of a path, whether its tag or role suggests noise, whether its names do, and where it points."""
    if "=" not in rest:
        return tag, tag in NOISE_TAGS, False, ""
    names, noise, named, target = [], tag in NOISE_TAGS, False, ""
    for key, a, b, c in ATTRIBUTE.findall(rest):
        value, key = a or b or c, key.lower()
        if key in ("href", "src"):
            target = value
            continue
        if key == "role":
            noise |= value.strip().lower() in NOISE_ROLES
            continue
        words = {w.lower() for w in NAME_PARTS.findall(value)}
        named |= tag not in WHOLE and bool(words & NOISE_NAMES)
        names.append(re.sub(r"\d+", "", value))
    return (f"{tag}.{'.'.join(names)}" if names else tag), noise, named, target


def _has_text(node: Node) -> bool:
    todo: list[Node | str] = [node]
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            if node.strip():
                return True
        elif not node.noise and node.tag not in MUTE_TAGS:
            todo += node.children
    return False


def _settle(root: Node) -> None:
    """Names (or a form) round every marked article don't make it noise: those below the fewest of them stay."""
    found: dict[str, list[tuple[int, tuple | None, Node]]] = {"article": [], "main": []}
    todo: list[tuple[Node, tuple | None, int]] = [(root, None, 0)]
    while todo:
        node, above, n = todo.pop()
        for child in node.children:
            if isinstance(child, str) or (child.noise and not child.soft):
                continue
            m = n + child.soft
            chain = (child, above) if child.soft else above
            if child.tag in found:
                found[child.tag].append((m, chain, child))
            todo.append((child, chain, m))
    articles, mains = found["article"], found["main"]
    if not articles + mains or any(m == 0 for m, _, _ in articles):
        return
    if any(m == 0 and _has_text(x) for m, _, x in mains):
        return
    marked = articles or mains
    least = min(m for m, _, _ in marked)
    for m, chain, _ in marked:
        while m == least and chain:
            chain[0].noise = False
            chain = chain[1]


def parse(text: str) -> Node:
    """The page as a tree; every stretch of text is a child string, still with its character references."""
    root = Node("", "", 0)
    stack = [root]
    at = 0

    def close(tags: tuple[str, ...], until: tuple[str, ...]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                del stack[k:]
                return
            if stack[k].tag in until:
                return

    n = len(text)
    while at < n:
        found = TOKEN.search(text, at)
        if not found:
            stack[-1].children.append(text[at:])
            break
        if found.start() > at:
            stack[-1].children.append(text[at : found.start()])
        at = found.end()
        if not found[2]:
            continue
        tag = found[2].lower()
        if found[1]:
            if tag == "p" and not any(x.tag == "p" for x in stack):
                continue
            if tag not in INLINE:
                close((tag,), ())
            else:
                close((tag,), tuple(ENDS_P - {"p"}) + ("td", "th"))
            continue
        if tag in ENDS_P:
            close(("p",), ("button", "td", "th", "table", "article", "section", "div", "li", "body"))
        if tag in CLOSED_BY:
            close(CLOSED_BY[tag], SCOPES[tag])
        top = stack[-1]
        label, noise, named, target = _labels(tag, found[3])
        if tag == "header":
            noise |= not any(x.tag in KEEP_TAGS for x in stack)
        node = Node(tag, label, top.path, noise or named, named and not noise or tag == "form", target=target)
        if node.block:
            node.path = _digest(f"{top.path}/{label}")
        top.children.append(node)
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}\\s*>", re.I).search(text, at)
            if tag in ("title", "textarea") and end:
                node.children.append(text[at : end.start()])
            at = end.end() if end else n
        elif tag not in VOID and not found[3].endswith("/"):
            stack.append(node)
    _settle(root)
    return root


def marked_parts(root: Node) -> list[Node]:
    """Marked articles that are neither inside another nor in noise; without any, main parts."""
    stack: list[tuple[Node, bool]] = [(root, False)]
    marked: list[Node] = []
    while stack:
        node, inside = stack.pop()
        for child in reversed(node.children):
            if isinstance(child, Node) and not child.noise:
                if child.tag in KEEP_TAGS and not inside:
                    marked.append(child)
                stack.append((child, inside or child.tag == "article"))
    return [m for m in marked if m.tag == "article"] or [m for m in marked if m.tag == "main"]


def place(root: Node) -> tuple[list[Node], set[int]]:
    """Sets what is doubtful. The marked parts of the page, and the identities of the nodes that hold one."""
    order = marked_parts(root)
    own = {id(m) for m in order}
    holds: set[int] = set()
    above: list[Node] = []
    todo: list[Node | None] = [root] if order else []
    while todo:  # None: the last of above is done
        node = todo.pop()
        if node is None:
            above.pop()
            continue
        if id(node) in own:
            holds |= {id(x) for x in above}
        above.append(node)
        todo.append(None)
        todo += [c for c in node.children if isinstance(c, Node)]
    stack = [(root, False, not order)]
    while stack:
        node, doubt, inside = stack.pop()
        for child in node.children:
            if isinstance(child, Node):
                within = inside or id(child) in own
                child.doubt = doubt or child.noise or not (within or id(child) in holds)
                stack.append((child, child.doubt, within))
    return order, holds


def _digest(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def features(root: Node) -> dict[tuple[int, str], list[int]]:
    """For each node of a placed page and kind ("p" its shape, "c" its text, "l" targets, "d" doubtful): a digest per element."""
    found: dict[tuple[int, str], list[int]] = {}

    def own(node: Node, text: list[str], shape: list[str], targets: list[str]) -> None:
        if node.target:
            targets.append(node.target)
        for child in node.children:
            if isinstance(child, str):
                text.append(child)
            elif not child.block:
                own(child, text, shape, targets)
            else:
                shape.append(child.label)

    todo = [root]
    while todo:
        node = todo.pop()
        todo += [c for c in node.children if isinstance(c, Node) and c.tag not in MUTE_TAGS and c.tag not in RAW]
        if not node.block or node.tag in VOID or not node.tag:
            continue
        text: list[str] = []
        shape: list[str] = []
        targets: list[str] = []
        own(node, text, shape, targets)
        found.setdefault((node.path, "p"), []).append(_digest("|".join(shape)))
        if words := " ".join("".join(text).split()):
            found.setdefault((node.path, "c"), []).append(_digest(words))
        if targets:
            found.setdefault((node.path, "l"), []).extend(map(_digest, targets))
        if node.doubt:
            found.setdefault((node.path, "d"), []).append(0)
    return found


def entropy(counts: list[int]) -> float:
    """In units of the log of the number of elements counted: 0 if all agree, 1 if all differ."""
    total = sum(counts)
    if total < 2:
        return 1.0
    return -sum(c / total * math.log(c / total) for c in counts) / math.log(total)


def noisy_nodes(pages: DataFrame, least: float = LEAST, sure: float = SURE) -> DataFrame:
    """host, path, doubt: the unimportant nodes of each host's style tree."""

    def rows_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts: Counter[tuple[str, int, str, int]] = Counter()
            for url, text in zip(batch["url"], batch["html"]):
                if text:
                    host, root = host_of(url), parse(text)
                    place(root)
                    for (path, kind), digests in features(root).items():
                        if kind == "p":
                            counts[host, path, "n", 0] += 1
                        for d in digests:
                            counts[host, path, kind, d] += 1
            if counts:
                yield pd.DataFrame([(*key, n) for key, n in counts.items()], columns=["host", "path", "kind", "digest", "n"])

    counted = pages.select("url", "html").mapInPandas(rows_of, "host string, path long, kind string, digest long, n long")
    each = counted.groupBy("host", "path", "kind", "digest").agg(F.sum("n").alias("n"))
    of = lambda *kinds: F.col("kind").isin(*kinds)
    total = lambda value, *kinds: F.coalesce(F.sum(F.when(of(*kinds), value)), F.lit(0.0))
    nodes = each.groupBy("host", "path").agg(
        total(F.col("n"), "p").alias("t"), total(F.col("n") * F.log("n"), "p").alias("shapes"), total(F.lit(1), "c", "l").alias("said"),
        total(F.log("n"), "c", "l").alias("again"), total(F.col("n"), "n").alias("pages"), total(F.col("n"), "d").alias("d"),
    )
    shape = F.when(F.col("t") < 2, 1.0).otherwise((F.log("t") - F.col("shapes") / F.col("t")) / F.log("t"))
    content = F.when(F.col("said") == 0, 0.0).when(F.col("t") < 2, 1.0).otherwise(1 - F.col("again") / F.col("said") / F.log("t"))
    plain = (F.col("pages") * F.greatest(shape, content) + ONE) / (F.col("pages") + ONE)
    doubtful = F.col("pages") * shape / (F.col("pages") + DOUBT)
    nodes = nodes.withColumn("doubt", 2 * F.col("d") > F.col("t"))
    return nodes.where(F.when(F.col("doubt"), doubtful < sure).otherwise(plain < least)).select("host", "path", "doubt")


def _unimportant(root: Node, plain: Set[int], doubt: Set[int] | None) -> set[int]:
    """Identities of the nodes whose branches are unimportant on this page. doubt: None if all doubtful nodes are."""
    order: list[Node] = []
    todo = [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [c for c in node.children if isinstance(c, Node)]
    gone: set[int] = set()
    for node in reversed(order):  # children come before their parents
        known = not node.tag or node.tag in MUTE_TAGS or node.tag in VOID or ((doubt is None or node.path in doubt) if node.doubt else node.path in plain)
        if known and all(isinstance(c, str) or id(c) in gone for c in node.children):
            gone.add(id(node))
    return gone


def main_text(root: Node, plain: Set[int] = frozenset(), doubt: Set[int] | None = None) -> str:
    """The page's main text, without the branches that the style tree's unimportant nodes make.

    plain, doubt: the paths of the host's unimportant nodes; without them, the page is a host of its own.
    """
    order, holds = place(root)
    gone = _unimportant(root, plain, doubt)
    own = {id(m) for m in order}
    blocks: list[str] = []
    piece: list[str] = []

    def end_block() -> None:
        if words := entities.unescape("".join(piece)).split():
            blocks.append(" ".join(words))
        piece.clear()

    todo: list[tuple[Node | str | None, bool, bool, bool]] = [(root, not order, id(root) not in gone, False)]
    while todo:  # node, whether its own text is read, whether plain nodes are judged, and whether a doubtful branch round it is sure
        node, read, judged, sure = todo.pop()
        if node is None:
            end_block()
            continue
        if isinstance(node, str):
            if read:
                piece.append(node)
            continue
        if id(node) in own:  # a host that repeats its one article says nothing of the article's branches
            judged, sure = id(node) not in gone, False
        elif node.doubt:
            open_to_it = not sure or node.noise
        else:
            open_to_it = judged and node.block and node.tag not in HEADINGS
        if node.tag in MUTE_TAGS or (node.tag and id(node) not in own and id(node) in gone and open_to_it):
            end_block()
            continue
        sure = sure or (node.doubt and doubt is not None and node.path not in doubt)
        within = [(c, id(node) not in holds, judged, sure) for c in reversed(node.children)]
        if node.tag not in INLINE:
            end_block()
            todo.append((None, read, judged, sure))
        todo += within
    end_block()
    return " ".join(blocks)


def extract(pages: DataFrame, noise: DataFrame | None = None) -> DataFrame:
    """Per row: page_id, url, text, n_chars. noise: the hosts' unimportant nodes, computed from pages if not given."""
    noise = noisy_nodes(pages) if noise is None else noise
    paths = lambda doubt: F.collect_list(F.when(F.col("doubt") == doubt, F.col("path")))
    hosts = saved(noise.groupBy("host").agg(paths(False).alias("plain"), paths(True).alias("doubt")), "style-trees")

    @F.pandas_udf("string")
    def host_column(urls: pd.Series) -> pd.Series:
        return pd.Series([host_of(u) for u in urls], dtype=object)

    @F.pandas_udf("string")
    def texts(pages: pd.Series, plain: pd.Series, doubt: pd.Series) -> pd.Series:
        sets: dict[bytes, frozenset[int]] = {}

        def as_set(paths) -> frozenset[int]:
            if paths is None:
                return frozenset()
            key = np.asarray(paths, np.int64).tobytes()
            if key not in sets:
                sets[key] = frozenset(np.frombuffer(key, np.int64).tolist())
            return sets[key]

        return pd.Series([main_text(parse(h), as_set(p), as_set(d)) if h else "" for h, p, d in zip(pages, plain, doubt)], dtype=object)

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    joined = rows.withColumn("host", host_column("url")).join(hosts, "host", "left")
    found = joined.select("page_id", "url", texts.asNondeterministic()("html", "plain", "doubt").alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
