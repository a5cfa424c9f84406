"""Main text of web pages by consensus of their hosts.

Each page is parsed, once over and in time linear in its length, and its containers are scored by their clean text: what is not in links
and not marked as boilerplate. The smallest container with more than half of it is the page's core; what stands around the core is
added level by level, unless it is made of links, is a mere label or a notice. The page votes for the generalised path of tags and
classes of what it took, and against those of what it left out. Spark adds up the votes of a host, and each page is extracted again: from
the containers on the host's winning paths, with what the page itself holds for article text and the host does not reject. So a page on
which a box outgrows the article, or which has another template, is told by its host or left to itself.

Names of classes and ids are no veto inside an article: there, doubtful ones ("more", "side") count only beside a majority of links.

Nulls: null or empty html gives an empty text; a null url has the host "". Very long pages and any nesting are read whole. Cut-off, unclosed
and misnested markup gives a tree. Ties between containers can't be, since only one holds more than half; between paths of equal votes the
smaller string wins. Repeated rows stay, and each votes. Clashing columns of the input are carried, but for ``text``, which is replaced. An
empty table gives an empty one.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postalloom.llm.common import cut, row, table, to_python

NAME = "op2_consensus_extract"
ORACLE = None

#: A path counts with at least this share of the votes of its host's most frequent one, and of such paths the MOST_PATHS most frequent.
LEAST_SHARE = 0.1
MOST_PATHS = 20
#: Up to so many rows of winning paths are broadcast (at most MOST_PATHS * MOST_PATH characters a side, some 200 as a rule); more are joined by a salted shuffle.
MOST_BROADCAST = 200_000
SALTS = 32

#: Comments, declarations and tags; a tag whose quotes don't close ends at the next ">".
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*))(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Their content is no markup; it ends at their own end tag only.
RAW = frozenset(("script", "style", "textarea", "title", "noscript", "xmp", "iframe", "noembed", "noframes"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are never article text.
DROPPED = RAW | frozenset("head nav aside footer form button select option svg template menu dialog canvas audio video object applet fieldset label datalist".split())
BLOCKS = frozenset("address article blockquote body center dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 header hgroup hr html li main ol p pre section summary table tbody td tfoot th thead tr ul br caption".split())
CONTAINERS = frozenset("article body center details div main section td blockquote".split())
#: An end tag, or the start tag of the second set, closes an open element of the first.
CLOSED_BY = {"p": BLOCKS - {"br", "body", "html"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody"}, "th": {"td", "th", "tr", "tbody"}, "option": {"option"}}
#: Open elements beyond which an implied end doesn't reach.
SCOPES = frozenset("html body table td th ul ol dl div article section main aside nav footer header form blockquote figure button".split())
#: Words of class, id and role that mark what is not the article.
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners billboard sponsor sponsored sponsors promo promos promotion promoted "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager masthead topbar footer bottombar colophon copyright "
    "sidebar aside related recommended recommendations trending tagcloud comment comments commentlist disqus respond replies "
    "share sharing social newsletter subscribe subscription signup login cookie cookies consent gdpr notice notices popup modal overlay paywall toolbar "
    "complementary contentinfo".split()
)
#: Words that mark it outside an article only; inside one, they need a majority of links beside them.
DOUBT = frozenset("header foot legal side rail widget widgets more popular tags toc skip search follow alert reply reviews discussion hidden".split())
SURE = frozenset(("article", "main"))
CONTENT = frozenset("content article post entry story main body text articlebody maincontent".split())
#: These tell what stands beside the content, and can name a frame around both.
LAYOUT = frozenset("nav navbar navigation sidebar footer aside topbar menu toolbar banner".split())
#: A container beside the core is part of the article from so many characters on, or so large a share of the core.
LEAST_BESIDE, LEAST_OF_CORE = 40, 0.05
#: Up to so many characters a container beside the core with one of these is a notice.
NOTICE = re.compile(r"\u00a9|\bcopyright\b|\ball rights reserved\b|\bcookies?\b|\bprivacy policy\b", re.I)
MOST_NOTICE = 300
#: A container within the core that the host agrees on is taken alone if it holds so much of it.
NEARLY_ALL = 0.95
#: Longer paths are no template; such a page stands for itself.
MOST_PATH = 2000
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
WORD = re.compile(r"[a-z]+|[0-9]+")
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


@dataclass(slots=True, eq=False)
class Node:
    tag: str
    attrs: dict[str, str]
    parent: Node | None
    children: list = field(default_factory=list)  # nodes and strings in page order
    noise: bool = False
    doubt: bool = False
    start: int = 0  # its place in page order
    end: int = 0  # and that of the last node within
    clean: int = 0  # characters of text outside links and boilerplate
    linked: int = 0  # characters in links

    def within(self, other: Node) -> bool:
        return other.start <= self.start <= other.end


def attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(source)} if source.strip(" /\t\n\r\f") else {}


def marks(tag: str, attrs: dict[str, str], inside: bool) -> tuple[frozenset, bool]:
    """(what makes an element no part of an article, whether that is doubtful); ``inside``: it stands in an article."""
    if tag in DROPPED or tag == "header" and not inside:
        return frozenset((tag,)), False
    if not attrs:
        return frozenset(), False
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or "style" in attrs and HIDING.search(attrs["style"]):
        return frozenset(("hidden",)), False
    names = " ".join([attrs[k] for k in ("class", "id", "role") if k in attrs])
    if not names or tag in SURE or tag in ("html", "body"):
        return frozenset(), False
    words = frozenset(WORD.findall(CAMEL.sub(" ", names).lower()))
    if found := words & NOISE:
        return found, False
    return frozenset(), bool(words & DOUBT) and not words & CONTENT


class Tree:
    """The nodes of a page in page order, the first is the root. Unknown ends are skipped, missing ends are implied, what is open at the end of the page ends there.

    Open elements are kept as a stack with the places of each tag in it, so that no tag looks at more than it closes.
    """

    def __init__(self, source: str):
        root = Node("", {}, None)
        self.nodes = [root]
        self.open: list[Node] = [root]
        self.places: dict[str, list[int]] = {}
        self.framed: list[Node] = []  # open elements that a layout word marks
        at = 0
        while at < len(source):
            m = TOKEN.search(source, at)
            if m is None:
                self.open[-1].children.append(source[at:])
                break
            if m.start() > at:
                self.open[-1].children.append(source[at : m.start()])
            at = m.end()
            closing, name, rest = (m[1], m[2], m[3]) if m[2] is not None else (m[4], m[5], m[6])
            if name is None:
                continue
            tag = name.lower()
            if closing:
                self._end(tag)
                continue
            self._begin(tag, rest)
            if tag in RAW:
                end = _raw_end(tag).search(source, at)
                at = end.end() if end else len(source)
        for node in reversed(self.nodes):  # children come before their parents
            self.measure(node)

    def _last(self, tags) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def _close(self, place: int) -> None:
        while len(self.open) > place:
            node = self.open.pop()
            self.places[node.tag].pop()
            if self.framed and self.framed[-1] is node:
                self.framed.pop()

    def _end(self, tag: str) -> None:
        place = self._last((tag,))
        if place and (tag in REACHING or place >= self._last(HOLDING)):  # an inline or block end does not reach out of these
            self._close(place)

    def _begin(self, tag: str, rest: str) -> None:
        implied = self._last([t for t, by in CLOSED_BY.items() if tag in by])
        if implied and implied >= self._last(SCOPES):
            self._close(implied)
        attrs = attributes(rest)
        inside = any(self.places.get(t) for t in SURE)
        words, doubt = marks(tag, attrs, inside)
        node = Node(tag, attrs, self.open[-1], [], bool(words), doubt, len(self.nodes))
        self.open[-1].children.append(node)
        self.nodes.append(node)
        if tag in SURE and not node.noise:  # what holds the article is named after what stands beside it
            for frame in self.framed:
                frame.noise = False
            self.framed.clear()
        if tag not in VOID and tag not in RAW and not rest.rstrip().endswith("/"):
            self.places.setdefault(tag, []).append(len(self.open))
            self.open.append(node)
            if words and words <= LAYOUT and tag not in DROPPED:
                self.framed.append(node)

    def measure(self, node: Node) -> None:
        """The text below a node, from what its children have."""
        node.end = max(node.end, node.start)
        node.clean = node.linked = 0
        for x in node.children:
            if isinstance(x, str):
                node.clean += len(x.strip())
            elif not (x.noise or x.doubt):
                node.clean += x.clean
                node.linked += x.linked
        if node.tag == "a":
            node.linked, node.clean = node.linked + node.clean, 0
        if node.parent is not None:
            node.parent.end = max(node.parent.end, node.end)


#: End tags that close an element whatever it stands in, and elements that other ends don't reach out of.
REACHING = frozenset("article main section body html table tr tbody div".split())
HOLDING = ("td", "th", "table", "article", "body")


@lru_cache
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}\s*>|</{re.escape(tag)}\Z", re.I)


def step(node: Node) -> str:
    """Tag and classes; digits are generalised, so numbered classes of one template agree."""
    classes = sorted({re.sub(r"\d+", "#", c).replace("/", "|") for c in node.attrs.get("class", "").lower().split()})
    return ".".join([node.tag, *classes])


def path_of(node: Node) -> str:
    """The steps from the top; "" if they are too long."""
    steps, size = [], 0
    while node is not None and node.tag and size <= MOST_PATH:
        steps.append(step(node))
        size += len(steps[-1])
        node = node.parent
    return ("/".join(reversed(steps)) or "/") if size <= MOST_PATH else ""


def on_paths(tree: Tree, paths: list[str]) -> dict[str, list[Node]]:
    """The nodes on each path, none within another of its path, in page order; boilerplate is left out."""
    found: dict[str, list[Node]] = {p: [] for p in paths}
    by_steps: dict[tuple, str] = {}
    starts: set[tuple] = set()
    for p in paths:
        steps = () if p == "/" else tuple(p.split("/"))
        by_steps[steps] = p
        starts |= {steps[:i] for i in range(len(steps) + 1)}
    stack: list[tuple[Node, tuple]] = [(tree.nodes[0], ())]
    while stack:  # only what the paths lead to is visited
        node, steps = stack.pop()
        path = by_steps.get(steps)
        if path is not None and not (found[path] and node.within(found[path][-1])):
            found[path].append(node)
        for x in reversed(node.children):
            if isinstance(x, Node) and not x.noise and (down := (*steps, step(x))) in starts:
                stack.append((x, down))
    return found


def blocks(node: Node, without: frozenset[int] | set[int] = frozenset()) -> list[str]:
    """The text of each block below ``node`` in page order, without what is noise and without the nodes at the places ``without``."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        whole = " ".join(html.unescape("".join(run)).split())
        if whole:
            out.append(whole)
        run.clear()

    stack: list[object] = [node]
    while stack:
        item = stack.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            run.append(item)
        elif item is node or not (item.noise or item.doubt or item.start in without):
            if item.tag in BLOCKS:
                flush()
                stack.append(None)
            stack.extend(reversed(item.children))
    flush()
    return out


def elements(node: Node) -> list[Node]:
    return [x for x in node.children if isinstance(x, Node) and not (x.noise or x.doubt)]


def is_sure(node: Node) -> bool:
    return node.tag in SURE or node.attrs.get("role") == "main"


@dataclass
class Choice:
    """What a page takes for its article: ``top`` without the nodes ``left``. ``core`` is the container that decided it, ``beside`` what was added to it."""

    top: Node
    core: Node
    beside: list[Node]
    left: list[Node]

    def text(self, without: list[Node]) -> str:
        return "\n".join(blocks(self.top, {x.start for x in (*self.left, *without)}))


def settle(tree: Tree, inside: Node) -> None:
    """Inside an article, names that leave room for doubt count only beside a majority of links. Measures again what that changes, each node once."""
    within = tree.nodes[inside.start : inside.end + 1]
    if not any(x.doubt for x in within):
        return
    for node in reversed(within):
        tree.measure(node)
        node.doubt = node.doubt and node.clean <= node.linked
    up = inside.parent
    while up is not None:
        tree.measure(up)
        up = up.parent


def choose(tree: Tree) -> Choice | None:
    """The page's own article, None if it has no text."""
    root = tree.nodes[0]
    measure = "clean" if root.clean else "linked"
    whole = getattr(root, measure)
    if not whole:
        return None
    core = here = root
    while here is not None:
        if here.tag in CONTAINERS:
            core = here
        here = next((x for x in elements(here) if 2 * getattr(x, measure) > whole), None)
    up = core
    while up is not None and not is_sure(up):
        up = up.parent
    if up is not None:
        core = up
    settle(tree, core)
    size = getattr(core, measure)
    top, beside, left = core, [], []
    passed: list[Node] = []
    here = core
    while here.parent is not None and not (is_sure(core) and 4 * size >= 3 * getattr(root, measure)):
        child, here = here, here.parent
        added = any(isinstance(x, str) and x.strip() for x in here.children)
        for x in here.children:
            if isinstance(x, str) or x is child or x.noise or not (x.clean or x.linked) or x.doubt and x.tag in CONTAINERS:
                continue
            if _belongs(x, size):
                added = True
                x.doubt = False
                beside.append(x)
            else:
                passed.append(x)
        if added:
            top = here
            left += passed
            passed = []
    return Choice(top, core, beside, left + passed)


def _belongs(x: Node, size: int) -> bool:
    """Whether an element beside a core of ``size`` characters is part of the article."""
    if x.linked >= max(x.clean, 1):
        return False
    if x.tag not in CONTAINERS:
        return True
    if x.clean < LEAST_BESIDE and x.clean < LEAST_OF_CORE * size:
        return False
    return x.clean > MOST_NOTICE or not NOTICE.search(" ".join(blocks(x)))


def vote(source: str | None) -> list[tuple[str, bool]]:
    """(path, whether it is article) of what the page took, its core first, and of the containers that it left out."""
    own = choose(Tree(source or ""))
    if own is None:
        return []
    found = {path_of(x): False for x in own.left if x.tag in CONTAINERS}
    found |= {path_of(x): True for x in (own.core, *own.beside) if x.tag in CONTAINERS or x is own.core}
    found.pop("", None)
    first = path_of(own.core)
    return sorted(found.items(), key=lambda v: v[0] != first)


def covered(x: Node, nodes: list[Node]) -> bool:
    """Whether ``x`` is one of ``nodes``, which are in page order and apart, or within one."""
    at = bisect_right(nodes, x.start, key=lambda n: n.start) - 1
    return at >= 0 and x.within(nodes[at])


def extract(source: str | None, taken: list[str] | None, rejected: list[str] | None = None) -> str:
    """The article: what is on the first of the host's paths ``taken`` that holds text here, with what the page itself takes and the host does not reject."""
    tree = Tree(source or "")
    own = choose(tree)
    if own is None:
        return "\n".join(blocks(tree.nodes[0]))
    by_path = on_paths(tree, [*(taken or ()), *(rejected or ())])
    refused = {x.start for p in rejected or () for x in by_path[p]}
    others = [x for x in own.beside if x.start in refused]
    for path in taken or ():
        found = [x for x in by_path[path] if x.clean or x.linked]
        if not found or covered(own.core, found) and found[0] is own.core:
            continue
        if all(x.within(own.core) for x in found):
            if sum(x.clean for x in found) >= NEARLY_ALL * own.core.clean and not own.beside:
                return text_of(found)
            break
        if is_sure(own.core) and own.core.start not in refused:
            break
        if all(x.start in refused or covered(x, found) for x in (own.core, *own.beside)):
            return text_of(found)
        if own.core.start in refused and all(x.within(own.top) for x in found):
            return own.text([own.core, *(x for x in others if not covered(x, found))])
    return own.text(others)


def text_of(nodes: list[Node]) -> str:
    return "\n".join([t for n in nodes for t in blocks(n)])


def host_of(url: Column) -> Column:
    """What stands between ``://`` and the next /, ?, # or the end, without user and port, in lower case; "" if there is none."""
    host = F.regexp_extract(F.lower(url), r"://(?:[^/?#]*@)?([^/?#:]*)", 1)
    return F.coalesce(host, F.lit(""))


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, taken, rejected): the paths with at least LEAST_SHARE of the votes of a host, most votes first; taken: most of a path's votes are for it."""
    voted = pages.select(host_of(F.col("url")).alias("host"), "html")
    schema = "host string, path string, inside boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths, sides = [], [], []
            for host, source in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
                for path, inside in vote(source.as_py()):
                    hosts.append(host)
                    paths.append(path)
                    sides.append(inside)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(sides, pa.bool_())], ["host", "path", "inside"])

    votes = to_python(voted).mapInArrow(run, schema).groupBy("host", "path").agg(F.count_if("inside").alias("yes"), F.count("*").alias("n"))
    votes = cut(votes)
    best = votes.groupBy("host").agg(F.max("n").alias("most"))
    kept = votes.join(best.withColumnRenamed("host", "_host"), F.col("host") == F.col("_host")).where(F.col("n") >= LEAST_SHARE * F.col("most"))
    taken = 2 * F.col("yes") > F.col("n")
    heaviest = F.struct((-F.col("n")).alias("n"), "path")
    ranked = kept.groupBy("host").agg(*[F.slice(F.sort_array(F.collect_list(F.when(side, heaviest))), 1, MOST_PATHS).alias(name) for name, side in (("taken", taken), ("rejected", ~taken))])
    return ranked.select("host", F.col("taken.path").alias("taken"), F.col("rejected.path").alias("rejected"))


def extracted(pages: DataFrame, text: str = "text") -> DataFrame:
    """``pages`` without html but with the main text. Markup is read twice and shuffled only where the hosts
    are too many to broadcast their paths; then a host's pages go to SALTS tasks.
    """
    winners = cut(host_paths(pages))
    named = pages.select(row(pages, "html", text), "html", host_of(F.col("url")).alias("host"))
    paths = winners.select(F.col("host").alias("of"), "taken", "rejected")
    if winners.count() <= MOST_BROADCAST:
        joined = named.join(F.broadcast(paths), F.col("host") == F.col("of"), "left")
    else:
        salted = named.withColumn("salt", F.pmod(F.xxhash64("row", "html"), F.lit(SALTS)))
        spread = paths.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = salted.join(spread, (F.col("host") == F.col("of")) & (F.col("salt") == F.col("place")), "left")
    wanted = joined.select("row", "html", "taken", "rejected")
    schema = T.StructType([wanted.schema["row"], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c) for c in ("html", "taken", "rejected")]
            texts = [extract(*(x.as_py() for x in one)) for one in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], schema.names)

    return to_python(wanted).mapInArrow(run, schema).select("row.*", F.col("text").alias(text))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text and its number of code points."""
    done = extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return done.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
