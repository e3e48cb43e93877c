"""Main text of web pages by minimum-cut labelling.

The page is read into blocks: runs of text between block-level tags, with the tags open around them.
A logistic classifier over each block's surroundings and text gives the log-odds of content, which become
capacities from a source or to a sink. Neighbours in page order, and blocks under the same open
element (by a node of that element), are tied by smoothness edges on the same scale, which weaken where
containers differ. The minimum cut by maximum flow is the labelling of least cost; the blocks on the
source's side are the main text.

The classifier is fitted on a bounded sample of about SAMPLE_PAGES pages, spread by hash over the table:
blocks in elements whose names say what they hold (article or main against nav, footer, aside, form or
header) are its labelled rows, each also without that knowledge, so that text and layout learn to tell
them apart by themselves. Weights are drawn to PRIOR, which alone counts where nothing is labelled.

Defined cases: a null or empty page gives an empty text; pages without tags are one block; unclosed,
stray and wrongly nested tags are taken as browsers do in the main (a paragraph ends at the next
block tag, an unknown end tag is skipped); repeated rows give equal rows; an empty table gives an
empty result; pages are read whole; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Element names of the language by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "template", "iframe", "svg", "math", "object", "canvas", "video", "audio", "textarea", "title", "xmp", "noembed", "noframes")
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr td th".split())
SECTIONS = frozenset("article aside body div footer form header html main nav section table".split())
NO_TEXT = frozenset("head script style noscript template iframe svg math object canvas video audio textarea title xmp noembed noframes select option button datalist dialog input fieldset legend".split())
#: Elements that don't show and so don't end a block.
QUIET = frozenset("script style noscript template".split())
AWAY = frozenset("nav footer aside form menu".split())
AWAY_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert alertdialog dialog toolbar".split())
#: Words in class and id names.
AWAY_NAMES = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|menus|sidebar|aside|rail|masthead|topbar|breadcrumb|breadcrumbs|crumbs|ad|ads|adv|advert|adverts|advertisement|adsense|banner|promo|promos|promotion|"
    r"sponsor|sponsored|sponsors|cookie|cookies|consent|gdpr|notice|notices|popup|newsletter|subscribe|subscription|signup|login|signin|register|share|sharing|social|related|recommended|recommendations|more-?stories|"
    r"comment|comments|commentlist|disqus|pagination|pager|paging|outbrain|taboola)(?=$|[\s_-]|\d)",
    re.I,
)
#: Such words that can also name a part of a text, and say less inside one.
DOUBTFUL_NAMES = re.compile(r"(?:^|[\s_-])(?:header|footer|alert|modal|overlay|reply|replies|respond|responses|discussion|search|toolbar|widget|widgets|tags|tagcloud|skip|copyright|disclaimer|toc)(?=$|[\s_-]|\d)", re.I)
HOME_NAMES = re.compile(r"(?:^|[\s_-])(?:article|content|main|post|entry|story|body|text|blog|page-?content|maincontent|post-?body|article-?body|hentry)(?=$|[\s_-]|\d)", re.I)
#: Names in which those words say something else: a text's own head, or that its page has a frame.
OWN_NAMES = re.compile(r"(?:article|post|entry|story|content|text)[_-]{1,2}(?:header|head|title|tags)|(?:has|have|with|no|without)[_-][\w-]+|(?:header|menu|footer|sidebar)[_-](?:fixed|left|right|open|closed|enabled|layout)", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
ENDED = re.compile(r"[.!?…:;\"'”’»)]$")


#: What the classifier looks at; what says outright whether a block is content is left out of a labelled row's second copy.
FEATURES = ("bias", "away", "away_name", "doubtful_name", "article", "home_name", "heading", "paragraph", "long", "ended", "links")
TOLD = (1, 2, 3, 4, 5)
#: Weights in log-odds of content that fitting starts from, and how far they are believed.
PRIOR, SPREAD = (0.5, -8.0, -8.0, -2.5, 3.0, 1.5, 1.0, 1.0, 1.5, 0.7, -4.0), 1.0
#: Pages that the classifier is fitted on, about; labelled rows that they count as, at most.
SAMPLE_PAGES, WORTH, ROUNDS = 2_000, 200, 30


@dataclass(frozen=True)
class Model:
    """The classifier's weights, and the smoothness edges in the same log-odds."""

    weights: tuple[float, ...] = PRIOR
    order_edge: float = 1.0
    order_edge_apart: float = 0.25
    dom_edge: float = 0.5


@dataclass(slots=True)
class Element:
    tag: str
    parent: "Element | None"
    away: bool = False  # an element of the page's frame
    away_name: bool = False
    doubtful: bool = False
    article: bool = False
    home: bool = False
    silent: bool = False
    depth: int = 0


@dataclass(slots=True)
class Block:
    at: Element
    parts: list = field(default_factory=list)
    linked: int = 0
    heading: bool = False
    paragraph: bool = False
    text: str = ""


def _element(tag: str, attrs: str, parent: Element | None) -> Element:
    e = Element(tag, parent)
    if parent is not None:
        e.away, e.away_name, e.doubtful = parent.away, parent.away_name, parent.doubtful
        e.article, e.home, e.silent, e.depth = parent.article, parent.home, parent.silent, parent.depth + 1
    if tag in NO_TEXT:
        e.silent = True
    if tag in AWAY or (tag == "header" and not e.article):
        e.away = True
    named = ""
    if attrs.strip(" /"):
        for m in ATTR.finditer(attrs):
            k, v = m[1].lower(), m[2] or m[3] or m[4] or ""
            if k in ("class", "id"):
                named += " " + v
            elif k == "role":
                e.away = e.away or v.lower() in AWAY_ROLES
                e.article = e.article or v.lower() in ("main", "article")
            elif k == "hidden" or (k == "aria-hidden" and v.lower() == "true") or (k == "style" and HIDDEN.search(v)):
                e.silent = True
    if tag in ("article", "main"):
        e.article = True
    if named and tag not in ("html", "body"):
        plain = OWN_NAMES.sub(" ", named)
        known = HOME_NAMES.search(named)
        doubtful, own = DOUBTFUL_NAMES.search(plain), tag in ("article", "main") and known
        if not own and (AWAY_NAMES.search(plain) or (doubtful and not (e.article or e.home))):
            e.away_name = True
        elif doubtful and not own:
            e.doubtful = True
        elif known:
            e.home = True
    return e


#: Open elements that a start tag ends.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("tr", "td", "th", "thead")}
STOPS = frozenset(("ul", "ol", "dl", "table", "select", "body", "html", "article", "section", "div", "main", "nav"))


def blocks_of(page: str) -> list[Block]:
    """The page's blocks of text that is neither markup nor hidden, in order."""
    root = Element("", None)
    open_, out, cur, link = root, [], None, 0
    at, n = 0, len(page)

    def add(s: str) -> None:
        nonlocal cur
        if open_.silent or not s:
            return
        if cur is None:
            if s.isspace():
                return
            e, heading, paragraph = open_, False, False
            while e is not root and e.tag in INLINE:
                e = e.parent
            heading, paragraph = e.tag in ("h1", "h2", "h3", "h4", "h5", "h6"), e.tag in ("p", "blockquote", "pre", "figcaption", "li", "dd")
            cur = Block(e, heading=heading, paragraph=paragraph)
            out.append(cur)
        s = html.unescape(s)
        cur.parts.append(s)
        if link:
            cur.linked += len(s)

    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if page.startswith("<![CDATA[", m.start()):
                add(page[m.start() + 9 : at].removesuffix("]]>"))
            continue
        tag, ends = m[2].lower(), bool(m[1])
        if tag in QUIET:
            pass
        elif tag not in INLINE:
            cur = None
        elif tag in ("br", "td", "th") and cur is not None:
            cur.parts.append(" ")
        if ends:
            e = open_
            while e is not root and e.tag != tag and not (e.tag in SECTIONS and tag not in SECTIONS):
                e = e.parent
            if e.tag == tag and e is not root:
                open_ = e.parent
                if tag == "a":
                    link = 0
            elif tag == "a":
                link = 0
            continue
        if tag in VOID:
            continue
        if tag not in INLINE and tag not in QUIET:
            link = 0
            e = open_
            while e is not root and e.tag in INLINE and e.tag not in ("td", "th"):
                e = e.parent
            if e is not open_ and e.tag == "p":  # a paragraph with inline elements left open
                open_ = e
            if open_.tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
                open_ = open_.parent
        if tag in ENDS:
            e = open_
            while e is not root and e.tag not in STOPS and e.tag not in ENDS[tag]:
                e = e.parent
            if e.tag in ENDS[tag]:
                open_ = e.parent
        if tag == "a":
            link = 1
        if m[3].endswith("/") and tag in ("svg", "path", "math"):
            continue
        open_ = _element(tag, m[3], open_)
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = close.start() if close else n
    for b in out:
        b.text = " ".join("".join(b.parts).split())
    return [b for b in out if b.text]


def features(b: Block) -> tuple[int, ...]:
    """The block's features in the order of FEATURES, in tenths."""
    e, n = b.at, len(b.text)
    out = e.away or e.away_name
    long = min(b.text.count(" ") + 1, 30) // 3
    seen = (1, e.away, e.away_name, e.doubtful, e.article and not out, e.home and not e.article and not out, b.heading, b.paragraph)
    return (*(10 * int(x) for x in seen), long, 10 * bool(ENDED.search(b.text)), 10 * min(b.linked, n) // n)


def score(b: Block, m: Model) -> float:
    """The classifier's log-odds: above 0 for content."""
    return sum(w * x for w, x in zip(m.weights, features(b))) / 10


def labelled_rows(page: str | None) -> list[tuple[tuple[int, ...], int]]:
    """(features, label) of the blocks whose elements say whether they are content, with and without that knowledge."""
    out = []
    for b in blocks_of(page) if page else []:
        e = b.at
        if e.away or (e.article and not e.away_name and not e.doubtful):
            x, y = features(b), int(not e.away)
            out += [(x, y), (tuple(0 if k in TOLD else v for k, v in enumerate(x)), y)]
    return out


def fitted(counts: list[tuple[tuple[int, ...], int, int]]) -> Model:
    """The model of greatest posterior for (features, label, how many rows); the bias stays as it is."""
    total = sum(n for *_, n in counts)
    if not total:
        return Model()
    x = np.array([c[0] for c in counts], float) / 10
    y, n = np.array([c[1] for c in counts], float), np.array([c[2] for c in counts], float) * min(1.0, WORTH / total)
    prior = np.array(PRIOR)
    w = prior.copy()
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-(x @ w)))
        slope = x.T @ (n * (y - p)) - (w - prior) / SPREAD**2
        bend = (x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(w)) / SPREAD**2
        step = np.linalg.solve(bend[1:, 1:], slope[1:])
        w[1:] += step
        if np.abs(step).max() < 1e-9:
            break
    return Model(tuple(np.round(w, 6).tolist()))


class Flow:
    """Maximum flow by shortest augmenting levels; arcs in flat lists."""

    def __init__(self, n: int):
        self.to: list[int] = []
        self.cap: list[int] = []
        self.arcs: list[list[int]] = [[] for _ in range(n)]

    def edge(self, u: int, v: int, forth: int, back: int = 0) -> None:
        self.arcs[u].append(len(self.to))
        self.to.append(v)
        self.cap.append(forth)
        self.arcs[v].append(len(self.to))
        self.to.append(u)
        self.cap.append(back)

    def _levels(self, s: int) -> list[int]:
        level = [-1] * len(self.arcs)
        level[s], queue = 0, deque([s])
        while queue:
            u = queue.popleft()
            for a in self.arcs[u]:
                v = self.to[a]
                if self.cap[a] > 0 and level[v] < 0:
                    level[v] = level[u] + 1
                    queue.append(v)
        return level

    def source_side(self, s: int, t: int) -> list[bool]:
        """Which nodes the source still reaches once the flow is at its maximum."""
        while True:
            level = self._levels(s)
            if level[t] < 0:
                return [x >= 0 for x in level]
            at, path, u = [0] * len(self.arcs), [], s
            while True:
                if u == t:
                    least = min(self.cap[a] for a in path)
                    for a in path:
                        self.cap[a] -= least
                        self.cap[a ^ 1] += least
                    k = next(i for i, a in enumerate(path) if not self.cap[a])
                    u = self.to[path[k] ^ 1]
                    del path[k:]
                    continue
                while at[u] < len(self.arcs[u]):
                    a = self.arcs[u][at[u]]
                    if self.cap[a] > 0 and level[self.to[a]] == level[u] + 1:
                        break
                    at[u] += 1
                if at[u] < len(self.arcs[u]):
                    path.append(a)
                    u = self.to[a]
                elif path:
                    u = self.to[path.pop() ^ 1]
                    at[u] += 1
                else:
                    break


#: Capacities are whole numbers: thousandths of log-odds.
UNIT = 1_000


def labelled(blocks: list[Block], m: Model = Model()) -> list[bool]:
    """True for content: the source's side of the minimum cut."""
    if not blocks:
        return []
    n, groups, own = len(blocks), {}, []
    for b in blocks:
        e = b.at
        while e.parent is not None and e.tag not in SECTIONS:
            e = e.parent
        own.append(groups.setdefault(id(e), len(groups)))
    g = Flow(n + len(groups) + 2)
    s, t = n + len(groups), n + len(groups) + 1
    whole = lambda x: int(round(x * UNIT))
    near, far, dom = whole(m.order_edge), whole(m.order_edge_apart), whole(m.dom_edge)
    for i, b in enumerate(blocks):
        x = whole(score(b, m))
        g.edge(s, i, x) if x > 0 else g.edge(i, t, -x)
        g.edge(i, n + own[i], dom, dom)
        if i:
            edge = near if own[i - 1] == own[i] else far
            g.edge(i - 1, i, edge, edge)
    return g.source_side(s, t)[:n]


def main_text(page: str | None, m: Model = Model()) -> str:
    if not page:
        return ""
    blocks = blocks_of(page)
    keep = labelled(blocks, m)
    return "\n\n".join(b.text for b, ok in zip(blocks, keep) if ok)


def fit(pages: DataFrame, column: str = "html") -> Model:
    """The classifier fitted on about SAMPLE_PAGES pages; what comes to the driver are counts of distinct feature rows."""
    every = -(-pages.count() // SAMPLE_PAGES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for x in b.column(0).to_pylist() for r in labelled_rows(x)]
            yield pa.RecordBatch.from_arrays([pa.array([list(r[0]) for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.int32())], names=["x", "y"])

    some = pages.where(F.pmod(F.xxhash64(column), F.lit(max(1, every))) == 0).select(column)
    counts = some.mapInArrow(run, "x array<int>, y int").groupBy("x", "y").agg(F.count("*").alias("n")).collect()
    return fitted(sorted((tuple(r["x"]), r["y"], r["n"]) for r in counts))


def extract(pages: DataFrame, column: str = "html", model: Model | None = None) -> DataFrame:
    """pages' columns but the html, with text and n_chars; the model is fitted on pages where none is given."""
    m = fit(pages, column) if model is None else model
    kept = pages.drop("text", "n_chars")
    at = kept.columns.index(column)
    fields = kept.schema.fields
    schema = T.StructType([*fields[:at], *fields[at + 1 :], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [*b.columns[:at], *b.columns[at + 1 :], pa.array([main_text(x, m) for x in b.column(at).to_pylist()], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return kept.mapInArrow(run, schema).withColumn("n_chars", F.length("text").cast("long"))


def op8_html_extraction(spark, sf_dir):
    from .common import table

    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
