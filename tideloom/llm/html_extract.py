"""Main text of web pages by minimum-cut labelling of their blocks."""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideloom.llm.registry import packed, register, table

#: About so many pages are drawn by a hash of their ids to fit the classifier of blocks.
FIT_PAGES = 2000
#: Cost of giving neighbours in page order, and blocks of one container, different labels. Neighbours
#: cost less the more steps through the tree lie between them, and less where the page's own marks change.
ADJACENT, PROXIMATE, CHANGE = 0.6, 0.9, 0.5
#: Steps between blocks that stand side by side in one container.
BESIDE = 2
#: Nothing inside these elements is text of the page.
SILENT = frozenset("script style template noscript svg math canvas iframe object audio video".split())
#: Elements that never hold the article.
CHROME = frozenset("nav header footer aside form menu dialog button select textarea label fieldset".split())
#: Elements that hold it.
MAIN = frozenset("article main".split())
#: Elements inside a line of text; all others begin and end a block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd mark meter output progress q "
    "rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements without content, which have no end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in class, id and role that name boilerplate.
BOILER = re.compile(
    r"(?:^|[-_ ])(?:ad|ads|advert\w*|banner|breadcrumbs?|byline|comments?|cookies?|consent|disqus|footer|header|login|"
    r"masthead|menu|modal|nav\w*|newsletter|notice|pagination|popup|promo\w*|related|respond|search|share|sharing|"
    r"sidebar|social|sponsor\w*|subscribe|toolbar|widget)(?:$|[-_ ])",
    re.IGNORECASE,
)
#: Elements whose opening ends an open one of the same kind, since its end tag may be left out.
_ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
         "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that leave a head open; any other ends it, since its end tag may be left out.
_IN_HEAD = frozenset("base basefont bgsound head html link meta noscript script style template title".split())
_TITLE_ENDS = re.compile(r"</\s*title\s*>|<(?:body|title)\b", re.IGNORECASE)
_MANY_DIGITS = re.compile(r"&#([0-9]{20,})")
_SCOPES = frozenset("article aside body div dl footer form header html main nav ol section table ul".split())
FEATURES = 12


@dataclass
class _Node:
    tag: str
    number: int
    up: int
    boiler: bool
    main: bool
    #: The nearest element that is not inline, itself included: its number, name, parent and depth.
    at: int = 0
    name: str = ""
    over: int = 0
    depth: int = 1


@dataclass
class Block:
    """A stretch of text between block boundaries, and where it stands."""

    text: str
    container: int
    tag: str
    depth: int
    boiler: bool
    main: bool
    linked: int
    letters: int = field(default=0)
    #: Steps through the tree from the block before.
    distance: int = field(default=0)


class _Reader(HTMLParser):
    """Cuts a page into blocks while it keeps the chain of open elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open = [_Node("", 0, 0, False, False)]
        self.count = 0
        self.silent = 0
        self.links = 0
        self.head = 0
        self.place = 0
        self.pieces: list[str] = []
        self.linked = 0
        self.blocks: list[Block] = []
        self.tags: Counter = Counter()
        #: Parent and depth of every element that is not inline, by number, and where the last block stands.
        self.tree: dict[int, tuple[int, int]] = {0: (0, 1)}
        self.last: int | None = None

    def end_block(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                node = self.open[-1]
                lines = ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "dt", "dd", "td", "th")
                container = node.over if node.name in lines else node.at
                block = Block(text, container, node.name, node.depth, node.boiler, node.main, self.linked)
                block.letters = sum(map(str.isalpha, text))
                block.distance = 0 if self.last is None else self.steps(self.last, node.at)
                self.last = node.at
                self.blocks.append(block)
            self.pieces, self.linked = [], 0

    def steps(self, a: int, b: int) -> int:
        """Steps through the tree between two elements; over all blocks no more than there are tags."""
        taken = 0
        while a != b:
            if self.tree[a][1] < self.tree[b][1]:
                a, b = b, a
            a, taken = self.tree[a][0], taken + 1
        return taken

    def parse_starttag(self, i):
        self.place = i
        return super().parse_starttag(i)

    def parse_marked_section(self, i, report=1):
        # HTML has none: what looks like one is a comment up to the next ">".
        return self.parse_bogus_comment(i, report)

    def end_head(self) -> None:
        for at, node in enumerate(self.open):
            if node.tag in ("head", "title"):
                self.close_to(at)
                return

    def handle_starttag(self, tag, attrs):
        if self.head and not self.silent and tag not in _IN_HEAD:
            self.end_head()
        if tag in VOID:
            if tag == "br":
                self.pieces.append(" ")
            elif tag not in INLINE:
                self.end_block()
            return
        if tag not in INLINE:
            self.end_block()
            self.close_implied(tag)
        up = self.open[-1]
        named = " ".join(v for k, v in attrs if v and k in ("class", "id", "role"))
        boiler = tag in CHROME or bool(named and BOILER.search(named))
        hidden = any(k == "hidden" or (k == "aria-hidden" and v == "true") for k, v in attrs)
        self.count += 1
        inside = tag in MAIN or (up.main and not boiler)
        outside = boiler or hidden or (up.boiler and tag not in MAIN)
        node = _Node(tag, self.count, up.number, outside, inside, up.at, up.name, up.over, up.depth)
        if tag not in INLINE:
            node.at, node.name, node.over, node.depth = self.count, tag, up.number, up.depth + 1
            self.tree[self.count] = (up.at, up.depth + 1)
        self.open.append(node)
        self.tags[tag] += 1
        if tag in SILENT:
            self.silent += 1
        if tag == "a":
            self.links += 1
        if tag in ("head", "title"):
            self.head += 1
        if tag == "title" and not self.get_starttag_text().endswith("/>"):
            # Tags in a title are text of it, but one that is never closed ends with the head.
            end = _TITLE_ENDS.search(self.rawdata, self.place + 1)
            if end and end.group().startswith("</"):
                self.set_cdata_mode(tag)

    def close_implied(self, tag: str) -> None:
        ends = _ENDS.get(tag, {"p"} if tag not in ("span",) else set())
        for at in range(len(self.open) - 1, 0, -1):
            node = self.open[at]
            if node.tag in ends:
                self.close_to(at)
                return
            if node.tag in _SCOPES:
                return

    def close_to(self, at: int) -> None:
        for node in self.open[at:]:
            self.tags[node.tag] -= 1
            self.silent -= node.tag in SILENT
            self.links -= node.tag == "a"
            self.head -= node.tag in ("head", "title")
        del self.open[at:]

    def handle_endtag(self, tag):
        if tag in VOID:
            return
        if tag not in INLINE:
            self.end_block()
        # An end tag of nothing that is open is not searched for.
        for at in range(len(self.open) - 1, 0, -1) if self.tags[tag] else ():
            if self.open[at].tag == tag:
                self.close_to(at)
                return
            if tag in INLINE and self.open[at].tag not in INLINE:
                return

    def handle_data(self, data):
        if self.head and not self.silent and self.open[-1].tag == "head" and not data.isspace():
            self.end_head()
        if self.silent or self.head:
            return
        self.pieces.append(data)
        if self.links:
            self.linked += sum(map(str.isalpha, data))


def blocks_of(html: str | None) -> list[Block]:
    """The blocks of a page in order; none for a null, empty or text-free page."""
    reader = _Reader()
    # Python refuses to read thousands of digits as a number.
    reader.feed(_MANY_DIGITS.sub(lambda m: f"&#{m[1].lstrip('0')[:8] or 0}", html or ""))
    reader.close()
    reader.end_block()
    return reader.blocks


def features(blocks: Sequence[Block]) -> np.ndarray:
    """What the classifier sees of each block, with a constant last."""
    rows = []
    for n, b in enumerate(blocks):
        words = b.text.split()
        rows.append(
            (
                math.log1p(len(words)) / 4,
                b.linked / max(1, b.letters),
                sum(w[-1] in ".!?," for w in words) / len(words),
                b.boiler,
                b.main,
                b.tag == "p",
                b.tag == "li",
                b.tag.startswith("h") and len(b.tag) == 2,
                n / len(blocks),
                min(b.depth, 20) / 20,
                len(words) < 4,
                1.0,
            )
        )
    return np.array(rows, float).reshape(-1, FEATURES)


def weak_labels(blocks: Sequence[Block]) -> list[int | None]:
    """1 inside the page's own article element, 0 in its own chrome, None elsewhere."""
    return [0 if b.boiler else 1 if b.main else None for b in blocks]


#: Weights where no page labels itself, and to which few labels are pulled: prose is long, closed by marks and free of links.
DEFAULT = np.array([4.0, -4.0, 2.0, -4.0, 4.0, 0.5, -1.0, 0.5, 0.0, 0.0, -1.0, -1.5])
#: The page's own marks among the features. They are the labels of the fit, so no weight is learned for them.
MARKS = [3, 4]


def train(design: np.ndarray, y: np.ndarray, times: np.ndarray, steps: int = 30) -> np.ndarray:
    """Logistic regression of rows that occur ``times`` often, by Newton steps with a pull to ``DEFAULT``."""
    beta = DEFAULT.copy()
    pull = np.eye(FEATURES) * max(1.0, 0.002 * times.sum())
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        hessian = (design * (times * p * (1 - p))[:, None]).T @ design + pull
        step = np.linalg.solve(hessian, design.T @ (times * (y - p)) - pull @ (beta - DEFAULT))
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def min_cut(content: np.ndarray, boiler: np.ndarray, edges: Sequence[tuple[int, int, float]]) -> np.ndarray:
    """Which nodes are on the source's side of a minimum cut.

    ``content[i]`` is paid where node i is labelled boilerplate and ``boiler[i]`` where it is
    labelled content; an edge's cost is paid where its ends differ. Dinic's algorithm: breadth
    first levels, then blocking flows along them. Of several minimum cuts the one with the
    fewest content nodes is taken.
    """
    n = len(content)
    source, sink = n, n + 1
    graph: list[list[list]] = [[] for _ in range(n + 2)]

    def connect(a: int, b: int, there: float, back: float) -> None:
        graph[a].append([b, there, len(graph[b])])
        graph[b].append([a, back, len(graph[a]) - 1])

    for i in range(n):
        # What both terminals could send straight through never matters.
        spare = min(content[i], boiler[i])
        connect(source, i, content[i] - spare, 0.0)
        connect(i, sink, boiler[i] - spare, 0.0)
    for a, b, cost in edges:
        connect(a, b, cost, cost)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for b, room, _ in graph[a]:
                if room > 1e-12 and level[b] < 0:
                    level[b] = level[a] + 1
                    queue.append(b)
        if level[sink] < 0:
            return np.array([x >= 0 for x in level[:n]])
        at, path = [0] * (n + 2), []
        a = source
        while True:
            if a == sink:
                amount = min(e[1] for e in path)
                for e in path:
                    e[1] -= amount
                    graph[e[0]][e[2]][1] += amount
                first = next(k for k, e in enumerate(path) if e[1] <= 1e-12)
                a = graph[path[first][0]][path[first][2]][0]
                del path[first:]
            while at[a] < len(graph[a]):
                e = graph[a][at[a]]
                if e[1] > 1e-12 and level[e[0]] == level[a] + 1:
                    break
                at[a] += 1
            if at[a] < len(graph[a]):
                path.append(graph[a][at[a]])
                a = path[-1][0]
            elif path:
                e = path.pop()
                a = graph[e[0]][e[2]][0]
                at[a] += 1
            else:
                break


def label(blocks: Sequence[Block], beta: np.ndarray) -> np.ndarray:
    """True where a block is content."""
    if not blocks:
        return np.zeros(0, bool)
    logit = features(blocks) @ beta
    content, boiler = np.logaddexp(0, logit), np.logaddexp(0, -logit)
    edges, last = [], {}

    def join(a: int, b: int, cost: float) -> None:
        same = blocks[a].boiler == blocks[b].boiler and blocks[a].main == blocks[b].main
        edges.append((a, b, cost if same else cost * CHANGE))

    for i, b in enumerate(blocks):
        if i:
            join(i - 1, i, ADJACENT * BESIDE / max(BESIDE, b.distance))
        before = last.get(b.container)
        if before is not None:
            join(before, i, PROXIMATE)
        last[b.container] = i
    return min_cut(content, boiler, edges)


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", fit_pages: int = FIT_PAGES) -> np.ndarray:
    """Weights of the block classifier, learned from pages that mark their article themselves.

    About ``fit_pages`` pages are drawn by a hash of their ids (all, where there are fewer); blocks
    inside an article or main element are positive, those in chrome negative; the weights learned are of
    the text alone (``MARKS`` are left out), so they tell blocks apart on pages without marks. The sample being
    bounded, its distinct feature rows are counted over the cluster and fitted on the driver. Where
    no page marks both kinds, ``DEFAULT`` weights serve.
    """
    n = pages.count()
    rate = min(1.0, fit_pages / max(1, n))
    chance = F.pmod(F.xxhash64(F.col(id_col), F.lit(29)), F.lit(1_000_003)) / 1_000_003
    drawn = pages.where(chance < rate).select(F.col(html_col).alias("_html"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ys = [], []
            for html in batch["_html"]:
                blocks = blocks_of(html.as_py())
                seen = features(blocks).round(2)
                seen[:, MARKS] = 0.0
                for x, y in zip(seen.tolist(), weak_labels(blocks)):
                    if y is not None:
                        rows.append(x)
                        ys.append(y)
            yield pa.RecordBatch.from_pydict(
                {"x": pa.array(rows, pa.list_(pa.float64())), "y": pa.array(ys, pa.int32())}
            )

    found = drawn.mapInArrow(parse, "x array<double>, y int").groupBy("x", "y").agg(F.count("*").alias("n"))
    found = found.toArrow()
    y = found["y"].to_numpy()
    if not len(y) or y.min() == y.max():
        return DEFAULT
    x = np.array(found["x"].to_pylist())
    return train(x, y, found["n"].to_numpy())


def extract(
    pages: DataFrame,
    beta: np.ndarray,
    id_col: str = "page_id",
    html_col: str = "html",
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per row of ``pages``: ``_kept`` (a struct of the ``keep`` columns), ``_page_id, _text``.

    A page is cut into blocks where elements other than inline ones begin and end. Scripts,
    styles, comments, the head and markup are never text; character references are decoded; white
    space inside a block becomes one space. A logistic classifier of the blocks gives each its
    terminal capacities, and neighbours in page order and in one container are joined by smoothness
    edges, weaker with the distance in the tree and across the borders of marked chrome or article;
    the minimum cut separates content from boilerplate. So a short line between paragraphs stays
    with them though alone it would look like boilerplate. The content blocks are joined in page
    order by one space.

    A null, empty or text-free page has the empty text, and so has a page of boilerplate only.
    A head ends where anything opens that cannot stand in one, also without its end tag, and a
    declaration that HTML does not know is a comment up to its ``>``. Every page is judged alone, so repeated rows agree.
    """
    named = pages.select(*packed(keep), F.col(id_col).alias("_page_id"), F.col(html_col).alias("_html"))
    out = named.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for html in batch["_html"]:
                blocks = blocks_of(html.as_py())
                texts.append(" ".join(b.text for b, kept in zip(blocks, label(blocks, beta)) if kept))
            columns = {name: batch[name] for name in out}
            yield pa.RecordBatch.from_pydict(columns | {"_text": pa.array(texts, pa.string())})

    return named.mapInArrow(run, named.select(*out, F.lit("").alias("_text")).schema)


@register("op10_html_extract")
def op10_html_extract(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    found = extract(pages, fit(pages), keep=("url",))
    return found.select(
        F.col("_page_id").alias("page_id"), "_kept.url", F.col("_text").alias("text"), F.length("_text").cast("long").alias("n_chars")
    )
