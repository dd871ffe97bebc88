"""Operator 4: main text of web pages by tag-path ratios."""

from __future__ import annotations

import html as entities
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import steps, without

# Element names of the HTML standard, grouped by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe svg select button noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
AROUND = frozenset("nav footer aside form menu dialog search head".split())
HEAD_OF = frozenset(["header"])
ARTICLE = frozenset("article main".split())
PAGE = frozenset("html body".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Elements that hold parts of a text or a single paragraph, so they aren't a whole article.
PART = frozenset("address blockquote dd dl dt figcaption figure hgroup hr li ol p pre summary table tbody tfoot thead tr ul".split()) | HEADINGS
#: Elements that an opening element of the same group ends.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
STOPS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
# Words in class, id and role that name what stands around an article.
AROUND_WORDS = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|breadcrumbs?|byline-share|comments?|comment-?list|disqus|cookies?|consent|dialog|footer|gdpr|login|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|notification|pager|pagination|popup|promo\w*|recommend\w*|related|search|share|sharing|sidebar|signup|skip|social|sponsor\w*|subscribe|teaser|toolbar|widget|complementary|contentinfo)(?:$|[\s_-])", re.I)
# Those that name what no article is part of; layout names such as "with-sidebar" may stand around one.
NEVER_WORDS = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|comments?|comment-?list|disqus|cookies?|consent|newsletter|promo\w*|recommend\w*|related|sponsor\w*|teaser)(?:$|[\s_-])", re.I)
HEAD_WORDS = re.compile(r"(?:^|[\s_-])header(?:$|[\s_-])", re.I)
ATTRIBUTE = re.compile(r"""(?:^|[\s/"'])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
HIDDEN = re.compile(r"""(?:^|[\s"'])hidden(?:$|[\s=/"'])|display\s*:\s*none""", re.I)
LETTER, NAME_END = re.compile(r"[a-zA-Z]"), re.compile(r"[\s/>]")
STOP = re.compile(r"[\"'>]")
#: Factors on the ratios of paths below elements that are named: by their tag, as no part of any article, or as layout.
AROUND_TAG, NEVER, LAYOUT = 0.0005, 0.005, 0.01
#: Shares of the mean score that a path of content, and a branch beside content, must reach.
STRONG, WEAK = 0.25, 0.1
SPACES = re.compile(r"\s+")
PUNCTUATION = re.compile(r"[.,;:!?…、。，！？；：]")


class Element:
    """An open or closed element: its name, the element above it, and what its path says.

    Paths are numbered; elements of equal names and priors below elements of one path share theirs.
    """

    __slots__ = ("name", "above", "prior", "path", "in_link", "in_article")

    def __init__(self, name: str, above: Element | None, prior: float, path: int):
        self.name, self.above, self.prior, self.path = name, above, prior, path
        self.in_link = name == "a" or above is not None and above.in_link
        self.in_article = name in ARTICLE or above is not None and above.in_article

    def __str__(self) -> str:
        names, x = [], self
        while x is not None and x.above is not None:
            names.append(x.name)
            x = x.above
        return "/".join(reversed(names))


class Node:
    """A run of text: its block and the element that holds it."""

    __slots__ = ("block", "place", "text")

    def __init__(self, block: int, place: Element, text: str):
        self.block, self.place, self.text = block, place, text


class Scanner:
    """Cuts a page into markup and text in time that grows with the page: what didn't end once isn't tried again."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.known: dict[re.Pattern, tuple[int, int]] = {}  # where each pattern isn't met
        self.dead: set[int] = set()  # quotes, met outside of quotes, behind which no tag ends

    def _next(self, pattern: re.Pattern, at: int) -> int:
        """Where the pattern is met next; a search that begins in what another has gone over ends where that did."""
        lo, hi = self.known.get(pattern, (0, -1))
        if not lo <= at <= hi:
            m = pattern.search(self.page, at)
            self.known[pattern] = (at, m.start() if m else len(self.page))
        return self.known[pattern][1]

    def tag_end(self, at: int) -> int | None:
        """Where the > of a tag stands whose attributes begin at `at`; the page's end if it is cut; null if a quote stays open."""
        met = []
        while True:
            at = self._next(STOP, at)
            if at == len(self.page) or self.page[at] == ">":
                return at
            met.append(at)
            close = -1 if at in self.dead else self.page.find(self.page[at], at + 1)
            if close < 0:
                self.dead.update(met)
                return None
            at = close + 1

    def __iter__(self) -> Iterator[tuple[str, int, int, str, str]]:
        """(kind, begin, end, name, attributes) of all markup: kinds "<", "</", "<!" and "[" for marked text; send() moves on."""
        page, n, at = self.page, len(self.page), 0
        while (at := page.find("<", at)) >= 0:
            found = None
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                found = ("<!", at, n if end < 0 else end + 3, "", "")
            elif page.startswith("<![CDATA[", at):
                end = page.find("]]>", at + 9)
                found = ("[", at, n if end < 0 else end + 3, "", "")
            elif page.startswith(("<!", "<?"), at):
                end = page.find(">", at)
                found = ("<!", at, n if end < 0 else end + 1, "", "")
            else:
                close = page.startswith("</", at)
                first = at + 1 + close
                name = self._next(NAME_END, first) if LETTER.match(page, first) else None
                end = None if name is None else self.tag_end(name)
                if end is not None:
                    found = ("</" if close else "<", at, min(end + 1, n), page[first:name].lower(), page[name:end])
            if found is None:
                at += 1
                continue
            moved = yield found
            at = found[2] if moved is None else moved
            if moved is not None:
                yield found  # for send


def nodes_of(page: str) -> list[Node]:
    """Text nodes in page order; elements that HTML ends by itself are ended, and an open end is taken as the end."""
    out: list[Node] = []
    root = Element("", None, 1.0, 0)
    opened: list[Element] = [root]
    count: dict[str, int] = defaultdict(int)
    paths: dict[tuple[int, str, float], int] = {}
    block = at = 0

    def text(lo: int, hi: int) -> None:
        if lo < hi and (t := page[lo:hi]) and (not t.isspace() or not out or out[-1].block == block):
            out.append(Node(block, opened[-1], entities.unescape(t)))

    def close(depth: int) -> None:
        nonlocal block
        if any(e.name in BLOCK for e in opened[depth:]):
            block += 1
        for e in opened[depth:]:
            count[e.name] -= 1
        del opened[depth:]

    def last(names: tuple[str, ...], stops: tuple[str, ...] = ()) -> int | None:
        """Depth of the innermost open element of these names, if none of the stops is inside it."""
        if not any(count[n] for n in names):
            return None
        for i in range(len(opened) - 1, 0, -1):
            if opened[i].name in stops:
                return None
            if opened[i].name in names:
                return i
        return None

    markup = iter(Scanner(page))
    found = next(markup, None)
    while found is not None:
        kind, begin, end, name, attributes = found
        text(at, begin)
        at = end
        if kind == "[":
            text(begin + 9, at - 3 if page.startswith("]]>", at - 3) else at)
        elif kind == "</":
            if (depth := last((name,))) is not None:
                close(depth)
            elif name in BLOCK:
                block += 1
        elif kind == "<":
            if name == "br" or name == "wbr":
                if out and out[-1].block == block:
                    out.append(Node(block, out[-1].place, "\n" if name == "br" else ""))
                found = next(markup, None)
                continue
            if name in BLOCK and (depth := last(("p",))) is not None:
                close(depth)
            if name in ENDS and (depth := last(ENDS[name], STOPS[name])) is not None:
                close(depth)
            if name in BLOCK:
                block += 1
            if name in RAW:
                if not attributes.endswith("/") or name in ("script", "style", "title"):
                    done = re.compile(rf"</{re.escape(name)}\s*(?:>|$)", re.I).search(page, at)
                    at = done.end() if done else len(page)
                    markup.send(at)
            elif name not in VOID and (name in BLOCK or not attributes.endswith("/")):
                above = opened[-1]
                prior = prior_of(name, attributes, above)
                opened.append(Element(name, above, prior, paths.setdefault((above.path, name, prior), len(paths) + 1)))
                count[name] += 1
        found = next(markup, None)
    text(at, len(page))
    return out


def prior_of(name: str, attributes: str, above: Element) -> float:
    """Factor that the names on the path of a new element give it."""
    prior = above.prior
    if prior == LAYOUT and name in ARTICLE:
        prior = 1.0
    if prior > AROUND_TAG:
        named = " ".join(v.strip("\"'") for k, v in ATTRIBUTE.findall(attributes)) if attributes else ""
        if name in AROUND or name in HEAD_OF and not above.in_article or attributes and HIDDEN.search(attributes):
            return AROUND_TAG
        if named and NEVER_WORDS.search(named) and name not in ("html", "body", "main"):
            return min(prior, NEVER)
        if named and name not in ARTICLE and name not in ("html", "body") and (AROUND_WORDS.search(named) or not above.in_article and HEAD_WORDS.search(named)):
            return min(prior, LAYOUT)
    return prior


def path_ratios(nodes: list[Node]) -> dict[int, float]:
    """Fused ratio of each path: characters a node, times the root of punctuation a node, times the prior of its names."""
    n: dict[int, int] = defaultdict(int)
    chars: dict[int, int] = defaultdict(int)
    marks: dict[int, int] = defaultdict(int)
    prior: dict[int, float] = {}
    for x in nodes:
        if t := x.text.strip():
            path = x.place.path
            n[path] += 1
            chars[path] += len(t)
            marks[path] += len(PUNCTUATION.findall(t))
            prior[path] = x.place.prior
    return {p: prior[p] * chars[p] / n[p] * math.sqrt((marks[p] + 0.5) / n[p]) for p in n}


def smooth(values: list[float], radius: int = 2) -> list[float]:
    """Gaussian smoothing in page order."""
    kernel = [math.exp(-(d * d) / (2 * radius)) for d in range(-radius, radius + 1)]
    out = []
    for i in range(len(values)):
        pairs = [(kernel[d + radius], values[i + d]) for d in range(-radius, radius + 1) if 0 <= i + d < len(values)]
        out.append(sum(k * v for k, v in pairs) / sum(k for k, _ in pairs))
    return out


def path_scores(real: list[Node]) -> tuple[dict[int, float], float]:
    """Score of each path, and the mean score of a character, where characters weigh as the priors of their paths.

    A node's score fuses its path's ratio with the ratios smoothed in page order (their geometric mean); a path's is the
    mean of its nodes'.
    """
    ratios = path_ratios(real)
    paths = [x.place.path for x in real]
    smoothed = smooth([ratios[p] for p in paths])
    n: dict[int, int] = defaultdict(int)
    total: dict[int, float] = defaultdict(float)
    for p, s in zip(paths, smoothed, strict=True):
        n[p] += 1
        total[p] += math.sqrt(ratios[p] * s)
    scores = {p: total[p] / n[p] for p in n}
    sizes = [x.place.prior * len(x.text.strip()) for x in real]
    return scores, sum(c * scores[p] for p, c in zip(paths, sizes, strict=True)) / sum(sizes)


def content_of(nodes: list[Node]) -> list[Node]:
    """Nodes of the article.

    Paths whose score reaches STRONG times the mean are content.  Another node stands in the branch below the deepest element
    above it that holds content.  If a name marks the node, it goes.  A branch that is part of a text (a heading, list, table)
    stays with the content beside it; a branch that is a container, or made of links, stays if its path scores reach WEAK
    times the mean.  Directly below the page itself only content and headings stay.
    """
    real = [x for x in nodes if x.text.strip()]
    if not real:
        return []
    scores, mean = path_scores(real)
    strong = {p for p, s in scores.items() if s >= STRONG * mean}
    holds: set[int] = set()  # elements that hold content, the page's root among them
    for x in real:
        e = x.place if x.place.path in strong else None
        while e is not None and id(e) not in holds:
            holds.add(id(e))
            e = e.above
    tops: dict[int, Element | None] = {}  # the branch of each element met: the highest one above it that holds nothing

    def branch_of(e: Element) -> Element | None:
        way = []
        while id(e) not in tops:
            if id(e) in holds or e.above is None:
                tops[id(e)] = None
                break
            way.append(e)
            e = e.above
        for below in reversed(way):
            tops[id(below)] = tops[id(below.above)] or below
        return tops[id(way[0])] if way else tops[id(e)]

    chars: dict[int, int] = defaultdict(int)
    links: dict[int, int] = defaultdict(int)
    score: dict[int, float] = defaultdict(float)
    weak = [(x, branch_of(x.place)) for x in real if x.place.path not in strong]
    for x, branch in weak:
        if branch is not None:
            size = len(x.text.strip())
            chars[id(branch)] += size
            links[id(branch)] += size if x.place.in_link else 0
            score[id(branch)] += size * scores[x.place.path]
    kept = {id(x) for x in real if x.place.path in strong}
    for x, branch in weak:
        if x.place.prior < 1:
            continue
        if branch is None:  # beside content in one element
            kept.add(id(x))
        elif branch.above.above is None or branch.above.name in PAGE:
            if branch.name in HEADINGS and len(holds) > 1:
                kept.add(id(x))
        elif branch.name in PART and 2 * links[id(branch)] < chars[id(branch)] or branch.name not in BLOCK and "-" not in branch.name or score[id(branch)] >= WEAK * mean * chars[id(branch)]:
            kept.add(id(x))
    blocks = {x.block for x in real if id(x) in kept}
    gone = {x.block for x in real if id(x) not in kept}
    return [x for x in nodes if id(x) in kept or not x.text.strip() and x.block in blocks - gone]


def main_text(page: str | None) -> str:
    """The article's blocks in page order, joined by two newlines; white space inside a block is one space."""
    blocks: list[str] = []
    last = None
    for x in content_of(nodes_of(page or "")):
        if x.block == last:
            blocks[-1] += x.text
        else:
            blocks.append(x.text)
            last = x.block
    return "\n\n".join(b for b in (SPACES.sub(" ", b).strip() for b in blocks) if b)


def extract_text(pages: DataFrame, *, html: str = "html") -> DataFrame:
    """pages with text and n_chars (code points) in the place of columns of those names; the html column isn't returned.

    A page without main text, a null page among them, has the empty text.  Rows are never merged or dropped.  Very long,
    deeply nested and broken pages take time and memory in proportion to their length: a quote that stays open is no tag.
    """
    pages = without(pages, *(c for c in ("text", "n_chars") if c != html))
    rest = [c for c in pages.columns if c != html]
    schema = T.StructType([*(f for f in pages.schema.fields if f.name != html), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch, html):
                texts = [main_text(p) for p in step.column(html).to_pylist()]
                columns = [step.column(c) for c in rest]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*rest, "text", "n_chars"])

    return pages.select(*[F.col(f"`{c}`") for c in pages.columns]).mapInArrow(run, schema)
