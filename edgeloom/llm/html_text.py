"""Main text of web pages by tag-path ratios.

Every text node has a root-to-leaf tag path; containers' classes are part of it. For each path the page's nodes are
aggregated: characters of text and punctuation marks outside links, each over the number of nodes. The two ratios are
smoothed along the page with a Gaussian window, in which nodes of the same parent path count more, and fused by their
product: a path whose nodes hold or adjoin long, punctuated text scores high. Up the tree they are smoothed too: a path
gets ``FAMILY`` times the mean (weighted by text) of all nodes in its article or main element, or else of its near container (below
body), so that headings, lists and tables of an article count with it however many short nodes follow each other. What
a path's elements say of themselves weighs its score: inside an article or main element it counts ``ARTICLE`` times, under a class, id or role that names
one of the things that are not the article ``NAMED`` times, and by its share of text outside links. Paths that reach
``SHARE`` of the score of the page's best path are content, and the text is that of their nodes: nothing else selects
or drops a node.

Elements that HTML itself sets apart (navigation, page headers, footers, asides, forms, scripts, styles) have no text
nodes. A page whose text is all links has an empty text.

The parser takes time in proportion to the page: a tag ends at its ``>`` outside quotes, or, where quotes don't
balance, at the first ``>`` or before the next ``<``.

Defined cases: null html is an empty page with an empty text; unclosed and misnested tags are tolerated; null or
repeated ids and urls keep their rows; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html as html_lib
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship_package, slices

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|iframe|svg|math|object|select|title)\b[^<>]*>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^<>]*>?"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)(?:((?>(?:[^<>\"']+|\"[^\"]{0,1000}\"|'[^']{0,1000}')*))>|([^<>]*)(?:>|(?=<)|\Z))",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_LETTERS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？、]")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: no text under these is article text; a header is the page's unless an article holds it
APART = frozenset("nav footer aside form button dialog menu head header".split())
#: what a class, id or role calls a thing that isn't the article
NAMES = frozenset("ad ads advert adverts advertisement menu nav navigation header footer sidebar notice cookie cookies comment comments".split())
ARTICLE, NAMED, SHARE, FAMILY = 3.0, 0.01, 0.02, 0.05
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article center details div dl figure main ol section table ul".split())
#: an opening tag of the key ends an open element of its values
IMPLIED_END = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: of tables and lists: an implied end doesn't look past these
SCOPES = frozenset("ul ol dl table html body article div section td th".split())
#: weights of the smoothing by distance along the page, and of nodes with another parent path
WINDOW, APART_WEIGHT = [math.exp(-(i * i) / 2) for i in range(3)], 0.4


class _Block:
    """An open block element: its path, whether it is apart, its prior, and the inline elements open in it."""

    __slots__ = ("tag", "path", "apart", "prior", "article", "inline")

    def __init__(self, tag, path, apart, prior, article):
        self.tag, self.path, self.apart, self.prior, self.article, self.inline = tag, path, apart, prior, article, []


def _named(attributes: str) -> bool:
    return any(not NAMES.isdisjoint(_LETTERS.findall((m[2] or m[3] or m[4] or "").lower())) for m in _ATTRIBUTE.finditer(attributes))


def _class(attributes: str) -> str:
    for m in _ATTRIBUTE.finditer(attributes):
        if m[1].lower() == "class":
            return "." + " ".join((m[2] or m[3] or m[4] or "").split())
    return ""


class _Page:
    """The text nodes of a page: ``nodes`` of (path, text, characters in links); ``parent``, ``prior`` and ``home`` of each path:
    its article, else the containers next above it, without those of the whole page."""

    def __init__(self, page: str):
        self.nodes: list[tuple[int, str, int]] = []
        self.parent, self.prior, self.home = [-1], [1.0], [()]
        self._paths: dict[tuple, int] = {}
        self._stack = [_Block("", 0, False, 1.0, False)]
        self._open: dict[str, int] = {}
        self._held: list[tuple[str, bool]] = []
        self._at = 0
        self._links = 0
        end = 0
        for m in _TOKEN.finditer(page):
            if m.start() > end:
                self._text(page[end : m.start()])
            end = m.end()
            if m[3] is not None:
                if m[2]:
                    self._end(m[3].lower())
                else:
                    self._start(m[3].lower(), m[4] if m[4] is not None else m[5])
        if end < len(page):
            self._text(page[end:])
        self._flush()

    def _text(self, raw: str):
        top = self._stack[-1]
        if not top.apart and not any(apart for _, apart in top.inline[-1:]):
            self._at = top.path
            self._held.append((raw, self._links > 0))

    def _flush(self):
        if self._held:
            text = _SPACE.sub(" ", html_lib.unescape("".join(t for t, _ in self._held))).strip()
            if text:
                linked = sum(len(html_lib.unescape(t).strip()) for t, link in self._held if link)
                self.nodes.append((self._at, text, min(linked, len(text))))
            self._held.clear()

    def _start(self, tag: str, attributes: str):
        stack = self._stack
        if tag == "br":
            return self._text(" ")
        if tag not in BLOCKS:
            if tag not in VOID and not attributes.rstrip().endswith("/"):
                top = stack[-1]
                apart = bool(top.inline and top.inline[-1][1]) or tag in APART
                top.inline.append((tag, apart))
                self._links += tag == "a"
            return
        self._flush()
        if stack[-1].tag == "p":  # a block ends an open paragraph, with the inline marks in it
            self._pop()
        ends = IMPLIED_END.get(tag)
        if ends:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ends:
                    self._pop(i)
                    break
                if stack[i].tag in SCOPES:
                    break
        if tag in VOID or attributes.rstrip().endswith("/"):
            return
        up = stack[-1]
        article = up.article or tag in ("article", "main")
        apart = up.apart or any(a for _, a in up.inline[-1:]) or (tag in APART and not (tag == "header" and up.article))
        prior = up.prior * (ARTICLE if article and not up.article else 1) * (NAMED if tag not in ("html", "body") and up.prior > NAMED and _named(attributes) else 1)
        key = (up.path, tag + (_class(attributes) if tag in CONTAINERS else ""), prior)
        path = self._paths.get(key)
        if path is None:
            path = self._paths[key] = len(self.parent)
            self.parent.append(up.path)
            self.prior.append(prior)
            if article:  # the outermost
                self.home.append(self.home[up.path] if up.article else (path,))
            else:
                self.home.append(tuple(b.path for b in stack[-2:] if b.tag not in ("", "html", "body")))
        stack.append(_Block(tag, path, apart, prior, article))
        self._open[tag] = self._open.get(tag, 0) + 1

    def _pop(self, i: int = -1):
        stack = self._stack
        for block in stack[i:]:
            self._open[block.tag] -= 1
            self._links -= sum(t == "a" for t, _ in block.inline)
        del stack[i:]

    def _end(self, tag: str):
        if tag in BLOCKS:
            self._flush()
            if self._open.get(tag):
                i = len(self._stack) - 1
                while self._stack[i].tag != tag:
                    i -= 1
                self._pop(i)
            return
        inline = self._stack[-1].inline
        for i in range(len(inline) - 1, -1, -1):
            if inline[i][0] == tag:
                self._links -= sum(t == "a" for t, _ in inline[i:])
                del inline[i:]
                break


def path_scores(nodes, parent, prior, home) -> dict[int, float]:
    """The fused score of each path."""
    size: dict[int, int] = {}
    text: dict[int, int] = {}
    marks: dict[int, int] = {}
    count: dict[int, int] = {}
    for path, t, linked in nodes:
        size[path] = size.get(path, 0) + len(t)
        text[path] = text.get(path, 0) + len(t) - linked
        marks[path] = marks.get(path, 0) + (len(_PUNCTUATION.findall(t)) if linked < len(t) else 0)
        count[path] = count.get(path, 0) + 1
    ratio = {p: (text[p] / n, marks[p] / n) for p, n in count.items()}
    family: dict[int, list[float]] = {}
    for p in count:
        for h in home[p]:
            f = family.setdefault(h, [0.0, 0])
            f[0] += ratio[p][0] * (ratio[p][1] + 0.1) * text[p]
            f[1] += text[p]
    total: dict[int, float] = {}
    for i, (path, _, _) in enumerate(nodes):
        a = b = whole = 0.0
        for j in range(max(0, i - 2), min(len(nodes), i + 3)):
            other = nodes[j][0]
            w = WINDOW[abs(i - j)] * (1 if parent[other] == parent[path] else APART_WEIGHT)
            a, b, whole = a + w * ratio[other][0], b + w * ratio[other][1], whole + w
        total[path] = total.get(path, 0) + a / whole * (b / whole + 0.1)
    up = {p: max((family[h][0] / max(family[h][1], 1) for h in home[p]), default=0.0) for p in total}
    return {p: max(total[p] / count[p], FAMILY * up[p]) * prior[p] * text[p] / size[p] for p in total}


def content_paths(nodes, parent, prior, home) -> set[int]:
    """Paths that reach ``SHARE`` of the score of the best: the one whose score and text are largest."""
    score = path_scores(nodes, parent, prior, home)
    held: dict[int, int] = {}
    for path, t, linked in nodes:
        held[path] = held.get(path, 0) + len(t) - linked
    best = max((score[p] * held[p], score[p]) for p in score)[1] if score else 0
    return {p for p, s in score.items() if s >= SHARE * best} if best else set()


def main_text(page: str | None) -> str:
    """The content nodes' texts, joined by two line feeds; empty if there is none."""
    p = _Page(page or "")
    chosen = content_paths(p.nodes, p.parent, p.prior, p.home)
    return "\n\n".join(t for path, t, _ in p.nodes if path in chosen)


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The ``keep`` columns, text, and n_chars (its code points) of every page."""
    ship_package(pages.sparkSession)
    at = len(keep)
    kept = pages.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{html}`")).toDF(*(f"c{i}" for i in range(at)), "html")
    schema = T.StructType([*kept.schema.fields[:-1], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, text=at):
                texts = [main_text(h) for h in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(at)), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return kept.mapInArrow(run, schema).toDF(*keep, "text", "n_chars")
