"""Main text of web pages by tag-path ratios.

A page is parsed into text nodes with their root-to-leaf tag paths. For each path text length and punctuation are summed and divided
by the number of its nodes; both ratios are smoothed along the page and fused. A word of a class, id or role that is usual for what
isn't the article is a step of the path and a prior: a factor below 1, small for ``STRONG`` words such as those of adverts and comments.
Paths whose ratio times prior reaches a share of the page's mean are content, and paths with a prior that don't reach it go.

The article is the smallest container that holds all content text, without leaving its heading or another article outside. Of that
container every block is returned whole, headings and other short ones too; menus, page headers, footers, asides, form controls,
scripts, styles and hidden elements are never text. In a page without an article or main element, link lists on paths that aren't content
go too. The time is linear in the page; a page is never cut.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textweft.llm import textkernel as tk

#: Of the page's mean fused ratio, from which a path's ratio times its prior makes it content.
SHARE = 0.25
KERNEL = np.array([0.25, 0.5, 0.25])

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"<]*"|'[^'<]*')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*)(?:>|\Z)""", re.S)
_NAMED = re.compile(r"""([a-zA-Z-]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe noscript template".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption".split()
)
NEVER = frozenset("head script style noscript template svg math canvas object iframe nav footer aside button select option textarea input label fieldset legend dialog menu title xmp noembed noframes audio video map".split())
HEADINGS = frozenset("h1 h2".split())
ALL_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of a class, id or role that mark what is seldom or never the article, and the priors of their paths.
STRONG = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promoted cookie cookies consent notice gdpr newsletter subscribe "
    "subscription sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments reply replies disqus share sharing social popup modal "
    "overlay copyright login signin signup pagination pager toolbar complementary contentinfo form banner header masthead".split()
)
WEAK = frozenset("related recommended search searchbox widget skip alert dialog aside disclaimer".split())
STRONG_PRIOR, WEAK_PRIOR = 0.02, 0.4
#: Those that an article's own parts may have.
_OWN = frozenset("header masthead banner".split())
THREADS = frozenset("comment comments reply replies disqus".split())
#: A start tag of the key closes an open element of the value, up to the elements that bound it.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody"), "thead": ("tr", "td", "th")}
_BOUND = frozenset("ul ol dl table select body html article section div main".split())


def _marked(attributes: str) -> set[str]:
    """Words of class, id and role, and ``hidden`` for hidden elements."""
    found: set[str] = set()
    for name, a, b, c in _NAMED.findall(attributes):
        key, value = name.lower(), a or b or c
        if key in ("class", "id", "role"):
            words = [w.lower() for w in _WORD.findall(value)]
            # with-sidebar and no-comments say what the page around is like
            found.update(w for w, before in zip(words, ["", *words], strict=False) if before not in ("with", "has", "no", "without"))
        elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value)):
            found.add("hidden")
    return found


_P_BOUND = frozenset("button table td th li article section div body html form aside nav footer header main blockquote".split())


class _Page:
    """Elements as parallel lists (parent, tag, marks) and text nodes as (element, text, block)."""

    def __init__(self, source: str) -> None:
        self.parent, self.tag, self.marks = [-1], ["#"], [frozenset()]
        self.nodes: list[tuple[int, str, int]] = []
        self._stack = [0]
        # where in the stack elements of a name are open, and block elements: no search of the stack
        self._open: dict[str, list[int]] = {}
        self._blocks: list[int] = []
        block, at = 0, 0
        end = len(source)
        while at < end:
            m = _TOKEN.search(source, at)
            text_end = m.start() if m else end
            if text_end > at:
                self.nodes.append((self._stack[-1], source[at:text_end], block))
            if not m:
                break
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            name = name.lower()
            if name in BLOCK:
                block += 1
            if m[1] or m[4]:
                place = self._last(name)
                if place > 0 and (name in BLOCK or not self._blocks or self._blocks[-1] < place):
                    self._cut(place)
                continue
            attributes = m[3] or m[6] or ""
            if name in BLOCK:
                self._close(("p",), _P_BOUND)
                if name in ALL_HEADINGS and len(self._stack) > 1 and self.tag[self._stack[-1]] in ALL_HEADINGS:
                    self._cut(len(self._stack) - 1)
            if name in _CLOSES:
                self._close(_CLOSES[name], _BOUND)
            if name == "body":
                self._close(("head",), frozenset())
            if name in ("td", "th", "br", "hr", "img"):
                self.nodes.append((self._stack[-1], " ", block))
            if name in VOID:
                continue
            self.parent.append(self._stack[-1])
            self.tag.append(name)
            self.marks.append(frozenset(_marked(attributes)) if attributes else frozenset())
            if name in RAW:
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(source, at)
                at = close.end() if close else end
                continue
            if not attributes.endswith("/") or name in BLOCK:
                self._open.setdefault(name, []).append(len(self._stack))
                if name in BLOCK:
                    self._blocks.append(len(self._stack))
                self._stack.append(len(self.tag) - 1)

    def _last(self, name: str) -> int:
        found = self._open.get(name)
        return found[-1] if found else 0

    def _cut(self, place: int) -> None:
        """Closes all elements from a place of the stack on."""
        while len(self._stack) > place:
            name = self.tag[self._stack.pop()]
            self._open[name].pop()
            if name in BLOCK:
                self._blocks.pop()

    def _close(self, names: tuple[str, ...], bounds: frozenset[str]) -> None:
        while (place := max(map(self._last, names))) and place > max(map(self._last, bounds), default=0):
            self._cut(place)
            if len(names) == 1:
                return


def path_ratios(paths: list[int], texts: list[str]) -> dict[int, float]:
    """The fused ratio of each path over the page's mean, from the paths of the text nodes in page order."""
    sums: dict[int, list[float]] = {}
    for p, t in zip(paths, texts, strict=True):
        s = sums.setdefault(p, [0, 0, 0])
        s[0] += len(t.strip())
        s[1] += len(_PUNCTUATION.findall(t))
        s[2] += 1
    length = _smooth(np.array([sums[p][0] / sums[p][2] for p in paths]))
    marks = _smooth(np.array([sums[p][1] / sums[p][2] for p in paths]))
    fused = length * (1 + marks)
    per_path: dict[int, list[float]] = {}
    for p, f in zip(paths, fused, strict=True):
        per_path.setdefault(p, []).append(f)
    mean = float(fused.mean())
    return {p: sum(f) / len(f) / mean for p, f in per_path.items()}


def main_text(source: str | None, share: float = SHARE) -> str:
    """The article of a page; empty for null, empty or text-free pages. Paths from ``share`` of the mean ratio on are content."""
    if not source:
        return ""
    page = _Page(source)
    n, parent = len(page.tag), page.parent
    holds = [t in ("article", "main") and not (page.marks[i] & ((STRONG | WEAK) - _OWN)) for i, t in enumerate(page.tag)]
    inside = holds[:]
    for i in range(1, n):
        inside[i] |= inside[parent[i]]
    around = holds[:]
    size, titled = [0] * n, [t == "h1" for t in page.tag]
    for e, t, _ in page.nodes:
        size[e] += len(t)
    for i in range(n - 1, 0, -1):
        around[parent[i]] |= around[i]
        if page.tag[i] not in NEVER:
            size[parent[i]] += size[i]
        titled[parent[i]] |= titled[i]
    out, prior = [False] * n, [1.0] * n
    for i in range(1, n):
        tag, marks = page.tag[i], page.marks[i]
        bad = tag in NEVER or (tag == "header" and not inside[i]) or "hidden" in marks
        out[i] = out[parent[i]] or (bad and not (around[i] and tag not in NEVER))
        own = 1.0
        if not around[i] and tag not in ("html", "body") or tag == "article" and not holds[i]:
            strong, weak = marks & STRONG, marks & WEAK
            if inside[i]:
                strong -= _OWN
            # what has the title, or most text of a page without an article, is a wrapper with an unlucky name, unless it is a thread
            wrapper = titled[i] or (not around[0] and 2 * size[i] > size[0])
            if strong & THREADS or (not wrapper and (strong or tag == "form")):
                own = STRONG_PRIOR
            elif weak and not wrapper:
                own = WEAK_PRIOR
        prior[i] = min(prior[parent[i]], own)
    real = [(e, entities.unescape(t)) for e, t, _ in page.nodes if not out[e] and t.strip()]
    if not real:
        return ""
    # a path is the number of its parent's path, a tag and a prior
    paths, known, in_link = [0] * n, {}, [False] * n
    for i in range(1, n):
        paths[i] = known.setdefault((paths[parent[i]], page.tag[i], prior[i]), len(known) + 1)
        in_link[i] = in_link[parent[i]] or page.tag[i] == "a"
    ratio = path_ratios([paths[e] for e, _ in real], [t for _, t in real])
    content = {paths[e] for e, _ in real if ratio[paths[e]] * prior[e] >= share}
    for i in range(1, n):
        out[i] = out[i] or (prior[i] < 1 and paths[i] not in content)
    kept = [(e, t, b) for e, t, b in page.nodes if not out[e]]
    mass, articles = [0] * n, [int(holds[i] and not inside[parent[i]] and not out[i]) if i else 0 for i in range(n)]
    for e, t in real:
        if paths[e] in content:
            mass[e] += len(t.strip())
    heading = [page.tag[i] in HEADINGS and not out[i] for i in range(n)]
    for i in range(n - 1, 0, -1):
        mass[parent[i]] += mass[i]
        articles[parent[i]] += articles[i]
        heading[parent[i]] |= heading[i]
    best = [0] * n
    for i in range(1, n):
        if not out[i] and (not best[parent[i]] or mass[i] > mass[best[parent[i]]]):
            best[parent[i]] = i
    root = 0
    while not holds[root]:
        b = best[root]
        if not b or mass[b] < mass[root] or articles[b] < articles[root] or mass[b] == 0 or page.tag[b] in _NO_CONTAINER or (heading[root] and not heading[b]):
            break
        root = b
    under = [False] * n
    under[root] = True
    for i in range(root + 1, n):
        under[i] = under[parent[i]]
    dropped: set[int] = set()
    if not holds[root] and not inside[root]:
        solid = [(e, b) for e, t, b in kept if t.strip()]
        dropped = {b for e, b in solid if in_link[e] and paths[e] not in content and not inside[e]} - {b for e, b in solid if not in_link[e]}
    blocks: list[str] = []
    current, parts = -1, []
    for e, t, b in [*kept, (root, "", -2)]:
        if b != current:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                blocks.append(text)
            current, parts = b, []
        if b >= 0 and under[e] and b not in dropped:
            parts.append(t)
    return "\n".join(blocks)


_NO_CONTAINER = HEADINGS | frozenset("p li tr td span a b i em strong".split())


def _smooth(x: np.ndarray) -> np.ndarray:
    return np.convolve(np.pad(x, 1, mode="edge"), KERNEL, mode="valid")


def extract(pages: DataFrame, share: float = SHARE) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every row of ``pages(page_id, url, html, ...)``.

    A null html is empty, and a page without text gives an empty text. Ids and urls may be null or repeat; there is one row per row.
    Other columns are ignored.
    """
    tk.small_batches(pages.sparkSession)
    own = pages.select("page_id", "url", "html")
    types = [f"{c} {own.schema[c].dataType.simpleString()}" for c in ("page_id", "url")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), share) for x in batch["html"]]
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return own.mapInArrow(run, ", ".join([*types, "text string", "n_chars long"]))
