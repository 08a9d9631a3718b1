"""Main text of web pages by a maximum-scoring subsequence of words and tags.

A page is a sequence of words and tags. A word scores more than 0 and a tag less, by how often its kind
stands inside and outside the content of labelled pages: those that mark their content with one ``article``
or ``main`` element. One linear scan finds the contiguous region with the largest sum. Since nothing of the
article may be dropped, the region grows at its ends to the element it lies in: the ``article`` or ``main``
that holds most of its words, or else the smallest sectioning element around it.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are asides:
elements of such a name, or with such a word as a whole token of class, id, role or aria-label ("sidebar" or
"site-footer", but not "with-sidebar"). The words of asides score as tags do and are left out of the text. An
element is no aside if it holds the page's only ``article`` or ``main`` (unless it is for comments); on a page
without these, a form or an element that only its class makes an aside is none if it holds over ten times the
words that are in no aside; ``html``, ``body``, ``article``, ``main`` and headings are never
asides by their class.

A block is text between block-level tags; ``br`` is white space. Character references are decoded once,
white space becomes one space, and blocks are joined by two line ends. Pages are read in linear time.

Defined results: a null or empty page has an empty text; markup that is never closed ends with the element
around it, a tag with an open quote at its first ``>``; text without any tag is one block; ties go to the earlier
and shorter region; without labelled pages words score 1 and tags -1; rows are extracted one by one, also equal
ones, and other columns are not read.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlane.llm.common import map_texts

#: Labelled pages that weights are learned from, at most.
SAMPLE = 500

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
#: The inside of a tag: a quote opens a value behind an equals sign only.
_INSIDE = re.compile(r"(?:[^>=]|=\s*+(?:\"[^\"]*\"|'[^']*'|(?![\"'])))*+>")
_HINT = re.compile(r"""\b(class|id|role|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)

#: Names of HTML elements.
BLOCKS = frozenset("address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LEFT_OUT = frozenset("aside audio button canvas dialog footer form head header input label menu nav noscript select video".split())
#: Elements whose content is no markup.
RAW = frozenset("iframe noscript script style template textarea title".split())
_CLOSERS = {name: re.compile(f"</{name}", re.I) for name in RAW}
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em i ins kbd mark math object q ruby s samp small span strong sub sup svg time u var".split())
NAMES = BLOCKS | VOID | LEFT_OUT | INLINE
CONTENT = frozenset(("article", "main"))
AROUND = frozenset(("article", "body", "div", "html", "main", "section", "td"))
#: What makes an aside that may be a wrapper of the whole page.
WRAPPERS = frozenset(("aside by class", "form"))
NEVER_HINTED = CONTENT | {"html", "body", "h1", "h2", "h3", "h4", "h5", "h6"}
#: Tokens of class, id, role and aria-label that mark an aside: reader comments, and others; alone or with
#: one of the words for places before them or for boxes behind them.
COMMENTS = "comment comments disqus reply replies respond"
ASIDES = "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs complementary consent contentinfo cookie cookies footer gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promotion promotions recommended related search share sharing sidebar signup social sponsor sponsored sponsors subscribe subscription toolbar widget"
PLACES = "article bottom entry global google left main page post primary reader right secondary site top user"
BOXES = "area articles banner bar block box buttons container form links list menu posts section slot stories unit widget wrapper"


def _tokens(words: str) -> re.Pattern:
    return re.compile(rf"(?:(?:{'|'.join(PLACES.split())})[_-])?(?:{'|'.join(words.split())})(?:[_-](?:{'|'.join(BOXES.split())}))?", re.I)


_COMMENT, _ASIDE = _tokens(COMMENTS), _tokens(ASIDES)


def hint(tag: str) -> str | None:
    """``comment`` or ``aside by class`` if a whole token of the tag's class, id, role or aria-label says so."""
    found = None
    for name, value in _HINT.findall(tag):
        value = value.strip("\"'")
        for token in [value.strip().replace(" ", "-")] if name.lower() == "aria-label" else value.split():
            if _COMMENT.fullmatch(token):
                return "comment"
            found = "aside by class" if _ASIDE.fullmatch(token) else found
    return found


def tokens(text: str) -> Iterator[tuple[str, str]]:
    """(kind, token) of a page in order: text, and open and close tags; each character is looked at a few
    times at most. What is between a raw element's tags, comments and declarations are passed over."""
    at, n, quoted = 0, len(text), True
    closers: dict[str, bool] = {}
    while at < n:
        start = text.find("<", at)
        start = n if start < 0 else start
        if start > at:
            yield "text", text[at:start]
            at = start
            continue
        head = text[at + 1 : at + 3]
        if head[:1] in ("!", "?"):
            opener, closer = next((x for x in (("<!--", "-->"), ("<![CDATA[", "]]>")) if text.startswith(x[0], at)), ("<!", ">"))
            end = text.find(closer, at + len(opener))
            at = n if end < 0 else end + len(closer)
            continue
        name = None if closers.get(">") is False else _NAME.match(text, at)
        if not name:
            yield "text", "<"
            at += 1
            continue
        inside = _INSIDE.match(text, name.end()) if quoted else None
        if inside is None:
            quoted = False  # a quote or tag stays open to the end: from here on tags end at the next >
            end = text.find(">", name.end()) + 1
            if not end:
                closers[">"] = False
                continue
        else:
            end = inside.end()
        element, closing = name[1].lower(), head[:1] == "/"
        if element in RAW and not closing:
            over = None if closers.get(element) is False else _CLOSERS[element].search(text, end)
            closers[element] = over is not None
            at = text.find(">", over.end()) + 1 or n if over else n
            continue
        yield "close" if closing else "open", text[at:end]
        at = end


class Page:
    """A page's blocks, its sequence of scored kinds, and the elements that mark content or stand around it."""

    def __init__(self, text: str | None) -> None:
        self.items: list[tuple[str, int, int]] = []  # kind ("-" before it: of an aside), words (0: a tag), block
        self.marked: list[tuple[int, int]] = []  # first and last item of each article or main outside of asides
        self.around: list[tuple[int, int]] = []  # of each sectioning element
        self.blocks: list[str] = []
        blocks: list[list[tuple[str, int]]] = [[]]  # pieces of text of each block, with their aside (0: none)
        asides: list[tuple[int, str]] = [(0, "")]  # the aside around, and what makes it one
        within: list[int] = []  # the aside of each item
        places: list[list] = []  # first and last item, aside and name of each sectioning element
        stack: list[tuple[str, int, list | None, str]] = []  # name, aside, its place, nearest block-level name
        opened: Counter = Counter()

        def closed() -> str:
            name, _, place, _ = stack.pop()
            opened[name] -= 1
            if place:
                place[1] = len(self.items)
            return name

        aside, parent = 0, "body"
        for kind, token in tokens(text or ""):
            if kind == "text":
                if n := len(token.split()):
                    self.items.append((f"word {'a' if stack and stack[-1][0] == 'a' else parent}", n, len(blocks) - 1))
                    within.append(aside)
                blocks[-1].append((token, aside))
                continue
            name = _NAME.match(token)[1].lower()
            self.items.append((f"tag {name if name in NAMES else 'other'}", 0, len(blocks) - 1))
            within.append(aside)
            if name == "br":
                blocks[-1].append((" ", 0))
                continue
            if name in BLOCKS:
                blocks.append([])
            if kind == "close":
                while opened[name] and closed() != name:
                    pass
            elif name not in VOID and not token.endswith("/>"):
                while stack and (name in BLOCKS and stack[-1][0] == "p" or name == "li" and stack[-1][0] == "li"):
                    closed()
                aside = stack[-1][1] if stack else 0
                why = name if name in LEFT_OUT else None if name in NEVER_HINTED else hint(token)
                if why:
                    asides.append((aside, why))
                    aside = len(asides) - 1
                place = [len(self.items) - 1, 0, aside, name] if name in AROUND else None
                if place:
                    places.append(place)
                stack.append((name, aside, place, name if name in BLOCKS else stack[-1][3] if stack else "body"))
                opened[name] += 1
            aside, parent = (stack[-1][1], stack[-1][3]) if stack else (0, "body")
        while stack:
            closed()
        out = self._left_out(asides, within, places)
        self.items = [(f"-{kind}" if n and out[i] else kind, n, block) for (kind, n, block), i in zip(self.items, within, strict=True)]
        self.around = [(a, b) for a, b, i, _ in places if not out[i]]
        self.marked = [(a, b) for a, b, i, name in places if not out[i] and name in CONTENT]
        self.blocks = ["".join(t for t, i in block if not out[i]) for block in blocks]

    def _left_out(self, asides: list[tuple[int, str]], within: list[int], places: list[list]) -> list[bool]:
        """Whether each aside is left out, with all in it."""
        sums = [0, *accumulate(n for _, n, _ in self.items)]
        kept = {0}

        def keep(aside: int) -> None:
            while aside:
                kept.add(aside)
                aside = asides[aside][0]

        commented = [False]
        for around, why in asides[1:]:
            commented.append(why == "comment" or commented[around])
        marked = [(sums[b] - sums[a], i) for a, b, i, name in places if name in CONTENT]
        if marked and all(i for _, i in marked) and (own := [x for x in marked if not commented[x[1]]]):
            keep(max(own, key=lambda x: x[0])[1])
        inside = [0] * len(asides)
        for (_, n, _), i in zip(self.items, within, strict=True):
            inside[i] += n
        outer = [0] * len(asides)  # the outermost aside around that isn't kept
        for i, (around, _) in enumerate(asides[1:], 1):
            outer[i] = outer[around] or (0 if i in kept else i)
        words = [0] * len(asides)
        for i, n in enumerate(inside):
            words[outer[i]] += n
        wraps = [i for i, (_, why) in enumerate(asides) if why in WRAPPERS and not commented[i]]
        large = max(wraps, key=lambda i: words[i], default=0)
        if words[large] > 10 * words[0] and not any(i == 0 for _, i in marked):
            keep(large)
        out = [False]
        for i, (around, _) in enumerate(asides[1:], 1):
            out.append(out[around] or i not in kept)
        return out

    def region(self, weights: dict[str, float]) -> tuple[int, int]:
        """First and last (exclusive) item of the region with the largest sum."""
        best, found, total, start = 0.0, (0, 0), 0.0, 0
        for i, (kind, n, _) in enumerate(self.items):
            total += weights.get(kind, 1.0) * n if n and kind[0] != "-" else -1.0 * n if n else weights.get(kind, -1.0)
            if total <= 0:
                total, start = 0.0, i + 1
            elif total > best:
                best, found = total, (start, i + 1)
        return found

    def text(self, weights: dict[str, float]) -> str:
        a, b = self.region(weights)
        if a == b:
            return ""
        sums = [0, *accumulate(n if kind[0] != "-" else 0 for kind, n, _ in self.items)]
        for c, d in sorted(self.marked, key=lambda x: x[1] - x[0]):
            if 2 * (sums[max(a, c, min(b, d))] - sums[max(a, c)]) > sums[b] - sums[a]:
                a, b = c, d
                break
        else:
            a, b = min(((c, d) for c, d in self.around if c <= a and b <= d), key=lambda x: x[1] - x[0], default=(0, len(self.items)))
        wanted = sorted({block for kind, n, block in self.items[a:b] if n and kind[0] != "-"})
        return "\n\n".join(x for i in wanted if (x := " ".join(html.unescape(self.blocks[i]).split())))


def learn(pages: DataFrame) -> dict[str, float]:
    """Weights of kinds of words and tags from labelled pages of pages (page_id, html)."""
    rows = pages.select("page_id", F.col("html").cast("string").alias("html")).filter(F.col("html").rlike(r"(?i)<(article|main)\b"))
    few = rows.select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(SAMPLE)
    rows = rows.join(F.broadcast(few), "page_id", "left_semi")  # SAMPLE rows at most

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inside, outside = Counter(), Counter()
            for t in batch.column(0).to_pylist():
                page = Page(t)
                if len(page.marked) == 1:
                    a, b = page.marked[0]
                    for i, (kind, n, _) in enumerate(page.items):
                        if kind[0] != "-":
                            (inside if a < i < b - 1 else outside)[kind] += n or 1
            kinds = list(inside | outside)
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array([inside[k] for k in kinds], pa.int64()), pa.array([outside[k] for k in kinds], pa.int64())], ["kind", "inside", "outside"])

    sums = map_texts(rows.select("html"), counted, "kind string, inside long, outside long").groupBy("kind").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    weights = {}
    for r in sums.collect():  # kinds of NAMES
        odds = math.log((r["inside"] + 1) / (r["outside"] + 1))
        weights[r["kind"]] = min(2.0, max(0.2, odds / 3)) if r["kind"].startswith("word ") else -min(6.0, max(0.3, 1.5 - odds / 2))
    return weights


TEXT = "page_id long, url string, text string, n_chars long"


def extracted(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """page_id, url, main text and its code points of every row of pages (page_id, url, html)."""
    weights = learn(pages) if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [Page(t.as_py()).text(weights) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return map_texts(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")), run, TEXT)
