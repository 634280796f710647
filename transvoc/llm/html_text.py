"""Main text of web pages by line-block distribution.

1. Markup is stripped: scripts, styles, comments and the elements that are not
   text, and elements that their tag, role, class or id calls a menu, page header,
   footer, sidebar, notice, advert, form or reader comments, leave empty lines;
   block elements and ``br`` end a line, other tags vanish.  A class, role or id
   is weak evidence (see :func:`_name` and :func:`_settle`): an element that holds the article or most of the page's
   unlinked text stays, and inside an article a word that may be a topic counts
   only for short or linked text.
2. Each line has a weight, the length of its text outside links; the block at a
   line is the sum of weights over a window of ``WINDOW`` lines that starts there.
3. A run of text begins at a surge point, a line whose block reaches
   ``SURGE`` characters and whose next lines carry text as well, and ends at a dive
   point, the next line from which the block is empty.  Lines of text that touch
   a run (a heading, a short last paragraph) belong to it.
4. The heaviest run is the field, with the runs, and the lines of the same
   container, that are parted from it only by stripped elements.
5. Where the page marks its article (``article``, ``main``, role ``main``, or an
   ``articleBody`` property; the outermost such element counts), the mark is
   evidence for the field's bounds.  The heaviest marked element is the field, with the marked
   elements whose runs reach it through lines of runs or stripped elements alone, and the unlinked text
   between them; short lines inside a mark count without a surge.  Lines of an
   outer mark beside its inner ones need unlinked text or a run.  If a field of runs
   outside outweighs it, the runs decide as if there were no mark.

A page is handled where it is read, so there is no shuffle; memory is one page's.

Defined results: null or empty HTML, or a page without text, gives the empty
string.  Text outside any element is text.  An element that is never closed ends
with its parent or, if that is unknown, at the next block element, so a broken
menu does not swallow the page.  Character references are decoded after the
markup has gone.  White space in a block becomes one space, ends are trimmed,
blocks are joined by one newline, in page order.  Repeated rows each give a row;
extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
SURGE = 80

#: Elements whose text is not read, and elements beside the article.
NO_TEXT = frozenset("script style noscript template svg math head title iframe object canvas audio video map "
                    "select datalist textarea button".split())
BESIDE = frozenset("nav header footer aside form menu dialog".split())
#: Words of a class, id or role that name what stands beside the article.
BESIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent "
    "gdpr notice popup modal overlay newsletter subscribe subscription paywall sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs masthead footer comment comments disqus replies share sharing social related recommended "
    "recommendations widget login signup search toolbar pagination pager complementary contentinfo".split())
#: Of these, the ones that an article may be about or a part of it be called.
TOPIC_WORDS = frozenset(
    "promotion cookies consent notice popup modal overlay subscribe subscription menu navigation share sharing social "
    "related recommended recommendations widget login signup search toolbar".split())
READER_WORDS = frozenset("comment comments disqus replies".split())
#: What follows one of these in a name is said of the element, not its name.
NEGATED = frozenset("has no with without hide".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words that name a page's head only where no article is open.
HEADER_WORDS = frozenset({"header"})
ARTICLE_ROLES = frozenset({"main", "article"})
#: Elements that stand inside a line, and those without an end tag.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby "
                   "s samp small span strike strong sub sup time tt u var wbr nobr picture source".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose end tag may be left out: a new block ends them.
CONTAINERS = frozenset("html body div section article main center table".split())
#: Elements inside a line whose content is not read, up to their own end tag; without one, or closed in their own tag,
#: they hold nothing.
SKIPPED = frozenset("svg noscript template iframe".split())
LOOSE = frozenset("p li dt dd tr td th option thead tbody tfoot".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|textarea|title)(?=[\s/>])(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>", re.S | re.I)
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|itemprop|aria-label|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


@dataclass
class Line:
    text: str
    linked: int = 0      # characters inside links
    stripped: bool = False
    article: int = -1    # number of the outermost article element that holds it
    inner: int = -1      # number of the innermost one
    box: int = 0         # number of the innermost container that holds it
    name: int = -1       # number of the innermost element that holds it and has a name of what stands beside


@dataclass
class _Open:
    tag: str
    beside: bool   # is itself stripped, or may be for its name
    hidden: bool   # it, or an element around it, is stripped
    article: int
    inner: int
    box: int
    name: int


@dataclass
class _Name:
    """An element with a name of what stands beside the article."""
    strong: bool    # whatever it holds
    reader: bool    # reader comments
    short: bool     # so little text is stripped, linked or not
    parent: int = -1


@dataclass
class _Page:
    lines: list[Line] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    linked: int = 0

    def end_line(self, stripped: bool, article: int, inner: int, box: int, name: int) -> None:
        text = " ".join(html.unescape("".join(self.parts)).split())
        if text or stripped or name >= 0:
            self.lines.append(Line("" if stripped else text, self.linked, stripped, article, inner, box, name))
        self.parts, self.linked = [], 0


def _beside(tag: str, in_article: bool) -> bool:
    return tag in NO_TEXT or (tag in BESIDE and not (tag == "header" and in_article))


def _name(tag: str, attributes: str, in_article: bool) -> _Name | None:
    """What the element's class, role and id say, if they hold a word of what stands beside the article."""
    if tag in ("html", "body") or not attributes:
        return None
    classes, ids = set(), set()
    for name, value in ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name not in ("class", "id", "role") or (
                name == "id" and (tag in HEADINGS or (tag == "section" and in_article))):
            continue
        for part in value.strip("\"'").split():
            words = [w.lower() for w in NAME_PART.findall(part)]
            end = next((i for i, w in enumerate(words) if w in NEGATED), len(words))
            (ids if name == "id" else classes).update(words[:end])
    known = READER_WORDS if tag in ("article", "main") else BESIDE_WORDS if in_article else BESIDE_WORDS | HEADER_WORDS
    classes, ids = classes & known, ids & known
    if in_article and tag in INLINE and tag != "a":
        classes, ids = classes - TOPIC_WORDS, ids - TOPIC_WORDS
    if not classes and not ids:
        return None
    topic = (classes | ids) <= TOPIC_WORDS and (in_article or (tag == "section" and not classes))
    return _Name(not topic, bool((classes | ids) & READER_WORDS), bool(classes) or not in_article)


def _weight(line: Line) -> int:
    return 0 if line.stripped or 2 * line.linked > len(line.text) else len(line.text)


def _settle(lines: list[Line], names: list[_Name], marks: list[int]) -> list[Line]:
    """``lines`` with those of named elements stripped, or not.

    ``marks`` has the innermost named element around each article element.  A named element stays if it holds the
    article, which is the heaviest marked element outside named ones, or else one in them that outweighs all text
    outside them; or if it holds most of the page's unlinked text (reader comments: if no article is marked outside).
    Of the rest, those that may be a part of the article stay if their unlinked text is as dense as a run's."""
    if not names:
        return lines
    weight, size, linked, count = ([0] * len(names) for _ in range(4))
    marked, plain = [0] * len(marks), 0
    for x in lines:
        w = _weight(x)
        if x.inner >= 0 and x.name == marks[x.inner]:
            marked[x.inner] += w
        if x.name < 0:
            plain += w
        else:
            weight[x.name] += w
            size[x.name] += len(x.text)
            linked[x.name] += x.linked
            count[x.name] += bool(x.text)
    total = plain + sum(weight)
    for i in range(len(names) - 1, -1, -1):
        up = names[i].parent
        if up >= 0:
            for of in (weight, size, linked, count):
                of[up] += of[i]
    reader = []
    for e in names:
        reader.append(e.reader or (e.parent >= 0 and reader[e.parent]))
    free = any(n < 0 and w >= SURGE for n, w in zip(marks, marked, strict=True))
    holds = set()
    if not free:
        inside = [(w, -k) for k, (n, w) in enumerate(zip(marks, marked, strict=True))
                  if n >= 0 and not reader[n] and w > plain]
        at = marks[-max(inside)[1]] if inside else -1
        while at >= 0:
            holds.add(at)
            at = names[at].parent
    gone: list[bool] = []
    for i, e in enumerate(names):
        if e.parent >= 0 and gone[e.parent]:
            gone.append(True)
        elif i in holds or (2 * weight[i] > total and not (reader[i] and free)):
            gone.append(False)
        else:
            dense = weight[i] >= SURGE and weight[i] * WINDOW >= SURGE * count[i]
            gone.append(e.strong or 2 * linked[i] > size[i] or (e.short and not dense))
    out = []
    for x in lines:
        if x.name >= 0 and gone[x.name]:
            out.append(Line("", 0, True, x.article, x.inner, x.box, x.name))
        elif x.text or x.stripped:
            out.append(x)
    return out


def _is_article(tag: str, attributes: str) -> bool:
    if tag in ("article", "main"):
        return True
    return any((name.lower() == "role" and value.strip("\"'").lower() in ARTICLE_ROLES)
               or (name.lower() == "itemprop" and value.strip("\"'") == "articleBody")
               for name, value in ATTRIBUTE.findall(attributes))


def _skips(tokens: list[re.Match[str]]) -> dict[int, int]:
    """The token that ends each element of ``SKIPPED``, by the token that starts it; an end tag belongs to the last
    open start tag of its name."""
    open_: dict[str, list[int]] = {}
    ends: dict[int, int] = {}
    for i, m in enumerate(tokens):
        tag = (m[3] or "").lower()
        if tag in SKIPPED:
            starts = open_.setdefault(tag, [])
            if not m[2]:
                if not (tag == "svg" and m[4].rstrip()[-1:] == "/"):
                    starts.append(i)
            elif starts:
                ends[starts.pop()] = i
    return ends


def lines_of(page: str) -> list[Line]:
    """The page's lines, with empty ones for what was stripped."""
    out = _Page()
    stack: list[_Open] = []
    boxes = 0
    names: list[_Name] = []
    marks: list[int] = []
    # Elements that the page never closes must not hide what follows.
    tokens = list(TOKEN.finditer(page))
    skips = _skips(tokens)
    last_end = {m[3].lower(): m.start() for m in tokens if m[2]}

    def state() -> tuple[bool, int, int, int, int]:
        if not stack:
            return False, -1, -1, 0, -1
        x = stack[-1]
        return x.hidden, x.article, x.inner, x.box, x.name

    def push(tag: str, beside: bool, named: _Name | None, marked: bool = False) -> None:
        nonlocal boxes
        hidden, article, inner, box, name = state()
        if tag in CONTAINERS:
            boxes = box = boxes + 1
        if named:
            named.parent, name = name, len(names)
            names.append(named)
        if marked:
            inner = len(marks)
            marks.append(name)
            article = inner if article < 0 else article
        stack.append(_Open(tag, beside or named is not None, beside or hidden, article, inner, box, name))

    def pop_to(i: int) -> None:
        out.end_line(*state())
        del stack[i:]

    at, links, until = 0, 0, -1
    for k, m in enumerate(tokens):
        if k <= until:
            at = m.end()
            continue
        piece = page[at:m.start()]
        at = m.end()
        if piece:
            if not state()[0]:
                out.parts.append(piece)
                if links:
                    out.linked += len(" ".join(piece.split()))
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if tag in SKIPPED:
            until = skips.get(k, -1)
            continue
        if tag == "br":
            out.end_line(*state())
            continue
        if m[2]:  # an end tag
            if tag == "a":
                links = max(0, links - 1)
            if tag in INLINE:
                where = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == tag and stack[i].beside), -1)
                if where >= 0:
                    pop_to(where)
                continue
            where = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == tag), -1)
            if where >= 0:
                pop_to(where)
            else:
                out.end_line(*state())
            links = 0
            continue
        attributes = m[4]
        in_article = state()[1] >= 0
        beside = _beside(tag, in_article)
        named = None if beside or state()[0] else _name(tag, attributes, in_article)
        if tag == "a":
            links += 1
        if tag in VOID:
            if tag not in INLINE:
                out.end_line(*state())
            continue
        if tag in INLINE:
            if (beside or named) and attributes.rstrip()[-1:] != "/" and last_end.get(tag, -1) > m.start():
                out.end_line(*state())
                push(tag, beside, named)
            continue
        out.end_line(*state())
        links = 0
        while stack and stack[-1].tag in LOOSE and (tag not in LOOSE or stack[-1].tag == tag or tag == "p"):
            if stack[-1].tag != "p" and tag not in LOOSE:
                break  # a list item or cell may hold blocks
            stack.pop()
        if attributes.rstrip()[-1:] == "/" and tag not in LOOSE:
            continue
        closed = tag in LOOSE or last_end.get(tag, -1) > m.start()
        push(tag, beside and closed, named if closed else None,
             _is_article(tag, attributes) and not state()[0] and not beside)
    tail = page[at:]
    if tail and not state()[0]:
        # A tag that the page's end cuts off is not text.
        out.parts.append(re.sub(r"<[/!?a-zA-Z][^>]*\Z", "", tail))
    out.end_line(*state())
    return _settle(out.lines, names, marks)


def runs(weights: list[int]) -> list[tuple[int, int]]:
    """(surge, dive) of each run of text in the distribution of blocks."""
    n = len(weights)
    blocks = [sum(weights[i:i + WINDOW]) for i in range(n)]
    found, i = [], 0
    while i < n:
        if blocks[i] >= SURGE and weights[i] and any(weights[i:i + WINDOW]):
            dive = i
            while dive < n and blocks[dive]:
                dive += 1
            start = i
            while start and weights[start - 1]:
                start -= 1
            found.append((start, dive))
            i = dive
        i += 1
    return found


def _reach(lines: list[Line], weights: list[int], at: int, step: int) -> int:
    """The last line of text that can be reached from ``at`` past stripped lines alone, in the same container."""
    i = at + step
    while 0 <= i < len(lines):
        if weights[i] and lines[i].box == lines[at].box:
            at = i
        elif not lines[i].stripped:
            break
        i += step
    return at


def _field(lines: list[Line], weights: list[int]) -> tuple[int, int] | None:
    """First line and end of the heaviest run and what belongs to it."""
    found = runs(weights)
    if not found:
        return None
    heavy = max(range(len(found)), key=lambda k: sum(weights[found[k][0]:found[k][1]]))
    first = last = heavy
    only_stripped = lambda a, b: all(x.stripped for x in lines[a:b])
    while first and only_stripped(found[first - 1][1], found[first][0]):
        first -= 1
    while last + 1 < len(found) and only_stripped(found[last][1], found[last + 1][0]):
        last += 1
    start, end = found[first][0], found[last][1]
    return _reach(lines, weights, start, -1), _reach(lines, weights, end - 1, 1) + 1


def _marked_field(lines: list[Line], weights: list[int]) -> list[int]:
    """The lines of the marked article, none if the page has no mark or a field outside outweighs it."""
    spans: dict[int, tuple[int, int]] = {}
    sizes: dict[int, tuple[int, int]] = {}
    for i, (x, w) in enumerate(zip(lines, weights, strict=True)):
        if x.article >= 0 and x.text:
            spans[x.article] = (spans.get(x.article, (i, i))[0], i + 1)
            a, b = sizes.get(x.article, (0, 0))
            sizes[x.article] = (a + w, b + len(x.text))
    if not sizes:
        return []
    covered = [False] * len(lines)
    for a, b in runs(weights):
        covered[a:b] = [True] * (b - a)
    order = sorted(spans, key=lambda k: spans[k])
    first = last = order.index(max(sizes, key=lambda k: (sizes[k], -k)))

    def joined(k: int, a: int, b: int) -> bool:
        """The ``k``-th mark holds text of a run, and only runs and stripped elements lie in between."""
        return (any(covered[i] and weights[i] for i in range(*spans[order[k]]))
                and all(covered[i] or lines[i].stripped for i in range(a, b)))

    while first and joined(first - 1, spans[order[first - 1]][1], spans[order[first]][0]):
        first -= 1
    while last + 1 < len(order) and joined(last + 1, spans[order[last]][1], spans[order[last + 1]][0]):
        last += 1
    start, end = spans[order[first]][0], spans[order[last]][1]
    outside = [0 if start <= i < end else w for i, w in enumerate(weights)]
    other = _field(lines, outside)
    if other and sum(outside[slice(*other)]) > sum(weights[start:end]):
        return []
    nested = {x.article for x in lines if x.inner != x.article}
    return [i for i in range(start, end)
            if weights[i] or (lines[i].article >= 0 and (
                covered[i] or lines[i].inner != lines[i].article or lines[i].article not in nested))]


def main_text(page: str | None) -> str:
    """The page's article."""
    lines = lines_of(page) if page else []
    weights = [_weight(x) for x in lines]
    kept = _marked_field(lines, weights)
    if not kept:
        field_ = _field(lines, weights)
        # No surge on so short a page: all lines outside links.
        kept = range(*field_) if field_ else [i for i, w in enumerate(weights) if w]
    return "\n".join(lines[i].text for i in kept if lines[i].text)


def extract(pages: DataFrame, *, content: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The ``keep`` columns of every page with ``text``, its main text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(keep))), pa.array(texts, pa.string())],
                names=[*keep, "text"])

    schema = pages.select(*keep).schema.add("text", "string")
    return pages.select(*keep, F.col(content).alias("__html")).mapInArrow(run, schema)
