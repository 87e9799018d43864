"""Main text of HTML pages by the distribution of text over line blocks.

Markup is stripped to lines, one for each block of the page; elements that are never an article's text (menus, forms,
adverts, ...) leave blank lines, as do lines of links. The text lengths of a sliding window of lines rise above SURGE at
a surge point and fall to nothing at a dive point; the lines between them are kept. A declared article is checked
against them: all its lines are the main text if at least half of what was found stands in it, else it is ignored and
the other text in the containers of the lines that were found is kept, too.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, whole_text

#: Lines in a window, and the characters in it beyond which text begins.
WINDOW = 3
SURGE = 86

# Element names and words of HTML.
RAW = ("script", "style", "textarea")
#: Left out if they have an end tag of their own; what follows an unclosed one is text of the page.
MEDIA = frozenset("noscript template iframe svg math object video audio canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUT = frozenset("head title nav header footer aside form menu dialog button select fieldset".split())
IN_HEAD = frozenset("base link meta title noscript template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner banners cookie cookies consent gdpr notice notices alert sidebar sidebars comment comments commentlist disqus reply replies respond menu menus nav navbar"
    " navigation breadcrumb breadcrumbs footer header masthead share sharing social related recommended promo promotion sponsor sponsored newsletter subscribe subscription signup popup modal overlay widget widgets toolbar pagination pager copyright login"
    " adsense adslot adbox adunit adcontainer adwrapper disclaimer".split()
)
#: Words that stand beside those in a class or id that names one thing, as in site-footer or comment-list.
BESIDE = frozenset(
    "site page main top bottom left right upper lower primary secondary global mobile desktop sticky fixed inner outer area box bar block section list link links item items post posts article articles"
    " story stories button buttons icon icons title form body text slot unit space zone wrap wrapper container count mini first last js".split()
)
#: An element with one of these is no article's wrapper, however much of the page it holds.
NEVER_TEXT = frozenset("ad ads advert adverts advertisement advertising adsense adslot adbox adunit cookie cookies consent gdpr comment comments commentlist disqus reply replies respond copyright disclaimer".split())
OF_ARTICLES = frozenset("comment comments reply replies ad advert advertisement sponsored promo".split())
NEVER_OUT = frozenset("html body main h1 h2 h3 h4 h5 h6".split())
#: Containers of paragraphs and other blocks.
HOLDERS = frozenset("article body div main section td".split())
#: An open p ends where one of these begins.
ENDS_P = frozenset("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

#: What may begin a tag, and the two raw elements' ends; each is tried at one place and never looks back.
TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
ATTRIBUTES = re.compile(r"[^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+)*+>")
RAW_TAG = re.compile(r"<(/?)(?:" + "|".join(RAW) + r")\b", re.I)
RAW_END = {name: re.compile(rf"</{name}\s*+>", re.I) for name in RAW}
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Line(NamedTuple):
    """A line, or (text None) the end of an element that may be left out."""

    text: str | None
    declared: int  # the innermost element that may be left out around the outermost article or main; NONE outside of any
    links: bool  # mostly links
    within: int  # the innermost element that may be left out around it, or TOP
    block: int = 0  # the element that holds the line, and the container around that, by the order in which they begin
    around: int = 0
    kind: str = "p"  # of the block


#: No declared article; no element that may be left out.
NONE, TOP = -2, -1
BLANK = Line("", NONE, False, TOP)


def names(found: dict[str, str], words: frozenset[str]) -> set[str]:
    """Those of the words that a class or id consists of, as a whole."""
    out: set[str] = set()
    for token in (found.get("class", "") + " " + found.get("id", "")).split():
        pieces = {p.lower() for p in PIECES.findall(token)}
        if pieces <= words | BESIDE:
            out |= pieces & words
    return out


#: What is_out() says: no, unless it is around the text, unless it is around a declared article, yes.
IN, WRAPPER, HOLDER, OUTSIDE = range(4)


def is_out(name: str, attributes: str) -> int:
    """Whether an element is a menu, header, footer, sidebar, notice, advert, form, reader comment or hidden."""
    if name in OUT:
        return WRAPPER if name in ("form", "fieldset") else OUTSIDE
    if not attributes or name in NEVER_OUT:
        return IN
    found = {k.lower(): (v or "").strip("\"'") for k, v in ATTRIBUTE.findall(attributes)}
    if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower():
        return OUTSIDE
    if name == "article":
        return OUTSIDE if names(found, OF_ARTICLES) else IN
    words = names(found, WORDS)
    return HOLDER if words & NEVER_TEXT else WRAPPER if words or found.get("role", "").lower() in ROLES else IN


class Tags:
    """The end of a tag that begins at a place, in time that adds up to the page's length over all of them.

    A tag ends at the first > outside of quotes; one whose quotes run to the end of the page without any is no tag, and
    the places behind its quoted values are remembered, so that no later tag walks the same way.
    """

    def __init__(self, page: str):
        self.page, self.dead = page, set[int]()
        self.quick, self.spots, self.same = True, list[int](), list[int]()

    def end(self, at: int) -> int:
        if self.quick:
            if m := ATTRIBUTES.match(self.page, at):
                return m.end()
            self.quick = False
            self.spots = [m.start() for m in re.finditer("[\"'>]", self.page)]
            self.same, last = [-1] * len(self.spots), {}  # the next of the same kind
            for k in range(len(self.spots) - 1, -1, -1):
                c = self.page[self.spots[k]]
                self.same[k], last[c] = last.get(c, -1), k
        k, seen = bisect_left(self.spots, at), []
        while k < len(self.spots):
            if self.page[self.spots[k]] == ">":
                return self.spots[k] + 1
            k = self.same[k] + 1
            if not k or k in self.dead:
                break
            seen.append(k)
        self.dead.update(seen)
        return -1


def pieces(page: str) -> Iterator[tuple[str, str, str, bool]]:
    """The page in its order: texts as ("", text, "", False), tags as (name, "", attributes, is an end tag); comments are left out, raw elements are ("script", "", "", False)."""
    last = at = 0
    tags, ended = Tags(page), page.rfind(">")  # behind the last > nothing is a tag
    while (at := page.find("<", at)) >= 0:
        begin, name, attributes, closing = at, "", "", False
        if page.startswith("<!--", at) or page.startswith("<![CDATA[", at):
            mark, skip = ("-->", 4) if page[at + 2] == "-" else ("]]>", 9)
            end = page.find(mark, at + skip)
            at = len(page) if end < 0 else end + 3
        elif page[at + 1 : at + 2] in ("!", "?") and at + 1 < len(page):
            end = page.find(">", at)
            at = len(page) if end < 0 else end + 1
        else:
            m = TAG.match(page, at) if at < ended else None
            end = -1
            if m:
                closing, name = m[1] == "/", page[m.start(2) : min(m.end(2), m.start(2) + 64)].lower()
                if name in RAW and not closing:
                    end = page.find(">", m.end()) + 1
                    behind = None
                    if page[end - 2] == "/":  # closed in itself, unless the next raw tag is an end
                        behind = RAW_TAG.search(page, end)
                    if page[end - 2] != "/" or (behind and behind[1]):
                        close = RAW_END[name].search(page, end)
                        end = close.end() if close else len(page)
                    else:
                        name = ""
                else:
                    end = tags.end(m.end())
                    attributes = page[m.end() : max(end - 1, m.end())]
            if end < 0:
                at += 1
                continue
            at = end
        if begin > last:
            yield "", page[last:begin], "", False
        last = at
        if name:
            yield name, "", attributes, closing
    if last < len(page):
        yield "", page[last:], "", False


class Page:
    """A page as it is walked: the open elements, with the places of some kinds among them, and the lines so far."""

    def __init__(self) -> None:
        self.lines: list[Line] = []
        self.parts: list[str] = []
        self.links = 0  # characters of parts in links
        self.open: list[str] = []
        self.begun: list[int] = []  # the numbers of the open elements
        self.opened: dict[str, int] = defaultdict(int)
        self.blocks: list[int] = []  # places of open elements that aren't inline
        self.holders: list[int] = []
        self.lists: list[int] = []
        self.count = 0
        self.out_at = -1  # how many elements are open around the outermost one that is left out
        self.inside: list[int] = []  # the same of the articles that are open
        self.declared = NONE
        self.media: list[tuple[int, int, list[str], int, int]] = []  # the same of open MEDIA, and lines, parts and links before
        self.maybe: list[int] = []  # the same of the elements that may be left out
        self.within = TOP
        self.grades: list[int] = []  # of all elements that may be left out
        self.parents: list[int] = []

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            at = self.blocks[-1] if self.blocks else -1
            up = -1
            if self.holders:
                up = self.holders[-1] if self.holders[-1] != at else self.holders[-2] if len(self.holders) > 1 else -1
            around = 0 if up < 0 or self.open[up] == "body" else self.begun[up]
            self.lines.append(Line(text, self.declared, 2 * self.links > len(text), self.within, self.begun[at] if at >= 0 else 0, around, self.open[at] if at >= 0 else "body"))
        self.parts, self.links = [], 0

    def add(self, text: str) -> None:
        if self.out_at < 0:
            self.parts.append(html.unescape(text))
            if self.opened["a"]:
                self.links += len(self.parts[-1].strip())

    def close(self, to: int, ended: bool = False) -> None:
        if self.maybe and self.maybe[-1] >= to:
            self.flush()
        for name in self.open[to:]:
            self.opened[name] -= 1
        del self.open[to:], self.begun[to:]
        for places in (self.blocks, self.holders, self.lists, self.inside):
            while places and places[-1] >= to:
                places.pop()
        if 0 <= to <= self.out_at:
            self.out_at = -1
            self.lines.extend([BLANK] * WINDOW)
        while self.maybe and self.maybe[-1] >= to:
            self.maybe.pop()
            self.lines.extend([Line(None, NONE, False, self.within)] * WINDOW)
            self.within = self.parents[self.within]
        if not self.inside:
            self.declared = NONE
        while self.media and self.media[-1][0] >= to:
            at, n, before, length, linked = self.media.pop()
            if ended and at == to:
                del self.lines[n:]
                self.parts, self.links = [*before[:length], " "], linked

    def begin(self, name: str, attributes: str) -> None:
        if self.open and self.open[-1] == "head" and name not in IN_HEAD:
            self.close(len(self.open) - 1)
        if name in ENDS_P and self.blocks and self.open[self.blocks[-1]] == "p":
            self.close(self.blocks[-1])
        elif name == "li" and self.lists and self.open[self.lists[-1]] == "li":
            self.close(self.lists[-1])
        grade = is_out(name, attributes) if self.out_at < 0 and name not in MEDIA else IN
        if grade:
            self.flush()
        at = len(self.open)
        if grade == OUTSIDE:
            self.out_at = at
        elif grade:
            self.maybe.append(at)
            self.parents.append(self.within)
            self.within = len(self.grades)
            self.grades.append(grade)
        elif self.out_at < 0 and name in ("article", "main"):
            self.declared = self.within if not self.inside else self.declared
            self.inside.append(at)
        if self.out_at < 0 and name in MEDIA:
            self.media.append((at, len(self.lines), self.parts, len(self.parts), self.links))
        if attributes.endswith("/"):
            self.close(at)
            return
        self.count += 1
        self.open.append(name)
        self.opened[name] += 1
        self.begun.append(0 if name == "body" else self.count)
        if name not in INLINE:
            self.blocks.append(at)
        if name in HOLDERS:
            self.holders.append(at)
        if name in ("li", "ul", "ol"):
            self.lists.append(at)

    def end(self, name: str) -> None:
        if self.opened[name]:
            at = len(self.open) - 1
            while self.open[at] != name:
                at -= 1
            self.close(at, True)


def lines_of(page: str) -> list[Line]:
    """The lines of a page, blank ones where an element was left out."""
    walk = Page()
    for name, text, attributes, closing in pieces(page):
        if not name:
            walk.add(text)
            continue
        if walk.out_at < 0:
            if name in MEDIA or (name in RAW and not closing):
                walk.parts.append(" ")
            elif name not in INLINE:
                walk.flush()
        if name in RAW and not closing:
            continue
        if closing:
            walk.end(name)
        elif name not in VOID:
            walk.begin(name, attributes)
    walk.flush()
    return left(walk.lines, walk.grades, walk.parents) if walk.grades else walk.lines


def left(lines: list[Line], grades: list[int], parents: list[int]) -> list[Line]:
    """The lines without the elements that may be left out.

    One stays if it is around at least half of the text of declared articles, or (a WRAPPER) has most of the page's text
    that isn't links while nothing is declared outside of it. Elements' sums are those of their lines and of the elements
    in them, which begin after them.
    """
    text, around, inner = ([0] * (len(grades) + 1) for _ in range(3))  # the last place is that of TOP
    all_text = all_declared = own = 0
    for line in lines:
        if line.text:
            n = 0 if line.links else len(line.text)
            all_text += n
            text[line.within] += n
            if line.declared != NONE:
                all_declared += len(line.text)
                inner[line.within] += len(line.text)
                around[line.declared] += len(line.text)
                own += len(line.text) if line.within == line.declared else 0  # not in an element within the article
    for e in range(len(grades) - 1, -1, -1):
        for sums in (text, around, inner):
            if parents[e] != TOP:
                sums[parents[e]] += sums[e]
    gone = [False] * (len(grades) + 1)
    for e, grade in enumerate(grades):
        most_declared = around[e] and 2 * around[e] >= own
        most_text = grade == WRAPPER and 2 * text[e] > all_text and inner[e] == all_declared
        gone[e] = gone[parents[e]] or not (most_declared or most_text)
    out = []
    for line in lines:
        if line.text is None:
            out.extend([BLANK] * gone[line.within])
        elif not gone[line.within]:
            out.append(line)
    return out


def between(lengths: list[int]) -> list[int]:
    """The places of text between surge and dive points."""
    sums = [sum(lengths[i : i + WINDOW]) for i in range(len(lengths))]
    found, within = [], False
    for i, total in enumerate(sums):
        within = (within or total > SURGE) if lengths[i] else within and total > 0
        if within and lengths[i]:
            found.append(i)
    return found


def containers(lines: list[Line], found: list[int]) -> list[int]:
    """The places found and those of other text that stands in the same containers.

    A line that a div, section or the like holds itself is in that one, and in the next one around where more lines
    found are set in the same way; other blocks are in the next one around them.
    """
    alike: dict[int, set[int]] = {}
    for i in found:
        if lines[i].kind in HOLDERS:
            alike.setdefault(lines[i].around, set()).add(lines[i].block)

    def of(line: Line) -> set[int]:
        if line.kind not in HOLDERS:
            return {line.around}
        return {line.block, line.around} if line.around and (line.kind == "td" or len(alike.get(line.around, ())) > 1) else {line.block}

    own = set().union(*(of(lines[i]) for i in found))
    return [i for i, line in enumerate(lines) if line.text and not line.links and not own.isdisjoint(of(line))]


def longest_run(lengths: list[int]) -> list[int]:
    runs, begin = [], None
    for i, n in enumerate([*lengths, 0]):
        if n and begin is None:
            begin = i
        elif not n and begin is not None:
            runs.append((begin, i))
            begin = None
    return list(range(*max(runs, key=lambda r: (sum(lengths[r[0] : r[1]]), -r[0])))) if runs else []


def kept(lines: list[Line]) -> list[str]:
    """The texts between surge and dive points and in their containers, or all of the declared element if it holds at least half of those between."""
    lengths = [0 if line.links else len(line.text) for line in lines]
    inside = [i for i, line in enumerate(lines) if line.text and line.declared != NONE]
    found = between(lengths)
    if found:
        agrees = 2 * sum(lengths[i] for i in found if lines[i].declared != NONE) >= sum(lengths[i] for i in found)
        found = found if inside and agrees else sorted({*found, *containers(lines, found)})
    else:  # no surge: the longest run of lines
        found = longest_run(lengths)
        agrees = sum(len(lines[i].text) for i in inside) >= sum(lengths[i] for i in found if lines[i].declared == NONE)
    return [lines[i].text for i in (inside if inside and agrees else found)]


def main_text(page: str) -> str:
    return " ".join(kept(lines_of(page)))


SCHEMA = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame) -> DataFrame:
    """A row for each page (page_id, url, html): its main text and the code points in it.

    A null or empty page, or one without text, has the text "" and length 0. White space is what Unicode calls so (a
    no-break space as well) and the four ASCII separators. A page is walked once, forwards: megabytes of broken markup
    take seconds. Null ids and urls stay null, repeated rows give repeated rows, an empty table gives none; other columns
    are not read.
    """
    arrow_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), whole_text("html").alias("html")).mapInArrow(run, SCHEMA)
