"""Main text of web pages by a maximum-scoring subsequence of words and tags.

A page is a sequence of tags and pieces of text. Each word scores the log odds of its place (the element it stands in
and those around it) being main text, each tag a negative score; one linear scan finds the contiguous
run of the highest sum. The scores are fitted on labelled pages: pages of the table in which the author
marks the text with exactly one ``article`` or ``main`` element (at most ``most`` of them, the first by a hash of their id),
together with the counts of ``PRIOR`` for the places that those pages lack: a place with ``ENOUGH`` words in them is scored
by them alone. Inside the run, elements that are not part of the text by their name or role are left out (a
role is a whole class, id or role value made of role words and such as say where a box stands; headings and paragraphs are never left out by a
value), white space in a block becomes one space and the blocks are joined by empty lines. Marks cannot tell reader comments inside an
article from its text, so role words stay a fixed list; words may score below zero as well as tags.

Defined results: null and empty html give an empty text; a page without a positive run (no words, menus only) gives an empty text; unclosed and unknown
tags, broken references and a page cut off in a tag are read as far as they go; rows with a null id are extracted and not
learned from; repeated rows repeat; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import html as references
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemark.llm.rows import map_arrow
from telemark.session import settle

MOST_LEARNED = 2000
#: Words of a place in marked pages from which it needs no prior.
ENOUGH = 500

#: Element names of HTML by what they do to a text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav "
    "ol option p pre section summary table tbody tfoot thead tr ul caption".split()
)
RAW = frozenset("script style noscript template textarea title iframe svg object select".split())
APART = frozenset("nav footer aside form button dialog menu label".split())
CLOSES_P = BLOCK - {"body", "html", "head"}
#: Role words in class, id and role attributes of elements that are no part of the text.
ROLES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs footer header masthead "
    "topbar toolbar cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommended recommendations "
    "comment comments commentlist respond disqus reply replies discussion pagination pager widget widgets form contentinfo complementary copyright tags tagcloud skip disclaimer paywall teaser rail".split()
)
#: Words that say where a box stands, beside a role word.
PLACES = frozenset(
    "site page main global top bottom left right upper lower header footer primary secondary list lists box bar block blocks section area wrap wrapper container inner outer slot unit item items panel "
    "group row column col banner body content text title heading link links button btn icon image img inline floating sticky fixed hidden mobile desktop js wp module component zone space region nav the".split()
)
#: Elements that no class, id or role value takes out of the text.
KEPT = frozenset("h1 h2 h3 h4 h5 h6 p".split())
CARDS = frozenset("ad ads advert advertisement sponsored promo related teaser comment comments reply".split())
TEXTUAL = frozenset("content article main body text entry post story page container wrapper".split())

#: Words in and out of the main text by place, as a small set of labelled layouts would count them.
PRIOR = {
    "p": (400, 20), "h1": (40, 4), "h2": (30, 6), "h3": (30, 8), "blockquote": (40, 2), "pre": (40, 2), "li": (40, 30), "td": (20, 20), "div": (40, 40), "article": (60, 2), "main": (60, 2), "section": (30, 10),
    "span": (20, 20), "a": (10, 60), "body": (30, 20), "nav": (0, 60), "footer": (0, 60), "aside": (0, 60), "header": (6, 40), "form": (0, 60), "button": (0, 40), "label": (0, 40), "role": (0, 120), "figcaption": (20, 5),
}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|title|iframe|svg|object|select)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:/>|>.*?(?:</(?P=raw)\s*>|\Z))"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest2>[^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_ROLE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _set_apart(name: str, rest: str, in_text: bool) -> bool:
    """Whether an element is no part of the text: by its name, its role words or because it is hidden."""
    if name in ("html", "body"):
        return False
    roles = CARDS if name in ("main", "article") else ROLES
    if name in APART or (name == "header" and not in_text):
        return True
    for key, a, b, c in _ROLE.findall(rest):
        value, key = (a or b or c), key.lower()
        if key == "hidden":
            return True
        if key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if key in ("class", "id", "role") and name not in KEPT and not (name == "header" and in_text):
            for word in value.split():
                parts = [p.lower() for p in _PART.findall(word)]
                if any(p in roles for p in parts) and all(p in roles or p in PLACES for p in parts) and parts[-1] not in TEXTUAL:
                    return True
    return False


@dataclass(frozen=True)
class Item:
    """A tag (``words`` 0) or a piece of text, with the names of the elements around it, inner first."""

    tag: str
    words: int
    text: str
    around: tuple[str, ...]
    apart: bool
    marked: int  # how many article or main elements it lies in
    block: bool = False


def items(page: str) -> Iterator[Item]:
    stack: list[tuple[str, bool, bool]] = []  # (name, apart, article or main)
    around: tuple[str, ...] = ()
    apart, marked = False, 0

    def settle_stack():
        nonlocal around, apart, marked
        around = tuple(n for n, _, _ in reversed(stack))
        apart, marked = any(a for _, a, _ in stack), sum(m for _, _, m in stack)

    for m in _TOKEN.finditer(page):
        if (text := m["text"]) is not None:
            decoded = references.unescape(text)
            yield Item("", len(decoded.split()), decoded, around, apart, marked)
            continue
        name = (m["name"] or m["name2"] or m["raw"] or "").lower()
        if not name or m["raw"]:
            if m["raw"]:
                yield Item(name, 0, "", around, apart, marked)
            continue
        if m["name"] is None and not m[0].endswith(">"):
            continue  # cut off in a tag
        rest = m["rest"] or m["rest2"] or ""
        if m["end"] or m["end2"]:
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            # an inline end tag does not close the blocks around it
            yield Item(f"/{name}", 0, "", around, apart, marked, name in BLOCK)
            if at is not None and (name in BLOCK or not any(n in BLOCK for n, _, _ in stack[at:])):
                del stack[at:]
                settle_stack()
        else:
            if name in CLOSES_P:
                closes = {"p"} | ({"li"} if name == "li" else {"dd", "dt"} if name in ("dd", "dt") else {"tr", "td", "th"} if name == "tr" else set())
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in closes:
                        del stack[i:]
                        break
                    if stack[i][0] in BLOCK:
                        break
            if name not in VOID and not rest.endswith("/"):
                stack.append((name, _set_apart(name, rest, marked > 0), name in ("article", "main")))
            settle_stack()
            yield Item(name, 0, "", around, apart, marked, name in BLOCK)


def _places(item: Item) -> tuple[str, ...]:
    """What a word's odds are read from: its innermost element, a link around it, the strangest element further out."""
    inner = item.around[0] if item.around else "body"
    block = next((n for n in item.around if n in BLOCK), "body")
    out = (inner if inner in PRIOR else "span", block if block in PRIOR else "div")
    if "a" in item.around[:3]:
        out += ("a",)
    return (*out, "role") if item.apart else out


def _mark(found: list[Item]) -> str | None:
    """The element name by which the author marks the text: the only article, or else the only main."""
    starts = Counter(i.tag for i in found if i.tag in ("article", "main") and i.around[:1] == (i.tag,) and not i.apart)
    return next((n for n in ("article", "main") if starts[n] == 1), None)


def _tallied(pages: list[str | None]) -> list[tuple[str, int, int]]:
    """(place, words in, words out) and (<tag>, in, out) of pages that mark one element as their text."""
    inside, outside = Counter(), Counter()
    for page in pages:
        found = list(items(page or ""))
        if (mark := _mark(found)) is None:
            continue
        for i in found:
            to = inside if mark in i.around and not i.apart else outside
            if i.words:
                for place in ("role",) if i.apart else set(_places(i)):
                    to[place] += i.words
            elif i.tag and not i.apart:
                to[f"<{i.tag}>"] += 1
    return [(k, inside[k], outside[k]) for k in sorted({*inside, *outside})]


@dataclass
class Scores:
    place: dict[str, float]
    tag: dict[str, float]

    def of(self, item: Item) -> float:
        if not item.words:
            return 0.0 if not item.tag else -4.0 if item.apart else self.tag.get(item.tag, -0.5)
        at = [self.place.get(p, 0.0) for p in _places(item)]
        return item.words * max(-3.0, min(3.0, at[0] / 2 + at[1] / 2 + sum(min(0.0, x) for x in at[2:])))


def scores(counts: dict[str, tuple[int, int]]) -> Scores:
    """Log odds; the prior's layouts weigh as much as a tenth of the words counted, at least as they are, and nothing where
    pages say enough of a place."""
    words = sum(a + b for k, (a, b) in counts.items() if k[0] != "<")
    weight = max(1.0, words / 10 / sum(a + b for a, b in PRIOR.values()))
    place = {}
    for k in {*PRIOR, *(k for k in counts if k[0] != "<")}:
        a, b = counts.get(k, (0, 0))
        c, d = PRIOR.get(k, (1, 1)) if a + b < ENOUGH else (0, 0)
        place[k] = math.log((a + weight * c + 1) / (b + weight * d + 1))
    tag = {k[1:-1]: -min(4.0, max(0.2, 0.5 - math.log((a + 1) / (b + 1)))) for k, (a, b) in counts.items() if k[0] == "<"}
    return Scores(place, tag)


def region(values: list[float]) -> tuple[int, int]:
    """[start, end) of the maximum-scoring run, the first and longest of equals; (0, 0) if none is positive."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for i, v in enumerate(values):
        total += v
        if total >= best and total > 0:
            best, found = total, (start, i + 1)
        if total < 0:
            total, start = 0.0, i + 1
    return found


def main_text(page: str | None, weights: Scores) -> str:
    found = list(items(page or ""))
    start, end = region([weights.of(x) for x in found])
    blocks, open_block = [], []
    for x in found[start:end]:
        if x.block:
            blocks.append(open_block)
            open_block = []
        elif x.tag in ("br", "td", "th", "/td", "/th"):
            open_block.append(" ")
        elif x.text and not x.apart:
            open_block.append(x.text)
    texts = (" ".join("".join(b).split()) for b in [*blocks, open_block])
    return "\n\n".join(t for t in texts if t)


def learn(pages: DataFrame, most: int = MOST_LEARNED) -> Scores:
    named = pages.where("page_id is not null and html is not null")
    taken = settle(named.select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(most).distinct(), "learned")
    texts = named.join(F.broadcast(taken), "page_id", "left_semi").select("html")

    def work(htmls):
        rows = _tallied(htmls)
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["place", "inside", "outside"]
        )

    total = map_arrow(texts, work, "place string, inside long, outside long").groupBy("place").agg(F.sum("inside").alias("a"), F.sum("outside").alias("b"))
    # tag names may be anything: those met most often, at most 1,000
    rows = total.orderBy(F.desc(F.col("a") + F.col("b")), "place").limit(1000).collect()
    return scores({r.place: (r.a, r.b) for r in rows})


def extracted(pages: DataFrame, most: int = MOST_LEARNED) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages``."""
    weights = learn(pages, most)

    def work(ids, urls, htmls):
        texts = [main_text(h, weights) for h in htmls]
        yield pa.RecordBatch.from_pydict(
            {"page_id": ids, "url": urls, "text": texts, "n_chars": [len(t) for t in texts]},
            pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())]),
        )

    return map_arrow(pages.select("page_id", "url", "html"), work, "page_id long, url string, text string, n_chars long")
