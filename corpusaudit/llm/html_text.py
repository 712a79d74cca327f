"""Main text of web pages, with boilerplate found by a suffix array over the pages of each host.

A page is cut into blocks. Each block has a zone: ``main`` inside the article a page marks, ``chrome`` inside what its
markup names as menu, header, footer, sidebar, notice, advert, form or comments, ``open`` otherwise. What the markup
leaves open is decided by repetition: the texts outside articles of all pages of a host are searched for long strings
that other pages of the host have too (suffix arrays over shards, see ``repeats``); open blocks that such strings
cover go, and unique ones stay. Text inside a marked article stays also where it repeats, as pages quote each other.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusaudit.llm.common import strings
from corpusaudit.llm.repeats import merged, repeated_runs

MAIN, CHROME, OPEN = "main", "chrome", "open"
#: Bytes that a repeated string has at least, and the part of a block that has to be covered.
REPEATED_BYTES = 32
COVERED = 0.6

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_TAG_END = re.compile(r"[>\"']")
_RAW = frozenset("script style noscript template iframe object svg math canvas textarea select title".split())
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_INLINE = frozenset("a abbr b bdi bdo big cite code em font i kbd mark q s samp small span strike strong sub sup time tt u var".split())
_IMPLIED_END = frozenset("p li dt dd tr td th option".split())
#: Elements, roles and words of class and id that name boilerplate (fixed values).
_CHROME_TAGS = frozenset("nav footer aside form button dialog menu".split())
_CHROME_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
_CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer disqus "
    "footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notification overlay pager pagination popup promo promoted promotion "
    "related recommended recommendations replies respond responses share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar widget".split()
)
_MAIN_WORDS = frozenset("article articlebody content entry main post story".split())
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def _words(value: str) -> list[str]:
    return [w.lower() for w in _PART.findall(value)]


def _names_boilerplate(found: dict[str, str], in_main: bool) -> bool:
    """Whether a word of class or id names boilerplate."""
    for value in (*found.get("class", "").split(), *found.get("id", "").split()):
        words = set(_words(value))
        # with-sidebar, no-comments and the like tell about the page; an article's own header has its title
        if not {"with", "has", "no", "without"} & words and (words & _CHROME_WORDS) - ({"header"} if in_main or words & _MAIN_WORDS else set()):
            return True
    return False


def _zone(name: str, attrs: str, outer: str, by_form: bool) -> str:
    """Zone of what stands in an element, from its own markup and the zone around it."""
    if outer == CHROME and not (by_form and name in ("article", "main")):
        return CHROME
    found = {k.lower(): html.unescape(v.strip("\"'")) for k, v in _ATTR.findall(attrs)} if attrs.strip() else {}
    if name in ("article", "main"):
        # reader comments and teasers are articles too, by their markup; what is named a post or a story is the text
        named = {w for k in ("class", "id") for w in _words(found.get(k, ""))}
        return CHROME if not named & _MAIN_WORDS and _names_boilerplate(found, False) else MAIN
    if name in _CHROME_TAGS or name == "header" and outer != MAIN:
        return CHROME
    if name in ("html", "body") or not found:
        return outer
    role = found.get("role", "").lower()
    if role in _CHROME_ROLES or "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", ""):
        return CHROME
    if role in ("main", "article") or found.get("itemprop") == "articleBody":
        return MAIN
    return CHROME if _names_boilerplate(found, outer == MAIN) else outer


def tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """Start, end, name (empty for comments and what is skipped whole), whether it ends an element, attributes.

    One pass forward: what is looked for and not there is looked for once, so the time is linear in the page, however
    broken it is. A tag ends at the first ``>`` outside quotes; a quote that no later one closes inside the page's last
    tag is a letter. A script or style that nothing closes reaches to the end, other raw elements to the next tag.
    """
    last, missing, at = page.rfind(">"), set(), page.find("<")
    while 0 <= at:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
            yield at, end, "", False, ""
            at = page.find("<", end)
            continue
        if at > last:
            return
        is_end = page.startswith("/", at + 1)
        found = _NAME.match(page, at + 1 + is_end)
        if found is None:
            if page[at + 1 : at + 2] in ("!", "?", "/"):
                end = page.find(">", at) + 1
                yield at, end, "", False, ""
                at = page.find("<", end)
            else:
                at = page.find("<", at + 1)
            continue
        end = _end_of_tag(page, found.end(), last)
        name, attrs = found[0].lower(), page[found.end() : end - 1]
        if name in _RAW and not is_end:
            close = None if name in missing else re.compile(rf"</{name}\s*>", re.I).search(page, end)
            if close:
                end = close.end()
            elif name in ("script", "style"):
                end = len(page)
            else:
                missing.add(name)
                end = page.find("<", end)
                end = len(page) if end < 0 else end
            name = ""
        yield at, end, name, is_end, attrs
        at = page.find("<", end)


def _end_of_tag(page: str, at: int, last: int) -> int:
    """Behind the ``>`` that ends a tag; there is one at ``last``."""
    first = page.find(">", at)
    while True:
        mark = _TAG_END.search(page, at)
        if mark is None or mark.start() > last:
            return first + 1
        if mark[0] == ">":
            return mark.end()
        at = page.find(mark[0], mark.end()) + 1
        if not at:
            return first + 1


@dataclass
class Block:
    zone: str
    text: str


def blocks_of(page: str) -> list[Block]:
    """Blocks with text in page order; character references are decoded, white space is one blank."""
    out: list[Block] = []
    held: list[str] = []
    stack: list[tuple[str, str, bool]] = []  # name, zone inside, whether a form made it chrome
    names: Counter[str] = Counter()  # of the stack
    zone, by_form = OPEN, False

    def flush() -> None:
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            out.append(Block(zone, text))

    def leave(depth: int) -> None:
        nonlocal zone, by_form
        flush()
        names.subtract(x[0] for x in stack[depth:])
        del stack[depth:]
        zone, by_form = (stack[-1][1], stack[-1][2]) if stack else (OPEN, False)

    at = 0
    for start, end, name, is_end, attrs in tags(page):
        if start > at:
            held.append(html.unescape(page[at:start]))
        at = end
        if not name:
            continue
        block = name in _BLOCK
        if is_end:
            if names[name]:
                depth = len(stack) - 1
                while stack[depth][0] != name and (block or stack[depth][0] not in _BLOCK):
                    depth -= 1
                if stack[depth][0] == name:
                    leave(depth)
                elif block:
                    flush()
            elif block:
                flush()
            continue
        if name == "br":
            held.append(" ")
        if block:
            if stack and stack[-1][0] in _IMPLIED_END and (stack[-1][0] == name or stack[-1][0] == "p"):
                leave(len(stack) - 1)
            flush()
        if name in _VOID or attrs.endswith("/") and not block:
            continue
        inside = _zone(name, attrs, zone, by_form)
        # inline elements and those whose end is implied matter only where they change the zone or nest in one that did
        if inside == zone and (name in _INLINE or name in _IMPLIED_END) and not names[name]:
            continue
        if inside != zone:
            flush()
            by_form = name == "form"
        stack.append((name, inside, by_form))
        names[name] += 1
        zone = inside
    held.append(html.unescape(page[at:]))
    flush()
    return out


def _streams(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """``id, host, text``: what stands outside the article of each page, one block a line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["\n".join(b.text for b in blocks_of(p) if b.zone != MAIN) for p in strings(batch, "html")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("host"), pa.array(texts, pa.string())], names=["id", "host", "text"])

    kind = pages.schema[id_col].dataType.simpleString()
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    cols = pages.select(F.col(id_col).alias("id"), host.alias("host"), F.col(html_col).alias("html"))
    return cols.mapInArrow(run, f"id {kind}, host string, text string")


def main_text(blocks: list[Block], runs: list[tuple[int, int]]) -> str:
    """Text of a page, given the repeated byte runs of its stream."""
    marked = [b.text for b in blocks if b.zone == MAIN]
    if marked:
        return "\n".join(marked)
    starts, ends = merged(*(np.array([r[i] for r in runs], np.int64) for i in (0, 1)))
    kept, every, at = [], [], 0
    for b in blocks:
        size = len(b.text.encode())
        inside = np.minimum(ends, at + size) - np.maximum(starts, at)
        if b.zone == OPEN:
            every.append(b.text)
            if inside[inside > 0].sum() < COVERED * size:
                kept.append(b.text)
        at += size + 1
    # a page of which all repeats is a copy of another, not boilerplate
    return "\n".join(kept or every)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, ``text`` (empty if none), ``n_chars`` (its code points).

    Text is the blocks of the marked article in page order, one a line, or on pages without one the open blocks that
    are not covered by strings repeated on other pages of the host. Nothing is cut off or capped. A null page is empty and has
    empty text; pages with a null or odd url share one host without name; rows that repeat an id and text are copies of
    one page and no evidence for each other; an empty table gives an empty result. Very long and broken pages take time
    in proportion to their length.

    Pages are parsed where they lie, twice; only the strings around repeated places are shuffled, and the pages
    themselves only if they have no marked article.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    streams = _streams(pages, id_col, url_col, html_col)
    streams = streams.select("id", F.xxhash64("text").alias("h"), F.xxhash64("host").alias("scope"), "text")
    runs = repeated_runs(streams, REPEATED_BYTES, gram=16, across=True)
    runs = runs.groupBy("id", "h").agg(F.collect_set(F.struct("start", "end")).alias("runs"))
    runs = runs.select(F.col("id").alias("r_id"), F.col("h").alias("r_h"), "runs")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = pa.list_(pa.struct([("zone", pa.string()), ("text", pa.string())]))
        for batch in batches:
            texts, rest, stream = [], [], []
            for p in strings(batch, "html"):
                blocks = blocks_of(p)
                marked = any(b.zone == MAIN for b in blocks)
                texts.append(main_text(blocks, []) if marked else None)
                rest.append(None if marked else [{"zone": b.zone, "text": b.text} for b in blocks])
                stream.append(None if marked else "\n".join(b.text for b in blocks))
            cols = [batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(rest, block), pa.array(stream, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "url", "text", "blocks", "stream"])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for blocks, found in zip(batch.column("blocks").to_pylist(), batch.column("runs").to_pylist()):
                texts.append(main_text([Block(**b) for b in blocks], [(r["start"], r["end"]) for r in found or []]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string())], names=["id", "url", "text"])

    parsed = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    parsed = parsed.mapInArrow(parse, f"id {kind}, url string, text string, blocks array<struct<zone:string,text:string>>, stream string")
    done = parsed.where(F.col("text").isNotNull()).select("id", "url", "text")
    left = parsed.where(F.col("text").isNull()).select("id", "url", "blocks", F.xxhash64("stream").alias("h"))
    left = left.join(runs, F.col("id").eqNullSafe(F.col("r_id")) & (F.col("h") == F.col("r_h")), "left")
    decided = left.select("id", "url", "blocks", "runs").mapInArrow(decide, f"id {kind}, url string, text string")
    return done.unionByName(decided).select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.char_length("text").cast("long").alias("n_chars"))
