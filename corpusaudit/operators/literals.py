"""Which texts contain which literals, exactly, in one pass over each text whatever the number of literals.

Few literals are an automaton (Aho and Corasick) that each task runs over the texts it reads, so no text and no piece
of one is shuffled, and a literal that is in every text costs no more than its findings. What is collected and broadcast
is a part of ``PART_BYTES`` on average, whose automaton fits in the memory of a worker.

Literals of more than one part would take a pass over the texts for each. So of these, all that have at most ``LONGEST``
characters are looked for by the hashes of pieces of the texts, in parts of ``HASHED_BYTES``: a table of bits, two bytes a
literal, says which pieces may be one, and these few are compared with the literals of that hash, which are broadcast sorted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from uuid import uuid4

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from corpusaudit.session import cut_lineage

#: Text of literals, and of the columns they carry, in one automaton; it takes some fifty times that in memory.
PART_BYTES = 2 << 20
_HITS = 1 << 16  # rows of findings in one batch
_built: dict[str, ahocorasick.Automaton] = {}

#: Characters of a literal that is looked for by its hash.
LONGEST = 32
#: Text of literals, and of the columns they carry, that are looked for by hashes in one pass; a worker holds that and 20 bytes a literal.
HASHED_BYTES = 64 << 20
_HEAD = 8  # a piece is looked at in all lengths from here on only if its first characters begin a literal
_SLAB = 1 << 18  # characters hashed at once
_BASE = 0x9E3779B97F4A7C15


def _automaton(mark: str, table: pa.Table) -> ahocorasick.Automaton:
    """The automaton of a part, built once in a worker; its values are (length, rows of the part)."""
    if mark not in _built:
        rows: dict[str, list[int]] = {}
        for i, needle in enumerate(table.column("needle").to_pylist()):
            rows.setdefault(needle, []).append(i)
        automaton = ahocorasick.Automaton()
        for needle, at in rows.items():
            automaton.add_word(needle, (len(needle), at))
        automaton.make_automaton()
        _built.clear()
        _built[mark] = automaton
    return _built[mark]


def _is_word(text: str, at: int) -> bool:
    return 0 <= at < len(text) and (text[at].isalnum() or text[at] == "_")


def _whole(text: str, start: int, end: int) -> bool:
    """A boundary between a word character and none on both sides."""
    return _is_word(text, start - 1) != _is_word(text, start) and _is_word(text, end - 1) != _is_word(text, end)


def find_literals(
    texts: DataFrame,
    needles: DataFrame,
    keys: Sequence[str],
    content: str = "content",
    within: Sequence[str] = (),
    words: bool = False,
    carry: Sequence[str] = (),
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """``keys, needle`` and the ``carry`` columns of the literal, where the text contains it, once for each literal.

    ``keys`` identify a text; ``within`` are those of them that must be equal in the row of ``needles`` too. With
    ``words`` a literal counts only between word boundaries. Null and empty literals are in no text, null texts
    contain none.
    """
    one = cut_lineage(needles.select(*within, "needle", *carry).where("needle <> ''").distinct())
    parts = _parts(one, part_bytes)
    texts = texts.select(*dict.fromkeys([*keys, content]))
    out = None
    if parts > 1:
        is_short = F.length("needle") <= LONGEST
        short = one.where(is_short)
        for held in _held(short, _parts(short, HASHED_BYTES)):
            found = _found(texts, held, keys, content, within, carry, _by_hash(held, words, texts.sparkSession.sparkContext))
            out = found if out is None else out.unionByName(found)
        one = one.where(~is_short)
        parts = _parts(one, part_bytes)
    for held in _held(one, parts):
        found = _found(texts, held, keys, content, within, carry, _by_automaton(words))
        out = found if out is None else out.unionByName(found)
    if out is None:
        fields = {f.name: f.dataType.simpleString() for f in [*one.schema, *texts.schema]}
        return texts.select(*keys, *(F.lit(None).cast(fields[c]).alias(c) for c in ["needle", *carry])).limit(0)
    return out


def _held(needles: DataFrame, parts: int) -> Iterator[pa.Table]:
    """The literals of each part that has some."""
    for part in range(parts):
        held = needles.where(F.pmod(F.xxhash64(*needles.columns), F.lit(parts)) == part).toArrow()
        if held.num_rows:
            yield held


#: Of a table of literals and a name for it: a function that gives the rows of the table that are in each of some texts.
Finder = Callable[[str, pa.Table], Callable[[list[str]], Iterator[set[int]]]]


def _by_automaton(words: bool) -> Finder:
    def finder(mark: str, table: pa.Table) -> Callable[[list[str]], Iterator[set[int]]]:
        automaton = _automaton(mark, table)

        def find(texts: list[str]) -> Iterator[set[int]]:
            for text in texts:
                found: set[int] = set()
                for end, (length, literals) in automaton.iter(text):
                    if not words or _whole(text, end + 1 - length, end + 1):
                        found.update(literals)
                yield found

        return find

    return finder


def _found(texts: DataFrame, held: pa.Table, keys: Sequence[str], content: str, within: Sequence[str], carry: Sequence[str], finder: Finder) -> DataFrame:
    """``find_literals`` for one table of literals, by one pass over the texts. A text is one row until its literals are known."""
    kinds = dict(texts.dtypes)
    fields = {f.name: f.dataType.simpleString() for f in from_arrow_schema(held.schema)}
    hits = "ARRAY<STRUCT<" + ", ".join(f"`{c}`: {fields[c]}" for c in ["needle", *carry]) + ">>"
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keys), f"`_hits` {hits}"])
    shared = texts.sparkSession.sparkContext.broadcast(held)

    def scan(batches: Iterator[pa.RecordBatch], mark: str = uuid4().hex) -> Iterator[pa.RecordBatch]:
        table = shared.value
        find = finder(mark, table)
        only = list(zip(*(table.column(c).to_pylist() for c in within))) if within else None
        carried = table.select(["needle", *carry]).combine_chunks().to_batches()[0]

        def rows(batch: pa.RecordBatch, at: list[int], hits: list[list[int]]) -> pa.RecordBatch:
            cols = [batch.column(c).take(pa.array(at, pa.int64())) for c in keys]
            taken = carried.take(pa.array([j for some in hits for j in some], pa.int64()))
            ends = pa.array(np.cumsum([0, *map(len, hits)]).astype(np.int32))
            structs = pa.StructArray.from_arrays(taken.columns, names=taken.schema.names)
            return pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(ends, structs)], names=[*keys, "_hits"])

        for batch in batches:
            of = list(zip(*(batch.column(c).to_pylist() for c in within))) if within else None
            at, hits, n = [], [], 0
            for i, found in enumerate(find([t or "" for t in batch.column(content).to_pylist()])):
                mine = sorted(found) if of is None else [j for j in sorted(found) if only[j] == of[i]]
                if mine:
                    at.append(i)
                    hits.append(mine)
                    n += len(mine)
                if n >= _HITS:
                    yield rows(batch, at, hits)
                    at, hits, n = [], [], 0
            if n:
                yield rows(batch, at, hits)

    found = texts.mapInArrow(scan, schema).select(*keys, F.explode_outer("_hits").alias("_hit"))
    return found.select(*keys, *(F.col("_hit").getField(c).alias(c) for c in ["needle", *carry]))


def _parts(needles: DataFrame, part_bytes: int) -> int:
    size = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in needles.columns), F.lit(0).cast("bigint"))
    return -(-(needles.agg(F.sum(size).alias("n")).first()["n"] or 0) // part_bytes)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)


def _mixed(h: np.ndarray, length: int) -> np.ndarray:
    """Hashes whose high bits depend on all of them, and on the length."""
    h = (h ^ np.uint64(length * 0x2545F4914F6CDD1D & (2**64 - 1))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(29))


def _needle_hashes(needles: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths and hashes of literals, and hashes of their first characters."""
    power = _powers(_BASE, LONGEST)
    n, whole, head = np.array([len(x) for x in needles]), np.zeros(len(needles), np.uint64), np.zeros(len(needles), np.uint64)
    for at in range(0, len(needles), _HITS):
        some = slice(at, at + _HITS)
        starts = np.cumsum(n[some]) - n[some]
        codes = _codes("".join(needles[some]))
        place = np.arange(len(codes)) - np.repeat(starts, n[some])
        terms = codes * power[place]
        whole[some] = np.add.reduceat(terms, starts)
        head[some] = np.add.reduceat(np.where(place < _HEAD, terms, np.uint64(0)), starts)
    for length in np.unique(n).tolist():
        whole[n == length] = _mixed(whole[n == length], length)
    return n, whole, np.where(n >= _HEAD, _mixed(head, 0), np.uint64(0))


def _bits(hashes: np.ndarray) -> tuple[np.ndarray, int]:
    """A table of sixteen bits or more for each hash, and how far a hash is shifted to be a place in it."""
    log = max(16, int(16 * max(len(hashes), 1) - 1).bit_length())
    at = hashes >> np.uint64(64 - log)
    bits = np.zeros(1 << (log - 3), np.uint8)
    np.bitwise_or.at(bits, at >> np.uint64(3), np.left_shift(1, at & np.uint64(7), dtype=np.uint64).astype(np.uint8))
    return bits, 64 - log


def _marked(hashes: np.ndarray, table: tuple[np.ndarray, int]) -> np.ndarray:
    at = hashes >> np.uint64(table[1])
    return (table[0][at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _pieces_in(pieces: list[str], lengths: list[int], whole: tuple, head: tuple, power: np.ndarray, inverse: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray]]:
    """Pieces, starts, length and hashes of what may be literals; starts are below ``_SLAB``."""
    sizes = np.array([len(p) for p in pieces])
    ends = np.cumsum(sizes)
    begins = ends - sizes
    codes = _codes("".join(pieces))
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * power[: len(codes)], out=total[1:])
    at = np.arange(len(codes))
    room = np.repeat(ends, sizes) - at
    own = at - np.repeat(begins, sizes) < _SLAB
    window = lambda p, n: (total[p + n] - total[p]) * inverse[p]
    long_ = at[own & (room >= _HEAD)]
    long_ = long_[_marked(_mixed(window(long_, _HEAD), 0), head)]
    for n in lengths:
        starts = long_ if n >= _HEAD else at[own]
        starts = starts[room[starts] >= n]
        hashes = _mixed(window(starts, n), n)
        is_marked = _marked(hashes, whole)
        starts = starts[is_marked]
        of = np.searchsorted(ends, starts, "right")
        yield of, starts - begins[of], n, hashes[is_marked]


def _by_hash(held: pa.Table, words: bool, sc: SparkContext) -> Finder:
    """Literals of at most ``LONGEST`` characters, by the hashes of pieces of the texts."""
    n, whole, head = _needle_hashes(held.column("needle").to_pylist())
    order = np.argsort(whole, kind="stable")
    tables = np.unique(n).tolist(), _bits(whole), _bits(head[n >= _HEAD]), whole[order], order.astype(np.int32)
    shared = sc.broadcast(tables)

    def finder(mark: str, table: pa.Table) -> Callable[[list[str]], Iterator[set[int]]]:
        lengths, whole, head, hashes, rows = shared.value
        power, inverse = (_powers(b, 2 * _SLAB + LONGEST) for b in (_BASE, pow(_BASE, -1, 2**64)))
        needles = table.column("needle").combine_chunks()

        def find(texts: list[str]) -> Iterator[set[int]]:
            found: list[set[int]] = [set() for _ in texts]
            pieces: list[str] = []
            places: list[tuple[int, int]] = []
            size = done = 0

            def look() -> None:
                for of, starts, length, these in _pieces_in(pieces, lengths, whole, head, power, inverse):
                    low, high = np.searchsorted(hashes, these, "left"), np.searchsorted(hashes, these, "right")
                    some = np.flatnonzero(high > low)
                    for p, start, j, end in zip(of[some].tolist(), starts[some].tolist(), low[some].tolist(), high[some].tolist()):
                        i, text = places[p][0], texts[places[p][0]]
                        start += places[p][1]
                        if not words or _whole(text, start, start + length):
                            piece = text[start : start + length]
                            found[i].update(r for r in rows[j:end].tolist() if r in found[i] or needles[r].as_py() == piece)

            for i, text in enumerate(texts):
                for at in range(0, len(text), _SLAB):
                    pieces.append(text[at : at + _SLAB + LONGEST - 1])
                    places.append((i, at))
                    size += len(pieces[-1])
                    if size >= _SLAB:
                        look()
                        pieces, places, size = [], [], 0
                        # all texts before this one are done
                        yield from found[done:i]
                        found[done:i] = [set()] * (i - done)
                        done = i
            if pieces:
                look()
            yield from found[done:]

        return find

    return finder


def name_leaks(texts: DataFrame, names: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Project names inside texts, without regard to case: keys, rule, severity."""
    hits = find_literals(
        texts.select(*keys, F.lower("content").alias("content")), names.select(F.lower("name").alias("needle")), keys
    )
    return hits.select(*keys, F.concat(F.lit("project-name:"), F.col("needle")).alias("rule"), F.lit("CRITICAL").alias("severity"))
