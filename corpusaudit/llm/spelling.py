"""Spelling variants: words one edit apart, found by Bloom-guided neighbourhoods.

Each word of the vocabulary generates its edits and asks blocked Bloom filters whether they may be words; what they
let through is joined with the vocabulary by the whole string, which removes the false positives. An insertion is a
deletion seen from the longer word, and of two words that differ in one place only the one with the smaller code point
there asks, so each pair is generated once and nothing is asked twice.

Filters are sharded by word length, as a deletion asks only words one shorter and a replacement only words as long.
A length with many words is dealt into parts by a hash. Parts have at most ``PART_WORDS`` words on average, hence a
known size, and as many of them as fit in ``BUDGET`` bytes are broadcast at once: a larger vocabulary takes more
passes, not larger broadcasts. Edits have rolling hashes, so none is spelled out before a filter lets it through.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusaudit.llm.common import mix, strings, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = "[A-Za-zÀ-ÿ]+"
SHORTEST = 6
LEAST = 5
RATIO = 5
PART_WORDS = 1 << 20
BITS_PER_WORD = 16
#: Bytes of filters that are in memory at once, on the driver and in each task.
BUDGET = 64 << 20
_SLICE = 256  # blocks of a filter that are put together in one group
_BITS = 5  # bits of its block that a word sets
_BASE = 0x9E3779B97F4A7C15 | 1  # odd, so that it has an inverse
_INVERSE = pow(_BASE, -1, 1 << 64)
_CELLS = 1 << 21  # hashes held at once


def word_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, least: int = LEAST,
    edit: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """``word, n``: words of at least ``shortest`` code points that occur ``least`` times in whole texts.

    Words are runs of letters with A-Z lower-cased, changed by ``edit`` (id, word) if there is one, which never makes
    them longer. They are counted where they are read first, so a word that is everywhere moves once a task.
    """
    runs = F.regexp_extract_all(text_col, F.lit(LETTERS), F.lit(0))
    each = docs.select(F.col(id_col).alias("id"), F.explode_outer(runs).alias("run"))
    each = each.select("id", F.translate("run", UPPER, LOWER).alias("run")).where(F.length("run") >= shortest)
    word = edit(F.col("id"), F.col("run")) if edit else F.col("run")
    counted = each.select(word.alias("word")).where(F.length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= least)


def _codes(words: list[str], length: int) -> np.ndarray:
    """Code points, a row a word; all words have ``length`` of them."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length).astype(np.uint64)


def _spelled(codes: np.ndarray) -> list[str]:
    text, size = codes.astype(np.uint32).tobytes().decode("utf-32-le"), codes.shape[1]
    return [text[i : i + size] for i in range(0, len(text), size)]


def _powers(length: int) -> np.ndarray:
    out = np.full(length, _BASE, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)  # modulo 2^64


def _hashes(codes: np.ndarray) -> np.ndarray:
    return (codes * _powers(codes.shape[1])).sum(axis=1, dtype=np.uint64)


def _place(h: np.ndarray, parts: int, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Part, block and bits of rolling hashes in the filters of a length."""
    x = mix(h, 0)
    high = x >> np.uint64(32)
    bits = np.zeros(x.shape, np.uint64)
    for i in range(_BITS):
        bits |= np.uint64(1) << ((x >> np.uint64(6 * i)) & np.uint64(63))
    return high % np.uint64(parts), high // np.uint64(parts) % np.uint64(blocks), bits


def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, places in ``words``, code points."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(lengths[lengths > 0]).tolist():
        at = np.flatnonzero(lengths == length)
        yield length, at, _codes([words[i] for i in at], length)


def shards(vocabulary: DataFrame) -> dict[int, tuple[int, int]]:
    """For each length of a word: number of parts, and of 64-bit blocks in each."""
    counts = vocabulary.groupBy(F.length("word").alias("length")).agg(F.count(F.lit(1)).alias("n")).where("length > 0").collect()
    out = {}
    for r in counts:
        parts = -(-r["n"] // PART_WORDS)
        out[r["length"]] = (parts, max(1, -(-r["n"] // parts) * BITS_PER_WORD // 64))
    return out


def bloom_filters(vocabulary: DataFrame, sizes: dict[int, tuple[int, int]]) -> DataFrame:
    """``length, part, slice, bits``: blocked Bloom filters, so many 64-bit blocks a row."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, _, codes in _by_length(strings(batch, "word")):
                part, block, bits = _place(_hashes(codes), *sizes[length])
                cols = [pa.array(np.full(len(part), length)), *(pa.array(c.view(np.int64)) for c in (part, block, bits))]
                yield pa.RecordBatch.from_arrays(cols, names=["length", "part", "block", "bits"])

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(_SLICE, np.uint64)
        bits[rows["block"].to_numpy() % _SLICE] = rows["bits"].to_numpy().view(np.uint64)
        return rows[["length", "part", "slice"]].head(1).assign(bits=[bits.tobytes()])

    placed = vocabulary.select("word").mapInArrow(place, "length long, part long, block long, bits long")
    blocks = placed.groupBy("length", "part", "block").agg(F.bit_or("bits").alias("bits"))
    sliced = blocks.withColumn("slice", F.floor(F.col("block") / _SLICE))
    return sliced.groupBy("length", "part", "slice").applyInPandas(build, "length long, part long, slice long, bits binary")


def _held(filters: DataFrame, wanted: list[tuple[int, int]], sizes: dict[int, tuple[int, int]]) -> dict[tuple[int, int], np.ndarray]:
    """The filters of some shards, put together from their slices."""
    out = {key: np.zeros(-(-sizes[key[0]][1] // _SLICE) * _SLICE, np.uint64) for key in wanted}
    mine = F.struct("length", "part").isin([F.struct(F.lit(a).cast("long"), F.lit(b).cast("long")) for a, b in wanted])
    for r in filters.where(mine).toLocalIterator():
        at = r["slice"] * _SLICE
        out[r["length"], r["part"]][at : at + _SLICE] = np.frombuffer(r["bits"], np.uint64)
    return out


def passes(sizes: dict[int, tuple[int, int]], budget: int = BUDGET) -> list[list[tuple[int, int]]]:
    """Shards (length, part) that are asked together, with at most ``budget`` bytes of filters (or a single one)."""
    out, room = [[]], budget
    for length in sorted(sizes):
        parts, blocks = sizes[length]
        for part in range(parts):
            if out[-1] and 8 * blocks > room:
                out.append([])
                room = budget
            out[-1].append((length, part))
            room -= 8 * blocks
    return [p for p in out if p]


def _let_through(h: np.ndarray, length: int, sizes: dict, filters: dict) -> np.ndarray:
    """Which rolling hashes of edits may be words of ``length``, in the filters at hand."""
    parts, blocks = sizes[length]
    part, block, bits = _place(h, parts, blocks)
    out = np.zeros(h.shape, bool)
    for p in range(parts):
        held = filters.get((length, p))
        if held is not None:
            out |= (part == p) & (held[block] & bits == bits)
    return out


def neighbourhood(codes: np.ndarray, alphabet: np.ndarray, sizes: dict, filters: dict) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Rows of ``codes`` and the edits of these words that the filters let through."""
    n, length = codes.shape
    powers = _powers(length)
    terms = codes * powers
    if any(k[0] == length - 1 for k in filters):
        before = np.cumsum(terms, axis=1, dtype=np.uint64)
        h = before - terms + (before[:, -1:] - before) * np.uint64(_INVERSE)
        row, at = np.nonzero(_let_through(h, length - 1, sizes, filters))
        left = np.arange(length - 1)
        yield row, _spelled(codes[row[:, None], left + (left >= at[:, None])])
    if any(k[0] == length for k in filters):
        h = (terms.sum(axis=1, dtype=np.uint64)[:, None] - terms)[:, :, None] + powers[None, :, None] * alphabet
        larger = alphabet > codes[:, :, None]
        row, at, letter = (x[0] for x in np.nonzero(larger)) if not larger.size else np.nonzero(larger)
        may = _let_through(h[row, at, letter], length, sizes, filters)
        row, at, letter = row[may], at[may], letter[may]
        changed = codes[row]
        changed[np.arange(len(row)), at] = alphabet[letter]
        yield row, _spelled(changed)


def near_words(vocabulary: DataFrame, budget: int = BUDGET) -> DataFrame:
    """``a, b``: pairs (structs ``word, n``) of distinct words that differ by one edit, each pair once.

    ``vocabulary`` has ``word, n``, each word once; it is read once a pass. The alphabet is the code points it has.
    """
    sizes = shards(vocabulary)
    letters = vocabulary.select(F.explode_outer(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''").distinct()
    alphabet = np.array(sorted(ord(r["c"]) for r in letters.collect()), np.uint64)
    spark = vocabulary.sparkSession
    filters = written(bloom_filters(vocabulary, sizes), "spelling-filters") if sizes else None
    out = None
    for wanted in passes(sizes, budget):
        shared = spark.sparkContext.broadcast(_held(filters, wanted, sizes))

        def ask(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                words, counts = strings(batch, "word"), batch.column("n").to_numpy()
                for length, at, codes in _by_length(words):
                    step = max(1, _CELLS // (length * max(1, len(alphabet))))
                    for i in range(0, len(at), step):
                        for row, edits in neighbourhood(codes[i : i + step], alphabet, sizes, shared.value):
                            asked = at[i + row]
                            cols = [pa.array([words[j] for j in asked], pa.string()), pa.array(counts[asked], pa.int64()), pa.array(edits, pa.string())]
                            yield pa.RecordBatch.from_arrays(cols, names=["word", "n", "edit"])

        lengths = sorted({x for length, _ in wanted for x in (length, length + 1)} & set(sizes))
        asking = vocabulary.where(F.length("word").isin(lengths)).repartition(spark.sparkContext.defaultParallelism * 4, "word")
        edits = asking.mapInArrow(ask, "word string, n long, edit string").distinct()
        known = vocabulary.select(F.col("word").alias("b_word"), F.col("n").alias("b_n"))
        found = edits.join(known, F.col("edit") == F.col("b_word"))
        found = found.select(F.struct("word", "n").alias("a"), F.struct(F.col("b_word").alias("word"), F.col("b_n").alias("n")).alias("b"))
        found = written(found, "spelling-pairs")
        out = found if out is None else out.union(found)
    if out is None:
        one = F.struct("word", "n")
        return vocabulary.select(one.alias("a"), one.alias("b")).where(F.lit(False))
    return out


def roots(forms: DataFrame, steps: int) -> DataFrame:
    """``word, root`` from ``word, form`` without cycles, of chains of at most ``steps`` forms: each round doubles the
    steps taken, so a chain of 2^r forms takes r rounds."""
    out = forms.select("word", F.col("form").alias("root"))
    for _ in range(max(0, math.ceil(math.log2(max(1, steps))))):
        on = out.select(F.col("word").alias("at"), F.col("root").alias("on"))
        out = written(out.join(on, F.col("root") == F.col("at"), "left").select("word", F.coalesce("on", "root").alias("root")), "spelling-roots")
    return out


def group_variants(vocabulary: DataFrame, ratio: int = RATIO, budget: int = BUDGET) -> DataFrame:
    """One row per word: ``word, form, root, n, n_near, form_n``.

    ``form`` is the most frequent word one edit away (ties: the first in code-point order), if it occurs at least
    ``ratio`` times (more than 1) as often as the word, else null. ``root`` is where the forms of forms end, the word
    itself without one; counts grow by ``ratio`` with each form, so the chains are short and have no cycles.
    ``vocabulary`` has ``word, n``; null and empty words are left out, counts of repeated rows are added. An empty
    vocabulary gives an empty result.
    """
    words = vocabulary.where("word <> ''").groupBy("word").agg(F.sum("n").alias("n"))
    words = written(words, "vocabulary")
    pairs = near_words(words, budget)
    both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    first = F.min(F.struct((-F.col("b.n")).alias("n"), F.col("b.word").alias("word")))
    best = both.groupBy(F.col("a.word").alias("of"), F.col("a.n").alias("of_n")).agg(F.count(F.lit(1)).alias("n_near"), first.alias("first"))
    is_form = -F.col("first.n") >= ratio * F.col("of_n")
    best = best.select("of", "n_near", F.when(is_form, F.col("first.word")).alias("form"), F.when(is_form, -F.col("first.n")).alias("form_n"))
    best = written(best, "spelling-forms")
    forms = best.where("form is not null").select(F.col("of").alias("word"), "form")
    most = words.agg(F.max("n").alias("n")).first()["n"] or 1
    ends = roots(forms, max(1, int(math.log(max(most, ratio), ratio)) + 1)).select(F.col("word").alias("w"), "root")
    out = words.join(best, F.col("word") == F.col("of"), "left").join(ends, F.col("word") == F.col("w"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
