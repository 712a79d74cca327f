"""Benchmark decontamination: a BM25 index of the test items, asked with every passage of the training texts.

Items are cut into entries of nearly equal length, at most 128 words, so an entry of a longer item has 64 at least and
counts for itself. A posting has the BM25 impact of a word in an entry as a part of the
entry's own score, so a score is the part of an entry that a passage accounts for, and one threshold serves all.
Entries stand in blocks; an index keeps the largest impact of a word overall and in each block. Passages are all
windows of 256 words, every 128 words, so each run of up to 129 words lies whole in one of them. A passage is left
when the largest impacts of its words add up to less than the threshold; else blocks are left by their own bounds,
and only the postings of the remaining blocks are added up (block-max WAND, with whole blocks in place of pivots, so
that all entries above the threshold are found). What is retrieved is verified by shingles of five words: enough of the
whole entry, and of its question and of its answer each, has to be in the passage.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpusaudit.llm.common import mix, strings

ENTRY_WORDS = 128
SHINGLE = 5
#: Shorter items are hit only by a text that consists of the item.
LEAST_WORDS = 2
#: Of the question and of the answer, each.
PARTS = 0.5
BLOCK = 4
K1, B = 1.2, 0.75
#: Bytes of item text in one index; a larger benchmark is indexed and asked in several such parts.
INDEX_BYTES = 16 << 20
#: Windows that ask the index together, which bounds the memory of a task whatever its texts are.
WINDOWS = 256
_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.?!])\s+|\n+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def entries_of(text: str) -> list[tuple[list[str], int]]:
    """Entries of an item with the number of words of each that belong to the question.

    The question ends with the last question mark, or else before the last sentence; of an item of one sentence,
    or of an entry that lies in one of both, all words are question and answer alike (the number is 0).
    """
    sentences = [w for s in _SENTENCE.split(text) if (w := words_of(s))]
    marked = text.rfind("?") + 1
    head = len(words_of(text[:marked])) if marked else sum(map(len, sentences[:-1]))
    words = words_of(text)
    out = []
    pieces = -(-len(words) // ENTRY_WORDS)
    for k in range(pieces):
        a = k * len(words) // pieces
        part = words[a : (k + 1) * len(words) // pieces]
        cut = head - a
        out.append((part, cut if 0 < cut < len(part) else 0))
    return out


def runs(ids: np.ndarray, size: int) -> np.ndarray:
    """A number for each run of ``size`` word ids."""
    n = max(0, len(ids) - size + 1)
    h = np.full(n, size, np.uint64)
    for i in range(size):
        h = mix(h, ids[i : i + n].astype(np.int64).astype(np.uint64))
    return h


def overlap(item: np.ndarray, passage: np.ndarray) -> float:
    """Part of the item's distinct shingles (of fewer than five words: of the whole item) that the passage has."""
    size = min(SHINGLE, len(item))
    return float(np.isin(np.unique(runs(item, size)), runs(passage, size)).mean()) if size else 0.0


@dataclass
class Index:
    items: list  # item id of each entry
    entries: list[np.ndarray]  # word ids of each entry
    heads: list[int]
    words: dict[str, int]
    most: np.ndarray  # largest impact of each word
    post_start: np.ndarray  # postings of each word, by entry
    post_entry: np.ndarray
    post_impact: np.ndarray
    block_start: np.ndarray  # blocks of each word with the largest impact there
    block_id: np.ndarray
    block_most: np.ndarray

    @classmethod
    def build(cls, items: list[tuple[object, str]], df: dict[str, int], n_entries: int, mean_words: float) -> Index:
        """Index of items; ``df``, ``n_entries`` and ``mean_words`` are of the whole benchmark."""
        ids, lists, heads = [], [], []
        for item, text in items:
            for words, head in entries_of(text):
                ids.append(item)
                lists.append(words)
                heads.append(head)
        words = {w: i for i, w in enumerate(sorted({w for part in lists for w in part}))}
        idf = np.array([np.log(1 + (n_entries - df[w] + 0.5) / (df[w] + 0.5)) for w in words])
        entries = [np.array([words[w] for w in part], np.int64) for part in lists]
        terms, owners, impacts = [], [], []
        for e, part in enumerate(entries):
            term, tf = np.unique(part, return_counts=True)
            score = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(part) / mean_words))
            terms.append(term)
            owners.append(np.full(len(term), e))
            impacts.append(score / score.sum())
        term, owner, impact = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (terms, owners, impacts))
        order = np.lexsort((owner, term))
        term, owner, impact = term[order], owner[order], impact[order].astype(np.float64)
        bounds = np.arange(len(words) + 1)
        key = term * (len(entries) // BLOCK + 1) + owner // BLOCK
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
        block_most = np.maximum.reduceat(impact, first) if len(first) else impact
        post_start, block_start = np.searchsorted(term, bounds), np.searchsorted(term[first], bounds)
        most = np.maximum.reduceat(impact, post_start[:-1]) if len(words) else impact
        return cls(ids, entries, heads, words, most, post_start, owner, impact, block_start, owner[first] // BLOCK, block_most)

    def retrieve(self, window: np.ndarray, term: np.ndarray, n: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, entry, score) of all that reach the threshold; ``window, term`` are the distinct words of ``n`` windows."""
        able = np.bincount(window, self.most[term], n) >= threshold
        window, term = window[able[window]], term[able[window]]
        blocks = len(self.items) // BLOCK + 1
        at, of = _ranges(self.block_start[term], self.block_start[term + 1])
        bound = np.bincount(window[of] * blocks + self.block_id[at], self.block_most[at], n * blocks)
        live = bound >= threshold
        some = live.reshape(n, blocks).any(axis=1)[window]
        window, term = window[some], term[some]
        at, of = _ranges(self.post_start[term], self.post_start[term + 1])
        inside = live[window[of] * blocks + self.post_entry[at] // BLOCK]
        at, of = at[inside], of[inside]
        key = window[of] * len(self.items) + self.post_entry[at]
        order = np.argsort(key)
        key, impact = key[order], self.post_impact[at[order]]
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else key
        score = np.add.reduceat(impact, starts) if len(key) else impact
        key, score = key[starts][score >= threshold], score[score >= threshold]
        return key // max(1, len(self.items)), key % max(1, len(self.items)), score

    def hits(self, texts: list[str], threshold: float, similarity: float, least: int = LEAST_WORDS, parts: float = PARTS) -> Iterator[tuple]:
        """(text, item, first word of the passage, score, overlap, question overlap, answer overlap): the best passage
        of each item in each text. Entries of fewer than ``least`` words are hit only by texts that have no other words."""
        ids, owner, first = [], [], []
        for i, text in enumerate(texts):
            words = words_of(text)
            ids.append(np.fromiter(map(self.words.get, words, repeat(-1)), np.int64, len(words)))
            n = max(1, -(-len(words) // ENTRY_WORDS) - 1)
            owner.append(np.full(n, i))
            first.append(np.arange(n) * ENTRY_WORDS)
        if not self.items or not texts:
            return
        owner, first = np.concatenate(owner), np.concatenate(first)
        step = min(WINDOWS, max(16, (1 << 20) // (len(self.items) // BLOCK + 1)))
        for a in range(0, len(owner), step):
            windows = [ids[i][f : f + 2 * ENTRY_WORDS] for i, f in zip(owner[a : a + step], first[a : a + step])]
            window, term = np.repeat(np.arange(len(windows)), list(map(len, windows))), np.concatenate(windows)
            pair = np.sort((window * len(self.words) + term)[term >= 0])
            pair = pair[np.append(True, pair[1:] != pair[:-1])] if len(pair) else pair
            found = self.retrieve(pair // len(self.words), pair % len(self.words), len(windows), threshold)
            yield from self._verified(windows, owner[a : a + step], first[a : a + step], found, similarity, ids, least, parts)

    def _verified(self, windows, owner, first, found, similarity, ids, least, parts) -> Iterator[tuple]:
        for w, e, score in zip(*found):
            if len(self.entries[e]) < least and not np.array_equal(self.entries[e], ids[owner[w]]):
                continue
            entry, head, window = self.entries[e], self.heads[e], windows[w]
            whole = overlap(entry, window)
            if whole >= similarity:
                question, answer = (overlap(entry[:head], window), overlap(entry[head:], window)) if head else (whole, whole)
                if min(question, answer) >= parts:
                    yield int(owner[w]), self.items[e], int(first[w]), float(score), whole, question, answer


def best_passages(hits: Iterator[tuple]) -> list[tuple]:
    """Of the hits of one text and item the one with most overlap, then score, then the first."""
    best: dict = {}
    for h in hits:
        key, rank = h[:2], (h[4], h[3], -h[2])
        if key not in best or rank > best[key][0]:
            best[key] = rank, h
    return [h for _, h in best.values()]


def _ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, one after the other, and which range each is of."""
    n = ends - starts
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(len(of)) + (starts - np.cumsum(n) + n)[of], of


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    threshold: float = 0.5,
    similarity: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    least_words: int = LEAST_WORDS,
    parts_similarity: float = PARTS,
) -> DataFrame:
    """One row per document and item that a passage of the document contains: id, ``item_id``, ``passage`` (its first
    word), ``score``, ``overlap``, ``question_overlap``, ``answer_overlap``.

    Words are runs of letters and digits in lower case. A hit has at least ``threshold`` of the entry's BM25 score,
    ``similarity`` of its shingles of five words (an item of fewer words: the whole item, word
    by word) and ``parts_similarity`` of those of its question and of its answer, so a question with another answer is none. An item of fewer than ``least_words`` words, found in nearly any text, is hit only by a document that has
    just these words. Null and empty texts have no words and no hits,
    null ids pass through, repeated rows give repeated hits, repeated items hits of their ids, a null item id is an id;
    without items, or without documents, the result is empty. Documents are read once for each part of the
    benchmark of ``INDEX_BYTES``, the bound of what is broadcast.
    """
    spark = docs.sparkSession
    kind, item_kind = (f.schema[c].dataType.simpleString() for f, c in ((docs, id_col), (benchmark, item_col)))
    items = benchmark.select(F.col(item_col).alias("item"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text")).distinct()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, words = [], []
            for text in strings(batch, "text"):
                for part, _ in entries_of(text):
                    n.append(len(part))
                    words.append(sorted(set(part)))
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(words, pa.list_(pa.string()))], names=["n", "words"])

    entries = items.mapInArrow(split, "n long, words array<string>")
    n_entries, mean_words = entries.agg(F.count("n"), F.coalesce(F.avg("n"), F.lit(1.0))).first()
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-total // INDEX_BYTES))
    frequency = entries.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    schema = f"`{id_col}` {kind}, item_id {item_kind}, passage int, score double, overlap double, question_overlap double, answer_overlap double"
    item_type = to_arrow_type(benchmark.schema[item_col].dataType)
    out = None
    for part in range(parts):
        some = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part)
        of_part = some.mapInArrow(split, "n long, words array<string>").select(F.explode("words").alias("word")).distinct()
        df = {r["word"]: r["df"] for r in frequency.join(of_part, "word", "left_semi").collect()}
        index = Index.build([(r["item"], r["text"]) for r in some.orderBy("item", "text").collect()], df, n_entries, mean_words)
        shared = spark.sparkContext.broadcast(index)

        def ask(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column("id").to_pylist()
                rows = [(ids[h[0]], *h[1:]) for h in best_passages(shared.value.hits(strings(batch, "text"), threshold, similarity, least_words, parts_similarity))]
                types = [batch.schema.field("id").type, item_type, pa.int32(), *[pa.float64()] * 4]
                cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays(cols, names=[id_col, "item_id", "passage", "score", "overlap", "question_overlap", "answer_overlap"])

        found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(ask, schema)
        out = found if out is None else out.unionByName(found)
    return out
