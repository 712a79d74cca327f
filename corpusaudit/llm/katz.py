"""Scores of a Katz backoff language model learned from the corpus it scores.

Bigram and unigram counts are discounted after Good and Turing; what a context loses by that goes to the words not
seen after it, in proportion to their unigram probabilities, with a weight that makes the whole sum to one.

Texts are cut into chunks of about a million tokens, stored once as numbers. A chunk asks for what it needs with its
own distinct keys, each sent once with its count in the chunk, so neither a frequent word nor a frequent pair gathers more
rows in one place than there are chunks. Keys are partitioned by range of their hash; a partition merges the counts of all chunks (the
partitioned table of that order) and answers each chunk in the order of its question:

1. words: how often in training
2. pairs: how often in training, and which chunk has to account for the pair
3. contexts: chunks add up the discounted mass and the unigram mass of the pairs they account for; the answer is the
   backoff weight.

Chunks evaluate their tokens with the first two answers, and add the weights of the third.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpusaudit.llm.common import binaries, mix, partitions, written

CHUNK_TOKENS = 1 << 20
#: Counts up to this are discounted.
DISCOUNTED = 5
#: Hashes of the end of a text and of the context before its first word; no word has these by more than chance.
END, BEGIN = np.uint64(1), np.uint64(2)
ROWS = "chunk long, kind int, bucket int, data binary"


# -- arrays as bytes


def put_sorted(keys: np.ndarray) -> bytes:
    """Ascending numbers as differences, byte by byte, without the leading bytes that are always zero."""
    diff = np.diff(keys, prepend=np.uint64(0))
    width = max(1, -(-int(diff.max()).bit_length() // 8)) if len(diff) else 1
    return bytes([width]) + np.ascontiguousarray(diff.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def get_sorted(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1)
    diff = np.zeros((planes.shape[1], 8), np.uint8)
    diff[:, :width] = planes.T
    return np.cumsum(diff.view("<u8").ravel(), dtype=np.uint64)


def put_small(values: np.ndarray) -> bytes:
    """Numbers that are mostly below 255, one byte each; the others follow."""
    return len(values).to_bytes(8, "little") + np.minimum(values, 255).astype(np.uint8).tobytes() + values[values >= 255].astype("<i8").tobytes()


def get_small(data: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    n = int.from_bytes(data[at : at + 8], "little")
    out = np.frombuffer(data, np.uint8, n, at + 8).astype(np.int64)
    large = np.flatnonzero(out == 255)
    out[large] = np.frombuffer(data, "<i8", len(large), at + 8 + n)
    return out, at + 8 + n + 8 * len(large)


def put_all(values: tuple | dict) -> bytes:
    """Pickled and compressed: what is written and shuffled whole is most of what the operator puts on disk."""
    data = pickle.dumps(values, protocol=5)
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def get_all(data: bytes | pa.Buffer) -> tuple | dict:
    data = memoryview(data)
    return pickle.loads(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd"))


# -- the model


def discounts(kinds: np.ndarray) -> np.ndarray:
    """Good-Turing discount of each count from 0 to DISCOUNTED from numbers of kinds with each count (to one more).

    A count whose discount would not lie between 0 and 1 stays as it is.
    """
    d = np.ones(DISCOUNTED + 1)
    if kinds[1] > 0:
        common = (DISCOUNTED + 1) * kinds[DISCOUNTED + 1] / kinds[1]
        for r in range(1, DISCOUNTED + 1):
            if kinds[r] > 0 and common < 1:
                ratio = (r + 1) * kinds[r + 1] / (r * kinds[r])
                value = (ratio - common) / (1 - common)
                d[r] = value if 0 < value < 1 else 1.0
    return d


def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    return counts * np.where(counts <= DISCOUNTED, d[np.minimum(counts, DISCOUNTED)], 1.0)


class Unigrams:
    """Discounted unigram probabilities; all unseen words together are one more event, so that the sum is one."""

    def __init__(self, total: int, kinds: np.ndarray):
        self.total, self.d = total, discounts(kinds)
        lost = sum(kinds[r] * r * (1 - self.d[r]) for r in range(1, DISCOUNTED + 1))
        # nothing lost: one more token, which was unseen
        self.size, self.unseen = (total, lost) if lost > 0 else (total + 1, 1.0)

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, discounted(counts, self.d), self.unseen) / self.size


def backoff(total: np.ndarray, mass: np.ndarray, low: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Backoff weight of contexts, and the denominator of their pairs.

    ``total`` counts the context, ``mass`` sums the discounted counts of its pairs, ``low`` tells that one of them was
    discounted, ``seen`` sums the unigram probabilities of the words after it. A context that lost nothing gets one
    more token, which was unseen.
    """
    size = total + np.where(low, 0, 1)
    return (size - mass) / size / (1 - seen), size


# -- chunks


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class Chunk:
    """Documents as numbers of words: ``keys`` are the sorted hashes of the words, with BEGIN and END among them."""

    def __init__(self, ids: list, held: list[bool], words: _Numbers, stream: list[np.ndarray]):
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        self.keys, place = np.unique(np.concatenate([hashes, [END, BEGIN]]), return_inverse=True)
        self.ids, self.held = ids, np.array(held, bool)
        self.sizes = np.array([len(s) for s in stream], np.int64) + 1
        ends = np.cumsum(self.sizes)
        tokens = np.full(ends[-1] if len(ends) else 0, place[len(words)], np.int64)
        inside = np.ones(len(tokens), bool)
        inside[ends - 1] = False
        tokens[inside] = place[np.concatenate(stream)] if inside.any() else []
        self.tokens = tokens.astype(np.int32)

    def document(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)

    def learned(self) -> np.ndarray:
        """Which tokens are of training documents."""
        return np.repeat(~self.held, self.sizes)

    def contexts(self) -> np.ndarray:
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[np.cumsum(self.sizes) - self.sizes] = np.searchsorted(self.keys, BEGIN)
        return before

    def word_counts(self) -> np.ndarray:
        counts = np.bincount(self.tokens[self.learned()], minlength=len(self.keys))
        counts[np.searchsorted(self.keys, BEGIN)] = (~self.held).sum()
        return counts

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct pair hashes, where each first stands, and the place of each token's pair among them."""
        h = mix(mix(self.keys, 11)[self.contexts()], self.keys[self.tokens])
        order = np.argsort(h).astype(np.int32)
        h = h[order]
        new = np.append(True, h[1:] != h[:-1]) if len(h) else np.empty(0, bool)
        place = np.empty(len(h), np.int32)
        place[order] = np.cumsum(new, dtype=np.int32) - 1
        return h[new], order[new], place

    def to_bytes(self) -> bytes:
        # the bytes of a token apart, as the higher ones say little
        planes = np.ascontiguousarray(self.tokens.astype("<u4").view(np.uint8).reshape(-1, 4).T)
        return put_all((self.ids, self.held, self.sizes, put_sorted(self.keys), planes.tobytes()))

    @classmethod
    def from_bytes(cls, data: bytes | pa.Buffer) -> Chunk:
        c = cls.__new__(cls)
        c.ids, c.held, c.sizes, keys, planes = get_all(data)
        c.keys = get_sorted(keys)
        c.tokens = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<i4").ravel().astype(np.int32, copy=False)
        return c


def chunks_of(docs: DataFrame) -> DataFrame:
    """Chunk rows of ``id, held, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        ids, held, words, stream, n = [], [], _Numbers(), [], 0
        for batch in batches:
            for i, h, text in zip(batch.column("id").to_pylist(), batch.column("held").to_pylist(), binaries(batch, "text")):
                parts = text.lower().split()  # at ASCII only, as the tokens are defined
                stream.append(np.fromiter(map(words.__getitem__, parts), np.int32, len(parts)))
                ids.append(i)
                held.append(h)
                n += len(parts) + 1
                if n >= CHUNK_TOKENS:
                    yield _rows([(chunk, 0, 0, Chunk(ids, held, words, stream).to_bytes())])
                    ids, held, words, stream, n = [], [], _Numbers(), [], 0
                    chunk += 1
        if ids:
            yield _rows([(chunk, 0, 0, Chunk(ids, held, words, stream).to_bytes())])

    return docs.mapInArrow(run, ROWS)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["chunk", "kind", "bucket", "data"])


def slices(keys: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, first, last) of sorted hashes, by equal ranges."""
    bounds = np.searchsorted(keys, np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)) if buckets > 1 else []
    edges = [0, *map(int, bounds), len(keys)]
    return [(b, i, j) for b, (i, j) in enumerate(zip(edges, edges[1:])) if j > i]


Merge = Callable[[np.ndarray, list[bytes]], tuple[list[bytes], bytes]]


def ask(questions: DataFrame, merge: Merge, kind: int, name: str) -> DataFrame:
    """Answers to rows ``chunk, kind, bucket, data``, as such rows; ``merge`` answers all questions of a bucket, and
    what it says about the bucket stands in a row of chunk -1."""

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("chunk")
        answers, about = merge(rows["chunk"].to_numpy(), list(rows["data"]))
        chunk = [*rows["chunk"], -1]
        return pd.DataFrame({"chunk": chunk, "kind": kind, "bucket": int(key[0]), "data": [*answers, about]})

    return written(questions.groupBy("bucket").applyInPandas(lambda key, rows: run(key, rows), ROWS), name)


def _merge_counts(datas: list[bytes], special: bool) -> tuple[list[np.ndarray], list[np.ndarray], tuple]:
    """Of questions with keys and counts: each key's total, which question accounts for it, and totals of the bucket."""
    keys, counts = [], []
    for data in datas:
        n = int.from_bytes(data[:8], "little")
        keys.append(get_sorted(data[8 : 8 + n]))
        counts.append(get_small(data, 8 + n)[0].astype(np.int32))  # of one chunk
    sizes = np.cumsum([len(k) for k in keys])[:-1]
    # all arrays here are as long as the bucket, so each goes as soon as it has been used
    every = np.concatenate(keys)
    del keys
    order = np.argsort(every, kind="stable")
    every = every[order]
    new = np.append(True, every[1:] != every[:-1])
    first = np.flatnonzero(new)
    counted = every[first] != BEGIN if special else slice(None)
    del every
    count = np.concatenate(counts)[order]
    del counts
    totals = np.add.reduceat(count, first, dtype=np.int64)
    # the first question in order that counts a key at all accounts for it
    having = np.where(count > 0, np.arange(len(count)), len(count))
    owner = np.zeros(len(count) + 1, bool)
    owner[np.minimum.reduceat(having, first)] = True
    del count, having
    owns = np.empty(len(order), bool)
    owns[order] = owner[:-1]
    total = np.empty(len(order), np.int64)
    total[order] = np.repeat(totals, np.diff(first, append=len(order)))
    totals = totals[counted]
    kinds = np.bincount(np.minimum(totals, DISCOUNTED + 2), minlength=DISCOUNTED + 3)
    return np.split(total, sizes), np.split(owns, sizes), (int(totals.sum()), int((totals > 0).sum()), kinds)


def _question(keys: np.ndarray, *more: bytes) -> bytes:
    packed = put_sorted(keys)
    return len(packed).to_bytes(8, "little") + packed + b"".join(more)


def _merge_words(chunks: np.ndarray, datas: list[bytes]) -> tuple[list[bytes], bytes]:
    totals, _, about = _merge_counts(datas, True)
    return [put_small(t) for t in totals], pickle.dumps(about)


def _merge_pairs(chunks: np.ndarray, datas: list[bytes]) -> tuple[list[bytes], bytes]:
    totals, owns, about = _merge_counts(datas, False)
    return [put_small(2 * t + o) for t, o in zip(totals, owns)], pickle.dumps(about)


def _merge_contexts(chunks: np.ndarray, datas: list[bytes]) -> tuple[list[bytes], bytes]:
    """Backoff weights: log10 of the weight and of the denominator for each context asked for."""
    said, asked = zip(*map(pickle.loads, datas))
    keys = np.concatenate([get_sorted(s[0]) for s in said])
    total, mass, low, seen = (np.concatenate([s[i] for s in said]) for i in range(1, 5))
    known, place = np.unique(keys, return_inverse=True)
    add = lambda x: np.bincount(place, x, len(known))
    size = np.zeros(len(known))
    size[place] = total
    weight, denominator = backoff(size, add(mass), add(low) > 0, add(seen))
    answers = []
    for a in asked:
        at = np.searchsorted(known, get_sorted(a))
        answers.append(np.concatenate([np.log10(weight[at]), np.log10(denominator[at])]).astype("<f8").tobytes())
    return answers, b""


def _collected(answers: DataFrame) -> tuple[int, int, np.ndarray]:
    """Totals of all buckets: one row for each, whatever the input."""
    parts = [pickle.loads(r["data"]) for r in answers.where("chunk = -1").select("data").collect()]
    return sum(p[0] for p in parts), sum(p[1] for p in parts), sum((p[2] for p in parts), np.zeros(DISCOUNTED + 3, np.int64))


def _answers(rows: pd.DataFrame, kind: int) -> list[bytes]:
    return list(rows[rows["kind"] == kind].sort_values("bucket")["data"])


def katz_scores(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """One row per document: id, ``held_out, n_tokens, n_known, train_tokens, base_score, score``.

    The model learns from all documents for which ``held_out`` (a boolean column) is not true, and scores all. Tokens
    are words in lower case (A-Z only) between ASCII white space, and one end. ``score`` is the log10 probability
    of the text under the backoff model, unseen words being one event; ``base_score`` that of add-one unigrams. A
    null text is empty: only its end is scored. Null ids pass through, repeated rows count and score each. Without training
    documents every probability is that of the one unseen event (score 0). An empty table gives an empty result.
    """
    buckets = buckets or partitions(docs.sparkSession)
    id_type = docs.schema[id_col].dataType
    chunks = written(chunks_of(docs.select(F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text_col).alias("text"))), "katz-chunks")

    def questions(make: Callable[[Chunk], tuple[np.ndarray, np.ndarray]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for number, data in zip(batch.column("chunk").to_pylist(), batch.column("data")):
                    keys, counts = make(Chunk.from_bytes(data.as_buffer()))  # not a copy of all rows of the batch
                    yield _rows([(number, 0, b, _question(keys[i:j], put_small(counts[i:j]))) for b, i, j in slices(keys, buckets)])

        return chunks.mapInArrow(run, ROWS)

    def pair_counts(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        keys, _, place = chunk.pairs()
        return keys, np.bincount(place[chunk.learned()], minlength=len(keys))

    words = ask(questions(lambda c: (c.keys, c.word_counts())), _merge_words, 1, "katz-words")
    pairs = ask(questions(pair_counts), _merge_pairs, 2, "katz-pairs")
    total, distinct, word_kinds = _collected(words)
    _, _, pair_kinds = _collected(pairs)
    unigrams, d = Unigrams(total, word_kinds), discounts(pair_kinds)

    def evaluate(rows: pd.DataFrame) -> pd.DataFrame:
        chunk = Chunk.from_bytes(_answers(rows, 0)[0])
        count = np.concatenate([get_small(a)[0] for a in _answers(rows, 1)])
        _, first, place = chunk.pairs()
        ctx, word = chunk.contexts()[first], chunk.tokens[first]
        del first
        answer = np.concatenate([get_small(a)[0] for a in _answers(rows, 2)])
        seen, owns = answer >> 1, (answer & 1).astype(bool)
        del answer
        p = unigrams(count)
        # what this chunk has to say about its contexts
        n = len(chunk.keys)
        least = np.zeros(n, bool)  # contexts known to lose something
        discounted_kind = (seen > 0) & (seen <= DISCOUNTED) & (d[np.minimum(seen, DISCOUNTED)] < 1)
        least[ctx[discounted_kind]] = True
        own = np.flatnonzero(owns)
        mass = np.bincount(ctx[own], discounted(seen[own], d), n)
        unigram_mass = np.bincount(ctx[own], p[word[own]], n)
        low = np.bincount(ctx[own], discounted_kind[own], n)
        tells = np.unique(ctx[own])
        del own, owns, discounted_kind
        # pairs: those seen in training are complete but for a denominator that may have grown by one. Tokens of a pair
        # score alike, so what is as long as the chunk is looked up in what is as long as its pairs
        part = np.where(seen > 0, np.log10(np.maximum(discounted(seen, d), 1e-300) / np.maximum(count[ctx], 1)), np.log10(p)[word])
        open_weight = (seen == 0) & (count[ctx] > 0)
        some = open_weight | ((seen > 0) & ~least[ctx])
        wants = np.unique(ctx[some])
        where = np.searchsorted(wants, ctx).astype(np.int32)
        del ctx, word, seen
        doc, docs_n = chunk.document(), len(chunk.sizes)
        done = {
            "ids": chunk.ids,
            "held": chunk.held,
            "sizes": chunk.sizes,
            "known": np.bincount(doc, (count > 0)[chunk.tokens], docs_n).astype(np.int64),
            "base": np.bincount(doc, np.log10((count + 1) / (total + distinct + 1))[chunk.tokens], docs_n),
            "part": np.bincount(doc, part[place], docs_n),
        }
        del part
        asked = some[place]
        doc, place = doc[asked], place[asked]
        done["need"] = (doc, where[place], open_weight[place], np.log10(np.maximum(count[wants], 1)))
        out = [(rows["chunk"].iloc[0], 0, -1, put_all(done))]
        del done, doc, place, asked, where, open_weight, some
        told, wanted = chunk.keys[tells], chunk.keys[wants]
        both = np.unique(np.concatenate([told, wanted]))
        for b, i, j in slices(both, buckets):
            lo, hi = both[i], both[j - 1]
            t0, t1 = np.searchsorted(told, lo), np.searchsorted(told, hi, side="right")
            w0, w1 = np.searchsorted(wanted, lo), np.searchsorted(wanted, hi, side="right")
            at = tells[t0:t1]
            says = (put_sorted(told[t0:t1]), count[at].astype(np.int32), mass[at], low[at] > 0, unigram_mass[at])
            out.append((rows["chunk"].iloc[0], 3, b, pickle.dumps((says, put_sorted(wanted[w0:w1])), protocol=5)))
        return pd.DataFrame(out, columns=["chunk", "kind", "bucket", "data"])

    together = chunks.unionByName(words.where("chunk >= 0")).unionByName(pairs.where("chunk >= 0"))
    evaluated = written(together.groupBy("chunk").applyInPandas(lambda rows: evaluate(rows), ROWS), "katz-evaluated")
    weights = ask(evaluated.where("kind = 3"), _merge_contexts, 3, "katz-weights")

    def finish(rows: pd.DataFrame) -> pd.DataFrame:
        done = get_all(_answers(rows, 0)[0])
        answers = [np.frombuffer(a, "<f8").reshape(2, -1) for a in _answers(rows, 3)]
        weight, size = np.concatenate(answers, axis=1) if answers else np.zeros((2, 0))
        doc, where, is_weight, old = done["need"]
        more = np.where(is_weight, weight[where], old[where] - size[where]) if len(doc) else np.zeros(0)
        n = len(done["sizes"])
        score = done["part"] + np.bincount(doc, more, n)
        return pd.DataFrame(
            {
                "id": pd.Series(pa.array(done["ids"], to_arrow_type(id_type)).to_pandas(types_mapper=pd.ArrowDtype)),
                "held_out": done["held"],
                "n_tokens": done["sizes"],
                "n_known": done["known"],
                "train_tokens": total,
                "base_score": done["base"],
                "score": score,
            }
        )

    last = evaluated.where("kind = 0").unionByName(weights.where("chunk >= 0"))
    schema = f"id {id_type.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return last.groupBy("chunk").applyInPandas(lambda rows: finish(rows), schema).withColumnRenamed("id", id_col)
