"""Where byte strings of a given length repeat across documents, by suffix arrays over shards.

Each string of ``length`` bytes contains the smallest of its grams (of 32 bytes, by a hash), and that gram is found in
every document that has the string, at the same place in it: an anchor. Around an anchor lies the region that all
strings through it lie in. Regions of one anchor that are alike are counted where they are, before any shuffle;
such copies repeat as a whole. Regions that differ are fetched once each and gathered, anchors whole, in shards of
some megabytes. A shard holds each place of the corpus once, as fragments between separators; its suffix array puts
equal strings side by side, and the permuted common prefixes tell where neighbours share ``length`` bytes.

An anchor with more different regions than a shard holds is not gathered at all: its strings are counted by their hashes,
in chunks first and then by ranges of hashes, however many there are.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpusaudit.llm.common import binaries, mix, partitions, written
from corpusaudit.llm.suffix_array import permuted_prefixes, suffix_array

#: Bytes of regions in a shard, and the number of different regions of an anchor up to which it is gathered.
SHARD_BYTES = 2 << 20
GATHERED = 1000
#: Bytes of fragments whose strings are counted together before they are sent.
CHUNK_BYTES = 1 << 20
_SYMBOLS = mix(np.arange(256, dtype=np.uint64), 1)


def gram_hashes(text: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` bytes (a power of two), from those of its halves."""
    h = _SYMBOLS[text]
    step, factor = 1, np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        while step < size:
            h = h[:-step] * factor + h[step:]
            factor *= factor * np.uint64(2) + np.uint64(1)
            step *= 2
        return h


def anchors(text: bytes, length: int, gram: int, scope: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of a text: of each run of ``length`` bytes its smallest gram, the first of equals."""
    if len(text) < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = mix(gram_hashes(np.frombuffer(text, np.uint8), gram), scope)
    width = length - gram + 1
    # 40 bits of the hash, then the place, so that the smallest also tells where it is
    place = np.arange(len(h), dtype=np.uint64) & np.uint64(0xFFFFFF)
    key = (h & np.uint64(0xFFFFFFFFFF000000)) | place
    n = -(-len(key) // width) * width
    rows = np.concatenate([key, np.full(n - len(key), ~np.uint64(0))]).reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    runs = len(key) - width + 1
    least = np.minimum(back[:runs], ahead[width - 1 : width - 1 + runs])
    at = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    low = (least[at] & np.uint64(0xFFFFFF)).astype(np.int64)
    place = at + ((low - at) & 0xFFFFFF)  # places are kept modulo 2^24, runs are far shorter
    place = np.unique(place)
    return place, h[place]


def covered(flags: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes covered by strings of ``length`` bytes that start where ``flags`` is true."""
    at = np.flatnonzero(flags)
    if not len(at):
        return at, at
    gap = np.flatnonzero(np.diff(at) > length)
    return at[np.append(0, gap + 1)], at[np.append(gap, len(at) - 1)] + length


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs that overlap or touch, as one."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.append(True, starts[1:] > reach[:-1]) if len(starts) else np.empty(0, bool)
    first = np.flatnonzero(new)
    return starts[first], reach[np.append(first[1:] - 1, len(starts) - 1)] if len(starts) else reach


def shard_repeats(owner: np.ndarray, scope: np.ndarray, start: np.ndarray, data: list[bytes], length: int, across: bool) -> list[tuple[int, int, int]]:
    """(fragment, start, end) of runs of repeated strings in a shard of fragments that overlap nowhere.

    Strings repeat within a ``scope``, and with ``across`` under different ``owner``s.
    """
    sizes = np.array([len(d) for d in data])
    # separators are 1, the end is 0, bytes follow
    t = np.zeros(sizes.sum() + len(data) + 1, np.uint16)
    begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    for b, d in zip(begins, data):
        t[b : b + len(d)] = np.frombuffer(d, np.uint8)
        t[b : b + len(d)] += 2
        t[b + len(d)] = 1
    sa = suffix_array(t)
    _, shares = permuted_prefixes(t, sa, length)
    fragment = np.repeat(np.arange(len(data)), sizes + 1)
    fragment = np.append(fragment, len(data) - 1)
    left = (begins + sizes)[fragment] - np.arange(len(t))
    shares &= left >= length
    group = np.cumsum(~shares[sa])
    # suffixes that share the string and the scope, by owner
    order = np.lexsort((owner[fragment[sa]], scope[fragment[sa]], group))
    suffix = sa[order]
    of = fragment[suffix]
    new = np.append(True, (group[order][1:] != group[order][:-1]) | (scope[of][1:] != scope[of][:-1]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(new)) - 1
    many = owner[of[first]] != owner[of[last]] if across else last > first
    flags = np.zeros(len(t), bool)
    flags[suffix] = many[np.cumsum(new) - 1]
    flags &= left >= length
    out = []
    for a, b in zip(*covered(flags, length)):
        while a < b:  # runs of neighbouring fragments can touch
            f = fragment[a]
            end = min(b, begins[f] + sizes[f])
            out.append((int(f), int(start[f] + a - begins[f]), int(start[f] + end - begins[f])))
            a = end + 1
    return out


def repeated_runs(texts: DataFrame, length: int, gram: int = 32, across: bool = False) -> DataFrame:
    """``id, h, start, end``: byte runs of ``texts`` (``id, h, scope, text``) covered by repeated strings of ``length`` bytes.

    A string repeats when it starts anywhere else, or with ``across`` in another row, of the same ``scope`` (a
    number). ``id`` and ``h`` (a hash of the text) together name a row; rows equal in both are copies of each other.
    Runs of a row can overlap. Null texts have no bytes.
    """
    kind = texts.schema["id"].dataType.simpleString()
    most = length - gram

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, anchor, region, start, end = [], [], [], [], []
            for row, (text, scope) in enumerate(zip(binaries(batch, "text"), batch.column("scope").to_pylist())):
                place, h = anchors(text, length, gram, scope & 0xFFFFFFFFFFFFFFFF)
                a, b = np.maximum(place - most, 0), np.minimum(place + length, len(text))
                rows += [row] * len(place)
                anchor.append(h)
                region += [xxhash.xxh3_64_intdigest(text[i:j], p - i) for p, i, j in zip(place.tolist(), a.tolist(), b.tolist())]
                start.append(a)
                end.append(b)
            if rows:
                cols = [batch.column("id").take(pa.array(rows)), batch.column("h").take(pa.array(rows)), pa.array(np.concatenate(anchor).view(np.int64))]
                cols += [pa.array(np.array(region, np.uint64).view(np.int64)), pa.array(np.concatenate(start), pa.int32()), pa.array(np.concatenate(end), pa.int32())]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "h", "anchor", "region", "start", "end"])

    found = texts.select("id", "h", "scope", "text").mapInArrow(mark, f"id {kind}, h long, anchor long, region long, start int, end int")
    found = written(found, "anchors")
    place = F.struct("id", "h", "start", "end")
    copies = [F.min(place).alias("low"), F.max(F.struct("id", "h")).alias("high"), F.count(F.lit(1)).alias("n")]
    regions = found.groupBy("anchor", "region").agg(*copies)
    alike = (F.col("n") > 1) & ((F.col("low.id") != F.col("high.id")) | (F.col("low.h") != F.col("high.h")) | F.lit(not across))
    regions = written(regions.select("anchor", "region", "low", alike.alias("alike")), "regions")
    whole = regions.where("alike").select("anchor", "region")
    runs = found.join(whole, ["anchor", "region"], "left_semi").select("id", "h", "start", "end")

    # written first, so that both sides of the join are plain exchanges and an anchor of many regions can be split
    several = written(regions.groupBy("anchor").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "several")
    several = regions.select("anchor", "low.*").join(several, "anchor")
    several = written(several, "several")
    shards = -(-several.where(F.col("m") <= GATHERED).count() * (most + length) // SHARD_BYTES) or 1
    shard = F.when(F.col("m") <= GATHERED, F.pmod(F.xxhash64("anchor"), F.lit(shards)).cast("int")).otherwise(-1)
    wanted = several.select("id", "h", F.struct(shard.alias("shard"), "start", "end").alias("w"))
    wanted = wanted.groupBy("id", "h").agg(F.collect_list("w").alias("wanted")).select(F.col("id").alias("w_id"), F.col("h").alias("w_h"), "wanted")
    fetched = texts.join(wanted, F.col("id").eqNullSafe(F.col("w_id")) & (F.col("h") == F.col("w_h")))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, shards, starts, data = [], [], [], []
            for row, (text, want) in enumerate(zip(binaries(batch, "text"), batch.column("wanted").to_pylist())):
                by: dict[int, list] = {}
                for w in want:
                    by.setdefault(w["shard"], []).append((w["start"], w["end"]))
                for s, spans in by.items():
                    a, b = np.array(spans).T
                    for i, j in zip(*(x.tolist() for x in merged(a, b))):
                        rows.append(row)
                        shards.append(s)
                        starts.append(i)
                        data.append(text[i:j])
            cols = [batch.column(c).take(pa.array(rows, pa.int64())) for c in ("id", "h", "scope")]
            cols += [pa.array(shards, pa.int32()), pa.array(starts, pa.int32()), pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "h", "scope", "shard", "start", "data"])

    fetched = fetched.select("id", "h", "scope", "text", "wanted").mapInArrow(fetch, f"id {kind}, h long, scope long, shard int, start int, data binary")
    hot = several.where(F.col("m") > GATHERED).limit(1).count() > 0
    if hot:
        fetched = written(fetched, "fragments")

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        owner, _ = pd.factorize(pd.MultiIndex.from_arrays([rows["id"].astype(str), rows["h"]]))
        out = shard_repeats(owner, rows["scope"].to_numpy(), rows["start"].to_numpy(), list(rows["data"]), length, across)
        at = [f for f, _, _ in out]
        return pd.DataFrame({"id": rows["id"].iloc[at], "h": rows["h"].iloc[at], "start": [a for _, a, _ in out], "end": [b for _, _, b in out]})

    gathered = fetched.where("shard >= 0").groupBy("shard")
    runs = runs.unionByName(gathered.applyInPandas(lambda rows: search(rows), f"id {kind}, h long, start int, end int"))
    return runs.unionByName(_counted(fetched.where("shard < 0"), kind, length, across)) if hot else runs


_PACKED = "chunk long, kind int, bucket int, data binary"


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["chunk", "kind", "bucket", "data"])


def _distinct(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of pairs of hashes, where each distinct pair first stands in it, and the place of each pair among them."""
    order = np.lexsort((two, one))
    a, b = one[order], two[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])) if len(a) else np.empty(0, bool)
    place = np.empty(len(a), np.int64)
    place[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), place


def _several(one: np.ndarray, two: np.ndarray, low: np.ndarray, high: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct pairs with the smallest and largest owner and the number of strings of each, and each pair's place."""
    order, first, place = _distinct(one, two)
    if not len(first):
        return one, two, low, high, n, place
    at = order[first]
    return one[at], two[at], np.minimum.reduceat(low[order], first), np.maximum.reduceat(high[order], first), np.add.reduceat(n[order], first), place


def _counted(fragments: DataFrame, kind: str, length: int, across: bool) -> DataFrame:
    """Runs of strings that occur more than once in fragments, counted by two 64-bit hashes of each string.

    Fragments are packed in chunks. A chunk asks once for each distinct string it has, with its number there, the
    ranges of hashes add up what all chunks have, and answer in the order of the question.
    """
    buckets = partitions(fragments.sparkSession)
    id_type = to_arrow_type(fragments.schema["id"].dataType)

    def hashes(data: list[bytes], scope: list[int], owner: np.ndarray) -> tuple[np.ndarray, ...]:
        one, two, who = [], [], []
        for d, x, o in zip(data, scope, owner):
            t = np.frombuffer(d, np.uint8)
            for out, seed in ((one, 3), (two, 5)):
                out.append(string_hashes(t, length, mix(np.uint64(x & 0xFFFFFFFFFFFFFFFF), seed)))
            who.append(np.full(len(one[-1]), o))
        one, two, who = (np.concatenate(x) if x else np.empty(0, np.uint64) for x in (one, two, who))
        return _several(one, two, who, who, np.ones(len(one), np.int64))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            rows = [r for r in batch.to_pylist() if len(r["data"]) >= length]
            sizes = np.cumsum([len(r["data"]) for r in rows])
            while len(rows):
                some = max(1, int(np.searchsorted(sizes, CHUNK_BYTES)))
                part, rows = rows[:some], rows[some:]
                sizes = sizes[some:] - sizes[some - 1]
                owner = np.array([xxhash.xxh3_64_intdigest(f"{r['id']}|{r['h']}") for r in part], np.uint64)
                data, scope = [r["data"] for r in part], [r["scope"] for r in part]
                one, two, low, high, n, place = hashes(data, scope, owner)
                where = [(r["id"], r["h"], r["start"], len(r["data"]) - length + 1) for r in part]
                out = [(chunk, 0, -1, pickle.dumps((where, place.astype(np.int32)), protocol=5))]
                edges = [0, *np.searchsorted(one, np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)).tolist(), len(one)]
                out += [(chunk, 1, b, pickle.dumps((one[i:j], two[i:j], low[i:j], high[i:j], n[i:j]), protocol=5)) for b, (i, j) in enumerate(zip(edges, edges[1:])) if j > i]
                yield _packed(out)
                chunk += 1

    def add_up(rows: pd.DataFrame) -> pd.DataFrame:
        asked = [pickle.loads(x) for x in rows["data"]]
        *_, low, high, n, place = _several(*(np.concatenate([a[i] for a in asked]) for i in range(5)))
        many = (low != high if across else n > 1)[place]
        ends = np.cumsum([len(a[0]) for a in asked])[:-1]
        return pd.DataFrame({"chunk": rows["chunk"], "kind": 2, "bucket": rows["bucket"], "data": [np.packbits(m).tobytes() for m in np.split(many, ends)]})

    def mark(rows: pd.DataFrame) -> pd.DataFrame:
        asked = rows[rows["kind"] == 1].sort_values("bucket")["data"]
        answers = rows[rows["kind"] == 2].sort_values("bucket")["data"]
        many = [np.unpackbits(np.frombuffer(m, np.uint8), count=len(pickle.loads(q)[0])) for q, m in zip(asked, answers)]
        where, place = pickle.loads(rows[rows["kind"] == 0]["data"].iloc[0])
        flags = np.concatenate(many).astype(bool)[place]
        out, at = [], 0
        for i, h, start, n in where:
            a, b = covered(flags[at : at + n], length)
            out += [(i, h, start + x, start + y) for x, y in zip(a.tolist(), b.tolist())]
            at += n
        ids = pd.Series(pa.array([o[0] for o in out], id_type).to_pandas(types_mapper=pd.ArrowDtype))
        return pd.DataFrame({"id": ids, **{c: [o[k] for o in out] for k, c in enumerate(("h", "start", "end"), 1)}})

    packed = written(fragments.select("id", "h", "scope", "start", "data").mapInArrow(pack, _PACKED), "strings")
    answers = packed.where("kind = 1").groupBy("bucket").applyInPandas(lambda rows: add_up(rows), _PACKED)
    return packed.unionByName(answers).groupBy("chunk").applyInPandas(lambda rows: mark(rows), f"id {kind}, h long, start int, end int")


def string_hashes(text: np.ndarray, length: int, seed: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of ``length`` bytes, from hashes of runs of powers of two."""
    h, step, out, used = mix(_SYMBOLS[text], seed), 1, None, 0
    n = len(text) - length + 1
    while True:
        if length & step:
            part = h[used : used + n]
            out = part.copy() if out is None else mix(out, part)
            used += step
        if 2 * step > length:
            return out
        h = mix(h[:-step], h[step:])
        step *= 2


def scope_of(column: Column | None = None) -> Column:
    return F.lit(0).cast("long") if column is None else F.xxhash64(column)
