"""Removal of long strings that repeat anywhere in a corpus, found by suffix arrays (see ``repeats``)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusaudit.llm.common import binaries
from corpusaudit.llm.repeats import merged, repeated_runs, scope_of


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n_bytes``, ``n_removed``, ``n_spans``, ``removed`` (runs), ``kept`` (bytes), ``kept_sha256``.

    Texts are UTF-8 bytes, null as empty. A byte goes when a string of ``length`` bytes that covers it starts anywhere
    else too, in the same document as well; all strings are judged on the input. ``removed`` are the maximal runs,
    ``kept`` what is left, put together. Texts shorter than ``length`` stay whole. Rows that repeat id and text are copies and
    lose what their copy has; rows that repeat an id with another text are documents of their own, as are those with null ids. An
    empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    h = F.xxhash64(F.col(text_col))
    texts = docs.select(F.col(id_col).alias("id"), h.alias("h"), scope_of().alias("scope"), F.col(text_col).alias("text"))
    runs = repeated_runs(texts, length).groupBy("id", "h").agg(F.collect_set(F.struct("start", "end")).alias("runs"))
    runs = runs.select(F.col("id").alias("r_id"), F.col("h").alias("r_h"), "runs")
    rows = texts.drop("scope").join(runs, F.col("id").eqNullSafe(F.col("r_id")) & (F.col("h") == F.col("r_h")), "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            size, gone, spans, kept = [], [], [], []
            for text, found in zip(binaries(batch, "text"), batch.column("runs").to_pylist()):
                a, b = (np.array([r[k] for r in found or []], np.int64) for k in ("start", "end"))
                a, b = merged(a, b)
                size.append(len(text))
                gone.append(int((b - a).sum()))
                spans.append([{"start": i, "end": j} for i, j in zip(a.tolist(), b.tolist())])
                kept.append(b"".join([text[i:j] for i, j in zip([0, *b.tolist()], [*a.tolist(), len(text)])]))
            digest = [hashlib.sha256(k).hexdigest() for k in kept]
            cols = [batch.column("id"), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(list(map(len, spans)), pa.int64())]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(spans, span), pa.array(kept, pa.binary()), pa.array(digest, pa.string())], names=names)

    names = [id_col, "n_bytes", "n_removed", "n_spans", "removed", "kept", "kept_sha256"]
    schema = f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, removed array<struct<start:int,end:int>>, kept binary, kept_sha256 string"
    return rows.select("id", "text", "runs").mapInArrow(cut, schema)
