"""Line state of documents that are larger than a row: fences, prose and tables over chunks of whole lines.

Input: ``corpus, path, block, seq, content``, the chunks of a document in the order of ``block`` and ``seq``. Each chunk
is summed up in one small row: how its lines change what a line after them sees. A prefix over these rows, inside blocks
and then over blocks, gives each chunk what it starts with. The chunk is then read by the operators for whole
documents, behind the line that opens what it is in.

Only summaries are ordered. Texts are joined with what they start with: a broadcast by the size Spark measures, as long
as the summaries are small, else one shuffle of the chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusaudit.functions import text as tx
from corpusaudit.operators.lines import KEY, explode_fenced_lines, table_rows

ORDER = ["block", "seq"]


def with_carried(chunks: DataFrame, summary: DataFrame, sums: Sequence[str] = (), lasts: Sequence[str] = ()) -> DataFrame:
    """Chunks with ``<c>_before`` for the columns of the summary: the sum, or the last value that is not null, of all
    chunks of the document before. A document has one summary per chunk."""
    inside = Window.partitionBy(*KEY, "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy(*KEY).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda w: [*(F.sum(c).over(w).alias(f"{c}_in") for c in sums), *(F.last(c, True).over(w).alias(f"{c}_in") for c in lasts)]
    totals = [*(F.sum(c).alias(c) for c in sums), *(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in lasts)]
    blocks = summary.groupBy(*KEY, "block").agg(*totals)
    blocks = blocks.select(*KEY, "block", *[c.alias(n) for c, n in zip(upto(over), [f"{c}_base" for c in [*sums, *lasts]])])
    both = summary.select(*KEY, *ORDER, *upto(inside)).join(blocks, [*KEY, "block"])
    zero = F.lit(0).cast("long")
    before = [(F.coalesce(f"{c}_in", zero) + F.coalesce(f"{c}_base", zero)).alias(f"{c}_before") for c in sums]
    before += [F.coalesce(f"{c}_in", f"{c}_base").alias(f"{c}_before") for c in lasts]
    return chunks.join(both.select(*KEY, *ORDER, *before), [*KEY, *ORDER])


def fenced_lines(chunks: DataFrame) -> DataFrame:
    """``lines.explode_fenced_lines`` of documents in chunks; line numbers are of the whole document, and long."""
    lined = tx.with_lines(chunks)
    marks = F.size(F.filter("lines", tx.is_fence)).cast("long")
    summary = lined.select(*KEY, *ORDER, F.size("lines").cast("long").alias("lines"), marks.alias("marks"))
    carried = with_carried(chunks, summary, sums=["lines", "marks"])
    # a chunk that starts inside a fence is read behind a line that opens it
    inside = (F.col("marks_before") % 2).cast("int")
    at = F.struct("path", "lines_before", "marks_before", inside.alias("opened"))
    read = carried.select("corpus", at.alias("path"), F.when(inside == 1, F.concat(F.lit(tx.FENCE + "\n"), "content")).otherwise(F.col("content")).alias("content"))
    opened, first = F.col("path.opened"), F.col("path.marks_before")
    return (
        explode_fenced_lines(read)
        .where(F.col("line_no") > opened)
        .select(
            "corpus",
            F.col("path.path").alias("path"),
            (F.col("path.lines_before") + F.col("line_no") - opened).alias("line_no"),
            "line",
            "is_marker",
            "in_fence",
            (F.col("fence_no") + F.floor(first / 2)).cast("long").alias("fence_no"),
        )
    )


def prose_lines(chunks: DataFrame) -> DataFrame:
    """``lines.prose_lines`` of documents in chunks."""
    return fenced_lines(chunks).where("NOT is_marker AND NOT in_fence").select(*KEY, "line_no", "line")


def table_rows_of(chunks: DataFrame, is_header: Callable[[Column], Column]) -> DataFrame:
    """``lines.table_rows`` of documents in chunks: a table goes on in the next chunk below the header it started with."""
    ends = F.filter("lines", lambda l: is_header(l) | ~F.startswith(F.trim(l), F.lit("|")))
    last = F.try_element_at(ends, F.lit(-1))
    header = F.when(last.isNull(), None).when(is_header(last), last).otherwise("")
    summary = tx.with_lines(chunks).select(*KEY, *ORDER, header.alias("header"))
    carried = with_carried(chunks, summary, lasts=["header"])
    content = F.when(F.col("header_before") != "", F.concat("header_before", F.lit("\n"), "content")).otherwise(F.col("content"))
    return table_rows(carried.select(*KEY, content.alias("content")), is_header)
