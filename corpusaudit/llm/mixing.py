"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source gets a share of the budget by weight, at most a number of times its own size; what is above goes to the
others by weight. A share is filled with whole epochs of the source first. The rest is sampled without
replacement: a document gets an exponential key whose rate is its quality weight, the smallest keys come first,
and in that order each document is taken that fits what is left of the rest.

The order of a source is never made in one task. Keys fall into buckets of equal expected numbers; sums of
buckets and running sums inside each give what the rows before a row take, in rounds that halve the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusaudit.llm.common import WORD, written

#: Buckets of keys for each source; the rows sorted in one task are this part of a source.
BUCKETS = 4096
WEIGHTS = (3.0, 1.0, 2.0)


def source_targets(sizes: DataFrame, share: float, most: float, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``; weights go to sources in code-point order, repeating.

    A source stays at its bound exactly when bound / weight is below the common level; in the order of that
    quotient the level is the largest of (budget - bounds before) / (weights not before). One row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    chosen = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", chosen).withColumn("bound", F.lit(most) * F.col("source_size"))
    rows = rows.withColumn("quotient", F.col("bound") / F.col("weight"))
    every = Window.partitionBy()
    before = Window.orderBy("quotient", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("bound").over(before), F.lit(0.0))
    free = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    rows = rows.withColumn("step", left / free).withColumn("level", F.max("step").over(every))
    return rows.select("source", "source_size", F.least("bound", F.col("weight") * F.col("level")).alias("target"))


def sampled(rows: DataFrame) -> DataFrame:
    """``row`` of what is taken when the rows of each source come in the order of their keys and each is taken if it fits.

    ``rows`` has ``source, bucket, key, id, size, row`` and ``rest``, what may still be taken of the source. In a round,
    rows of at most half the rest add up; the first of them that no longer fits, or the first larger one that fits what
    the rows before it leave, ends the round. All before it are settled and less than half the rest is left, so there
    are at most as many rounds as a rest has bits. What lies behind and still fits goes to the next round.
    """
    taken = rows.select("row").limit(0)
    here = F.struct("bucket", "key", "id", "size", "row")
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("source", "bucket").orderBy("key", "id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("source", "bucket", "key", "id", "size", "row", "rest")
    while not rows.isEmpty():
        rows = rows.withColumn("small", 2 * F.col("size") <= F.col("rest")).withColumn("adds", F.when(F.col("small"), F.col("size")).otherwise(0))
        buckets = rows.groupBy("source", "bucket").agg(F.sum("adds").alias("words"))
        buckets = buckets.select(F.col("source").alias("b_source"), F.col("bucket").alias("b_bucket"), F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("before"))
        placed = rows.join(buckets, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bucket") == F.col("b_bucket"))).drop("b_source", "b_bucket")
        placed = placed.withColumn("upto", F.col("before") + F.sum("adds").over(inside)).withColumn("here", here)
        placed = written(placed.drop("before", "adds"), "mix")
        ends = F.when(F.col("small"), F.col("upto") > F.col("rest")).otherwise(F.col("upto") + F.col("size") <= F.col("rest"))
        used = F.when(F.col("small"), F.col("upto") - F.col("size")).otherwise(F.col("upto") + F.col("size"))
        end = placed.where(ends).groupBy("source").agg(F.min(F.struct("here", "small", used.alias("used"))).alias("end"))
        end = end.select(F.col("source").alias("e_source"), "end")
        settled = placed.join(end, F.col("source").eqNullSafe(F.col("e_source")), "left")
        before = F.col("end").isNull() | (F.col("here") < F.col("end.here"))
        takes = F.when(F.col("small"), before).otherwise(F.coalesce(F.col("here") == F.col("end.here"), F.lit(False)))
        settled = settled.withColumn("takes", takes).withColumn("behind", F.coalesce(F.col("here") > F.col("end.here"), F.lit(False)))
        settled = settled.withColumn("rest", F.col("rest") - F.coalesce(F.col("end.used"), F.lit(0)))
        settled = settled.where("takes OR (behind AND size <= rest)")
        settled = written(settled.select("source", "bucket", "key", "id", "size", "row", "rest", "takes"), "mix")
        taken = taken.union(settled.where("takes").select("row"))
        rows = settled.where("NOT takes").drop("takes")
    return taken


def mix_sources(
    docs: DataFrame,
    quality: DataFrame | None = None,
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 20240229,
    weights: tuple[float, ...] = WEIGHTS,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    label_col: str | None = None,
) -> DataFrame:
    """One row per document: id, ``source, size, source_size, target, copies, taken``.

    ``size`` is the number of words (null text: 0), ``taken`` = ``copies`` x ``size``. ``quality`` has an id (the
    column ``label_col`` of both, or else ``id_col``) and a number ``quality`` (several for an id: the largest counts); documents of quality above 0 are twice as likely,
    those of 0 half as likely as documents without. A document that does not fit what is left of
    its source is passed over and the ones behind it go on, so at the end no document left out would fit.
    Keys depend on id and seed only, so reruns agree; ties are broken by id, then size, and rows that
    repeat both are told apart by their place in the table written here. A null source is a source and
    comes last; a null id is an id; a source without words gets 0; an empty table an empty result.
    """
    label_col = label_col or id_col
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(label_col).alias("label_id"), F.col(source_col).alias("source"), F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("size")
    )
    rate = F.lit(1.0)
    if quality is not None:
        best = quality.groupBy(F.col(label_col).alias("q_id")).agg(F.max("quality").alias("quality"))
        rows = rows.join(best, F.col("label_id") == F.col("q_id"), "left").drop("q_id")
        rate = F.when(F.col("quality").isNull(), 1.0).when(F.col("quality") > 0, 2.0).otherwise(0.5)
    uniform = (F.shiftrightunsigned(F.xxhash64("id", F.lit(seed)), 11) + 0.5) / float(1 << 53)
    rows = rows.select("id", "source", "size", (-F.log(uniform) / rate).alias("key"), (1 - F.pow(uniform, 1 / rate)).alias("place"))
    rows = rows.select("id", "source", "size", "key", F.floor(F.col("place") * BUCKETS).cast("int").alias("bucket"), F.monotonically_increasing_id().alias("row"))
    rows = written(rows, "mix")

    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    sizes = buckets.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = source_targets(sizes, share, most, weights)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = targets.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    rows = written(rows.withColumnRenamed("source", "r_source").join(targets, F.col("r_source").eqNullSafe(F.col("source"))).drop("r_source"), "mix")
    taken = sampled(rows.where("size > 0 AND size <= rest"))
    out = rows.join(taken.withColumnRenamed("row", "t_row"), F.col("row") == F.col("t_row"), "left")
    copies = F.col("epochs") + F.when(F.col("t_row").isNotNull(), 1).otherwise(0)
    copies = F.when(F.col("size") > 0, copies).otherwise(F.col("epochs")).cast("long")
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
