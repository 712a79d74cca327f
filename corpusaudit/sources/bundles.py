"""Text that holds many files or many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusaudit.functions import paths
from corpusaudit.functions import text as tx

# Fixed value: the line that opens a file of a bundle.
MARKER = r"---\s*FILE:\s*(.+?)\s*---"


def split_bundles(bundles: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """Files of a bundle: keys, file_no, path, content (trimmed, one newline at the end).

    What precedes the first marker is dropped. Names and bodies of a bundle are two arrays of its row.
    """
    text = F.col(content)
    names = F.regexp_extract_all(text, F.lit(MARKER), F.lit(1))
    bodies = F.split(text, MARKER, -1)
    both = F.arrays_zip(names.alias("name"), F.slice(bodies, F.lit(2), F.greatest(F.size(names), F.lit(0))).alias("body"))
    part = bundles.where(text.rlike(MARKER)).select(*keys, F.posexplode_outer(both).alias("n", "f")).where(F.col("n").isNotNull())
    body = F.regexp_replace("f.body", r"^\s+|\s+\z", "")
    return part.select(
        *keys,
        (F.col("n") + 1).alias("file_no"),
        F.trim("f.name").alias("path"),
        F.concat(body, F.lit("\n")).alias("content"),
    )


def contained(files: DataFrame) -> DataFrame:
    """Adds output_path and is_safe: a path, less a leading ``docs/``, that stays below the output folder."""
    bare = F.regexp_replace("path", "^docs/", "")
    target = paths.normalise(bare)
    absolute = F.startswith(bare, F.lit("/"))
    safe = ~absolute & ~target.rlike(r"^\.\.(/|$)")
    return files.withColumn("is_safe", safe).withColumn("output_path", F.when(safe, target))


def accepted(files: DataFrame) -> DataFrame:
    return contained(files).where("is_safe").drop("is_safe")


def rejects(files: DataFrame) -> DataFrame:
    return contained(files).where(~F.col("is_safe")).drop("is_safe", "output_path")


def split_delimited(outputs: DataFrame, keys: list[str], content: str = "content", sep: str = "\t") -> DataFrame:
    """Rows of delimited outputs, first line = header: keys, row_no, record MAP. Short rows are padded with ''.

    Of columns whose header names are equal the last one counts.
    """
    df = tx.with_lines(outputs.select(*keys, F.trim(content).alias("content")))
    header = F.transform(F.split(F.try_element_at(F.col("lines"), F.lit(1)), sep, -1), lambda c: F.lower(F.trim(c)))
    row = (
        df.withColumn("header", header)
        .select(*keys, "header", F.posexplode_outer("lines").alias("row_no", "line")).where(F.col("row_no").isNotNull())
        .where(F.col("row_no") > 0)
    )
    cells = F.transform(F.split("line", sep, -1), lambda c: F.trim(c))
    padded = F.transform("header", lambda _, i: F.coalesce(F.get(cells, i), F.lit("")))
    # a name is kept where it stands last
    last = F.filter(F.transform("header", lambda name, i: F.struct(name.alias("name"), F.get(padded, i).alias("value"), F.array_contains(F.slice("header", i + 2, F.size("header")), name).alias("again"))), lambda c: ~c["again"])
    record = F.map_from_entries(F.transform(last, lambda c: F.struct(c["name"], c["value"])))
    return row.select(*keys, "row_no", record.alias("record"))
