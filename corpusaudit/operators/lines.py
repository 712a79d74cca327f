"""Lines, fenced blocks, headings, sections, slides and table rows of a ``files`` table.

Input: ``corpus, path, content``. Nothing here shuffles: see functions.text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusaudit.functions import text as tx

KEY = ["corpus", "path"]


def explode_lines(files: DataFrame) -> DataFrame:
    """corpus, path, line_no (from 1), line."""
    return (
        tx.with_lines(files.select(*KEY, "content"))
        .select(*KEY, F.posexplode_outer("lines").alias("pos", "line")).where(F.col("pos").isNotNull())
        .select(*KEY, (F.col("pos") + 1).alias("line_no"), "line")
    )


def explode_fenced_lines(files: DataFrame) -> DataFrame:
    """Lines with their fence state: ``is_marker`` for the fence lines, ``in_fence``, ``fence_no`` from 1.

    An opening marker has the number of the block it opens; a closing marker the one it closes.
    """
    runs = tx.with_fences(tx.with_lines(files.select(*KEY, "content"))).select(
        *KEY, F.explode_outer("fences").alias("run")
    ).where(F.col("run").isNotNull())
    run_no = F.col("run.run_no")
    marker = (run_no > 0) & (F.col("pos") == 0)
    code = run_no % 2 == 1
    number = F.when(code | marker, F.floor((run_no + 1) / 2)).cast("int")
    return runs.select(*KEY, "run", F.posexplode_outer("run.lines").alias("pos", "line")).where(F.col("pos").isNotNull()).select(
        *KEY,
        (F.col("run.first_line") + F.col("pos")).alias("line_no"),
        "line",
        marker.alias("is_marker"),
        (code & ~marker).alias("in_fence"),
        number.alias("fence_no"),
    )


def prose_lines(files: DataFrame) -> DataFrame:
    """Lines outside fenced code, with their true line numbers."""
    return (
        tx.with_prose(tx.with_lines(files.select(*KEY, "content")))
        .select(*KEY, F.posexplode_outer("prose").alias("pos", "line")).where(F.col("pos").isNotNull())
        .where(F.col("line").isNotNull())
        .select(*KEY, (F.col("pos") + 1).alias("line_no"), "line")
    )


def headings(files: DataFrame) -> DataFrame:
    """corpus, path, line_no, level, heading, slug."""
    found = prose_lines(files).where(F.col("line").rlike(tx.HEADING))
    title = F.trim(F.regexp_extract("line", tx.HEADING, 1))
    return found.select(
        *KEY,
        "line_no",
        F.length(F.regexp_extract("line", "^(#+)", 1)).alias("level"),
        title.alias("heading"),
        tx.slug(title).alias("slug"),
    )


def with_sections(df: DataFrame, low: int, high: int, into: str = "parts") -> DataFrame:
    """Add the runs between headings of the levels ``low`` to ``high`` (outside code); needs ``lines``."""
    df = tx.with_prose(df, "lines", "_prose")
    mark = rf"^#{{{low},{high}}}\s+"
    return tx.cut_runs(df, "lines", lambda l: l.rlike(mark), into, detect="_prose").drop("_prose")


def sections(files: DataFrame, low: int = 1, high: int = 3) -> DataFrame:
    """corpus, path, section_no (0 = before the first heading), level, heading, first_line, body."""
    df = with_sections(tx.with_lines(files.select(*KEY, "content")), low, high)
    run = df.select(*KEY, F.explode_outer("parts").alias("p")).where(F.col("p").isNotNull())
    head = F.when(F.col("p.run_no") > 0, F.try_element_at(F.col("p.lines"), F.lit(1)))
    rest = F.when(
        F.col("p.run_no") > 0, F.slice("p.lines", F.lit(2), F.greatest(F.size("p.lines") - 1, F.lit(0)))
    ).otherwise(F.col("p.lines"))
    return run.select(
        *KEY,
        F.col("p.run_no").alias("section_no"),
        F.length(F.regexp_extract(head, "^(#+)", 1)).alias("level"),
        F.trim(F.regexp_extract(head, r"^#+\s+(.*)$", 1)).alias("heading"),
        F.col("p.first_line").alias("first_line"),
        F.array_join(F.coalesce(rest, F.array()), "\n").alias("body"),
    ).where((F.col("section_no") > 0) | (F.col("body") != ""))


def slides(files: DataFrame) -> DataFrame:
    """Slides of a deck: cut at ``---`` lines, front matter left out. corpus, path, slide_no, first_line, lines."""
    df = tx.cut_runs(
        tx.with_lines(files.select(*KEY, "content")), "lines", lambda l: l.rlike(r"^\s*---\s*$"), "runs"
    )
    # with front matter the first line is itself a separator: run 0 is empty and run 1 is the front matter
    front = F.try_element_at(F.col("lines"), F.lit(1)).rlike(r"^\s*---\s*$")
    run = df.select(*KEY, front.alias("front"), F.explode_outer("runs").alias("r")).where(F.col("r").isNotNull()).where(
        ~(F.coalesce(F.col("front"), F.lit(False)) & (F.col("r.run_no") <= 1))
    )
    body = F.when(F.col("r.run_no") == 0, F.col("r.lines")).otherwise(
        F.slice("r.lines", F.lit(2), F.greatest(F.size("r.lines") - 1, F.lit(0)))
    )
    first = F.col("r.first_line") + F.when(F.col("r.run_no") == 0, 0).otherwise(1)
    return run.select(
        *KEY, F.col("r.run_no").alias("slide_no"), first.alias("first_line"), body.alias("lines")
    ).where(F.size("lines") > 0)


# Fixed value: the row below a table header.
SEPARATOR_ROW = r"^\|[\s:|-]+\|$"


def cells(row: Column) -> Column:
    return F.transform(F.split(F.trim(row), r"\|"), lambda c: F.trim(c))


def table_rows(files: DataFrame, is_header: Callable[[Column], Column]) -> DataFrame:
    """Data rows of the Markdown tables whose header line ``is_header`` accepts.

    corpus, path, header ARRAY, cells ARRAY. A table ends at the first line that does not start with a
    pipe; separator rows are left out.
    """
    # a text without the header words has no such line
    df = tx.with_lines(files.select(*KEY, "content").where(is_header(F.col("content"))))
    df = tx.cut_runs(
        df, "lines", lambda l: is_header(l) | ~F.startswith(F.trim(l), F.lit("|")), "runs"
    )
    run = df.select(*KEY, F.explode_outer("runs").alias("r")).where(F.col("r").isNotNull()).where(
        (F.col("r.run_no") > 0) & is_header(F.try_element_at(F.col("r.lines"), F.lit(1)))
    )
    rows = run.select(
        *KEY,
        cells(F.try_element_at(F.col("r.lines"), F.lit(1))).alias("header"),
        F.posexplode_outer("r.lines").alias("pos", "row"),
    ).where(F.col("pos").isNotNull()).where((F.col("pos") > 0) & ~F.trim("row").rlike(SEPARATOR_ROW))
    return rows.select(*KEY, "header", cells(F.col("row")).alias("cells"))


def cell_under(header: str, row: str, word: str, last: bool = False) -> Column:
    """Cell below the first (or last) header cell that contains ``word``; quotes and blanks trimmed."""
    where = F.transform(F.col(header), lambda c: F.contains(c, F.lit(word)))
    at = F.array_position(F.reverse(where) if last else where, True)
    at = F.when(at > 0, F.size(header) + 1 - at if last else at).cast("int")
    value = F.try_element_at(F.col(row), at)
    return F.trim(F.regexp_replace(value, "^`+|`+$", ""))
