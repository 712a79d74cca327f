"""Column functions on text: lines, runs of lines, slugs, routes, names and literal replacement.

A document is one row. Whatever carries state from line to line (code fences, tables, sections, slides,
diagram blocks) is computed inside that row by cutting the array of lines at its separator lines, so no
line is ever shuffled and the cost is linear in the text, however unevenly files are spread over corpora.

Arrays are exploded with the ``_outer`` forms and NULLs filtered after: for the plain forms Catalyst infers
``size(array) > 0`` and pushes it below the projections, which would compute every array a second time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FENCE = "```"
HEADING = r"^#{1,6}\s+(.+)$"
#: What ``\\s`` and ``.`` are inside a line; and what may follow the place where ``$`` matches in one.
BLANK, INNER, LAST = r"[ \t\x0B\f]", r"[^\n\x{85}\x{2028}\x{2029}]", r"[\x{85}\x{2028}\x{2029}]?"


def unix(content: Column) -> Column:
    """``\\r\\n`` and ``\\r`` as ``\\n``."""
    return F.replace(F.replace(content, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def split_lines(content: Column) -> Column:
    """Pieces between newlines; ``\\r\\n`` and ``\\r`` count as ``\\n``; an empty text has none."""
    return F.when(F.length(content) == 0, F.array().cast("array<string>")).otherwise(F.split(unix(content), "\n", -1))


def in_text(regex: str) -> str:
    """A pattern for single lines (``^`` first, ``$`` last if at all) as one that finds these lines inside a ``unix`` text.

    A text is then searched once, without being cut into an array of lines whose elements are looked at one by one.
    """
    if regex.endswith("$"):
        regex = regex[:-1] + LAST + "$"
    return "(?md)" + regex.replace(r"\s", BLANK).replace(".", INNER)


def prose_text(content: Column) -> Column:
    """The ``unix`` text in which fenced lines and fence markers are empty lines; lines keep their numbers."""
    pieces = F.split(unix(content), in_text(r"^\s*" + FENCE) + "[^\n]*", -1)
    prose = F.transform(pieces, lambda p, k: F.when(k % 2 == 1, F.regexp_replace(p, "[^\n]+", "")).otherwise(p))
    return F.when(F.contains(content, F.lit(FENCE)), F.array_join(prose, "")).otherwise(unix(content))


def with_lines(df: DataFrame, content: str = "content", into: str = "lines") -> DataFrame:
    """Add the array of lines. The final empty element left by a closing newline is dropped."""
    parts = split_lines(F.col(content))
    df = df.withColumn("_parts", parts)
    drop = (F.size("_parts") > 0) & (F.try_element_at(F.col("_parts"), F.lit(-1)) == "")
    kept = F.when(drop, F.slice("_parts", F.lit(1), F.size("_parts") - 1)).otherwise(F.col("_parts"))
    return df.withColumn(into, kept).drop("_parts")


def cut_runs(
    df: DataFrame,
    lines: str,
    is_break: Callable[[Column], Column],
    into: str,
    detect: str | None = None,
) -> DataFrame:
    """Cut an array of lines before every line that ``is_break`` accepts.

    Adds ``into ARRAY<STRUCT<run_no, first_line, lines>>``: run 0 holds what precedes the first break,
    every later run starts with its break line. ``detect`` names another array of the same length on
    which breaks are looked for (lines with fenced code blanked, for example).
    """
    probe = F.col(detect or lines)
    df = df.withColumn(
        "_cuts",
        F.filter(
            F.transform(probe, lambda l, i: F.when(is_break(l), i + 1)), lambda n: n.isNotNull()
        ),
    )
    df = df.withColumn("_from", F.concat(F.array(F.lit(1)), F.col("_cuts"))).withColumn(
        "_to", F.concat(F.col("_cuts"), F.array(F.size(lines) + 1))
    )
    runs = F.transform(
        F.arrays_zip("_from", "_to"),
        lambda z, k: F.struct(
            k.alias("run_no"),
            z["_from"].alias("first_line"),
            F.slice(F.col(lines), z["_from"], z["_to"] - z["_from"]).alias("lines"),
        ),
    )
    return df.withColumn(into, runs).drop("_cuts", "_from", "_to")


def is_fence(line: Column) -> Column:
    return line.rlike(r"^\s*" + FENCE)


def with_fences(df: DataFrame, lines: str = "lines", into: str = "fences") -> DataFrame:
    """Runs between fence markers: odd runs are code, an unclosed fence runs to the end of the file."""
    return cut_runs(df, lines, is_fence, into)


def _blank(run: Column) -> Column:
    code = run["run_no"] % 2 == 1
    return F.transform(
        run["lines"],
        lambda l, i: F.when(code | ((run["run_no"] > 0) & (i == 0)), F.lit(None).cast("string")).otherwise(l),
    )


def with_prose(df: DataFrame, lines: str = "lines", into: str = "prose") -> DataFrame:
    """Array of the same length in which fenced lines and fence markers are NULL."""
    df = with_fences(df, lines, "_runs")
    return df.withColumn(into, F.flatten(F.transform("_runs", _blank))).drop("_runs")


def slug(text: Column) -> Column:
    """Anchor of a heading: lower case, word characters of any script kept, blanks become one ``-``."""
    kept = F.regexp_replace(F.trim(F.lower(text)), r"[^\p{L}\p{M}\p{N}_\s-]", "")
    return F.btrim(F.regexp_replace(kept, r"[\s-]+", "-"), F.lit("-"))


def normalise_route(path: Column) -> Column:
    """Drop the query, make ``{x}``, ``:x`` and ``[x]`` one placeholder, drop trailing slashes."""
    bare = F.substring_index(path, "?", 1)
    marked = F.regexp_replace(bare, r"\{[^}]+\}", "{_}")
    marked = F.regexp_replace(marked, r":[\p{L}\p{N}_]+", "{_}")
    marked = F.regexp_replace(marked, r"\[[^\]]+\]", "{_}")
    bare = F.regexp_replace(marked, "/+$", "")
    return F.when(bare == "", F.lit("/")).otherwise(bare)


def kebab(name: Column, acronyms: bool = True) -> Column:
    """CamelCase to kebab-case; with ``acronyms`` a run of capitals is split before its last letter."""
    cut = F.regexp_replace(name, "(?<=[a-z0-9])([A-Z])", "-$1")
    if acronyms:
        cut = F.regexp_replace(cut, "(?<=[A-Z])([A-Z][a-z])", "-$1")
        return F.regexp_replace(F.lower(cut), "^-+|-+$", "")
    return F.lower(cut)


def replace_all(text: Column, pairs: Iterable[tuple[str, str]]) -> Column:
    """Literal replacements in the given order; later pairs see the result of earlier ones."""
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)


def clean_version(version: Column) -> Column:
    return F.regexp_replace(version, "^[^0-9]*", "")


def major_version(version: Column) -> Column:
    return F.regexp_extract(version, "([0-9]+)", 1)


def safe_integer(value: Column) -> Column:
    return value.try_cast("bigint")


def quote_identifier(name: str, dialect: str) -> str:
    """Quoted identifier for the text of a JDBC query."""
    return f"`{name}`" if dialect == "mysql" else f'"{name}"'


def is_safe_identifier(name: Column) -> Column:
    return name.rlike("^[A-Za-z_][A-Za-z0-9_]{0,127}$")


def is_safe_name(name: Column) -> Column:
    """No parent step and no separator."""
    return ~(F.contains(name, F.lit("..")) | F.contains(name, F.lit("/")) | F.contains(name, F.lit("\\")))


def tidy_page(markdown: Column) -> Column:
    """Comments dropped, three or more newlines folded to two, outer white space trimmed."""
    bare = F.regexp_replace(markdown, "(?s)<!--.*?-->", "")
    return F.regexp_replace(F.regexp_replace(bare, "\n{3,}", "\n\n"), r"^\s+|\s+\z", "")


def display_width(text: Column) -> Column:
    """Columns on a terminal: a code point above U+2E80 takes two."""
    return F.length(text) + F.regexp_count(text, F.lit(r"[\x{2E81}-\x{10FFFF}]"))


def title_of(content: Column, fallback: Column) -> Column:
    """First line that starts with ``# ``, without its marks; else the fallback in title case."""
    found = F.regexp_extract(content, r"(?m)^[ \t]*# (.*)$", 1)
    words = F.initcap(F.regexp_replace(fallback, "[-_]", " "))
    return F.when(
        content.rlike(r"(?m)^[ \t]*# "), F.trim(F.regexp_replace(found, "^[# ]+", ""))
    ).otherwise(words)


def estimate_tokens(chars: Column) -> Column:
    return F.floor(chars / F.lit(4)).cast("bigint")


def line_count(content: Column) -> Column:
    """Number of newlines plus one."""
    return F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit(""))) + 1
