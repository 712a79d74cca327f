"""Column functions on POSIX paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """Everything before the last ``/``; empty for a top-level file."""
    return F.left(path, F.length(path) - F.length(basename(path)) - 1)


def extension(path: Column) -> Column:
    """Last suffix with its dot, lower case; leading dots of a hidden file do not count."""
    return F.lower(F.regexp_extract(basename(path), r"^\.*[^.].*?(\.[^.]*)$", 1))


def stem(path: Column) -> Column:
    base = basename(path)
    return F.regexp_replace(base, r"^(\.*[^.].*?)\.[^.]*$", "$1")


def _last(parts: Column) -> Column:
    return F.try_element_at(parts, F.lit(-1))


def _push(done: Column, part: Column) -> Column:
    up = (part == "..") & (F.size(done) > 0) & (F.coalesce(_last(done), F.lit("")) != "..")
    return (
        F.when(part.isin("", "."), done)
        .when(up, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.concat(done, F.array(part)))
    )


def normalise(path: Column) -> Column:
    """Fold ``.``, ``..`` and ``//``; a leading ``..`` stays, so a path that leaves the root stays visible."""
    # what may have such a part; a path without one is its own result either way
    ends = F.startswith(path, F.lit("/")) | F.endswith(path, F.lit("/")) | F.endswith(path, F.lit("."))
    plain = ~(ends | F.contains(path, F.lit("//")) | F.contains(path, F.lit("./")))
    folded = F.array_join(
        F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), _push), "/"
    )
    return F.when(plain, path).otherwise(folded)


def joined(source_path: Column, target: Column) -> Column:
    """Target of a relative link written in ``source_path``, not folded yet; ``/x`` is taken from the corpus root."""
    folder = dirname(source_path)
    return (
        F.when(target == "", source_path)
        .when(F.startswith(target, F.lit("/")) | (folder == ""), target)
        .otherwise(F.concat(folder, F.lit("/"), target))
    )


def resolve(source_path: Column, target: Column) -> Column:
    """The same, folded."""
    return normalise(joined(source_path, target))


def parents(path: Column) -> Column:
    """All folders above a file, nearest last: ``a/b/c.md`` gives ``[a, a/b]``."""
    parts = F.split(path, "/")
    return F.when(
        F.size(parts) > 1,
        F.transform(
            F.sequence(F.lit(1), F.size(parts) - 1),
            lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"),
        ),
    ).otherwise(F.array().cast("array<string>"))
