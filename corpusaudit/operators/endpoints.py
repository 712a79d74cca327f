"""API endpoints in documents, routes in sources, and the check of one against the other."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusaudit.functions import paths
from corpusaudit.functions.text import normalise_route
from corpusaudit.operators.classify import project_types
from corpusaudit.operators.joins import join_per_corpus
from corpusaudit.operators.lines import cell_under, table_rows

# Fixed values.
ALLOWED_SCHEMES = ["http", "https"]
BLOCKED_HOSTS = ["169.254.169.254", "metadata.google.internal"]
VERBS = ["GET", "POST", "PUT", "PATCH", "DELETE"]
METHOD_HEADER, PATH_HEADER = "メソッド", "パス"
PROSE = r"(GET|POST|PUT|PATCH|DELETE)\s+(/[^\s|)`]+)"
EXPRESS = r"""(?i)(?:router|app)\.(get|post|put|patch|delete)\s*\(\s*['"]([^'"]+)['"]"""
NEXT_EXPORT = r"export\s+(?:async\s+)?function\s+(GET|POST|PUT|PATCH|DELETE)"
LARAVEL = r"""(?i)Route::(get|post|put|patch|delete|any)\s*\(\s*['"]([^'"]*)['"]"""
LARAVEL_PREFIX = r"""['"]prefix['"][\s]*=>[\s]*['"]([^'"]*)['"]"""
LARAVEL_GROUP = r"function\s*\(\s*\)\s*\{"


def endpoints(docs: DataFrame) -> DataFrame:
    """Distinct (corpus, method, path) from prose and from tables with method and path columns."""
    raw = F.regexp_extract_all("content", F.lit(PROSE), F.lit(0))
    prose = (
        docs.where(F.col("content").rlike(r"(GET|POST|PUT|PATCH|DELETE)\s"))
        .select("corpus", F.explode_outer(F.array_distinct(raw)).alias("raw")).where(F.col("raw").isNotNull())
        .select("corpus", F.regexp_extract("raw", PROSE, 1).alias("method"), F.regexp_extract("raw", PROSE, 2).alias("path"))
    )
    is_header = lambda l: F.contains(l, F.lit("|")) & F.contains(l, F.lit(METHOD_HEADER)) & F.contains(l, F.lit(PATH_HEADER))
    cell = (
        table_rows(docs, is_header)
        .select(
            "corpus",
            F.upper(cell_under("header", "cells", METHOD_HEADER, last=True)).alias("method"),
            cell_under("header", "cells", PATH_HEADER, last=True).alias("path"),
        )
        .where(F.col("method").isin(VERBS) & F.startswith("path", F.lit("/")))
    )
    return prose.unionByName(cell).distinct()


def _route(method: Column, path: Column) -> Column:
    return F.struct(method.alias("method"), path.alias("path"))


def _nuxt_verbs(name: Column) -> Column:
    chain = None
    for verb in VERBS:
        hit = F.contains(name, F.lit(f".{verb.lower()}."))
        one = F.array(F.lit(verb))
        chain = F.when(hit, one) if chain is None else chain.when(hit, one)
    return chain.otherwise(F.array(*[F.lit(v) for v in VERBS]))


def source_routes(files: DataFrame) -> DataFrame:
    """Distinct (corpus, method, path) declared in sources: Express calls, Next.js exports, Nuxt file names, Laravel groups.

    Routes of all kinds are read from the files where they lie; only routes, without any text, meet the types of
    their corpus (a column ``project_types`` where the files have it, else found from the marker files).
    """
    if "project_types" in files.columns:
        types = files.select("corpus", F.explode("project_types").alias("kind")).distinct()
    else:
        types = project_types(files).select("corpus", F.explode("project_types").alias("kind"))
    return declared_routes(files).join(types, ["corpus", "kind"], "left_semi").select("corpus", "method", "path").distinct()


def declared_routes(files: DataFrame) -> DataFrame:
    """kind, corpus, method, path of what looks like a route of some kind of project, distinct."""
    p, c = F.col("path"), F.col("content")
    of = lambda kind, df: df.select(F.lit(kind).alias("kind"), "corpus", "method", "path").where(F.col("method").isNotNull())
    express = (
        files.where(p.rlike(r"\.(js|ts)$") & ~p.rlike("(^|/)(node_modules|\\.git|dist|build)/"))
        .select("corpus", F.explode_outer(F.regexp_extract_all(c, F.lit(EXPRESS), F.lit(0))).alias("raw")).where(F.col("raw").isNotNull())
        .select("corpus", F.upper(F.regexp_extract("raw", EXPRESS, 1)).alias("method"), F.regexp_extract("raw", EXPRESS, 2).alias("path"))
    )
    folder = F.regexp_extract(p, r"^app/(?:(.*)/)?route\.[^/]*$", 1)
    next_path = F.concat(F.lit("/"), F.translate(F.when(folder == "", F.lit(".")).otherwise(folder), "[]", "{}"))
    nextjs = files.where(p.rlike(r"^app/(.*/)?route\.[^/]*$")).select("corpus", F.explode_outer(F.regexp_extract_all(c, F.lit(NEXT_EXPORT), F.lit(1))).alias("method"), next_path.alias("path"))
    bare = F.regexp_replace(F.regexp_extract(p, "^server/api/(.*)$", 1), r"\.[^./]*$", "")
    nuxt = files.where(p.rlike(r"^server/api/.*\.(js|ts)$")).select(
        "corpus", F.explode_outer(_nuxt_verbs(F.lower(paths.basename(p)))).alias("method"), F.concat(F.lit("/api/"), F.translate(bare, "[]", "{}")).alias("path")
    )
    each = of("express", express).unionByName(of("nextjs", nextjs)).unionByName(of("nuxt", nuxt)).unionByName(of("laravel", laravel_routes(files)))
    return each.distinct()


_GROUP = T.StructType().add("start", T.IntegerType()).add("stop", T.IntegerType()).add("prefix", T.StringType())
_CALL = T.StructType().add("pos", T.IntegerType()).add("method", T.StringType()).add("path", T.StringType())


@F.pandas_udf(T.StructType().add("groups", T.ArrayType(_GROUP)).add("calls", T.ArrayType(_CALL)))
def _laravel_positions(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Where groups open and close (matching braces) and where routes are declared: positions only."""
    import re

    prefix, opening, call, brace = (re.compile(x) for x in (LARAVEL_PREFIX, LARAVEL_GROUP, LARAVEL, "[{}]"))

    def groups(text: str) -> Iterator[dict]:
        for m in prefix.finditer(text):
            start = opening.search(text, m.start())
            if start is None:
                continue
            depth, stop = 1, len(text)
            for b in brace.finditer(text, start.end()):
                depth += 1 if b.group() == "{" else -1
                if depth == 0:
                    stop = b.end()
                    break
            yield {"start": start.end(), "stop": stop, "prefix": m.group(1)}

    for contents in batches:
        yield pd.DataFrame(
            {
                "groups": [list(groups(t)) for t in contents],
                "calls": [
                    [{"pos": m.start(), "method": m.group(1), "path": m.group(2)} for m in call.finditer(t)]
                    for t in contents
                ],
            }
        )


def laravel_routes(files: DataFrame) -> DataFrame:
    """Routes with the prefixes of the groups around them, outermost first.

    Groups and calls of a file stay in its row; the look-up by position is a filter over the few groups.
    """
    slashes = lambda c: F.regexp_replace(c, "^/+|/+$", "")
    at = files.where(F.col("path").isin("routes/api.php", "routes/web.php")).select(
        "corpus", "path", _laravel_positions("content").alias("found")
    )
    call = at.select(
        "corpus",
        F.when(F.contains("path", F.lit("api.php")), "api").otherwise("").alias("base"),
        F.array_sort("found.groups").alias("groups"),
        F.explode_outer("found.calls").alias("call"),
    ).where(F.col("call").isNotNull())
    around = F.filter("groups", lambda g: (g["start"] <= F.col("call.pos")) & (F.col("call.pos") < g["stop"]))
    parts = F.concat(F.array("base"), F.transform(around, lambda g: slashes(g["prefix"])), F.array(slashes(F.col("call.path"))))
    full = F.concat(F.lit("/"), F.array_join(F.filter(parts, lambda x: x != ""), "/"))
    verb = F.upper("call.method")
    verbs = F.when(verb == "ANY", F.array(*[F.lit(v) for v in VERBS])).otherwise(F.array(verb))
    return call.select("corpus", F.explode_outer(verbs).alias("method"), full.alias("path")).where(F.col("method").isNotNull())


def verify_endpoints(found: DataFrame, routes: DataFrame) -> DataFrame:
    """Verdict per documented endpoint; unmatched is WARN but counts as a failure."""
    known = routes.select("corpus", "method", normalise_route(F.col("path")).alias("route")).distinct()
    judged = found.withColumn("route", normalise_route(F.col("path"))).join(
        known.withColumn("hit", F.lit(True)), ["corpus", "method", "route"], "left"
    )
    judged = join_per_corpus(judged, known.select("corpus").distinct().withColumn("checkable", F.lit(True)), ["path"])
    each = judged.where(F.col("checkable")).select(
        "corpus",
        F.when(F.col("hit"), "OK").otherwise("WARN").alias("status"),
        F.concat_ws(" ", "method", "path").alias("label"),
        F.when(F.col("hit"), "").otherwise("no such route").alias("message"),
        F.col("hit").isNull().alias("counts_as_failure"),
    )
    blind = (
        judged.where(F.col("checkable").isNull())
        .groupBy("corpus")
        .agg(F.concat(F.count("*").cast("string"), F.lit(" endpoints")).alias("label"))
        .select("corpus", F.lit("WARN").alias("status"), "label", F.lit("no routes found").alias("message"), F.lit(False).alias("counts_as_failure"))
    )
    return each.unionByName(blind).select(F.lit("endpoint").alias("check"), "*")


def filter_routes(routes: DataFrame, has_credentials: bool) -> DataFrame:
    """Without credentials only routes that need none; a missing flag means none needed."""
    return routes if has_credentials else routes.where(~F.coalesce("auth_required", F.lit(False)))


def screen_paths(files: DataFrame) -> DataFrame:
    """Screen paths in flow diagrams and inline code: corpus, path, name; one row per path."""
    forms = [r'\w+\["(/[^"<\]]*)', r'\w+\["(/[^"]+)"?\]', r'\w+\("(/[^"<\)]*)', r"`(/[a-zA-Z0-9/_-]+)`"]
    found = F.concat(*[F.regexp_extract_all("content", F.lit(f), F.lit(1)) for f in forms])
    route = files.select("corpus", F.explode_outer(F.array_distinct(found)).alias("raw")).where(F.col("raw").isNotNull()).select("corpus", F.trim("raw").alias("path"))
    name = F.replace(F.regexp_replace("path", "^/+|/+$", ""), F.lit("/"), F.lit("-"))
    return (
        route.where(~F.col("path").rlike("style |class |click |:::"))
        .distinct()
        .select("corpus", "path", F.when(name == "", "root").otherwise(name).alias("name"), F.lit(False).alias("auth_required"))
    )


def capture_path(folder: Column, name: Column) -> Column:
    """File of a capture below ``folder``; NULL for a name that is empty or hidden after its folders are cut."""
    safe = paths.basename(name)
    return F.when((safe != "") & ~F.startswith(safe, F.lit(".")), F.concat(folder, F.lit("/"), safe, F.lit(".png")))


def is_allowed_url(url: Column) -> Column:
    """http or https, and no metadata host."""
    scheme, host = F.try_parse_url(url, F.lit("PROTOCOL")), F.try_parse_url(url, F.lit("HOST"))
    return F.coalesce(scheme.isin(ALLOWED_SCHEMES) & ~host.isin(BLOCKED_HOSTS), F.lit(False))


def capture_report(results: DataFrame) -> DataFrame:
    """captured, failed and the bytes of the successes, per corpus."""
    ok = F.col("success")
    return results.groupBy("corpus").agg(
        F.count_if(ok).alias("captured"),
        F.count_if(~ok).alias("failed"),
        F.coalesce(F.sum(F.when(ok, F.col("size"))), F.lit(0)).alias("total_size"),
    )
