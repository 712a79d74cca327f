"""URL filters by rules, with block decisions that follow redirects and canonical links.

A rule is a host with all its subdomains and a prefix of the path; the longest one that fits an address decides it.
Addresses that redirect to each other, or name each other as canonical, are one resource under several names. They
are the connected components of a graph of addresses, and what is blocked under one name is blocked under all of
them, also where the blocked address itself is no page. A rule that fits an address binds it: an alias with an allow
rule of its own stays allowed, whatever its component holds.

DataFrame functions only. Rules are looked up by key (a suffix of the host, a prefix of the path), so their number is
no factor: an address asks once for each length of path that its hosts have rules of. Equal addresses are asked once.
Addresses of pages without an edge never enter the rounds of the components.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusaudit.functions.paths import normalise
from corpusaudit.llm.common import written
from corpusaudit.llm.simhash import components
from corpusaudit.operators.joins import fits_broadcast

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What holds no markup of its own; an unclosed one reaches to the end, as in a browser.
_OPAQUE = r"(?is)<!--.*?(?:-->|\z)|<(script|style|textarea|title)\b.*?(?:</\1\b|\z)"
_TAG = r"(?i)<(?:link|meta)\s[^<>]*+>"
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """Behind the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_key(url: Column) -> Column:
    """What two spellings of one address share: no fragment, scheme and host in lower case, ``/`` for no path."""
    plain = F.regexp_extract(url, r"(?s)^([^#]*)", 1)
    origin = F.regexp_extract(plain, r"(?s)^(.*?://[^/?]*)", 1)
    rest = F.substr(plain, F.length(origin) + 1)
    return F.when(origin == "", plain).otherwise(
        F.concat(F.translate(origin, UPPER, LOWER), F.when(F.startswith(rest, F.lit("/")), "").otherwise("/"), rest)
    )


def resolve_url(base: Column, target: Column) -> Column:
    """``target`` as an absolute address, as a link of the page ``base``; null where it is none."""
    origin = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    path = F.regexp_extract(target, r"(?s)^([^?#]*)", 1)
    rest = F.substr(target, F.length(path) + 1)
    folder = F.regexp_extract(url_path(base), r"(?s)^(.*/)", 1)
    whole = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(folder, path))
    # a folder keeps its last slash, which folding the dots takes away
    slash = F.when(whole.rlike(r"(^|/)\.{0,2}$"), "/").otherwise("")
    folded = F.regexp_replace(normalise(whole), r"^(\.\./?)+", "")
    placed = F.concat(origin, F.lit("/"), F.concat(folded, F.when(folded == "", "").otherwise(slash)), rest)
    asked = F.regexp_extract(base, r"(?s)^([^?#]*)", 1)
    return (
        F.when((target == "") | (origin == ""), F.when(target.rlike(_SCHEME + "//"), target))
        .when(target.rlike(_SCHEME), F.when(target.rlike(_SCHEME + "//"), target))
        .when(F.startswith(target, F.lit("//")), F.concat(F.regexp_extract(base, r"(?s)^(.*?:)//", 1), target))
        .when(F.startswith(target, F.lit("#")), base)
        .when(F.startswith(target, F.lit("?")), F.concat(asked, target))
        .otherwise(placed)
    )


def _attribute(tag: Column, name: str) -> Column:
    value = r"""(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    parts = [F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*{value}", i) for i in (1, 2, 3)]
    return F.trim(F.regexp_replace(F.concat(*parts), r"(?i)&(?:amp|#38|#x26);", "&"))


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``source, target``: canonical links and refreshes of whole pages, as absolute addresses.

    Comments, scripts, styles, titles and text areas hold no links. A null address or page gives none.
    """
    near = pages.where(F.col(url_col).isNotNull() & F.col(html_col).rlike("(?i)canonical|http-equiv"))
    plain = F.regexp_replace(html_col, _OPAQUE, " ")
    tags = near.select(F.col(url_col).alias("source"), F.explode_outer(F.regexp_extract_all(plain, F.lit(_TAG), F.lit(0))).alias("tag"))
    tag = F.col("tag")
    canonical = F.when(F.lower(_attribute(tag, "rel")).rlike(r"(^|\s)canonical(\s|$)"), _attribute(tag, "href"))
    wait = r"""(?is)^[\s\d.]*[;,]?\s*url\s*=\s*["']?([^"']*)"""
    refresh = F.when(F.lower(_attribute(tag, "http-equiv")) == "refresh", F.trim(F.regexp_extract(_attribute(tag, "content"), wait, 1)))
    target = F.when(tag.rlike("(?i)^<link"), canonical).otherwise(refresh)
    found = tags.select("source", target.alias("target")).where("target <> ''")
    return found.select("source", resolve_url(F.col("source"), F.col("target")).alias("target")).where("target is not null")


def fitting_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``host, path, rule, verdict`` of distinct ``host, path`` that a rule fits: the longest rule.

    ``rules`` has ``host, path, verdict``. Of equally long rules an allow rule wins, then the one with the longer
    host, then the first by text. Rules with a null are no rules. The rules are broadcast only if they are few, by
    count; otherwise keys are shuffled.
    """
    rules = rules.select("host", "path", "verdict").where("host is not null and path is not null and verdict is not null").distinct()
    most = rules.agg(F.max(F.size(F.split("host", r"\."))).alias("n")).first()["n"] or 0
    hint = F.broadcast if fits_broadcast(rules) else (lambda df: df)
    lengths = rules.groupBy(F.col("host").alias("r_host")).agg(F.collect_set(F.length("path")).alias("lengths"))
    keys = rules.select(F.col("host").alias("k_host"), F.col("path").alias("k_path"), "verdict")
    labels = F.size(F.split("host", r"\."))
    some = F.sequence(F.lit(1), F.least(labels, F.greatest(F.lit(most), F.lit(1))))
    suffixes = F.transform(some, lambda k: F.array_join(F.slice(F.split("host", r"\."), labels - k + 1, k), "."))
    asked = urls.select("host", "path", F.explode_outer(suffixes).alias("r_host")).join(hint(lengths), "r_host")
    asked = asked.select("host", "path", "r_host", F.explode_outer("lengths").alias("length")).where(F.col("length") <= F.length("path"))
    asked = asked.select("host", "path", F.col("r_host").alias("k_host"), F.left("path", F.col("length")).alias("k_path"))
    fits = asked.join(hint(keys), ["k_host", "k_path"])
    rule = F.concat("k_host", "k_path")
    order = F.struct(-F.length(rule), F.col("verdict") != "allow", -F.length("k_host"), rule, "verdict")
    best = fits.groupBy("host", "path").agg(F.min_by(F.struct(rule.alias("rule"), "verdict"), order).alias("b"))
    return best.select("host", "path", "b.rule", "b.verdict")


def filter_urls(
    pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None,
    id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
) -> DataFrame:
    """One row per page: id, url, ``host, path, rule, verdict``.

    ``rules`` has ``host, path, verdict`` (``allow`` or ``block``), ``redirects`` (a crawl's answers, if there are
    any) ``source, target``. An address takes the verdict of the longest rule that fits it. Without a rule it is
    blocked if an alias of it, in any number of steps, is blocked by a rule, and else allowed. Null addresses, and
    those without ``://``, have an empty host and path and no rule; they are aliases of nothing. Repeated addresses
    and rows are judged alike and all returned; an empty table gives an empty result.
    """
    id_, url = F.col(id_col), F.col(url_col)
    rows = pages.select(id_.alias("p_id"), url.alias("p_url"), url_host(url).alias("host"), url_path(url).alias("path"), url_key(url).alias("p_key"))
    edges = page_links(pages, url_col, html_col)
    if redirects is not None:
        edges = edges.union(redirects.select("source", "target").where("source is not null and target is not null"))
    edges = written(edges.select("target", url_key(F.col("source")).alias("a"), url_key(F.col("target")).alias("b")).distinct(), "url-edges")

    places = rows.select("host", "path").union(edges.select(url_host(F.col("target")), url_path(F.col("target")))).distinct()
    ruled = written(fitting_rules(places, rules), "url-rules")

    roots = components(edges.select("a", "b"))
    named = edges.select(F.col("target").alias("u"), F.col("b").alias("key")).union(
        rows.join(roots, F.col("p_key") == F.col("node"), "left_semi").select("p_url", "p_key")
    ).distinct()
    named = named.select("key", url_host(F.col("u")).alias("host"), url_path(F.col("u")).alias("path"))
    blocked = named.join(ruled.where("verdict = 'block'"), ["host", "path"], "left_semi").select("key").distinct()
    bad = roots.join(blocked, F.col("node") == F.col("key")).select(F.col("root").alias("bad")).distinct()
    aliases = roots.join(bad, F.col("root") == F.col("bad"), "left_semi").select(F.col("node").alias("alias"))

    best = ruled.select(F.col("host").alias("r_host"), F.col("path").alias("r_path"), "rule", F.col("verdict").alias("r_verdict"))
    out = rows.join(best, (F.col("host") == F.col("r_host")) & (F.col("path") == F.col("r_path")), "left")
    out = out.join(aliases, F.col("p_key") == F.col("alias"), "left")
    verdict = F.coalesce("r_verdict", F.when(F.col("alias").isNotNull(), "block").otherwise("allow"))
    return out.select(F.col("p_id").alias(id_col), F.col("p_url").alias(url_col), "host", "path", "rule", verdict.alias("verdict"))
