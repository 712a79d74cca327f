"""The operators applied to the given tables, with production parameters, and SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusaudit.llm import decontaminate, exact_dedup, html_text, katz, language, mixing, periodic_runs, simhash, spelling
from corpusaudit.llm import substring_dedup, token_counts, token_files, url_filter
from corpusaudit.llm.common import WORD, Query, configured, fold, shared_path, table

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = configured(fn)
    return fn


@query
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a passage that is a benchmark item."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from three quarters of the labels."""
    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 4, 2)
    model = language.fit_language_model(docs.where(~held_out))
    return language.predict_languages(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op3_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of all documents without strings of 400 bytes that repeat."""
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents in packed files, as read back."""
    path = shared_path(spark, "tokens")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path(TOKENIZER), END_ID)
    return token_files.read_token_files(spark, path)


@query
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


ORACLES["op5_exact_dedup"] = r"""
    SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = min(doc_id) OVER same AS kept, sha256(t) AS text_sha256
    FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
    WINDOW same AS (PARTITION BY t)"""


@query
def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return html_text.extract_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@query
def op7_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents under a model learned from six sevenths of them."""
    return katz.katz_scores(table(spark, sf_dir, "documents"), fold("doc_id", 7, 2))


@query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


@query
def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mix of one and a half times all words."""
    mix = mixing.mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return mix.select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


#: Host, path, verdict.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


@query
def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the addresses of all pages."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


ORACLES["op11_url_filter"] = r"""
    WITH RECURSIVE rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
           ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
         links AS (SELECT url AS a, unnest(regexp_extract_all(html,
               '(?i)<link\s[^<>]*rel="?canonical"?\s[^<>]*href="([a-z]+://[^"]*)"', 1)) AS b FROM pages),
         edges AS (SELECT split_part(a, '#', 1) AS a, split_part(b, '#', 1) AS b FROM links
                   UNION SELECT split_part(b, '#', 1), split_part(a, '#', 1) FROM links),
         urls AS (SELECT url AS u FROM pages UNION SELECT b FROM links),
         parts AS (SELECT u, CASE WHEN contains(u, '://') THEN translate(regexp_extract(u, '^.*?://([^/?#]*)', 1, 's'),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
                   CASE WHEN contains(u, '://') THEN regexp_extract(u, '^.*?://[^/?#]*([^?#]*)', 1, 's') ELSE '' END AS path FROM urls),
         judged AS (SELECT u, host, path, arg_min(h || p, -length(h || p)) AS rule, arg_min(v, -length(h || p)) AS v
                    FROM parts LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY u, host, path),
         bad(u) AS (SELECT split_part(u, '#', 1) FROM judged WHERE v = 'block' UNION SELECT b FROM bad JOIN edges ON a = u)
    SELECT page_id, host, path, rule, coalesce(v, CASE WHEN split_part(url, '#', 1) IN (SELECT u FROM bad) THEN 'block' ELSE 'allow' END) AS verdict
    FROM pages LEFT JOIN judged ON url = u"""


def misspelled(id_: Column, word: Column) -> Column:
    """The word, or now and then (by a hash of id and word) the word without one of its letters."""
    h = F.crc32(F.concat(id_.cast("string"), F.lit(":"), word).cast("binary"))
    at = (h % F.length(word)).cast("int")
    return F.when(h % 199 == 0, F.concat(F.left(word, at), F.substr(word, at + 2))).otherwise(word)


@query
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants of the words of all documents."""
    return spelling.group_variants(spelling.word_counts(table(spark, sf_dir, "documents"), edit=misspelled))


ORACLES["op12_spelling"] = r"""
    WITH RECURSIVE crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)),
             lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
         runs AS (SELECT doc_id, w, count(*) AS k FROM (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents) WHERE length(w) >= 6 GROUP BY ALL),
         hashed AS (SELECT w, k, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(doc_id || ':' || w, ''),
             lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [(192 | (unicode(x) >> 6))::BIGINT, (128 | (unicode(x) & 63))::BIGINT] END))),
             lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h FROM runs, crc),
         words AS (SELECT w, sum(k)::BIGINT AS n FROM (SELECT k, CASE WHEN h % 199 = 0 THEN w[:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS w
             FROM hashed) WHERE length(w) >= 6 GROUP BY w HAVING sum(k) >= 5),
         gaps AS (SELECT DISTINCT w, n, w[:i] || w[i + 2:] AS d, w[:i] || '*' || w[i + 2:] AS s
             FROM (SELECT w, n, unnest(range(length(w))) AS i FROM words)),
         near AS (SELECT a.w AS a, a.n AS an, b.w AS b, b.n AS bn FROM gaps a JOIN gaps b ON a.s = b.s AND a.w <> b.w
             UNION SELECT g.w, g.n, x.w, x.n FROM gaps g JOIN words x ON g.d = x.w
             UNION SELECT x.w, x.n, g.w, g.n FROM gaps g JOIN words x ON g.d = x.w),
         best AS (SELECT a, an, count(*) AS n_near, max(bn) AS m, first(b ORDER BY bn DESC, b) AS b FROM near GROUP BY a, an),
         forms AS (SELECT w, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * n THEN b END AS form, CASE WHEN m >= 5 * n THEN m END AS form_n
             FROM words LEFT JOIN best ON w = a),
         walk AS (SELECT w, w AS at, form AS nxt FROM forms UNION ALL SELECT k.w, f.w, f.form FROM walk k JOIN forms f ON f.w = k.nxt)
    SELECT f.w AS word, f.form, k.at AS root, n, n_near, form_n FROM forms f JOIN walk k ON k.w = f.w AND k.nxt IS NULL"""


def repeated_tails(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: in a tenth of the documents, by a hash of the id, a stretch of words repeats to the end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    chosen = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("words")).withColumn("n", F.size("words"))
    g = F.floor(F.col("h") / 10)
    a = (g % F.when(F.col("n") > 0, F.col("n"))).cast("int")
    rest = F.col("n") - a
    p = (1 + F.floor(rest / (3 + g % 8))).cast("int")
    tail = F.flatten(F.array_repeat(F.slice("words", a + 1, p), F.ceil(rest / p).cast("int")))
    text = F.array_join(F.concat(F.slice("words", F.lit(1), a), F.slice(tail, F.lit(1), rest)), " ")
    return chosen.select("doc_id", F.when(F.col("n") > 0, text).otherwise(F.col("text")).alias("text"))


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words of all documents, and what is left without their repetitions."""
    out = periodic_runs.periodic_runs(repeated_tails(table(spark, sf_dir, "documents")))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("m"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    out = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("r"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length = -F.col("r.m")
    milli = F.expr("(-r.m * 1000) div r.period")
    return out.select("doc_id", "n_runs", F.col("r.start").alias("start"), length.alias("length"), F.col("r.period").alias("period"), milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
