"""Queries on lines, links, leaks and references."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusaudit import schemas
from corpusaudit.functions import paths
from corpusaudit.functions import text as tx
from corpusaudit.operators import chunks, citations, endpoints, leakage, lines, links, literals, tables
from corpusaudit.operators.leakage import LeakRule, TermRule
from corpusaudit.plans import inputs as i
from corpusaudit.plans.registry import ORACLES, fences_sql, lines_sql, prose_sql, query, table
from corpusaudit.session import spread

DOCS = i.DOCUMENTS.sql()
ORDERS = i.ORDER_PAGES.sql()


@query("q_lines", f"SELECT corpus, path, line_no, CAST(length(line) AS INTEGER) AS chars FROM ({lines_sql(DOCS)})")
def q_lines(spark, sf):
    return lines.explode_lines(i.DOCUMENTS.df(spark, sf)).select("corpus", "path", "line_no", F.length("line").alias("chars"))


@query(
    "q_fences",
    f"""SELECT corpus, path, line_no, is_marker, seen % 2 = 1 AND NOT is_marker AS in_fence,
          CASE WHEN is_marker OR seen % 2 = 1 THEN CAST((seen + 1) // 2 AS INTEGER) END AS fence_no
        FROM ({fences_sql(ORDERS)})""",
)
def q_fences(spark, sf):
    return lines.explode_fenced_lines(i.ORDER_PAGES.df(spark, sf)).drop("line")


CHUNKED = f"SELECT corpus, path, string_agg(content, '' ORDER BY block, seq) AS content FROM ({i.ORDER_CHUNKS.sql()}) GROUP BY corpus, path"


@query(
    "q_chunk_fences",
    f"""SELECT corpus, path, CAST(line_no AS BIGINT) AS line_no, line, is_marker, seen % 2 = 1 AND NOT is_marker AS in_fence,
          CASE WHEN is_marker OR seen % 2 = 1 THEN CAST((seen + 1) // 2 AS BIGINT) END AS fence_no
        FROM ({fences_sql(CHUNKED)})""",
)
def q_chunk_fences(spark, sf):
    """Fences of documents that come in chunks; most of them are open at the end of a chunk."""
    return chunks.fenced_lines(i.ORDER_CHUNKS.df(spark, sf))


@query(
    "q_chunk_tables",
    f"""WITH l AS (SELECT *, contains(line, 'テーブル名') AS h, contains(line, 'テーブル名') OR NOT starts_with(trim(line), '|') AS b FROM ({lines_sql(CHUNKED)})),
          g AS (SELECT *, sum(CASE WHEN b THEN 1 ELSE 0 END) OVER (PARTITION BY corpus, path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM l)
        SELECT corpus, path, line AS "row" FROM g JOIN (SELECT corpus, path, run FROM g WHERE h) USING (corpus, path, run) WHERE NOT b AND line <> '|--|--|'""",
)
def q_chunk_tables(spark, sf):
    """Table rows below a header that stands in another chunk."""
    found = chunks.table_rows_of(i.ORDER_CHUNKS.df(spark, sf), lambda l: F.contains(l, F.lit("テーブル名")))
    return found.select("corpus", "path", F.concat(F.lit("| "), F.get("cells", F.lit(1)), F.lit(" | "), F.get("cells", F.lit(2)), F.lit(" |")).alias("row"))


HEADING_SQL = "regexp_matches(line, '^#{1,3}\\s+')"


@query(
    "q_sections",
    f"""WITH l AS ({fences_sql(ORDERS)}),
        n AS (SELECT *, sum(CASE WHEN h THEN 1 ELSE 0 END) OVER (PARTITION BY corpus, path ORDER BY line_no
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section_no
              FROM (SELECT *, {HEADING_SQL} AND NOT is_marker AND seen % 2 = 0 AS h FROM l))
        SELECT corpus, path, CAST(section_no AS INTEGER) AS section_no,
          CAST(max(CASE WHEN h THEN length(regexp_extract(line, '^(#+)', 1)) END) AS INTEGER) AS level,
          max(CASE WHEN h THEN trim(regexp_extract(line, '^#+\\s+(.*)$', 1)) END) AS heading,
          min(line_no) AS first_line,
          coalesce(string_agg(CASE WHEN NOT h THEN line END, chr(10) ORDER BY line_no), '') AS body
        FROM n GROUP BY corpus, path, section_no""",
)
def q_sections(spark, sf):
    return lines.sections(i.ORDER_PAGES.df(spark, sf), 1, 3)


@query(
    "q_headings",
    f"""SELECT corpus, path, line_no, CAST(length(regexp_extract(line, '^(#+)', 1)) AS INTEGER) AS level,
          trim(regexp_extract(line, '^#+\\s+(.*)$', 1)) AS heading,
          regexp_replace(regexp_replace(regexp_replace(lower(trim(regexp_extract(line, '^#+\\s+(.*)$', 1))),
            '[^\\p{{L}}\\p{{N}}_\\s-]', '', 'g'), '\\s+', '-', 'g'), '-+', '-', 'g') AS slug
        FROM ({prose_sql(ORDERS)}) WHERE regexp_matches(line, '^#{{1,6}}\\s+.')""",
)
def q_headings(spark, sf):
    return lines.headings(i.ORDER_PAGES.df(spark, sf))


# ------------------------------------------------------------------------------------------- links

LINK_RE = "!?\\[([^\\]]*)\\]\\(([^)]+)\\)"


@query(
    "q_md_links",
    f"""SELECT corpus, path, line_no, CAST(k AS INTEGER) AS link_no, regexp_extract(raw[k], '{LINK_RE}', 1) AS text,
          regexp_extract(raw[k], '{LINK_RE}', 2) AS url, raw[k][1] = '!' AS is_image
        FROM (SELECT *, unnest(generate_series(1, len(raw))) AS k FROM (
          SELECT corpus, path, line_no, regexp_extract_all(line, '{LINK_RE}', 0) AS raw FROM ({lines_sql(ORDERS)})))""",
)
def q_md_links(spark, sf):
    return links.markdown_links(i.ORDER_PAGES.df(spark, sf))


@query(
    "q_broken_links",
    """WITH o AS (SELECT *, concat('orders/', o_orderkey, '.md') AS path FROM orders)
       SELECT 'shop' AS corpus, path, CAST(5 AS INTEGER) AS line_no, concat(o_orderkey + 1, '.md') AS url, 'file not found' AS reason,
         concat('orders/', o_orderkey + 1, '.md') AS target_path
       FROM o WHERE NOT EXISTS (SELECT 1 FROM orders n WHERE n.o_orderkey = o.o_orderkey + 1)
       UNION ALL
       SELECT 'shop', path, 4, concat('../img/', lower(o_orderpriority), '.svg'), 'file not found', concat('img/', lower(o_orderpriority), '.svg')
       FROM o WHERE o_orderstatus = 'P'
       UNION ALL
       SELECT 'shop', path, 4, concat('../customers/', o_custkey, '.md#open-balance'),
         CASE WHEN c_custkey IS NULL THEN 'file not found' ELSE 'anchor not found' END, concat('customers/', o_custkey, '.md')
       FROM o LEFT JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'P'
       UNION ALL
       SELECT 'shop', path, 3, concat('../customers/', o_custkey, '.md#customer-', o_custkey), 'file not found', concat('customers/', o_custkey, '.md')
       FROM o WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)""",
)
def q_broken_links(spark, sf):
    files = i.ORDER_PAGES.df(spark, sf).unionByName(i.CUSTOMER_PAGES.df(spark, sf))
    return links.check_links(files, skip_fences=True).drop("anchor")


@query(
    "q_recheck",
    """WITH c AS (SELECT * FROM customer WHERE c_custkey % 5 <> 0),
            o AS (SELECT *, concat('orders/', o_orderkey, '.md') AS path, c_custkey FROM orders LEFT JOIN c ON c_custkey = o_custkey)
       SELECT 'shop' AS corpus, path, CAST(5 AS INTEGER) AS line_no, concat(o_orderkey + 1, '.md') AS url, 'file not found' AS reason,
         concat('orders/', o_orderkey + 1, '.md') AS target_path
       FROM o WHERE o_orderkey % 11 <> 0 AND NOT EXISTS (SELECT 1 FROM orders n WHERE n.o_orderkey = o.o_orderkey + 1)
       UNION ALL
       SELECT 'shop', path, 4, concat('../img/', lower(o_orderpriority), '.svg'), 'file not found', concat('img/', lower(o_orderpriority), '.svg')
       FROM o WHERE o_orderstatus = 'P' AND o_orderkey % 11 <> 0
       UNION ALL
       SELECT 'shop', path, 4, concat('../customers/', o_custkey, '.md#open-balance'),
         CASE WHEN c_custkey IS NULL THEN 'file not found' ELSE 'anchor not found' END, concat('customers/', o_custkey, '.md')
       FROM o WHERE o_orderstatus = 'P' AND o_orderkey % 11 <> 0
       UNION ALL
       SELECT 'shop', path, 3, concat('../customers/', o_custkey, '.md#customer-', o_custkey),
         CASE WHEN c_custkey IS NULL THEN 'file not found' ELSE 'anchor not found' END, concat('customers/', o_custkey, '.md')
       FROM o WHERE o_orderkey % 11 <> 0 AND (c_custkey IS NULL OR c_custkey % 7 = 1)
       UNION ALL
       SELECT 'shop', path, 1, concat('../customers/', o_custkey, '.md'), 'file not found', concat('customers/', o_custkey, '.md')
       FROM o WHERE o_orderkey % 11 = 0 AND c_custkey IS NULL""",
)
def q_recheck(spark, sf):
    """Pages as a stream: orders arrive after the customers they link to; then some customers go, some lose the
    heading that is linked to, and some orders are written anew. Only what that touches is checked again."""
    from uuid import uuid4

    from corpusaudit.session import checkpoint_dir
    from corpusaudit.streaming import incremental, link_index

    base = f"{checkpoint_dir(spark)}/recheck-{uuid4().hex}"
    pages = lambda df: df.select("corpus", "path", "content", F.octet_length("content").cast("long").alias("size"), F.lit(None).cast("timestamp").alias("modified_at"))
    later = lambda df, path, content: df.select(
        F.lit("shop").alias("corpus"), F.expr(path).alias("path"), F.expr(content).alias("content"),
        F.expr(f"CAST(octet_length({content}) AS BIGINT)").alias("size"), F.expr("TIMESTAMP '2020-01-01 00:00:00'").alias("modified_at"),
    )
    customers = table(spark, sf, "customer").where("c_custkey % 5 = 0 OR c_custkey % 7 = 1")
    changed = later(customers, "concat('customers/', c_custkey, '.md')", "CASE WHEN c_custkey % 5 <> 0 THEN '# Client' END")
    rewritten = later(table(spark, sf, "orders").where("o_orderkey % 11 = 0"), "concat('orders/', o_orderkey, '.md')", "concat('[x](../customers/', o_custkey, '.md)')")
    for rows in (pages(i.CUSTOMER_PAGES.df(spark, sf)), pages(i.ORDER_PAGES.df(spark, sf)), changed.unionByName(rewritten)):
        rows.write.mode("append").option("compression", "zstd").parquet(f"{base}/files")
        stream = incremental.stream_files(spark, f"{base}/files", 1_000_000)
        link_index.start_link_check(stream, f"{base}/index", f"{base}/checkpoint", skip_fences=True).awaitTermination()
    return link_index.LinkIndex(spark, f"{base}/index").broken().drop("anchor")


@query(
    "q_html_links",
    """SELECT page_id, CAST(k AS INTEGER) AS link_no, urls[k] AS url FROM (
         SELECT page_id, urls, unnest(generate_series(1, len(urls))) AS k FROM (
           SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS urls FROM pages))""",
)
def q_html_links(spark, sf):
    return links.html_links(table(spark, sf, "pages").select("page_id", "html"))


@query(
    "q_broken_page_links",
    """WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS corpus,
               trim(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/') AS at,
               regexp_extract_all(html, 'href="([^"]*)"', 1) AS urls FROM pages),
         l AS (SELECT page_id, corpus, k, urls[k] AS url FROM (SELECT *, unnest(generate_series(1, len(urls))) AS k FROM p))
       SELECT page_id, corpus, CAST(k AS INTEGER) AS link_no, url, target_path FROM (
         SELECT *, trim(regexp_extract(url, '^([^?#]*)', 1), '/') AS target_path FROM l
         WHERE NOT regexp_matches(url, '^(https?://|mailto:|ftp://)')) t
       WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.corpus = t.corpus AND p.at = t.target_path)
       UNION ALL SELECT -1 - page_id, 'own.example', 1, concat('p', page_id + 7, '.html#x'), concat('d', page_id % 7, '/p', page_id + 7, '.html') FROM pages
       WHERE page_id + 7 NOT IN (SELECT page_id FROM pages)
       UNION ALL SELECT -1 - page_id, 'own.example', 3, '../gone', 'gone' FROM pages""",
)
def q_broken_page_links(spark, sf):
    """The given pages, and as many of one site that link to each other, to themselves and to nothing."""
    pages = table(spark, sf, "pages").select("page_id", "url", "html")
    own = pages.selectExpr(
        "-1 - page_id AS page_id",
        "concat('https://own.example/d', page_id % 7, '/p', page_id, '.html') AS url",
        """concat('<a href="p', page_id + 7, '.html#x">n</a> <a href="/d', page_id % 7, '/p', page_id, '.html?q">s</a> <a href="../gone">g</a> <a href="#y">y</a>') AS html""",
    )
    out = links.broken_page_links(pages.unionByName(own))
    return out.select("page_id", "corpus", "link_no", "url", "target_path")


IMAGE_SQL = i.IMAGES.sql()
PAGE_SQL = f"{i.FEATURE_PAGES.sql()} UNION ALL {i.NATION_PAGES.sql()}"


@query(
    "q_reverse_links",
    f"""WITH im AS (SELECT DISTINCT corpus, regexp_extract(path, '[^/]*$') AS image FROM ({IMAGE_SQL})),
        pg AS ({PAGE_SQL}),
        rl AS (SELECT 1 AS rank, '^(.+)-er-\\w+\\.svg$' AS re, ['05-data-model.md'] AS keys
               UNION ALL SELECT 2, '^(.+)-feat-\\w+\\.svg$', ['features/', '03-features.md']
               UNION ALL SELECT 3, '^(.+)-seq-\\w+\\.svg$', ['07-walkthrough.md']),
        ex AS (SELECT corpus, image, arg_min(re, rank) AS re, arg_min(keys, rank) AS keys FROM im, rl WHERE regexp_matches(image, re) GROUP BY ALL),
        ck AS (SELECT corpus, image, concat('manual/', regexp_extract(image, re, 1), '/', unnest(keys)) AS prefix FROM ex),
        jn AS (SELECT ck.corpus, ck.image, ck.prefix, contains(pg.content, ck.image) AS shown
               FROM ck JOIN pg ON pg.corpus = ck.corpus AND (pg.path = prefix OR (ends_with(prefix, '/') AND starts_with(pg.path, prefix))))
        SELECT corpus, image, string_agg(DISTINCT CASE WHEN ends_with(prefix, '/') THEN concat(prefix, '*.md') ELSE prefix END, ',') AS expected
        FROM jn GROUP BY corpus, image HAVING NOT bool_or(shown)""",
)
def q_reverse_links(spark, sf):
    both = i.IMAGES.df(spark, sf).unionByName(i.FEATURE_PAGES.df(spark, sf)).unionByName(i.NATION_PAGES.df(spark, sf))
    return links.unreferenced_images(both)


@query(
    "q_index_links",
    """SELECT concat('n', n_nationkey) AS corpus, 'index.md' AS path, CAST(2 AS INTEGER) AS line_no, concat('m/', n_regionkey, '.md#x') AS url,
         concat('m/', n_regionkey, '.md') AS target_path
       FROM nation n WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n.n_nationkey AND s_suppkey = n.n_regionkey)""",
)
def q_index_links(spark, sf):
    index = table(spark, sf, "nation").selectExpr(
        "concat('n', n_nationkey) AS corpus", "'index.md' AS path", "concat('# T', chr(10), '[a](m/', n_regionkey, '.md#x) [m](mailto:q) [b](#y)') AS content"
    )
    pages = table(spark, sf, "supplier").selectExpr("concat('n', s_nationkey) AS corpus", "concat('m/', s_suppkey, '.md') AS path", "'' AS content")
    return links.check_index_links(index.unionByName(pages))


# ------------------------------------------------------------------------------------------- leaks

RULES = [
    LeakRule("card", "[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}", "CRITICAL", "card number"),
    LeakRule("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "HIGH", "mail address"),
    LeakRule("ipv4", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "MEDIUM", "network address", allow_in=("fr/", "es/")),
    LeakRule("license", "[Ll]icen[sc]ed? under [^.]*", "LOW", "license line"),
    LeakRule("token", 'token = "[^"]+"', "CRITICAL", "secret"),
]
ALLOW = {"ipv4": "AND NOT regexp_matches(path, '^(fr|es)/')"}
LEAK_SQL = " UNION ALL ".join(
    f"""SELECT 'leak' AS "check", corpus, path, line_no, '{r.name}' AS rule, '{r.severity}' AS severity,
          regexp_extract(line, '{r.regex}') AS matched, '{r.description}' AS message
        FROM l WHERE regexp_matches(line, '{r.regex}') {ALLOW.get(r.name, '')}"""
    for r in RULES
)
LEAKS = f"WITH l AS ({lines_sql(DOCS)}) {LEAK_SQL}"


@query("q_leak_findings", LEAKS)
def q_leak_findings(spark, sf):
    """Lines of all documents against the leak rules."""
    return leakage.scan(i.DOCUMENTS.df(spark, sf), RULES)


@query(
    "q_leak_gate",
    f"""SELECT corpus, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high,
          count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) AS total, count(*) FILTER (severity IN ('CRITICAL', 'HIGH')) > 0 AS blocked
        FROM ({LEAKS}) GROUP BY corpus""",
)
def q_leak_gate(spark, sf):
    return leakage.gate(leakage.scan(i.DOCUMENTS.df(spark, sf), RULES))


@query("q_leak_severity", f"SELECT corpus, severity, count(*) AS findings FROM ({LEAKS}) GROUP BY corpus, severity")
def q_leak_severity(spark, sf):
    return leakage.severity_counts(leakage.scan(i.DOCUMENTS.df(spark, sf), RULES))


@query("q_stream_leaks", LEAKS)
def q_stream_leaks(spark, sf):
    """The same scan as a stream over the documents, read back from its sink in the shared folder."""
    from uuid import uuid4

    from corpusaudit.session import checkpoint_dir
    from corpusaudit.streaming.incremental import start_leak_scan

    base = f"{checkpoint_dir(spark)}/stream-{uuid4().hex}"
    schema = table(spark, sf, "documents").schema
    # a glob matches the table both as one file and as a folder of files
    rows = spark.readStream.schema(schema).parquet(f"{sf}/documents.parque[t]")
    files = rows.selectExpr(*[f"{e} AS {c}" for c, e in i.DOCUMENTS.columns.items()])
    found = leakage.scan(i.DOCUMENTS.df(spark, sf), RULES).schema
    start_leak_scan(files, RULES, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.schema(found).parquet(f"{base}/out")


@query("q_stored_findings", LEAKS)
def q_stored_findings(spark, sf):
    """Findings written to a folder per check in the shared folder, as read back."""
    from uuid import uuid4

    from corpusaudit.session import checkpoint_dir
    from corpusaudit.sources import sinks

    found = leakage.scan(i.DOCUMENTS.df(spark, sf), RULES)
    path = f"{checkpoint_dir(spark)}/findings-{uuid4().hex}"
    sinks.write_findings(found, path)
    return spark.read.schema(found.schema).parquet(path).select(found.columns)


@query(
    "q_name_findings",
    f"""SELECT 'leak' AS "check", corpus, path, line_no, concat('project-name:', n) AS rule, 'CRITICAL' AS severity, n AS matched, 'name of an analysed project' AS message
        FROM ({lines_sql(DOCS)}) JOIN (SELECT DISTINCT lower(regexp_extract(url, '://([^/.:]+)', 1)) AS n FROM pages) ON contains(lower(line), n)
        WHERE n <> '' AND NOT regexp_matches(path, '^de/')""",
)
def q_name_findings(spark, sf):
    """Site names of the pages in the lines of documents; the German folder may name them."""
    names = table(spark, sf, "pages").select(F.regexp_extract("url", "://([^/.:]+)", 1).alias("name"))
    return leakage.name_findings(i.DOCUMENTS.df(spark, sf), names, ["de/"])


def _json_lines(spark, df, name):
    """A configuration file in the shared folder: one object a line, written by as many tasks as the rows have."""
    from uuid import uuid4

    from corpusaudit.session import checkpoint_dir

    folder = f"{checkpoint_dir(spark)}/{name}-{uuid4().hex}"
    df.write.json(folder)
    return folder


RULE_LANGS = "SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL"


@query(
    "q_rule_files",
    f"""SELECT 'term' AS "check", corpus, path, line_no, 'error' AS severity, concat(lang, 't') AS matched, lang AS expected, 'ending' AS message
        FROM ({prose_sql(DOCS)}) JOIN ({RULE_LANGS}) ON contains(line, concat(lang, 't'))""",
)
def q_rule_files(spark, sf):
    """Terms of a rule file, written from the languages of the documents, in whole documents."""
    from corpusaudit.sources.files import read_term_rules

    langs = table(spark, sf, "documents").where("lang IS NOT NULL").select("lang").distinct()
    path = _json_lines(spark, langs.selectExpr("concat(lang, 't') AS wrong", "lang AS correct", "'ending' AS context", "false AS in_code"), "terms")
    return leakage.wrong_terms(i.DOCUMENTS.df(spark, sf), read_term_rules(spark, path, lines=True))


@query(
    "q_leak_rule_files",
    f"""SELECT 'leak' AS "check", corpus, path, line_no, concat('r-', lang) AS rule, 'HIGH' AS severity, regexp_extract(line, concat(lang, '[a-z]+[.]')) AS matched, 'end' AS message
        FROM ({lines_sql(DOCS)}) JOIN ({RULE_LANGS}) ON regexp_matches(line, concat(lang, '[a-z]+[.]')) WHERE NOT starts_with(path, 'fr/')""",
)
def q_leak_rule_files(spark, sf):
    """Leak rules of a rule file in whole documents; the French folder is allowed to break them."""
    from corpusaudit.sources.files import read_leak_rules

    langs = table(spark, sf, "documents").where("lang IS NOT NULL").select("lang").distinct()
    rules = langs.selectExpr("concat('r-', lang) AS name", "concat(lang, '[a-z]+[.]') AS regex", "'HIGH' AS severity", "'end' AS description", "array('fr/') AS allow_in")
    return leakage.scan(i.DOCUMENTS.df(spark, sf), read_leak_rules(spark, _json_lines(spark, rules, "leaks"), lines=True))


@query(
    "q_impact_rule_files",
    """SELECT 'shop' AS corpus, concat('src/n', s_nationkey, '/s', s_suppkey, '.py') AS path, concat('nation-', lower(n_name), '.md') AS doc FROM supplier JOIN nation ON n_nationkey = s_nationkey""",
)
def q_impact_rule_files(spark, sf):
    """Documents that depend on the files of suppliers, by the rules of a file: one for each nation."""
    from corpusaudit.operators import impact
    from corpusaudit.sources.files import read_impact_rules

    rules = table(spark, sf, "nation").selectExpr("concat('src/n', n_nationkey, '/*.py') AS source_pattern", "array(concat('nation-', lower(n_name), '.md')) AS docs")
    changed = table(spark, sf, "supplier").selectExpr("'shop' AS corpus", "concat('src/n', s_nationkey, '/s', s_suppkey, '.py') AS path")
    return impact.affected_documents(changed, read_impact_rules(spark, _json_lines(spark, rules, "impact"), lines=True)).drop("rule_no")


@query(
    "q_routes_file",
    "SELECT concat('/s/', s_suppkey) AS path, s_name AS name, s_acctbal < 0 AS auth_required FROM supplier WHERE s_acctbal >= 0",
)
def q_routes_file(spark, sf):
    """Routes of route lists, written from the suppliers, that need no login."""
    from corpusaudit.sources.files import read_routes

    routes = table(spark, sf, "supplier").selectExpr("concat('/s/', s_suppkey) AS path", "s_name AS name", "s_acctbal < 0 AS auth_required")
    return endpoints.filter_routes(read_routes(spark, _json_lines(spark, routes, "routes"), lines=True), False)


@query(
    "q_allowed_urls",
    """SELECT page_id, url, page_id % 8 IN (0, 1, 2) AND regexp_matches(url, '^https?://') AS allowed FROM (
         SELECT page_id, CASE page_id % 8 WHEN 3 THEN replace(replace(url, 'https:', 'ftp:'), 'http:', 'ftp:') WHEN 4 THEN 'http://169.254.169.254/latest'
           WHEN 5 THEN 'https://metadata.google.internal/x?y' WHEN 6 THEN concat('javascript:', url) WHEN 7 THEN NULL ELSE url END AS url FROM pages)""",
)
def q_allowed_urls(spark, sf):
    """Addresses of pages, of which five in eight have a blocked host or scheme, or are none."""
    url = """CASE page_id % 8 WHEN 3 THEN replace(replace(url, 'https:', 'ftp:'), 'http:', 'ftp:') WHEN 4 THEN 'http://169.254.169.254/latest'
           WHEN 5 THEN 'https://metadata.google.internal/x?y' WHEN 6 THEN concat('javascript:', url) WHEN 7 THEN NULL ELSE url END AS url"""
    return table(spark, sf, "pages").selectExpr("page_id", url).select("page_id", "url", endpoints.is_allowed_url(F.col("url")).alias("allowed"))


MODEL_FILES = i.files_of(
    "part",
    "p_brand",
    "CASE p_size % 3 WHEN 0 THEN concat('app/Models/M', CAST(p_partkey AS STRING), '.php') WHEN 1 THEN 'prisma/schema.prisma' ELSE concat('app/Other/M', CAST(p_partkey AS STRING), '.php') END",
    """CASE p_size % 3 WHEN 1 THEN concat('model M', CAST(p_partkey AS STRING), ' {', chr(10), '  @@map("t', CAST(p_partkey AS STRING), '")', chr(10), '}')
       ELSE concat('protected $table = ', chr(39), 'm_', CAST(p_partkey AS STRING), chr(39), ';', chr(10), '$table = "second";') END""",
)


@query(
    "q_model_tables",
    """SELECT DISTINCT p_brand AS corpus, unnest(CASE p_size % 3 WHEN 0 THEN [concat('m_', p_partkey)] ELSE [concat('M', p_partkey), concat('t', p_partkey)] END) AS table_name
       FROM part WHERE p_size % 3 < 2""",
)
def q_model_tables(spark, sf):
    """Tables that models name, the first name of each, and those of Prisma schemas."""
    return tables.declared_tables(MODEL_FILES.df(spark, sf))


@query("q_benchmark_leak", "SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def q_benchmark_leak(spark, sf):
    """Documents that hold a whole passage of the benchmark."""
    docs = spread(table(spark, sf, "documents")).select("doc_id", F.col("text").alias("content"))
    items = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("needle"))
    hits = literals.find_literals(docs, items.select("needle"), ["doc_id"])
    # equal passages are one literal; the identifiers come back at the end
    return hits.join(items, "needle").select("doc_id", "item_id")


@query(
    "q_name_leaks",
    """SELECT doc_id, concat('project-name:', n) AS rule, 'CRITICAL' AS severity
       FROM documents d JOIN (SELECT DISTINCT lower(regexp_extract(url, '://([^/.:]+)', 1)) AS n FROM pages) ON contains(lower(d.text), n)
       WHERE n <> ''""",
)
def q_name_leaks(spark, sf):
    """Site names of the pages inside documents, without regard to case."""
    docs = spread(table(spark, sf, "documents")).select("doc_id", F.col("text").alias("content"))
    names = table(spark, sf, "pages").select(F.regexp_extract("url", "://([^/.:]+)", 1).alias("name"))
    return literals.name_leaks(docs, names, ["doc_id"])


TERMS = [TermRule("recieve", "receive", "typo"), TermRule("Seting", "Setting", "typo"), TermRule("queque", "que", "repeat", True), TermRule("thth", "th", "repeat")]
TERM_SQL = " UNION ALL ".join(
    f"""SELECT 'term' AS "check", corpus, path, line_no, '{"info" if t.in_code else "error"}' AS severity, '{t.wrong}' AS matched,
          '{t.correct}' AS expected, '{t.context}' AS message FROM p WHERE contains(line, '{t.wrong}')"""
    for t in TERMS
)
TERM_ALL = f"WITH p AS ({prose_sql('SELECT corpus, path, content FROM (' + DOCS + ') UNION ALL ' + ORDERS)}) {TERM_SQL}"


#: Every word of eight letters or more in a page is a term; lines meet them by their first eight characters.
MANY_TERMS = f"""
  WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(html, '[a-z]{{8,}}')) AS w FROM pages),
       l AS ({prose_sql(DOCS)}),
       g AS (SELECT corpus, path, line_no, line, unnest(generate_series(1, length(line) - 7)) AS k FROM l),
       h AS (SELECT DISTINCT corpus, path, line_no, line, w FROM g JOIN t ON substring(line, k, 8) = left(w, 8) AND starts_with(substring(line, k), w))"""


@query(
    "q_many_terms",
    f"""{MANY_TERMS} SELECT 'term' AS "check", corpus, path, line_no, CASE WHEN length(w) % 2 = 0 THEN 'info' ELSE 'error' END AS severity,
          w AS matched, upper(w) AS expected, 'page' AS message FROM h""",
)
def q_many_terms(spark, sf):
    """More than ten thousand terms in the lines of documents, in one pass."""
    rules = _page_words(spark, sf).selectExpr("w AS wrong", "upper(w) AS correct", "'page' AS context", "length(w) % 2 = 0 AS in_code")
    return leakage.wrong_terms_of(i.DOCUMENTS.df(spark, sf), rules)


@query(
    "q_many_leak_rules",
    f"""{MANY_TERMS.replace(prose_sql(DOCS), lines_sql(DOCS))},
          r AS (SELECT *, regexp_extract(line, concat(w, '[a-z]*[,.]')) AS m FROM h)
        SELECT 'leak' AS "check", corpus, path, line_no, concat('r-', w) AS rule, CASE WHEN length(w) % 2 = 0 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
          CASE WHEN length(w) % 2 = 0 THEN m ELSE w END AS matched, 'word of a page' AS message
        FROM r WHERE length(w) % 2 = 1 OR m <> ''""",
)
def q_many_leak_rules(spark, sf):
    """As many leak rules, half of them with a regex that decides where their literal is found."""
    rules = _page_words(spark, sf).selectExpr(
        "concat('r-', w) AS name", "w AS literal", "CASE WHEN length(w) % 2 = 0 THEN concat(w, '[a-z]*[,.]') END AS regex",
        "CASE WHEN length(w) % 2 = 0 THEN 'HIGH' ELSE 'MEDIUM' END AS severity", "'word of a page' AS description",
    )
    return leakage.scan_many(i.DOCUMENTS.df(spark, sf), rules)


def _page_words(spark, sf):
    words = F.regexp_extract_all("html", F.lit("[a-z]{8,}"), F.lit(0))
    return table(spark, sf, "pages").select(F.explode_outer(words).alias("w")).where(F.col("w").isNotNull()).distinct()


@query("q_terms", TERM_ALL)
def q_terms(spark, sf):
    both = i.DOCUMENTS.df(spark, sf).select("corpus", "path", "content").unionByName(i.ORDER_PAGES.df(spark, sf))
    return leakage.wrong_terms(both, TERMS)


@query(
    "q_term_gate",
    f"""SELECT corpus, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'info') AS infos,
          count(*) FILTER (severity = 'error') > 0 AS blocked FROM ({TERM_ALL}) GROUP BY corpus""",
)
def q_term_gate(spark, sf):
    both = i.DOCUMENTS.df(spark, sf).select("corpus", "path", "content").unionByName(i.ORDER_PAGES.df(spark, sf))
    return leakage.term_gate(leakage.wrong_terms(both, TERMS))


# -------------------------------------------------------------------------------- verified references

CITE_SQL = """
  WITH c AS (SELECT DISTINCT l_returnflag AS corpus, concat('src/part_', l_partkey, '.py') AS cited_path,
               concat(l_linenumber, '-', CAST(l_quantity AS BIGINT)) AS line_spec, CAST(l_quantity AS BIGINT) AS last FROM lineitem
             UNION SELECT l_returnflag, concat('src/part_', l_suppkey, '.py'), concat(l_linenumber), l_linenumber FROM lineitem),
       f AS (SELECT CASE WHEN p_type = 'PROMO' THEN 'A' ELSE 'N' END AS corpus, concat('src/part_', p_partkey, '.py') AS cited_path, p_size + 1 AS n FROM part)
  SELECT 'citation' AS "check", corpus, CASE WHEN n IS NULL THEN 'FAIL' WHEN last > n THEN 'WARN' ELSE 'OK' END AS status,
    concat(cited_path, ':', line_spec) AS label,
    CASE WHEN n IS NULL THEN 'file does not exist' WHEN last > n THEN concat('line out of range, last is ', n) ELSE '' END AS message
  FROM c LEFT JOIN f USING (corpus, cited_path)"""


@query("q_citations", CITE_SQL)
def q_citations(spark, sf):
    cited = citations.citations(i.CITING_PAGES.df(spark, sf))
    return citations.verify_citations(cited, citations.file_lengths(i.PART_SOURCES.df(spark, sf)))


@query(
    "q_verdict_totals",
    f"""SELECT corpus, "check", count(*) FILTER (status = 'OK') AS ok, count(*) FILTER (status = 'FAIL') AS fail,
          count(*) FILTER (status = 'WARN') AS warn FROM ({CITE_SQL}) GROUP BY GROUPING SETS ((corpus, "check"), (corpus))""",
)
def q_verdict_totals(spark, sf):
    return citations.verdict_totals(q_citations(spark, sf))


TABLES_SQL = """
  WITH p AS (SELECT *, replace(p_name, ' ', '_') AS snake FROM part),
       d AS (SELECT p_brand AS corpus, concat('m_', snake) AS t FROM p UNION SELECT p_brand, p_type FROM p
             UNION SELECT p_brand, concat('P_', p_type) FROM p UNION SELECT p_brand, 'Part' FROM p
             UNION SELECT p_brand, concat(snake, 's') FROM p),
       k AS (SELECT p_brand AS corpus, concat('m_', snake) AS t FROM p WHERE p_size > 20 AND p_brand <> 'Brand#7'
             UNION SELECT p_brand, p_type FROM p WHERE p_size > 25 AND p_brand <> 'Brand#7')
  """


@query("q_documented_tables", TABLES_SQL + "SELECT corpus, t AS table_name FROM d")
def q_documented_tables(spark, sf):
    return tables.documented_tables(i.TABLE_PAGES.df(spark, sf))


@query(
    "q_tables",
    TABLES_SQL
    + """SELECT 'table' AS "check", corpus, CASE WHEN k.t IS NOT NULL THEN 'OK' ELSE 'FAIL' END AS status, d.t AS label,
           CASE WHEN k.t IS NULL THEN 'not in the sources' ELSE '' END AS message
         FROM d LEFT JOIN k USING (corpus, t) WHERE corpus IN (SELECT corpus FROM k)
         UNION ALL SELECT 'table', corpus, 'WARN', concat(count(*), ' names'), 'no known tables' FROM d
         WHERE corpus NOT IN (SELECT corpus FROM k) GROUP BY corpus""",
)
def q_tables(spark, sf):
    known = tables.known_tables(tables.declared_tables(i.TABLE_SOURCES.df(spark, sf)))
    return tables.verify_tables(tables.documented_tables(i.TABLE_PAGES.df(spark, sf)), known)


ENDPOINT_SQL = """
  WITH e AS (SELECT DISTINCT concat('u', user_id) AS corpus, 'GET' AS method, concat('/', event_type, '/', user_id, '?v=', event_id) AS path,
               concat('/', event_type, '/', user_id) AS route FROM events
             UNION SELECT DISTINCT concat('u', user_id), 'POST', concat('/', event_type, '/{id}/'), concat('/', event_type, '/{_}') FROM events
             UNION SELECT DISTINCT concat('u', user_id), 'PUT', concat('/', event_type, '/[key]'), concat('/', event_type, '/{_}') FROM events),
       r AS (SELECT DISTINCT concat('u', user_id) AS corpus, m AS method, concat('/', event_type, '/{_}') AS route
             FROM events, (SELECT unnest(['GET', 'PUT']) AS m) WHERE value > 60)
  """


@query("q_endpoints", ENDPOINT_SQL + "SELECT corpus, method, path FROM e")
def q_endpoints(spark, sf):
    return endpoints.endpoints(i.ENDPOINT_PAGES.df(spark, sf))


def _typed(df, kind):
    return df.withColumn("project_types", F.array(F.lit(kind)))


@query(
    "q_endpoint_verdicts",
    ENDPOINT_SQL
    + """SELECT 'endpoint' AS "check", corpus, CASE WHEN r.route IS NULL THEN 'WARN' ELSE 'OK' END AS status, concat(method, ' ', path) AS label,
           CASE WHEN r.route IS NULL THEN 'no such route' ELSE '' END AS message, r.route IS NULL AS counts_as_failure
         FROM e LEFT JOIN r USING (corpus, method, route) WHERE corpus IN (SELECT corpus FROM r)
         UNION ALL SELECT 'endpoint', corpus, 'WARN', concat(count(*), ' endpoints'), 'no routes found', false FROM e
         WHERE corpus NOT IN (SELECT corpus FROM r) GROUP BY corpus""",
)
def q_endpoint_verdicts(spark, sf):
    routes = endpoints.source_routes(_typed(i.EXPRESS_SOURCES.df(spark, sf), "express"))
    return endpoints.verify_endpoints(endpoints.endpoints(i.ENDPOINT_PAGES.df(spark, sf)), routes)


@query(
    "q_source_routes",
    """SELECT corpus, m AS method, p AS path FROM (
         SELECT 'next' AS corpus, unnest(['GET', 'DELETE']) AS m, concat('/api/s', s_suppkey, '/{id}') AS p FROM supplier
         UNION SELECT 'nuxt', unnest(CASE WHEN c_acctbal < 0 THEN ['POST'] ELSE ['GET', 'POST', 'PUT', 'PATCH', 'DELETE'] END),
           concat('/api/c', c_custkey, CASE WHEN c_acctbal < 0 THEN '.post' ELSE '/{k}' END) FROM customer
         UNION SELECT concat('app', p_partkey), 'GET', concat('/api/v', p_size, '/items') FROM part
         UNION SELECT concat('app', p_partkey), unnest(['GET', 'POST', 'PUT', 'PATCH', 'DELETE']), concat('/api/v', p_size, '/', p_type) FROM part
         UNION SELECT concat('app', p_partkey), 'POST', '/api' FROM part)""",
)
def q_source_routes(spark, sf):
    laravel = """concat('Route::group([''prefix'' => ''v', p_size, '''], function () {', chr(10), ' Route::get(''/items'', 1);', chr(10),
      ' Route::group([''prefix'' => ''/', p_type, '/''], function () { Route::any('''', 2); });', chr(10), '});', chr(10), 'Route::post(''/'', 3);')"""
    # the routes of a scan are distinct in its task first, so tables with few splits are spread
    parts = [
        spread(table(spark, sf, "supplier")).selectExpr(
            "'next' AS corpus", "concat('app/api/s', s_suppkey, '/[id]/route.ts') AS path",
            "'export async function GET() {} export function DELETE() {}' AS content", "array('nextjs') AS project_types",
        ),
        spread(table(spark, sf, "customer")).selectExpr(
            "'nuxt' AS corpus", "concat('server/api/c', c_custkey, CASE WHEN c_acctbal < 0 THEN '.post.ts' ELSE '/[k].js' END) AS path",
            "'x' AS content", "array('nuxt') AS project_types",
        ),
        spread(table(spark, sf, "part")).selectExpr("concat('app', p_partkey) AS corpus", "'routes/api.php' AS path", f"{laravel} AS content", "array('laravel') AS project_types"),
    ]
    return endpoints.source_routes(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query(
    "q_screen_paths",
    """SELECT corpus, path, CASE WHEN path = '/' THEN 'root' ELSE replace(trim(path, '/'), '/', '-') END AS name, false AS auth_required FROM (
         SELECT DISTINCT concat('r', o_orderpriority) AS corpus, concat('/', lower(o_orderstatus), '/', o_custkey) AS path FROM orders
         UNION SELECT concat('r', o_orderpriority), concat('/in/', o_custkey) FROM orders
         UNION SELECT concat('r', o_orderpriority), concat('/', lower(o_orderstatus), '/', o_custkey, '<br>x') FROM orders)""",
)
def q_screen_paths(spark, sf):
    flow = table(spark, sf, "orders").selectExpr(
        "concat('r', o_orderpriority) AS corpus",
        """concat('n["/', lower(o_orderstatus), '/', o_custkey, '<br>x"] --> m', chr(10), 'see `/in/', o_custkey, '` x["/a class b"]') AS content""",
    )
    return endpoints.screen_paths(flow)


@query(
    "q_routes_open",
    """SELECT concat('u', user_id) AS corpus, count(*) FILTER (value > 20) AS captured, count(*) FILTER (value <= 20) AS failed,
         CAST(coalesce(sum(CASE WHEN value > 20 THEN event_id END), 0) AS BIGINT) AS total_size
       FROM events WHERE event_type <> 'signup' GROUP BY user_id""",
)
def q_routes_open(spark, sf):
    """Routes that need no login, and the report on capturing them."""
    routes = table(spark, sf, "events").selectExpr(
        "concat('u', user_id) AS corpus", "CASE WHEN event_type = 'signup' THEN true WHEN event_type = 'view' THEN false END AS auth_required",
        "value > 20 AS success", "event_id AS size",
    )
    return endpoints.capture_report(endpoints.filter_routes(routes, has_credentials=False))


# ------------------------------------------------------------------------------------ scalar functions


@query(
    "q_paths",
    """SELECT page_id, regexp_extract(url, '^([a-z]+):', 1) IN ('http', 'https') AS allowed,
         concat('shots/', regexp_extract(url, '[^/]*$'), '.png') AS capture,
         regexp_matches(url, '^(https?://|mailto:|ftp://)') AS external, trim(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/') AS folded,
         regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host,
         NOT (contains(url, '..') OR contains(url, '/')) AS safe_name, regexp_matches(url, '#top$') AS ignored
       FROM pages""",
)
def q_paths(spark, sf):
    """URL policy, path folding and name safety on page addresses."""
    url = F.col("url")
    host = F.try_parse_url(url, F.lit("HOST"))
    return table(spark, sf, "pages").select(
        "page_id",
        endpoints.is_allowed_url(url).alias("allowed"),
        F.coalesce(endpoints.capture_path(F.lit("shots"), url), F.lit("shots/.png")).alias("capture"),
        links.is_external(url).alias("external"),
        paths.normalise(F.concat(F.lit("./x/.."), F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1))).alias("folded"),
        host.alias("host"),
        tx.is_safe_name(url).alias("safe_name"),
        links.matches_any(url, ["*#top", "nothing/*"]).alias("ignored"),
    )


@query(
    "q_text_functions",
    """SELECT doc_id, CAST(n_chars // 4 AS BIGINT) AS tokens, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS INTEGER) AS lines,
         CAST(length(text) + len(regexp_extract_all(text, '[\\x{2E81}-\\x{10FFFF}]')) AS INTEGER) AS width,
         concat(lang, '-', source, '.tar') AS stem, '.gz' AS ext, regexp_matches(source, '^[A-Za-z_][A-Za-z0-9_]{0,127}$') AS identifier,
         CAST(regexp_extract(source, '([0-9]+)', 1) AS BIGINT) AS number,
         concat('dash-', lang, '-', source, '-http-server') AS kebab,
         concat(source, '-docs-2024-01-02') AS archive
       FROM documents""",
)
def q_text_functions(spark, sf):
    from corpusaudit.operators.assemble import archive_name

    name = F.concat("lang", F.lit("-"), "source", F.lit(".tar.gz"))
    camel = F.concat(F.lit("Dash"), F.initcap("lang"), F.initcap("source"), F.lit("HTTPServer"))
    return table(spark, sf, "documents").select(
        "doc_id",
        tx.estimate_tokens(F.col("n_chars")).alias("tokens"),
        tx.line_count(F.col("text")).alias("lines"),
        tx.display_width(F.col("text")).alias("width"),
        paths.stem(name).alias("stem"),
        paths.extension(name).alias("ext"),
        tx.is_safe_identifier(F.col("source")).alias("identifier"),
        tx.safe_integer(F.regexp_extract("source", "([0-9]+)", 1)).alias("number"),
        tx.kebab(camel).alias("kebab"),
        archive_name(F.col("source"), F.lit("2024-01-02").cast("date")).alias("archive"),
    )
