"""Queries on source trees, catalogs, migrations, versions and scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusaudit import schemas
from corpusaudit.operators import catalog, classify, dbconfig, frameworks, freshness, impact, leakage, migrations, quality, versions
from corpusaudit.plans import inputs as i
from corpusaudit.plans.registry import ORACLES, Derived, lines_sql, prose_sql, query, table
from corpusaudit.session import checkpoint_dir, spread
from corpusaudit.sources import catalogs, sinks
from corpusaudit.sources.files import decode, scan_tree

TREE = i.TREE.sql()


def tree(spark, sf):
    """Sources and marker files of all corpora."""
    return i.TREE.df(spark, sf).unionByName(i.MARKERS.df(spark, sf))


# the types of a corpus, from its marker files
TYPES_SQL = f"""
  mk AS ({i.MARKERS.sql()}),
  ty AS (SELECT corpus,
      list_filter([CASE WHEN bool_or(path = 'composer.json' AND contains(content, 'laravel')) THEN 'laravel' END,
        CASE WHEN bool_or(path = 'nuxt.config.ts') THEN 'nuxt' END,
        CASE WHEN bool_or(path = 'vue.config.js') AND NOT bool_or(path = 'nuxt.config.ts') THEN 'vue' END,
        CASE WHEN bool_or(path = 'next.config.js') THEN 'nextjs' END,
        CASE WHEN bool_or(path = 'package.json' AND contains(content, 'express')) THEN 'express' END], lambda x: x IS NOT NULL) AS types
    FROM mk GROUP BY corpus),
  f AS (SELECT t.*, coalesce(CASE WHEN len(types) > 0 THEN types END, ['generic']) AS types
    FROM ({TREE} UNION ALL SELECT corpus, path, content, size FROM mk) t LEFT JOIN ty USING (corpus))"""


@query(
    "q_project_types",
    f"WITH {TYPES_SQL} SELECT corpus, array_to_string(any_value(types), '+') AS project_type, count(*) AS files FROM f GROUP BY corpus",
)
def q_project_types(spark, sf):
    typed = classify.with_project_types(tree(spark, sf))
    return typed.groupBy("corpus").agg(F.array_join(F.any_value("project_types"), "+").alias("project_type"), F.count("*").alias("files"))


LOW = "('" + "', '".join(classify.LOW_FILES) + "')"
CLASS_SQL = f"""
  SELECT *, CASE
      WHEN name IN {LOW} OR starts_with(path, 'public/css/') OR starts_with(path, 'public/js/') THEN 'low'
      WHEN list_contains(types, 'laravel') AND regexp_matches(path, '^(routes|app/Models|app/Http/Controllers)/') THEN 'critical'
      WHEN (list_contains(types, 'nuxt') OR list_contains(types, 'vue') OR list_contains(types, 'nextjs')) AND starts_with(path, 'pages/') THEN 'critical'
      WHEN list_contains(types, 'nextjs') AND starts_with(path, 'app/') AND regexp_matches(name, '^(page|route|layout)[.]') THEN 'critical'
      WHEN list_contains(types, 'express') AND starts_with(path, 'routes/') THEN 'critical'
      WHEN regexp_matches(path, '(?i)(models?|schemas?|entities)/') AND NOT list_contains(types, 'laravel') THEN 'critical'
      WHEN list_contains(types, 'laravel') AND regexp_matches(path, '^(app/Services|app/Repositories|app/Http/Middleware|database/migrations)/') THEN 'high'
      WHEN (list_contains(types, 'nuxt') OR list_contains(types, 'vue')) AND regexp_matches(path, '^(stores?|composables)/') THEN 'high'
      WHEN list_contains(types, 'nextjs') AND regexp_matches(path, '^(src/)?lib/') THEN 'high'
      WHEN list_contains(types, 'express') AND starts_with(path, 'middleware/') THEN 'high'
      WHEN regexp_matches(path, '(?i)(services?|repositories|middleware|store|redux|hooks)/') THEN 'high'
      WHEN regexp_matches(path, '(?i)(migrations?|seeds?|factories)/') THEN 'high'
      WHEN regexp_matches(path, '(?i)(components?|utils?|helpers?|lib)/') THEN 'medium'
      WHEN regexp_matches(path, '(?i)(tests?|spec|__tests__)/') THEN 'medium'
      WHEN regexp_matches(path, '(?i)(views?|layouts?|templates?)/') THEN 'medium'
      WHEN regexp_matches(path, '[.](php|vue|json|js|ts|md)$') THEN 'medium' ELSE 'low' END AS category
  FROM (SELECT *, regexp_extract(path, '[^/]*$') AS name FROM f)
  WHERE NOT regexp_matches(path, '(^|/)(node_modules|vendor|[.]git|dist|build|__pycache__|[.]next|[.]nuxt|[.]output|[.]cache|coverage|[.]idea|[.]vscode)/')"""


@query("q_path_class", f"WITH {TYPES_SQL} SELECT corpus, path, category FROM ({CLASS_SQL})")
def q_path_class(spark, sf):
    return classify.manifest(classify.with_project_types(tree(spark, sf))).select("corpus", "path", "category")


@query(
    "q_manifest",
    f"""WITH {TYPES_SQL} SELECT corpus, category, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, CAST(sum(size // 4) AS BIGINT) AS tokens
        FROM ({CLASS_SQL}) GROUP BY GROUPING SETS ((corpus, category), (corpus))""",
)
def q_manifest(spark, sf):
    return classify.manifest_totals(classify.manifest(classify.with_project_types(tree(spark, sf))))


@query(
    "q_read_order",
    f"""WITH {TYPES_SQL} SELECT corpus, path, size, CAST(size // 4 AS BIGINT) AS tokens_est, category,
          CASE category WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END::BIGINT AS read_rank FROM ({CLASS_SQL})""",
)
def q_read_order(spark, sf):
    return classify.read_order(classify.manifest(classify.with_project_types(tree(spark, sf))))


@query(
    "q_doc_manifest",
    """SELECT source AS corpus, lang AS folder, count(*) AS files, CAST(sum(n_chars // 4) AS BIGINT) AS tokens, min(concat(doc_id, '.txt')) AS first_name
       FROM documents GROUP BY source, lang""",
)
def q_doc_manifest(spark, sf):
    """Folder listing and token totals of the documents."""
    listed = classify.directory_listing(i.DOCUMENTS.df(spark, sf))
    docs = i.DOCUMENTS.df(spark, sf).select("corpus", F.regexp_extract("path", "^([^/]*)/", 1).alias("folder"), F.expr("size div 4").alias("t"))
    names = listed.groupBy("corpus", "folder").agg(F.count("*").alias("files"), F.min("name").alias("first_name"))
    return names.join(docs.groupBy("corpus", "folder").agg(F.sum("t").alias("tokens")), ["corpus", "folder"])


@query(
    "q_special_files",
    f"""SELECT corpus, count(*) AS files, count(*) FILTER (regexp_matches(path, '^(database/migrations|db/migrate|migrations)/[^/]*$')) AS migrations,
          count(*) FILTER (regexp_matches(path, '^lang/ja/.*[.](php|json|js)$')) AS language_files, count(*) FILTER (starts_with(path, 'prisma/schema')) AS configs,
          count(*) FILTER (regexp_matches(path, '(^|/)(node_modules|vendor|dist|build)/')) AS excluded,
          count(*) FILTER (ends_with(path, '.dat')) AS packaged_out
        FROM ({TREE}) GROUP BY corpus""",
)
def q_special_files(spark, sf):
    p = F.col("path")
    out = ~classify.is_package_excluded(F.regexp_replace(p, r"\.dat$", ".mmd"))
    return i.TREE.df(spark, sf).groupBy("corpus").agg(
        F.count("*").alias("files"),
        F.count_if(classify.is_migration(p)).alias("migrations"),
        F.count_if(classify.is_language_file(p)).alias("language_files"),
        F.count_if(classify.is_db_config(p)).alias("configs"),
        F.count_if(classify.is_excluded(p)).alias("excluded"),
        F.count_if(~out).alias("packaged_out"),
    )


@query(
    "q_decode",
    """SELECT doc_id, concat(text, chr(65533)) AS replaced, lang <> 'fr' AS kept FROM documents""",
)
def q_decode(spark, sf):
    """Tolerant decoding: a bad byte at the end of every text; French texts are dropped by the strict policy."""
    raw = F.concat(F.encode("text", "utf-8"), F.unhex(F.lit("FF")))
    strict = F.when(F.col("lang") == "fr", raw).otherwise(F.encode("text", "utf-8"))
    return table(spark, sf, "documents").select("doc_id", decode(raw).alias("replaced"), decode(strict, "drop").isNotNull().alias("kept"))


FRONT_SQL = f"""
  fw AS (SELECT concat('s', s_suppkey) AS corpus,
      CASE WHEN s_nationkey < 5 THEN 'nuxt2' WHEN s_nationkey < 10 THEN 'vue3' WHEN s_nationkey < 15 THEN 'nextjs' WHEN s_nationkey < 20 THEN 'react' END AS framework,
      CASE WHEN s_nationkey < 5 THEN '2.15.8' WHEN s_nationkey < 10 THEN '3.2' WHEN s_nationkey < 15 THEN '13.1' WHEN s_nationkey < 20 THEN '17.0.2' END AS framework_version,
      'tailwindcss' AS ui_library, CASE WHEN s_nationkey < 5 THEN 'vuex' WHEN s_nationkey < 10 THEN 'pinia' END AS state_management FROM supplier)"""


@query("q_deps", f"WITH {FRONT_SQL} SELECT * FROM fw")
def q_deps(spark, sf):
    return frameworks.detect(i.PACKAGES.df(spark, sf).drop("path"))


@query(
    "q_frontends",
    f"""WITH {FRONT_SQL}, p AS ({i.FRONTEND_FILES.sql()}),
        j AS (SELECT fw.*, p.path, CASE WHEN framework IN ('nuxt2', 'vue3') THEN '[.]vue$' ELSE '[.](jsx|tsx)$' END AS ext FROM fw LEFT JOIN p USING (corpus) WHERE framework IS NOT NULL)
        SELECT corpus, framework, framework_version, ui_library, state_management, CASE WHEN framework IN ('nuxt2', 'nextjs') THEN 'file-based' END AS router_type,
          count(*) FILTER (regexp_matches(path, '^(src/|app/)?(pages|views|screens|routes)/') AND regexp_matches(path, ext)) AS page_count,
          count(*) FILTER (regexp_matches(path, '^(src/|app/)?(store|stores|state)/') AND regexp_matches(path, '[.](ts|js)$')) AS store_count,
          count(*) FILTER (regexp_matches(path, '^(src/|app/)?components/') AND regexp_matches(path, ext)) AS component_count
        FROM j GROUP BY ALL""",
)
def q_frontends(spark, sf):
    return frameworks.frontends(i.PACKAGES.df(spark, sf).unionByName(i.FRONTEND_FILES.df(spark, sf)))


@query(
    "q_router_types",
    f"""WITH {FRONT_SQL} SELECT corpus, framework, CASE WHEN framework IN ('nuxt2', 'nextjs') THEN 'file-based'
          WHEN CAST(substring(corpus, 2) AS BIGINT) % 2 = 0 THEN 'config-based' END AS router_type FROM fw WHERE framework IS NOT NULL""",
)
def q_router_types(spark, sf):
    """Front ends of which every other one has a router file."""
    path = "CASE WHEN s_suppkey % 2 = 0 THEN element_at(array('src/router/index.ts', 'src/router.js', 'app/router.js'), CAST(s_suppkey % 3 + 1 AS INT)) ELSE 'src/routers/index.ts' END"
    routers = table(spark, sf, "supplier").selectExpr("concat('s', s_suppkey) AS corpus", f"{path} AS path", "'' AS content")
    return frameworks.frontends(i.PACKAGES.df(spark, sf).unionByName(routers)).select("corpus", "framework", "router_type")


@query(
    "q_first_method",
    """SELECT corpus, path, method FROM (SELECT *, row_number() OVER (PARTITION BY corpus, path ORDER BY rank) AS rn FROM (
         SELECT DISTINCT concat('c', o_custkey) AS corpus, CASE WHEN o_totalprice > 300000 THEN lower(o_orderstatus) ELSE concat('more/', o_orderstatus) END AS path, 'source' AS method, 0 AS rank FROM orders
         UNION SELECT DISTINCT concat('c', o_custkey), lower(o_orderstatus), 'sibling', 1 FROM orders)) WHERE rn = 1""",
)
def q_first_method(spark, sf):
    base = table(spark, sf, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("corpus"), F.lower("o_orderstatus").alias("path"), "o_totalprice")
    path = F.when(F.col("o_totalprice") > 300000, F.col("path")).otherwise(F.concat(F.lit("more/"), F.upper("path")))
    src = base.select("corpus", path.alias("path"), F.lit("source").alias("method"))
    return frameworks.first_method(src, base.select("corpus", "path", F.lit("sibling").alias("method")))


# ------------------------------------------------------------------------------------------- catalogs

CATALOG_SQL = f"""
  t AS ({i.CATALOG_TABLES.sql()}),
  c AS (SELECT DISTINCT * FROM ({i.CATALOG_COLUMNS.sql()})),
  k AS (SELECT DISTINCT * FROM ({i.CATALOG_FKS.sql()})),
  x AS (SELECT DISTINCT * FROM ({i.CATALOG_INDEXES.sql()})),
  cg AS (SELECT corpus, table_name, string_agg(concat(column_name, CASE WHEN is_nullable = 'NO' THEN '!' ELSE '?' END, CASE WHEN column_default = 'NULL' THEN '' ELSE coalesce(column_default, '') END), ',' ORDER BY ordinal) AS columns,
      count(*) AS nc, coalesce(string_agg(CASE WHEN column_key = 'PRI' THEN column_name END, ',' ORDER BY ordinal), '') AS pk,
      coalesce(string_agg(CASE WHEN lower(column_name) IN ('is_active', 'deleted_at') THEN column_name END, ',' ORDER BY ordinal), '') AS flags,
      coalesce(string_agg(CASE WHEN lower(column_name) IN ('name', 'title') THEN column_name END, ',' ORDER BY ordinal), '') AS labels,
      bool_or(column_name = 'Name') AS has_name FROM c GROUP BY corpus, table_name),
  kg AS (SELECT corpus, table_name, count(*) AS nk, string_agg(concat(column_name, '>', referenced_table_name), ',' ORDER BY column_name, referenced_table_name) AS fks FROM k GROUP BY corpus, table_name),
  xg AS (SELECT corpus, table_name, string_agg(concat(index_name, ':', cols, ':', u), ';' ORDER BY index_name) AS indexes FROM (
      SELECT corpus, table_name, index_name, string_agg(column_name, '+' ORDER BY seq) AS cols, CASE WHEN min(non_unique) = '0' THEN 'true' ELSE 'false' END AS u FROM x GROUP BY ALL) GROUP BY corpus, table_name),
  cat AS (SELECT corpus, table_name, coalesce(columns, '') AS columns, coalesce(pk, '') AS primary_key, coalesce(fks, '') AS foreign_keys, coalesce(indexes, '') AS indexes,
      CASE WHEN contains(table_name, 'job') THEN 'S' WHEN coalesce(nk, 0) >= 2 AND coalesce(nc, 0) <= nk + 3 THEN 'R'
        WHEN coalesce(flags, '') <> '' OR starts_with(table_name, 'm_') OR (coalesce(has_name, false) AND coalesce(nk, 0) = 0) THEN 'M' ELSE 'T' END AS kind,
      coalesce(flags, '') AS flags, coalesce(labels, '') AS labels, ends_with(table_name, '_settings') AS is_settings_table,
      TRY_CAST(table_rows AS BIGINT) AS row_count
    FROM t LEFT JOIN cg USING (corpus, table_name) LEFT JOIN kg USING (corpus, table_name) LEFT JOIN xg USING (corpus, table_name))"""


def _catalog(spark, sf) -> DataFrame:
    return catalog.assemble(*[d.df(spark, sf) for d in (i.CATALOG_TABLES, i.CATALOG_COLUMNS, i.CATALOG_FKS, i.CATALOG_INDEXES)])


@query("q_catalog", f"WITH {CATALOG_SQL} SELECT * FROM cat")
def q_catalog(spark, sf):
    c = _catalog(spark, sf)
    none = F.array().cast("array<string>")
    join = lambda a, sep=",": F.array_join(F.coalesce(a, none), sep)
    column = lambda x: F.concat(x["name"], F.when(x["nullable"], "?").otherwise("!"), F.coalesce(x["default"], F.lit("")))
    index = lambda x: F.concat_ws(":", x["name"], F.array_join(x["columns"], "+"), x["unique"].cast("string"))
    return c.select(
        "corpus",
        "table_name",
        join(F.transform("columns", column)).alias("columns"),
        join(F.col("primary_key")).alias("primary_key"),
        join(F.transform("foreign_keys", lambda x: F.concat(x["column"], F.lit(">"), x["references_table"]))).alias("foreign_keys"),
        join(F.transform("indexes", index), ";").alias("indexes"),
        "kind",
        join(F.col("active_flag_columns")).alias("flags"),
        join(F.col("label_columns")).alias("labels"),
        "is_settings_table",
        "row_count",
    )


@query("q_table_kinds", f"WITH {CATALOG_SQL} SELECT corpus, kind, count(*) AS tables FROM cat GROUP BY ALL")
def q_table_kinds(spark, sf):
    return catalog.kind_counts(_catalog(spark, sf))


@query(
    "q_catalog_manifest",
    f"""WITH {CATALOG_SQL} SELECT corpus, 'active_flag_tables' AS section, table_name, flags AS columns FROM cat WHERE flags <> ''
        UNION ALL SELECT corpus, 'settings_tables', table_name, '' FROM cat WHERE is_settings_table
        UNION ALL SELECT corpus, 'label_sources', table_name, labels FROM cat WHERE labels <> ''
        UNION ALL SELECT corpus, 'master_data_candidates', table_name, '' FROM cat WHERE kind = 'M'""",
)
def q_catalog_manifest(spark, sf):
    return catalog.manifest_rows(_catalog(spark, sf))


@query("q_catalog_json", f"WITH {CATALOG_SQL} SELECT corpus, table_name, kind, row_count FROM cat")
def q_catalog_json(spark, sf):
    """The JSON document of each table, read back."""
    entry = catalog.entry_json(_catalog(spark, sf))
    back = F.from_json("entry", "kind STRING, row_count BIGINT")
    return entry.select("corpus", "table_name", back.alias("e")).select("corpus", "table_name", "e.kind", "e.row_count")


@query(
    "q_active_counts",
    """SELECT 'customer' AS table_name, 'is_active' AS flag, count(*) AS total, count(*) FILTER (c_acctbal > 0) AS active, count(*) FILTER (c_acctbal <= 0) AS inactive, true AS is_primary_flag FROM customer
       UNION ALL SELECT 'documents', 'is_active', count(*), count(*) FILTER (quality = 1), count(*) FILTER (quality <> 1), true FROM documents LEFT JOIN labels USING (doc_id)
       UNION ALL SELECT 'documents', 'hidden', count(*), count(*) FILTER (toxic = 0), count(*) FILTER (toxic <> 0), false FROM documents LEFT JOIN labels USING (doc_id)
       UNION ALL SELECT 'documents', 'deleted_at', count(*), count(*) FILTER (quality IS NULL), count(*) FILTER (quality IS NOT NULL), false FROM documents LEFT JOIN labels USING (doc_id)""",
)
def q_active_counts(spark, sf):
    cust = table(spark, sf, "customer").select((F.col("c_acctbal") > 0).cast("int").alias("is_active"))
    docs = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    docs = docs.select(F.col("quality").alias("is_active"), F.col("toxic").alias("hidden"), F.col("quality").alias("deleted_at"))
    return catalog.active_counts(cust, "customer", ["is_active"]).unionByName(
        catalog.active_counts(docs, "documents", ["is_active", "hidden", "deleted_at"])
    )


@query("q_sample_labels", "SELECT p_partkey, p_name AS name, p_type AS label, p_brand AS title, p_size AS value FROM part")
def q_sample_labels(spark, sf):
    part = table(spark, sf, "part").selectExpr("p_partkey", "p_name AS name", "p_type AS label", "p_brand AS title", "p_size AS value")
    return catalog.label_values(part, ["name", "label", "title", "value"], ["p_partkey"])


@query("q_settings_values", "SELECT * FROM supplier")
def q_settings_values(spark, sf):
    return catalog.settings_values(table(spark, sf, "supplier"), [F.desc("s_acctbal"), "s_suppkey"])


@query(
    "q_dump_catalog",
    """SELECT p_brand AS corpus, concat('t_', p_partkey) AS table_name,
         concat('id:bigint:false:,price:decimal(', p_size, ',2):true:0.00', CASE WHEN p_size > 25 THEN ',is_active:tinyint(1):true:1' ELSE '' END) AS columns,
         'id' AS primary_key, concat('price>', p_type, '.id') AS foreign_keys, 'uq_x:id+price:true' AS indexes,
         CASE WHEN p_size > 25 THEN 'M' ELSE 'T' END AS kind FROM part""",
)
def q_dump_catalog(spark, sf):
    c = catalog.dump_catalog(i.DUMPS.df(spark, sf))
    column = lambda x: F.concat_ws(":", x["name"], x["type"], x["nullable"].cast("string"), F.coalesce(x["default"], F.lit("")))
    return c.select(
        "corpus",
        "table_name",
        F.array_join(F.transform("columns", column), ",").alias("columns"),
        F.array_join("primary_key", ",").alias("primary_key"),
        F.array_join(F.transform("foreign_keys", lambda x: F.concat(x["column"], F.lit(">"), x["references_table"], F.lit("."), x["references_column"])), ",").alias("foreign_keys"),
        F.array_join(F.transform("indexes", lambda x: F.concat_ws(":", x["name"], F.array_join(x["columns"], "+"), x["unique"].cast("string"))), ";").alias("indexes"),
        "kind",
    )


@query(
    "q_source_precedence",
    """WITH a AS (SELECT DISTINCT CASE WHEN p_size > 49 THEN p_brand ELSE concat('old ', p_brand) END AS corpus, p_type AS table_name FROM part), b AS (SELECT DISTINCT p_brand AS corpus, p_name AS table_name FROM part)
       SELECT corpus, table_name, 0 AS source_rank FROM a UNION ALL SELECT corpus, table_name, 1 FROM b WHERE corpus NOT IN (SELECT corpus FROM a)""",
)
def q_source_precedence(spark, sf):
    part = table(spark, sf, "part")
    live = part.selectExpr("CASE WHEN p_size > 49 THEN p_brand ELSE concat('old ', p_brand) END AS corpus", "p_type AS table_name").distinct()
    return catalog.pick_source(live, part.selectExpr("p_brand AS corpus", "p_name AS table_name").distinct()).select("corpus", "table_name", "source_rank")


# ----------------------------------------------------------------------------- migrations and configs

EVENT_SQL = """
  ev AS (SELECT 'app' AS corpus, concat(lpad(CAST(event_id AS VARCHAR), 12, '0'), '.php') AS file, concat('t_', user_id) AS table_name,
      CASE event_type WHEN 'signup' THEN 'create' WHEN 'view' THEN 'create' WHEN 'purchase' THEN 'alter' ELSE 'drop' END AS action
    FROM events WHERE event_type IN ('signup', 'view', 'purchase', 'error')),
  cr AS (SELECT corpus, table_name, min(file) AS created_in FROM ev WHERE action = 'create' GROUP BY ALL)"""


@query(
    "q_migration_events",
    f"WITH {EVENT_SQL} SELECT corpus, file, CASE action WHEN 'create' THEN 0 WHEN 'alter' THEN 1 ELSE 2 END AS step, action, table_name FROM ev",
)
def q_migration_events(spark, sf):
    return migrations.migration_events(i.MIGRATION_FILES.df(spark, sf))


@query(
    "q_migrations",
    f"""WITH {EVENT_SQL} SELECT corpus, table_name, created_in, count(DISTINCT file) FILTER (action = 'alter' AND file >= created_in) AS modified_files,
          coalesce(bool_or(action = 'drop' AND file >= created_in), false) AS dropped, max(CASE WHEN action = 'drop' AND file >= created_in THEN file END) AS dropped_in
        FROM cr LEFT JOIN ev USING (corpus, table_name) GROUP BY ALL""",
)
def q_migrations(spark, sf):
    return migrations.table_history(migrations.migration_events(i.MIGRATION_FILES.df(spark, sf)))


@query(
    "q_migration_changes",
    f"WITH {EVENT_SQL} SELECT DISTINCT corpus, table_name, file FROM ev JOIN cr USING (corpus, table_name) WHERE action = 'alter' AND file >= created_in",
)
def q_migration_changes(spark, sf):
    return migrations.changes(migrations.migration_events(i.MIGRATION_FILES.df(spark, sf)))


@query(
    "q_db_configs",
    """SELECT concat('c', c_custkey) AS corpus, '.env' AS source_file,
         CASE c_mktsegment WHEN 'BUILDING' THEN 'mysql' WHEN 'MACHINERY' THEN 'postgresql' WHEN 'FURNITURE' THEN 'sqlsrv' ELSE 'unknown' END AS type,
         concat('h', c_nationkey) AS host, CAST(NULL AS VARCHAR) AS port, CAST(NULL AS VARCHAR) AS database, c_name AS username,
         CASE WHEN c_acctbal > 0 THEN true END AS has_password, CAST(NULL AS VARCHAR) AS detail FROM customer
       UNION ALL SELECT concat('s', s_suppkey), 'prisma/schema.prisma', 'postgresql', NULL, NULL, NULL, NULL, NULL, concat('URL_', s_suppkey) FROM supplier WHERE s_suppkey % 3 = 0
       UNION ALL SELECT concat('s', s_suppkey), 'a/app.properties', 'mysql', NULL, NULL, NULL, s_name, s_acctbal > 0, concat('jdbc:mysql://<redacted>@h', s_suppkey, '/d') FROM supplier WHERE s_suppkey % 3 = 1
       UNION ALL SELECT concat('s', s_suppkey), 'x/settings.py', 'sqlite', NULL, NULL, NULL, NULL, NULL, 'default' FROM supplier WHERE s_suppkey % 3 = 2""",
)
def q_db_configs(spark, sf):
    """Environment files of customers; Prisma, Spring and Django files of suppliers."""
    path = "CASE s_suppkey % 3 WHEN 0 THEN 'prisma/schema.prisma' WHEN 1 THEN 'a/app.properties' ELSE 'x/settings.py' END"
    text = """CASE s_suppkey % 3 WHEN 0 THEN concat('datasource db {', chr(10), ' provider = "postgresql"', chr(10), ' url = env("URL_', s_suppkey, '")', chr(10), '}')
              WHEN 1 THEN concat('spring.datasource.url = jdbc:mysql://u:p@h', s_suppkey, '/d', chr(10), 'spring.datasource.username=', s_name, chr(10), CASE WHEN s_acctbal > 0 THEN 'spring.datasource.password=x' ELSE '' END)
              ELSE concat('DATABASES = {', chr(10), '  "default": {', chr(10), '    "ENGINE": "django.db.backends.sqlite3",', chr(10), '  }', chr(10), '}') END"""
    more = table(spark, sf, "supplier").selectExpr("concat('s', s_suppkey) AS corpus", f"{path} AS path", f"{text} AS content")
    return dbconfig.db_configs(i.ENV_FILES.df(spark, sf).select("corpus", "path", "content").unionByName(more))


@query(
    "q_dsn",
    """SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN CASE WHEN s_nationkey < 10 THEN 'mysql' ELSE 'postgresql' END END AS type,
         CASE WHEN s_acctbal > 0 THEN 'bob' END AS username, CASE WHEN s_acctbal > 0 THEN concat('h', s_suppkey) END AS host, CASE WHEN s_acctbal > 0 THEN '5432' END AS port,
         CASE WHEN s_acctbal > 0 THEN concat('db_', s_nationkey) END AS database, CASE WHEN s_acctbal > 0 THEN true END AS has_password,
         CASE WHEN s_acctbal <= 0 THEN concat('x://<redacted>@h', s_suppkey) END AS redacted FROM supplier""",
)
def q_dsn(spark, sf):
    dsn = """CASE WHEN s_acctbal > 0 THEN concat(CASE WHEN s_nationkey < 10 THEN 'mariadb' ELSE 'postgres' END, '://bob:pw', s_suppkey, '@h', s_suppkey, ':5432/db_', s_nationkey)
             ELSE concat('x://u:p@h', s_suppkey) END"""
    df = table(spark, sf, "supplier").select("s_suppkey", F.expr(dsn).alias("dsn"))
    return df.select("s_suppkey", dbconfig.parse_dsn(F.col("dsn")).alias("p")).select("s_suppkey", "p.*")


# ------------------------------------------------------------------------------------------- versions

OLD_SQL = "SELECT source AS corpus, concat(lang, '/', doc_id, '.txt') AS path, sha256(text) AS sha FROM documents"
NEW_SQL = """SELECT source AS corpus, concat(lang, '/', doc_id, '.txt') AS path, sha256(replace(text, 'queque', 'que')) AS sha FROM documents JOIN labels USING (doc_id)
             UNION ALL SELECT 'bench', concat(item_id, '.txt'), sha256(text) FROM benchmark"""
DIFF_SQL = f"""SELECT corpus, path, CASE WHEN o.sha IS NULL THEN 'added' WHEN n.sha IS NULL THEN 'removed' WHEN o.sha = n.sha THEN 'same' ELSE 'changed' END AS change
               FROM ({OLD_SQL}) o FULL JOIN ({NEW_SQL}) n USING (corpus, path)"""


def _diff(spark, sf):
    docs = i.DOCUMENTS.df(spark, sf)
    text = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id"), "doc_id")
    new = text.selectExpr("source AS corpus", "concat(lang, '/', doc_id, '.txt') AS path", "replace(text, 'queque', 'que') AS content")
    bench = table(spark, sf, "benchmark").selectExpr("'bench' AS corpus", "concat(item_id, '.txt') AS path", "text AS content")
    return versions.compare(versions.snapshot(docs), versions.snapshot(new.unionByName(bench)), keep_same=True)


@query("q_snapshot_diff", DIFF_SQL)
def q_snapshot_diff(spark, sf):
    return _diff(spark, sf)


@query(
    "q_change_summary",
    f"""SELECT corpus, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed, count(*) FILTER (change = 'changed') AS changed,
          count(*) FILTER (change <> 'same') > 0 AS has_changes FROM ({DIFF_SQL}) GROUP BY corpus""",
)
def q_change_summary(spark, sf):
    return versions.change_summary(_diff(spark, sf))


@query(
    "q_exact_dups",
    """SELECT sha256(text) AS sha256, count(*) AS copies, min({'a': source, 'b': concat(lang, '/', doc_id, '.txt')}).a AS first_corpus,
         min({'a': source, 'b': concat(lang, '/', doc_id, '.txt')}).b AS first_path FROM documents GROUP BY text HAVING count(*) > 1""",
)
def q_exact_dups(spark, sf):
    return versions.copies(versions.snapshot(i.DOCUMENTS.df(spark, sf)))


LEDGER = Derived(
    "events",
    {
        "cache_key": "concat('k', CAST(user_id AS STRING), event_type)",
        "corpus": "concat('u', CAST(user_id AS STRING))",
        "commit": "CASE WHEN event_type = 'error' THEN '' ELSE event_type END",
        "generated_at": "ts",
        "file_count": "event_id",
        "facts_version": "1",
    },
)
CURRENT = Derived("customer", {"corpus": "concat('u', CAST(c_custkey AS STRING))", "commit": "CASE WHEN c_acctbal > 3000 THEN 'click' WHEN c_acctbal > 0 THEN 'view' ELSE '' END"})
NOW, AGE = "2024-01-30 23:59:59", 86400
LAST_SQL = f"SELECT corpus, max({{'t': generated_at, 'k': cache_key, 'c': commit}}) AS e FROM ({LEDGER.sql()}) GROUP BY corpus"


@query(
    "q_ledger_skip",
    f"""WITH w AS (SELECT DISTINCT concat('k', c_custkey, e) AS cache_key FROM customer, (SELECT unnest(['click', 'view']) AS e)),
          d AS (SELECT cache_key FROM ({LEDGER.sql()}) WHERE epoch(generated_at) >= epoch(TIMESTAMP '{NOW}') - {AGE})
        SELECT cache_key FROM w WHERE cache_key NOT IN (SELECT cache_key FROM d)""",
)
def q_ledger_skip(spark, sf):
    """Work of every customer that no recent ledger entry covers."""
    kinds = F.explode(F.array(F.lit("click"), F.lit("view"))).alias("e")
    work = table(spark, sf, "customer").select("c_custkey", kinds).select(F.concat(F.lit("k"), "c_custkey", "e").alias("cache_key"))
    return versions.to_do(work, LEDGER.df(spark, sf), F.lit(NOW).cast("timestamp"), AGE)


@query(
    "q_ledger_valid",
    f"""SELECT corpus, e.k AS cache_key, e.c AS commit FROM ({LAST_SQL}) LEFT JOIN (SELECT corpus, commit AS cur FROM ({CURRENT.sql()})) USING (corpus)
        WHERE epoch(e.t) >= epoch(TIMESTAMP '{NOW}') - {AGE} AND (e.c = '' OR coalesce(cur, '') = '' OR e.c = cur)""",
)
def q_ledger_valid(spark, sf):
    valid = versions.still_valid(LEDGER.df(spark, sf), CURRENT.df(spark, sf), F.lit(NOW).cast("timestamp"), AGE)
    return valid.select("corpus", "cache_key", "commit")


@query(
    "q_facts_state",
    f"""SELECT corpus, CASE WHEN e IS NULL THEN 'no cache' WHEN e.c = '' OR commit = '' THEN 'no commit' WHEN e.c = commit THEN 'unchanged' ELSE 'changed' END AS state
        FROM ({CURRENT.sql()}) LEFT JOIN ({LAST_SQL}) USING (corpus)""",
)
def q_facts_state(spark, sf):
    return versions.facts_state(CURRENT.df(spark, sf), LEDGER.df(spark, sf))


@query(
    "q_changed_files",
    f"""WITH s AS (SELECT corpus FROM ({CURRENT.sql()}) JOIN ({LAST_SQL}) USING (corpus) WHERE e.c <> '' AND commit <> '' AND e.c <> commit)
        SELECT concat('u', o_custkey) AS corpus, CAST(o_orderkey AS VARCHAR) AS path, CASE o_orderkey % 3 WHEN 0 THEN 'changed' ELSE 'added' END AS change
        FROM orders WHERE o_orderkey % 3 < 2 AND concat('u', o_custkey) IN (SELECT corpus FROM s)""",
)
def q_changed_files(spark, sf):
    """Files of the corpora whose commit has changed since the last entry, by their hashes."""
    orders = table(spark, sf, "orders").selectExpr("concat('u', o_custkey) AS corpus", "CAST(o_orderkey AS STRING) AS path", "o_orderkey", "CAST(o_totalprice AS STRING) AS content")
    new = versions.snapshot(orders)
    old = versions.snapshot(orders.where("o_orderkey % 3 <> 1").withColumn("content", F.expr("CASE WHEN o_orderkey % 3 = 0 THEN 'old' ELSE content END")))
    return versions.changed_files(versions.facts_state(CURRENT.df(spark, sf), LEDGER.df(spark, sf)), versions.compare(old, new))


@query(
    "q_ledger_expire",
    f"SELECT count(*) FILTER (epoch(ts) < epoch(TIMESTAMP '{NOW}') - {AGE}) AS removed FROM events",
)
def q_ledger_expire(spark, sf):
    return versions.expire(LEDGER.df(spark, sf), F.lit(NOW).cast("timestamp"), AGE)[1]


@query(
    "q_ledger_entry",
    f"""SELECT * FROM ({LEDGER.sql()}) WHERE (generated_at, cache_key) = (SELECT max((generated_at, cache_key)) FROM ({LEDGER.sql()}))""",
)
def q_ledger_entry(spark, sf):
    """The entry of the key that was written last."""
    ledger = LEDGER.df(spark, sf)
    key = ledger.agg(F.max_by("cache_key", F.struct("generated_at", "cache_key"))).first()[0]
    return versions.ledger_entry(ledger, key)


COUNTED = "NOT regexp_matches(path, '(^|/)(" + "|".join(d.replace(".", "[.]") for d in classify.COUNT_SKIP_DIRS) + ")(/|$)')"


@query("q_source_counts", f"SELECT corpus, count(*) AS file_count FROM ({i.TREE.sql()}) WHERE {COUNTED} GROUP BY corpus")
def q_source_counts(spark, sf):
    return classify.count_source_files(i.TREE.df(spark, sf))


@query(
    "q_stored_files",
    f"""SELECT corpus, path, content, CASE WHEN regexp_matches(path, '[.](md|mmd|svg|yaml|yml|json)$') THEN regexp_extract(path, '[.]([a-z]+)$', 1) ELSE 'other' END AS kind FROM ({i.TREE.sql()})""",
)
def q_stored_files(spark, sf):
    """Files stored by kind in the shared folder, as read back."""
    from uuid import uuid4

    path = f"{checkpoint_dir(spark)}/files-{uuid4().hex}"
    sinks.write_files(i.TREE.df(spark, sf).select("corpus", "path", "content"), path)
    return spark.read.parquet(path).select("corpus", "path", "content", "kind")


@query("q_stored_manifest", ORACLES["q_read_order"])
def q_stored_manifest(spark, sf):
    """The manifest written to a folder per category in the shared folder, as read back."""
    from uuid import uuid4

    listed = classify.manifest(classify.with_project_types(tree(spark, sf)))
    path = f"{checkpoint_dir(spark)}/manifest-{uuid4().hex}"
    sinks.write_manifest(listed, path)
    return spark.read.parquet(path).select(listed.columns)


@query(
    "q_run_log",
    """SELECT CASE WHEN n = 1 THEN 'full' ELSE 'update' END AS mode, coalesce(source, 'none') AS corpus, CAST(count(*) FILTER (n = 1 OR lang = 'en') AS BIGINT) AS file_count
       FROM documents, (SELECT unnest([1, 2]) AS n) GROUP BY n, source""",
)
def q_run_log(spark, sf):
    """A full run and an update appended to the run log in the shared folder, as read back."""
    from uuid import uuid4

    path = f"{checkpoint_dir(spark)}/log-{uuid4().hex}"
    docs = table(spark, sf, "documents").select(F.coalesce("source", F.lit("none")).alias("corpus"), "lang")
    for mode, counted in (("full", F.count("*")), ("update", F.count_if(F.col("lang") == "en"))):
        entry = docs.groupBy("corpus").agg(counted.alias("file_count"))
        sinks.append_run_log(entry.select(F.lit("audit").alias("name"), F.lit(mode).alias("mode"), F.current_timestamp().alias("generated_at"), "corpus", "file_count"), path)
    return spark.read.schema(schemas.RUN_LOG).json(path).where("name = 'audit' AND generated_at IS NOT NULL").select("mode", "corpus", "file_count")


@query(
    "q_scan_tree",
    """SELECT CASE WHEN lang = 'en' THEN 'english' ELSE 'other' END AS corpus, CAST(sum(octet_length(encode(coalesce(text, ''))) + 1) AS BIGINT) AS bytes,
         CAST(sum(length(coalesce(text, '')) + 1) AS BIGINT) AS chars FROM documents WHERE starts_with(source, 'src1') GROUP BY 1""",
)
def q_scan_tree(spark, sf):
    """Documents written as files below two corpora and scanned; what lies in an excluded folder is left out."""
    from uuid import uuid4

    base = f"{checkpoint_dir(spark)}/tree-{uuid4().hex}"
    docs = spread(table(spark, sf, "documents")).select(F.coalesce("text", F.lit("")).alias("value"), F.coalesce(F.startswith("source", F.lit("src1")), F.lit(False)).alias("kept"), F.col("lang").eqNullSafe("en").alias("en"))
    for corpus, mine in (("english", F.col("en")), ("other", ~F.col("en"))):
        docs.where(mine & F.col("kept")).select("value").write.text(f"{base}/{corpus}/src")
        docs.where(mine & ~F.col("kept")).select("value").write.text(f"{base}/{corpus}/node_modules/x")
    found = scan_tree(spark, base, glob="*.txt")
    return found.groupBy("corpus").agg(F.sum("size").alias("bytes"), F.sum(F.length("content")).cast("long").alias("chars"))


GIVEN = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@query(
    "q_session_catalog",
    " UNION ALL ".join(
        f"""SELECT '{t}' AS table_name, (SELECT count(*) FROM (DESCRIBE {t})) AS columns, (SELECT string_agg(column_name, ',' ORDER BY column_name) FROM (DESCRIBE {t})) AS names, count(*) AS rows FROM {t}"""
        for t in GIVEN
    ),
)
def q_session_catalog(spark, sf):
    """The given tables as views of the session: what its catalog knows of them, and their rows."""
    from uuid import uuid4

    mark = f"v{uuid4().hex}_"
    for t in GIVEN:
        table(spark, sf, t).createTempView(mark + t)
    try:
        known = catalogs.read_spark_catalog(spark, "default")
        counts = reduce(DataFrame.unionByName, [spark.table(mark + t).agg(F.count("*").alias("rows")).select(F.lit(mark + t).alias("table_name"), "rows") for t in GIVEN])
    finally:
        for t in GIVEN:
            spark.catalog.dropTempView(mark + t)
    of = known["columns"].where(F.startswith("table_name", F.lit(mark))).groupBy("table_name")
    found = of.agg(F.count("*").alias("columns"), F.array_join(F.array_sort(F.collect_list("column_name")), ",").alias("names"))
    return found.join(counts, "table_name").select(F.replace("table_name", F.lit(mark), F.lit("")).alias("table_name"), "columns", "names", "rows")


@query(
    "q_project_names",
    """SELECT DISTINCT name FROM (
         SELECT concat('app', p_partkey) AS name FROM part
         UNION ALL SELECT concat('s', p_size, 'x') FROM part UNION ALL SELECT lower(p_type) FROM part)""",
)
def q_project_names(spark, sf):
    files = table(spark, sf, "part").selectExpr(
        "explode(array(concat('.cache/facts-app', p_partkey, '.yaml'), concat('docs/manual/s', p_size, 'x/a.md'), concat('docs/architecture/', lower(p_type), '.md'), 'docs/architecture/index.md', 'docs/manual/test/x.md', concat('src/', p_name))) AS path"
    )
    return leakage.project_names(files)


@query("q_cache_keys", "SELECT doc_id, sha256(concat(source, '/', doc_id, ':', lang)) AS cache_key FROM documents")
def q_cache_keys(spark, sf):
    path = F.concat_ws("/", "source", "doc_id")
    return table(spark, sf, "documents").select("doc_id", versions.cache_key(path, F.col("lang")).alias("cache_key"))


FRESH_SQL = """
  f AS (SELECT o_orderpriority AS corpus, concat(o_orderkey, '.md') AS path,
      CASE WHEN o_orderstatus = 'P' THEN CAST(o_orderdate AS DATE) + 3 ELSE CAST(o_orderdate AS DATE) END AS doc_date, s AS source_date
    FROM orders LEFT JOIN (SELECT l_orderkey, max(CAST(l_shipdate AS DATE)) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey),
  j AS (SELECT *, CAST(date_diff('day', doc_date, source_date) AS INTEGER) AS age_days FROM f)"""


def _dated(spark, sf):
    # three forms of the date, one of them far behind the start of the text
    form = F.when(F.col("o_orderkey") % 3 == 0, "---\nlast_updated: '").when(F.col("o_orderkey") % 3 == 1, "生成日: ").otherwise("x" * 2100 + "\nGenerated: ")
    head = F.when(F.col("o_orderstatus") == "P", F.concat(form, F.expr("date_add(CAST(o_orderdate AS DATE), 3)"), F.lit("'\n")))
    docs = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("corpus"),
        F.concat("o_orderkey", F.lit(".md")).alias("path"),
        "o_orderkey",
        freshness.document_date(F.coalesce(head, F.lit("none")), F.col("o_orderdate")).alias("doc_date"),
    )
    ship = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(F.to_date("l_shipdate")).alias("source_date"))
    return docs.join(ship, "o_orderkey", "left").drop("o_orderkey")


@query(
    "q_freshness",
    f"""WITH {FRESH_SQL} SELECT *, CASE WHEN source_date IS NULL THEN 'unknown' WHEN age_days > 30 THEN 'stale' ELSE 'fresh' END AS state FROM j""",
)
def q_freshness(spark, sf):
    return freshness.freshness(_dated(spark, sf), threshold=30)


@query("q_stale_first", f"WITH {FRESH_SQL} SELECT corpus, path, age_days FROM j WHERE age_days > 60 ORDER BY age_days DESC, corpus, path")
def q_stale_first(spark, sf):
    return freshness.stale_first(freshness.freshness(_dated(spark, sf), threshold=60)).select("corpus", "path", "age_days")


@query(
    "q_badge",
    f"""WITH {FRESH_SQL} SELECT corpus, path, concat(CASE WHEN k % 3 = 0 THEN concat('# T', chr(10), chr(10)) WHEN k % 3 = 1 THEN concat('intro', chr(10)) ELSE '' END, '> 📊 鮮度: ', CASE
          WHEN age_days > 7 THEN concat('⚠️ 要更新（生成日: ', doc_date, ', ソース最終更新: ', source_date, ' — ', age_days, '日経過）')
          ELSE concat('✅ 最新（生成日: ', doc_date, ', ソース最終更新: ', coalesce(CAST(source_date AS VARCHAR), '不明'), '）') END, CASE WHEN k % 3 = 2 THEN chr(10) ELSE '' END, chr(10), 'x') AS page
        FROM (SELECT *, CAST(replace(path, '.md', '') AS BIGINT) AS k FROM j)""",
)
def q_badge(spark, sf):
    """Pages with a title, with an old badge, and with neither."""
    line = freshness.badge(F.col("doc_date"), F.col("source_date"))
    k = F.replace("path", F.lit(".md"), F.lit("")).cast("long") % 3
    page = F.when(k == 0, "# T\nx").when(k == 1, "intro\n> 📊 鮮度: old\nx").otherwise("x")
    return _dated(spark, sf).select("corpus", "path", freshness.with_badge(page, line).alias("page"))


@query(
    "q_fact_dates",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN CAST(o_orderdate AS DATE) + 1 ELSE CAST(o_orderdate AS DATE) END AS day FROM orders",
)
def q_fact_dates(spark, sf):
    """Dates of fact files in their two forms, and without one."""
    day = "date_add(CAST(o_orderdate AS DATE), 1)"
    text = F.expr(f"""CASE WHEN o_orderkey % 3 = 0 THEN concat('generated_at: "', {day}, '"') WHEN o_orderkey % 3 = 1 THEN concat('date: ', {day}) ELSE 'none' END""")
    return table(spark, sf, "orders").select("o_orderkey", freshness.document_date(text, F.col("o_orderdate"), freshness.FACT_DATES).alias("day"))


# --------------------------------------------------------------------------------------------- impact

IMPACT_SQL = f"""
  f AS ({TREE}),
  r(rule_no, re, docs) AS (VALUES (0, '(^|/)Controllers/API/.*Controller[.]php$', ['F', '04-api-reference.md']), (1, '(^|/)Models/.*[.]php$', ['05-data-model.md']),
    (2, '(^|/)pages/.*/.*[.]vue$', ['06-screen-specs.md', '02-screen-flow.md']), (3, '(^|/)store/.*[.]js$', ['F']),
    (4, '(^|/)routes/api[.]php$', ['04-api-reference.md', '02-screen-flow.md']), (5, '(^|/)config/.*$', ['01-overview.md']), (6, '[.]json$', ['01-overview.md'])),
  h AS (SELECT corpus, path, rule_no, unnest(docs) AS d, regexp_extract(path, '[^/]*$') AS name FROM f JOIN r ON regexp_matches(path, re)),
  a AS (SELECT corpus, path, name, CASE WHEN d <> 'F' THEN d
      WHEN contains(path, 'Controller') THEN concat('features/dash-', regexp_replace(lower(regexp_extract(name, '^Dash([A-Z][a-z]+)API', 1)), '^-|-$', ''), '-api', regexp_extract(name, 'API([0-9]+)', 1), '.md')
      ELSE concat('features/dash-', lower(regexp_extract(name, '^Dash([A-Z][a-z]+)API', 1)), '-api', regexp_extract(name, 'API([0-9]+)', 1), '.md') END AS doc, min(rule_no) AS rule_no
    FROM h GROUP BY ALL)"""


@query("q_affected", f"WITH {IMPACT_SQL} SELECT corpus, path, doc, min(rule_no) AS rule_no FROM a GROUP BY ALL")
def q_affected(spark, sf):
    return impact.affected_documents(i.TREE.df(spark, sf).select("corpus", "path"))


@query(
    "q_affected_many",
    f"""WITH t AS ({i.TREE.sql()}), p AS (SELECT *, regexp_extract(path, '[^/]*$') AS name FROM t)
        SELECT corpus, path, concat('part-', p_partkey, '.md') AS doc, CAST(p_partkey AS BIGINT) AS rule_no FROM p JOIN part ON
          CASE p_partkey % 3 WHEN 0 THEN regexp_matches(name, concat('API', p_partkey, '[.]')) WHEN 1 THEN regexp_matches(path, concat('^(.*/)?app/.*API', p_partkey, '.*[.]php$'))
            ELSE regexp_matches(name, concat('^.ash.*API', p_partkey, '[A-Z].*$')) END
        UNION ALL SELECT corpus, path, 'all.md', CAST(0 AS BIGINT) FROM p""",
)
def q_affected_many(spark, sf):
    """A rule for each part, and one that fits every path: thousands of globs in one pass over the paths."""
    pattern = "CASE p_partkey % 3 WHEN 0 THEN concat('*API', p_partkey, '.*') WHEN 1 THEN concat('app/*API', p_partkey, '*.php') ELSE concat('?ash*API', p_partkey, '[A-Z]*') END AS pattern"
    rules = table(spark, sf, "part").selectExpr("CAST(p_partkey AS BIGINT) AS rule_no", pattern, "array(concat('part-', p_partkey, '.md')) AS docs")
    every = spark.range(1).selectExpr("CAST(0 AS BIGINT) AS rule_no", "'*' AS pattern", "array('all.md') AS docs")
    return impact.affected_by(i.TREE.df(spark, sf).select("corpus", "path"), rules.unionByName(every))


@query("q_impact_plan", f"WITH {IMPACT_SQL} SELECT DISTINCT corpus, doc, path AS source_file, concat(name, ' changed') AS reason FROM a")
def q_impact_plan(spark, sf):
    return impact.update_plan(impact.affected_documents(i.TREE.df(spark, sf).select("corpus", "path")))


@query("q_impact_summary", f"WITH {IMPACT_SQL} SELECT corpus, doc, count(DISTINCT path) AS sources, min(path) AS first_source FROM a GROUP BY ALL")
def q_impact_summary(spark, sf):
    return impact.plan_summary(impact.update_plan(impact.affected_documents(i.TREE.df(spark, sf).select("corpus", "path")))).orderBy("corpus", "doc")


# -------------------------------------------------------------------------------------------- quality

PAGES = f"SELECT corpus, {i.PROJECT} AS project, path, content FROM (SELECT *, {i.PROJECT_PAGES.columns['corpus']} AS corpus, {i.PROJECT_PAGES.columns['path']} AS path, {i.PROJECT_PAGES.columns['content']} AS content FROM customer)"
HAS = lambda re: f"regexp_matches(content, '{re}')"
METRIC_SQL = f"""
  pg AS ({PAGES}),
  ln AS ({prose_sql('SELECT corpus, path, content FROM (' + PAGES + ')')}),
  rw AS ({lines_sql('SELECT corpus, path, content FROM (' + PAGES + ')')}),
  sc AS (SELECT corpus, path, sum(CASE WHEN regexp_matches(line, '^#{{1,3}}\\s+') THEN 1 ELSE 0 END) OVER (PARTITION BY corpus, path ORDER BY line_no) AS no, line FROM ln),
  sn AS (SELECT corpus, path, count(*) AS sections, count(*) FILTER (c) AS cited FROM (
      SELECT corpus, path, no, bool_or(regexp_matches(line, '\\([^)]*:[0-9]+\\)|<!-- source: [^>]+-->')) AS c FROM sc WHERE no > 0 GROUP BY ALL) GROUP BY ALL),
  hc AS (SELECT corpus, path, count(*) FILTER (regexp_matches(line, '^#{{2,4}}\\s+.+')) AS h24, count(*) FILTER (regexp_matches(line, '^#{{2,3}}\\s+.+')) AS h23 FROM ln GROUP BY ALL),
  rc AS (SELECT corpus, path, greatest(0, count(*) FILTER (regexp_matches(line, '^\\s*\\|') AND NOT contains(line, '---')) - count(*) FILTER (regexp_matches(line, '^\\s*\\|[\\s\\-:]+\\|'))) AS api,
      string_agg(line, chr(10) ORDER BY line_no) FILTER (line_no <= 50) AS head FROM rw GROUP BY ALL),
  fm AS (SELECT pg.*, CASE WHEN regexp_matches(path, '^(manual|architecture)/.*[.]md$') THEN coalesce(sections, 0) ELSE 0 END AS sections,
      CASE WHEN regexp_matches(path, '^(manual|architecture)/.*[.]md$') THEN coalesce(cited, 0) ELSE 0 END AS cited,
      CASE WHEN starts_with(path, 'manual/') THEN 1 ELSE 0 END AS inline, 1 AS links,
      CASE WHEN ends_with(path, '04-api-reference.md') THEN api END AS api, CASE WHEN ends_with(path, '05-data-model.md') THEN h24 END AS h24, CASE WHEN ends_with(path, '06-screen-specs.md') THEN h23 END AS h23,
      ends_with(path, '/00-index.md') AND contains(content, '文書番号') AND contains(content, 'バージョン') AND contains(content, '承認者') AS cover
    FROM pg LEFT JOIN sn USING (corpus, path) LEFT JOIN hc USING (corpus, path) LEFT JOIN rc USING (corpus, path)),
  pm AS (SELECT corpus, project, CAST(sum(sections) AS BIGINT) AS sections, CAST(sum(cited) AS BIGINT) AS cited, CAST(sum(inline) AS BIGINT) AS inline, count(*) AS links,
      CAST(sum(api) AS BIGINT) AS api_rows, CAST(sum(h24) AS BIGINT) AS model_headings, CAST(sum(h23) AS BIGINT) AS screen_headings, count(*) FILTER (contains(content, '【推測】')) AS speculation,
      count(*) FILTER (contains(content, '未確認')) AS unconfirmed, bool_or({HAS('無効化モジュール')}) AS has_disabled, bool_or({HAS('presence=1')}) AS has_active, bool_or({HAS('Tier 1 Tier2')}) AS tiers,
      bool_or(cover) AS has_cover, bool_or(starts_with(path, 'manual/') AND {HAS('改訂履歴')}) AS has_revision, bool_or(starts_with(path, 'manual/') AND {HAS('ステータス:')}) AS has_status,
      count(DISTINCT CASE WHEN NOT contains(path, '/extra-') THEN path END) AS expected_found, count(*) FILTER (sections > 0 AND cited * 2 < sections) AS low_citation_files
    FROM fm GROUP BY ALL)"""
GRADE = lambda v, a, b: f"CASE WHEN {v} >= {a} THEN 'A' WHEN {v} >= {b} THEN 'B' ELSE 'C' END"
AXES = [
    ("grounding", GRADE("ratio", 0.8, 0.5), "ratio", "low_citation_files > 0", "add citations to sections"),
    ("completeness", GRADE("found", 0.9, 0.7), "found", "expected_found < 15", "add missing files"),
    ("diagrams", GRADE("inline", 10, 5), "inline", "inline < 5", "add diagrams"),
    ("cross_references", GRADE("links", 20, 10), "links", "links < 10", "add internal links"),
    ("api", GRADE("coalesce(api_rows, 0)", 20, 5), "coalesce(api_rows, 0)", "coalesce(api_rows, 0) < 5", "add API rows"),
    ("tables", GRADE("coalesce(model_headings, 0)", 10, 5), "coalesce(model_headings, 0)", "coalesce(model_headings, 0) < 5", "add table sections"),
    ("screens", GRADE("coalesce(screen_headings, 0)", 15, 5), "coalesce(screen_headings, 0)", "coalesce(screen_headings, 0) < 5", "add screen sections"),
    ("speculation", "CASE WHEN speculation = 0 THEN 'A' WHEN speculation <= 5 THEN 'B' ELSE 'C' END", "speculation", "speculation > 0", "resolve speculation"),
    ("modules", GRADE("valid", 3, 1), "valid", "valid < 3", "document module validity"),
    ("formal", GRADE("formal", 3, 2), "formal", "formal < 3", "add cover, history and status"),
]
AXIS_SQL = f"""{METRIC_SQL},
  px AS (SELECT *, CASE WHEN sections > 0 THEN cited / sections ELSE 0 END AS ratio, expected_found / 15 AS found,
      CAST(has_disabled AS INT) + CAST(has_active AS INT) + CAST(tiers AS INT) AS valid, CAST(has_cover AS INT) + CAST(has_revision AS INT) + CAST(has_status AS INT) AS formal FROM pm),
  ax AS ({" UNION ALL ".join(
    f"SELECT corpus, project, '{n}' AS axis, {g} AS grade, round(CAST({v} AS DOUBLE), 6) AS value, CASE WHEN {c} THEN '{h}' END AS suggestion FROM px" for n, g, v, c, h in AXES)})"""


def _pages(spark, sf):
    return i.PROJECT_PAGES.df(spark, sf).withColumn("project", classify.project_of(F.col("path")))


@query(
    "q_project_metrics",
    f"""WITH {METRIC_SQL} SELECT corpus, project, sections, cited, inline, links, api_rows, model_headings, screen_headings, speculation, unconfirmed, has_disabled, has_active,
          tiers AS has_tier1, has_cover, has_revision, has_status, expected_found, low_citation_files FROM pm""",
)
def q_project_metrics(spark, sf):
    m = quality.project_metrics(_pages(spark, sf))
    return m.drop("mmd", "svg", "has_openapi", "has_tier2", "has_tier3", "in_manual")


@query("q_low_citations", f"WITH {METRIC_SQL} SELECT corpus, project, path, CAST(sections AS INTEGER) AS sections, CAST(cited AS INTEGER) AS cited FROM fm WHERE sections > 0 AND cited * 2 < sections")
def q_low_citations(spark, sf):
    return quality.low_citation_files(_pages(spark, sf))


@query(
    "q_axis_scores",
    f"WITH {AXIS_SQL} SELECT corpus, project, axis, grade, CASE grade WHEN 'A' THEN 3 WHEN 'B' THEN 2 ELSE 1 END AS score, value, suggestion FROM ax",
)
def q_axis_scores(spark, sf):
    return quality.axis_scores(quality.project_metrics(_pages(spark, sf)))


CARD_SQL = f"""{AXIS_SQL}, cd AS (SELECT corpus, project, CAST(round_even(sum(CASE grade WHEN 'A' THEN 3 WHEN 'B' THEN 2 ELSE 1 END) / 30 * 100, 0) AS INTEGER) AS numeric_score, count(suggestion) AS suggestions FROM ax GROUP BY ALL)"""


@query(
    "q_scorecard",
    f"""WITH {CARD_SQL} SELECT *, CASE WHEN numeric_score >= 90 THEN 'A' WHEN numeric_score >= 80 THEN 'A-' WHEN numeric_score >= 70 THEN 'B+' WHEN numeric_score >= 60 THEN 'B'
          WHEN numeric_score >= 50 THEN 'B-' WHEN numeric_score >= 40 THEN 'C+' ELSE 'C' END AS grade, numeric_score >= 60 AS passed FROM cd""",
)
def q_scorecard(spark, sf):
    return quality.scorecards(quality.axis_scores(quality.project_metrics(_pages(spark, sf))), "B")


EXPECTED = "[" + ", ".join(f"'{e}'" for e in quality.EXPECTED_FILES) + "]"
MISSING_SQL = f"""
  pg AS ({PAGES}), ex AS (SELECT corpus, project, replace(unnest({EXPECTED}), '{{name}}', project) AS expected FROM (SELECT DISTINCT corpus, project FROM pg)),
  ms AS (SELECT * FROM ex WHERE NOT EXISTS (SELECT 1 FROM pg WHERE pg.corpus = ex.corpus AND pg.path = ex.expected))"""


@query("q_completeness", f"WITH {MISSING_SQL} SELECT * FROM ms")
def q_completeness(spark, sf):
    return quality.missing_files(_pages(spark, sf))


@query(
    "q_suggestions",
    f"""WITH {MISSING_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY corpus, project ORDER BY expected) AS rn FROM ms)
        SELECT corpus, project, CAST(rn AS INTEGER) AS rank, expected, CAST(count(*) OVER (PARTITION BY corpus, project) AS INTEGER) AS missing FROM r""",
)
def q_suggestions(spark, sf):
    return quality.suggestions(quality.missing_files(_pages(spark, sf)))


@query(
    "q_indexed_projects",
    f"WITH pg AS ({PAGES}) SELECT DISTINCT corpus, regexp_extract(path, '^([^/]+)-index[.]md$', 1) AS name FROM pg WHERE ends_with(path, '-index.md') AND NOT contains(path, '/')",
)
def q_indexed_projects(spark, sf):
    return classify.indexed_projects(i.PROJECT_PAGES.df(spark, sf))


@query(
    "q_table_coverage",
    f"""WITH {METRIC_SQL}, k AS (SELECT 'wiki' AS corpus, count(*) AS known FROM part)
        SELECT corpus, CAST(sum(model_headings) AS BIGINT) AS documented, any_value(known) AS known, sum(model_headings) < any_value(known) AS short FROM pm JOIN k USING (corpus) GROUP BY corpus""",
)
def q_table_coverage(spark, sf):
    known = table(spark, sf, "part").select(F.expr("CASE WHEN p_size < 0 THEN p_brand ELSE 'wiki' END").alias("corpus"))
    return quality.table_coverage(quality.project_metrics(_pages(spark, sf)), known)


RAG = ["SYSTEM_OVERVIEW", "COMPONENTS", "FLOW", "DEPENDENCY", "ERROR_HANDLING", "BUSINESS_RULES", "CONSTRAINTS", "KEYWORDS"]


@query(
    "q_rag_sections",
    """SELECT 'r' AS corpus, concat(s_suppkey, '.rag.md') AS path, unnest(CASE WHEN s_nationkey < 10 THEN ['FLOW', 'KEYWORDS'] WHEN s_nationkey < 20 THEN ['SYSTEM_OVERVIEW'] ELSE [] END) AS section FROM supplier""",
)
def q_rag_sections(spark, sf):
    have = lambda drop: "concat(" + ", chr(10), ".join(f"'## {r}'" for r in RAG if r not in drop) + ")"
    text = f"CASE WHEN s_nationkey < 10 THEN {have(['FLOW', 'KEYWORDS'])} WHEN s_nationkey < 20 THEN {have(['SYSTEM_OVERVIEW'])} ELSE {have([])} END"
    return quality.missing_rag_sections(table(spark, sf, "supplier").selectExpr("'r' AS corpus", "concat(s_suppkey, '.rag.md') AS path", f"{text} AS content"))


@query(
    "q_openapi",
    """SELECT 'o' AS corpus, concat(s_suppkey) AS path, unnest(CASE WHEN s_acctbal < 0 THEN ['info', 'paths'] WHEN s_acctbal < 5000 THEN ['paths'] ELSE [] END) AS field FROM supplier""",
)
def q_openapi(spark, sf):
    text = """CASE WHEN s_acctbal < 0 THEN '{"openapi": "3", "x": {"info": 1}}' WHEN s_acctbal < 5000 THEN concat('openapi: 3', chr(10), 'info:', chr(10), '  paths: 1')
              ELSE '{"openapi": "3", "info": {}, "paths": {}}' END"""
    return quality.missing_openapi_fields(table(spark, sf, "supplier").selectExpr("'o' AS corpus", "concat(s_suppkey) AS path", f"{text} AS content"))


@query(
    "q_decisions",
    f"WITH pg AS ({PAGES}) SELECT corpus, CAST(sum(CASE WHEN contains(content, '未確認') THEN 1 ELSE 0 END) AS BIGINT) AS unconfirmed FROM pg GROUP BY corpus",
)
def q_decisions(spark, sf):
    return quality.unconfirmed_decisions(i.PROJECT_PAGES.df(spark, sf))


@query(
    "q_page_estimates",
    """SELECT concat('c', conv_id) AS corpus, count(*) AS chapters, CAST(sum(length(text) - length(replace(text, chr(10), '')) + 1) AS BIGINT) AS lines,
         CAST(sum(length(text)) AS BIGINT) AS chars, CAST(greatest(1, sum(length(text) - length(replace(text, chr(10), '')) + 1) // 40) AS BIGINT) AS pages
       FROM conversations GROUP BY conv_id""",
)
def q_page_estimates(spark, sf):
    return quality.page_estimates(table(spark, sf, "conversations").selectExpr("concat('c', conv_id) AS corpus", "text AS content"))
