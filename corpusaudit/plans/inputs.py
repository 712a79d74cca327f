"""Inputs derived from the given tables by projection: pages, diagrams, decks, sources, catalogs."""

from __future__ import annotations

from corpusaudit.plans.registry import FENCE, NL, Derived, cat, files_of, q, s

ORDER, CUST = s("o_orderkey"), s("o_custkey")

# native: the documents as text files of a corpus per source
DOCUMENTS = files_of("documents", "source", cat("lang", "'/'", s("doc_id"), "'.txt'"), "text", size="n_chars")

# one Markdown page per order: links, a fenced block, headings
ORDER_PAGES = files_of(
    "orders",
    "'shop'",
    cat("'orders/'", ORDER, "'.md'"),
    cat(
        "'# Order '", ORDER, NL, NL, "'Placed by [customer](../customers/'", CUST, "'.md#customer-'", CUST, "') on '",
        s("CAST(o_orderdate AS DATE)"), NL,
        "CASE WHEN o_orderstatus = 'P' THEN concat('![state](../img/', lower(o_orderpriority), '.svg) [gone](../customers/', "
        + CUST + ", '.md#open-balance)') ELSE '[mail](mailto:a@b.c) [web](https://x.example/a#b)' END",
        NL, "'[next]('", s("o_orderkey + 1"), "'.md)'", NL, FENCE, "'sql'", NL, "'select recieve from t -- # no heading'", NL,
        FENCE, NL, "'## Priority '", "o_orderpriority", NL, "CASE WHEN o_orderstatus = 'F' THEN 'recieve Seting' ELSE 'receive' END",
        NL, "'#### Detail'", NL, "'see [top](#order-'", ORDER, "')'", NL,
    ),
)
CUSTOMER_PAGES = files_of(
    "customer",
    "'shop'",
    cat("'customers/'", s("c_custkey"), "'.md'"),
    cat("'# Customer '", s("c_custkey"), NL, "c_name", NL, "'## Balance'", NL, s("c_mktsegment"), NL),
)

# documents in chunks: one document per customer, a chunk per order; fences and tables go on from chunk to chunk
ORDER_CHUNKS = Derived(
    "orders",
    {
        "corpus": "'shop'", "path": cat("'c'", CUST), "block": "CAST(floor(o_orderkey / 1000) AS BIGINT)", "seq": "CAST(o_orderkey % 1000 AS INTEGER)",
        "content": cat(
            "CASE WHEN o_orderkey % 4 = 0 THEN concat('```sql', chr(10), 'select', chr(10)) WHEN o_orderkey % 4 = 1 THEN concat('| No | テーブル名 |', chr(10), '|--|--|', chr(10))"
            " WHEN o_orderkey % 4 = 2 THEN concat('| a | t', CAST(o_orderkey AS STRING), ' |', chr(10)) ELSE concat('| b | u |', chr(10), 'end ', CAST(o_orderkey AS STRING), chr(10)) END"
        ),
    },
)
# bundles in chunks: one per conversation, a chunk per turn
BUNDLE_CHUNKS = Derived(
    "conversations",
    {
        "corpus": cat("'c'", s("conv_id")), "path": "'all'", "block": "CAST(floor(turn / 2) AS BIGINT)", "seq": "CAST(turn % 2 AS INTEGER)",
        "content": cat("'more of '", "role", NL, "CASE WHEN turn % 3 = 1 THEN concat('--- FILE: ', role, '/t', CAST(turn AS STRING), '.md ---', chr(10)) ELSE '' END", "text", NL),
    },
)

# images, one per supplier, and the pages expected to show them
IMAGES = files_of(
    "supplier",
    "'maps'",
    cat(
        "'diagrams/n'", s("s_nationkey"),
        "CASE WHEN s_acctbal < 0 THEN '-feat-f' WHEN s_acctbal < 3000 THEN '-er-e' WHEN s_acctbal < 6000 THEN '-seq-s' ELSE '-other-' END",
        s("s_suppkey"), "'.svg'",
    ),
    "''",
)
FEATURE_PAGES = files_of(
    "supplier",
    "'maps'",
    cat("'manual/n'", s("s_nationkey"), "'/features/f'", s("s_suppkey"), "'.md'"),
    cat("'shows ![x](../../../diagrams/n'", s("s_nationkey"), "CASE WHEN s_acctbal < -400 THEN '-feat-f' ELSE '-er-e' END", s("s_suppkey"), "'.svg)'"),
)
NATION_PAGES = files_of(
    "nation",
    "'maps'",
    cat("'manual/n'", s("n_nationkey"), "CASE WHEN n_regionkey < 3 THEN '/07-walkthrough.md' ELSE '/05-data-model.md' END"),
    cat("'![e](n'", s("n_nationkey"), "'-er-e'", s("n_nationkey"), "'.svg) ![s](n'", s("n_nationkey"), "'-seq-s'", s("n_nationkey"), "'.svg)'"),
)

# one page per line item that cites the source file of its part
CITING_PAGES = files_of(
    "lineitem",
    "l_returnflag",
    cat("'items/'", s("l_orderkey"), "'-'", s("l_linenumber"), "'.md'"),
    cat(
        "'stock (src/part_'", s("l_partkey"), "'.py:'", s("l_linenumber"), "'-'", s("CAST(l_quantity AS BIGINT)"), "') and <!-- source: src/part_'",
        s("l_suppkey"), "'.py:'", s("l_linenumber"), "' --> (no match:12)'",
    ),
)
PART_SOURCES = files_of(
    "part",
    "CASE WHEN p_type = 'PROMO' THEN 'A' ELSE 'N' END",
    cat("'src/part_'", s("p_partkey"), "'.py'"),
    "repeat(concat('x', chr(10)), p_size)",
)

# table names: pages and migrations per part
SNAKE = "replace(p_name, ' ', '_')"
TABLE_PAGES = files_of(
    "part",
    "p_brand",
    cat("'model/'", s("p_partkey"), "'.md'"),
    cat(
        "'| No | テーブル名 |'", NL, "'|---|---|'", NL, "'| 1 | `m_'", SNAKE, "'` |'", NL, "'| 2 | '", "p_type", "' |'", NL, "'end `'", SNAKE,
        "'s` `'", SNAKE, "'_id` `is_'", SNAKE, "'`'", NL, "'| 3 | outside |'", NL, FENCE, "'mermaid'", NL, "'erDiagram'", NL, "'  Part ||--o{ P_'",
        "p_type", "' : has'", NL, "'  Part {'", NL, "'    int id'", NL, "'  }'", NL, FENCE, NL,
    ),
)
TABLE_SOURCES = files_of(
    "part",
    "p_brand",
    cat("CASE WHEN p_size > 20 AND p_brand <> 'Brand#7' THEN 'database/migrations/' ELSE 'notes/' END", s("p_partkey"), "'.php'"),
    cat("'Schema::create('''", "'m_'", SNAKE, "''');'", "CASE WHEN p_size > 25 THEN concat('Schema::table(''', p_type, ''');') ELSE '' END"),
)

# endpoints: one page per event
ENDPOINT_PAGES = files_of(
    "events",
    cat("'u'", s("user_id")),
    cat("'api/'", s("event_id"), "'.md'"),
    cat(
        "'call GET /'", "event_type", "'/'", s("user_id"), "'?v='", s("event_id"), "' or POST /'", "event_type", "'/{id}/ now'", NL,
        "'| メソッド | パス |'", NL, "'|--|--|'", NL, "'| `put` | `/'", "event_type", "'/[key]` |'", NL, "'| COPY | /x |'", NL,
    ),
)
# Express sources: one file per event of some users
EXPRESS_SOURCES = files_of(
    "events",
    cat("'u'", s("user_id")),
    cat("'routes/'", s("event_id"), "CASE WHEN value > 60 THEN '.js' ELSE '.txt' END"),
    cat("'router.get(\"/'", "event_type", "'/:id\", f); app.PUT(\"/'", "event_type", "'/:k\")'"),
)

# bundles: one per turn of a conversation
BUNDLES = files_of(
    "conversations",
    cat("'c'", s("conv_id")),
    s("turn"),
    cat(
        "'intro '", "role", NL, "'--- FILE: docs/c'", s("conv_id"), "'/t'", s("turn"), "'.md ---'", NL, NL, "text", NL, NL, "'--- FILE: ../'", "role", "'.md ---'", NL,
        "'未確認'", NL, "'---FILE: a/../'", "role", "'/x.md ---'", NL, "'tail'",
    ),
)
# delimited client output, one per customer
OUTPUTS = files_of(
    "customer",
    cat("'c'", s("c_custkey")),
    "'out'",
    cat("'Table_Name'", "chr(9)", "'Rows'", "chr(9)", "'Note'", NL, "c_name", "chr(9)", s("c_nationkey"), NL, "c_mktsegment", "chr(9)", "'x'", "chr(9)", "' n '", NL),
)

# diagrams: one per order, with chains of nodes that share the customer
FLOWCHARTS = files_of(
    "orders",
    "o_orderpriority",
    cat("'diagrams/f'", ORDER, "'.mmd'"),
    cat(
        "CASE WHEN o_orderstatus = 'F' THEN 'flowchart TB' ELSE 'graph LR' END", NL, "'  O'", ORDER, "'[order] --> C'", CUST, "'(cust)'", NL, "'  subgraph S1[x]'", NL,
        "'    C'", CUST, "' --> D1'", NL, "'    D1 --> D2'", NL, "'  end'", NL, "'  subgraph S2'", NL, "'    E1 --> E2'", NL, "'  end'", NL,
        "CASE WHEN o_totalprice > 250000 THEN concat('  D2 --> E1', chr(10)) ELSE '' END", "'  E2 --> O'", ORDER, "'x'", NL, "'  %% A --> B'", NL,
    ),
)
STATES = files_of(
    "orders",
    "o_orderpriority",
    cat("'diagrams/s'", ORDER, "'.mmd'"),
    cat("'stateDiagram-v2'", NL, "'  [*] --> N'", CUST, NL, "'  N'", CUST, "' --> '", "o_orderstatus", NL, "'  '", "o_orderstatus", "' --> [*]'", NL),
)
# sequence diagrams: one per document, every line a message, a participant per document
MESSAGES = files_of(
    "documents",
    "source",
    cat("'seq/'", s("doc_id"), "'.mmd'"),
    cat("'sequenceDiagram'", NL, "'  participant '", "lang", NL, "'  actor A'", s("doc_id"), NL, "'  A->>B: '", "replace(text, chr(10), concat(chr(10), '  A->>B: '))"),
)
# entity diagrams: one per document, a relation per line
ENTITIES = files_of(
    "documents",
    "source",
    cat("'er/'", s("doc_id"), "'.mmd'"),
    cat("'erDiagram'", NL, "'  Doc'", s("doc_id"), "' {'", NL, "'    int id'", NL, "'  }'", NL, "'  X ||--o{ '", "lang", "' : '", "replace(text, chr(10), concat(chr(10), '  X ||--o{ Y : '))"),
)
# slide decks: one per document, a slide per line, a bullet per sentence
DECKS = files_of(
    "documents",
    "source",
    cat("'deck/'", s("doc_id"), "'.md'"),
    cat("'---'", NL, "'marp: true'", NL, "'---'", NL, "replace(replace(text, chr(10), concat(chr(10), '---', chr(10))), '. ', concat('.', chr(10), '- '))"),
)
# pages with inline diagrams: one per customer
INLINE_PAGES = files_of(
    "customer",
    "c_mktsegment",
    cat("CASE WHEN c_nationkey < 12 THEN 'manual/p' ELSE 'other/p' END", s("c_custkey"), "'/02-screen-flow.md'"),
    cat("'x'", NL, FENCE, "'mermaid'", NL, "'stateDiagram'", NL, "'a'", NL, FENCE, NL, FENCE, "'mermaid'", NL, "'bad'", NL, FENCE, NL, FENCE, "'mermaid'", NL, "'graph LR'", NL, FENCE, NL),
)
# pages that link to diagrams: one per customer
DIAGRAM_LINKS = files_of(
    "customer",
    "'maps'",
    cat("'p/'", s("c_custkey"), "'.md'"),
    cat("'![a](../d/n'", s("c_nationkey"), "'.mmd) [b](x'", s("c_custkey"), "'.mmd) ![s](q.svg)'"),
)

# chapters of a manual: one per turn of a conversation
CHAPTERS = files_of(
    "conversations",
    cat("'m'", s("conv_id")),
    "CASE WHEN turn = 3 THEN '03-features.md' WHEN role = 'assistant' THEN concat('features/t', CAST(turn AS STRING), '.md') ELSE concat('0', CAST(turn AS STRING), '-', role, '.md') END",
    "CASE WHEN role = 'user' THEN concat('# Turn ', CAST(turn AS STRING), chr(10), text) ELSE text END",
)
# feature tables: one page per part
FEATURES = files_of(
    "part",
    cat("'s'", s("p_size")),
    cat("'f'", s("p_partkey"), "'.md'"),
    cat("'# Tier '", "CASE WHEN p_type = 'PROMO' THEN '2' ELSE '9' END", NL, "'| 機能名 | d |'", NL, "'|:--|--|'", NL, "'| '", "p_name", "' View | x |'", NL, "'# Other'", NL, "'| '", "p_type", "' | tier2 |'", NL),
)
DISABLED = Derived(
    "part",
    {"corpus": "concat('s', CAST(p_size AS STRING))", "name": "concat(CASE WHEN p_retailprice < 903 THEN '' ELSE 'OLD_' END, upper(substring(p_name, 1, position(' ' IN p_name) - 1)))"},
)
# translation files: one per part
LANGUAGE_FILES = files_of(
    "part",
    "p_brand",
    cat("CASE WHEN p_size > 40 THEN 'lang/en/' WHEN p_size > 25 THEN 'lang/ja/' ELSE 'languages/ja_jp/' END", "'f'", s("p_partkey"), "CASE WHEN p_size > 25 THEN '.json' WHEN p_size > 15 THEN '.js' ELSE '.php' END"),
    "CASE WHEN p_size > 25 THEN concat('{\"a\": {\"', p_type, '\": \"V', CAST(p_partkey AS STRING), '\", \"n\": 1}, \"t\": \"', p_name, '\"}') "
    "WHEN p_size > 15 THEN concat('x = { ', chr(39), p_type, chr(39), ': ', chr(39), p_name, chr(39), ' }') "
    "ELSE concat('$languageStrings[', chr(39), 'SINGLE_', p_type, chr(39), '] = ', chr(39), 'S', CAST(p_partkey AS STRING), chr(39), '; ', chr(39), p_type, chr(39), ' => ', chr(39), p_name, chr(39), ',') END",
)


# source trees: one file per part, in a corpus per brand; folder by size, kind of file by type
FOLDERS = [
    "routes/", "app/Models/", "app/Http/Controllers/", "app/Http/Controllers/API/", "app/Services/", "app/Repositories/",
    "app/Http/Middleware/", "database/migrations/", "pages/", "pages/admin/", "store/", "stores/", "composables/", "lib/", "src/lib/",
    "middleware/", "components/", "utils/", "tests/", "latest/", "views/", "config/", "public/css/", "public/js/", "node_modules/x/",
    "dist/", "build/", "src/models/", "schemas/", "hooks/", "src/redux/", "seeds/", "spec/", "layouts/", "templates/", "docs/", "app/",
    "app/api/users/", "", "vendor/a/", "distance/", "src/components/", "src/views/", "app/components/", "src/store/", "lang/ja/",
    "db/migrate/", "migrations/", "prisma/", "helpers/",
]
ENDINGS = {
    "ECONOMY": ".php", "MEDIUM": ".vue", "PROMO": ".json", "LARGE": ".js", "SMALL": "Controller.php", "STANDARD": ".dat",
}
FOLDER_SQL = f"split_part({q('|'.join(FOLDERS))}, '|', p_size)"
ENDING_SQL = "CASE p_type " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in ENDINGS.items()) + " END"
CAMEL_SQL = "concat('Dash', upper(left(p_name, 1)), substring(p_name, 2, position(' ' IN p_name) - 2), 'API', " + s("p_partkey") + ")"
TREE = files_of(
    "part",
    "p_brand",
    cat(FOLDER_SQL, CAMEL_SQL, ENDING_SQL),
    "p_name",
    size="CAST(p_retailprice * 10 AS BIGINT)",
)
# marker files: project types by nation of the supplier
MARKERS = files_of(
    "supplier",
    cat("'Brand#'", s("s_nationkey + 1")),
    "CASE WHEN s_acctbal < 1000 THEN 'composer.json' WHEN s_acctbal < 3000 THEN 'nuxt.config.ts' WHEN s_acctbal < 5000 THEN 'package.json' "
    "WHEN s_acctbal < 6000 THEN 'next.config.js' WHEN s_acctbal < 7000 THEN 'vue.config.js' ELSE 'README.md' END",
    "CASE WHEN s_acctbal < 500 THEN '{\"require\": {\"laravel/framework\": \"^9\"}}' WHEN s_acctbal < 4000 THEN '{\"dependencies\": {\"express\": \"^4.1\"}}' ELSE '{bad' END",
    size="s_suppkey",
)
# package files: one per supplier
PACKAGES = files_of(
    "supplier",
    cat("'s'", s("s_suppkey")),
    "'package.json'",
    cat(
        "'{\"dependencies\": {\"lodash\": \"1\"'",
        "CASE WHEN s_nationkey < 5 THEN ', \"vue\": \"^2.6.1\", \"nuxt\": \"~2.15.8\", \"vuex\": \"3\"' WHEN s_nationkey < 10 THEN ', \"vue\": \">=3.2\", \"pinia\": \"1\"' "
        "WHEN s_nationkey < 15 THEN ', \"next\": \"13.1\", \"react\": \"18\"' ELSE '' END",
        "'}, \"devDependencies\": {\"tailwindcss\": \"3\"}, \"peerDependencies\": {'",
        "CASE WHEN s_nationkey >= 15 AND s_nationkey < 20 THEN '\"react-dom\": \"~17.0.2\"' ELSE '' END", "'}}'",
    ),
)
# front-end files: one per order, in the project of a supplier
FRONTEND_FILES = files_of(
    "orders",
    cat("'s'", s("o_custkey")),
    cat(
        "CASE o_orderpriority WHEN '1-URGENT' THEN 'pages/' WHEN '2-HIGH' THEN 'src/components/ui/' WHEN '3-MEDIUM' THEN 'store/' WHEN '5-LOW' THEN 'app/views/' ELSE 'other/pages/' END",
        "'f'", s("o_orderkey"), "CASE o_orderstatus WHEN 'F' THEN '.vue' WHEN 'O' THEN '.tsx' ELSE '.ts' END",
    ),
    "''",
)

# table catalogs: one table per part; columns, keys and indexes from its line items
def _table_name(key: str) -> str:
    return (
        f"concat(CASE WHEN {key} % 10 = 0 THEN 'm_' WHEN {key} % 10 = 1 THEN 'job_' ELSE 't_' END, CAST({key} AS STRING), "
        f"CASE WHEN {key} % 10 = 2 THEN '_settings' ELSE '' END)"
    )


def _database(key: str) -> str:
    return f"concat('db', CAST({key} % 7 AS STRING))"


CATALOG_TABLES = Derived(
    "part",
    {
        "corpus": _database("p_partkey"), "table_name": _table_name("p_partkey"), "table_type": "'BASE TABLE'",
        "table_rows": "CASE WHEN p_size > 10 THEN " + s("p_size") + " ELSE 'x' END", "table_comment": "p_type",
    },
)
COLUMN_SQL = (
    "CASE l_linenumber WHEN 1 THEN 'id' WHEN 2 THEN 'Name' WHEN 3 THEN 'is_active' WHEN 4 THEN 'created_at' "
    "WHEN 5 THEN 'title' WHEN 6 THEN 'deleted_at' ELSE 'amount' END"
)
CATALOG_COLUMNS = Derived(
    "lineitem",
    {
        "corpus": _database("l_partkey"), "table_name": _table_name("l_partkey"), "ordinal": "l_linenumber", "column_name": COLUMN_SQL,
        "column_type": "'int'", "is_nullable": "CASE WHEN l_linenumber = 1 THEN 'NO' ELSE 'YES' END",
        "column_default": "CASE WHEN l_linenumber = 3 THEN '1' WHEN l_linenumber = 5 THEN 'NULL' END",
        "column_key": "CASE WHEN l_linenumber = 1 THEN 'PRI' ELSE '' END",
    },
)
CATALOG_FKS = Derived(
    "lineitem",
    {
        "corpus": _database("l_partkey"), "table_name": _table_name("l_partkey"), "column_name": "concat('ref_', lower(l_returnflag), '_id')",
        "referenced_table_name": "concat('t_', lower(l_returnflag), l_linestatus)", "referenced_column_name": "'id'",
    },
)
CATALOG_INDEXES = Derived(
    "lineitem",
    {
        "corpus": _database("l_partkey"), "table_name": _table_name("l_partkey"), "index_name": "concat('ix_', lower(l_returnflag))",
        "seq": "l_linenumber", "column_name": COLUMN_SQL, "non_unique": "CASE WHEN l_returnflag = 'A' THEN '0' ELSE '1' END",
    },
)

# migrations: one file per event, a table per user
MIGRATION_FILES = files_of(
    "events",
    "'app'",
    cat("'database/migrations/'", "lpad(" + s("event_id") + ", 12, '0')", "'.php'"),
    cat(
        "CASE event_type WHEN 'signup' THEN 'Schema::create(''t_' WHEN 'purchase' THEN 'ALTER TABLE `t_' WHEN 'error' THEN 'DROP TABLE IF EXISTS `t_' WHEN 'view' THEN 'create_table :t_' ELSE 'no ' END",
        s("user_id"), "' x;'",
    ),
)

# configuration files: one per customer
ENV_FILES = files_of(
    "customer",
    cat("'c'", s("c_custkey")),
    "'.env'",
    cat(
        "'APP=1'", NL, "'DB_CONNECTION='", "CASE WHEN c_mktsegment = 'BUILDING' THEN 'MariaDB' WHEN c_mktsegment = 'MACHINERY' THEN 'pgsql' WHEN c_mktsegment = 'FURNITURE' THEN 'sqlsrv' ELSE '' END",
        NL, "'DB_HOST=\"h'", s("c_nationkey"), "'\"'", NL, "'DB_PASSWORD='", "CASE WHEN c_acctbal > 0 THEN 'secret' ELSE '' END", NL, "'DB_USERNAME='", "c_name", NL,
    ),
)

# SQL dumps: one statement per part
DUMPS = files_of(
    "part",
    "p_brand",
    cat("'dump/'", s("p_partkey"), "'.sql'"),
    cat(
        "'CREATE TABLE IF NOT EXISTS `t_'", s("p_partkey"), "'` ('", NL, "'  `id` bigint NOT NULL,'", NL, "'  `price` decimal('", s("p_size"), "',2) DEFAULT ''0.00'','", NL,
        "CASE WHEN p_size > 25 THEN concat('  `is_active` tinyint(1) DEFAULT 1,', chr(10)) ELSE '' END", "'  PRIMARY KEY (`id`),'", NL,
        "'  UNIQUE KEY `uq_x` (`id`,`price`),'", NL, "'  CONSTRAINT fk FOREIGN KEY (`price`) REFERENCES `'", "p_type", "'` (`id`)'", NL, "');'", NL,
    ),
)

# documentation sets: fifteen pages per project, one per customer
PAGES15 = [
    "architecture/{n}.md", "manual/{n}/00-index.md", "manual/{n}/01-overview.md", "manual/{n}/02-screen-flow.md",
    "manual/{n}/03-features.md", "manual/{n}/04-api-reference.md", "manual/{n}/05-data-model.md", "manual/{n}/06-screen-specs.md",
    "manual/{n}/07-walkthrough.md", "manual/{n}/08-review.md", "explanations/{n}/pro.md", "explanations/{n}/beginner.md",
    "explanations/{n}/sales.md", "decisions/{n}.md", "{n}-index.md",
]
PROJECT = "concat('p', CAST(CAST(floor(c_custkey / 15) AS BIGINT) AS STRING))"
SLOT = "(c_custkey - 15 * CAST(floor(c_custkey / 15) AS BIGINT))"


PAGE_SQL = (
    f"CASE WHEN c_mktsegment = 'FURNITURE' THEN concat('manual/', {PROJECT}, '/extra-', CAST(c_custkey AS STRING), '.md') "
    f"ELSE replace(split_part({q('|'.join(PAGES15))}, '|', CAST({SLOT} + 1 AS INT)), '{{n}}', {PROJECT}) END"
)
PROJECT_PAGES = files_of(
    "customer",
    "CASE WHEN c_nationkey < 0 THEN 'x' ELSE 'wiki' END",
    PAGE_SQL,
    cat(
        "'# '", "c_name", NL, "CASE WHEN c_acctbal > 2000 THEN '(src/a.py:12)' ELSE 'none' END", NL, "'## One'", NL, "'[a](b.md) [c](https://d) [e](#f) 未確認'", NL,
        "CASE WHEN c_acctbal > 5000 THEN '<!-- source: x.py:3 -->' ELSE '【推測】' END", NL, "'### Two'", NL,
        "CASE WHEN c_nationkey > 12 THEN 'ステータス: ok Tier 1 Tier2 Tier  3' ELSE '無効化モジュール presence=1' END", NL,
        "CASE WHEN c_nationkey > 5 THEN '## 改訂履歴 文書番号 バージョン 承認者' ELSE '#### deep' END", NL, FENCE, "'mermaid'", NL, "'graph LR'", NL, "'## not a heading'", NL, FENCE, NL,
        "'| m | p |'", NL, "'|---|---|'", NL, "repeat(concat('| GET | /x |', chr(10)), CAST(c_nationkey AS INT))",
    ),
)
