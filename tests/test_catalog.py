import json

from pyspark.sql import functions as F

from corpusaudit import schemas
from corpusaudit.operators import catalog, classify, dbconfig, frameworks, migrations
from tests.conftest import rows

# Path, project type, expected class.
PATHS = [
    ("routes/api.php", "laravel", "critical"), ("app/Models/User.php", "laravel", "critical"),
    ("app/Http/Controllers/UserController.php", "laravel", "critical"), ("app/api/users/route.ts", "nextjs", "critical"),
    ("app/page.tsx", "nextjs", "critical"), ("pages/index.vue", "nuxt", "critical"), ("routes/users.js", "express", "critical"),
    ("app/Services/UserService.php", "laravel", "high"), ("app/Repositories/UserRepository.php", "laravel", "high"),
    ("app/Http/Middleware/Auth.php", "laravel", "high"), ("store/index.js", "nuxt", "high"),
    ("database/migrations/2024_create_users.php", "laravel", "high"), ("components/Button.vue", "nuxt", "medium"),
    ("utils/helpers.ts", "generic", "medium"), ("tests/Feature/UserTest.php", "laravel", "medium"),
    ("package-lock.json", "generic", "low"), ("public/images/logo.png", "generic", "low"), ("public/css/app.css", "generic", "low"),
    (".env.example", "generic", "low"), ("composer.lock", "generic", "low"), ("pages/index.tsx", "nextjs", "critical"),
    ("app/layout.tsx", "nextjs", "critical"), ("main.py", "generic", "critical"), ("models/User.py", "generic", "critical"),
    ("schemas/user.ts", "generic", "critical"), ("composables/useAuth.ts", "nuxt", "high"), ("lib/db.ts", "nextjs", "high"),
    ("src/lib/utils.ts", "nextjs", "high"), ("middleware/auth.js", "express", "high"), ("hooks/useAuth.ts", "generic", "high"),
    ("migrations/001_init.sql", "generic", "high"), ("app.spec.ts", "generic", "medium"), ("app.test.ts", "generic", "medium"),
    ("app.test.js", "generic", "medium"), ("views/home.html", "generic", "medium"), ("layouts/default.vue", "nuxt", "medium"),
    ("config.yaml", "generic", "medium"), ("data.dat", "generic", "low"), ("public/js/app.js", "generic", "low"),
    ("pages/about.vue", "vue", "critical"), ("store/auth.js", "vue", "high"), ("latest/x.dat", "generic", "medium"),
]


def test_categories(spark):
    df = spark.createDataFrame([(p, t.split("+"), e) for p, t, e in PATHS], "path STRING, types ARRAY<STRING>, want STRING")
    got = df.select("path", "want", classify.category(F.col("path"), F.col("types")).alias("got"))
    assert rows(got.where("got <> want")) == []
    assert rows(df.where("path = 'latest/x.dat'").select(classify.category(F.col("path"), F.col("types"), anchored=True).alias("c"))) == [("low",)]


def test_project_types_and_manifest(spark):
    df = spark.createDataFrame(
        [
            ("l", "composer.json", '{"require": {"laravel/framework": "^9"}}', 8),
            ("l", "nuxt.config.js", "", 0), ("l", "app/Models/U.php", "x", 41), ("l", "node_modules/a.js", "x", 4),
            ("b", "composer.json", "{bad", 4), ("b", "lib/dist.py", "x", 7), ("b", "vue.config.js", "", 1),
            ("e", "package.json", '{"devDependencies": {"express": "4"}}', 3), ("e", "sub/next.config.js", "", 1), ("g", "x.py", "", 9),
        ],
        "corpus STRING, path STRING, content STRING, size BIGINT",
    )
    typed = classify.with_project_types(df)
    got = {r.corpus: r.project_types for r in typed.select("corpus", "project_types").distinct().collect()}
    assert got == {"l": ["laravel", "nuxt"], "b": ["vue"], "e": ["express"], "g": ["generic"]}
    listed = classify.manifest(typed)
    assert rows(listed.where("corpus = 'l'"), "path", "category", "tokens_est") == [
        ("app/Models/U.php", "critical", 10), ("composer.json", "medium", 2), ("nuxt.config.js", "medium", 0),
    ]
    total = classify.manifest_totals(listed).where("category is null and corpus = 'l'")
    assert rows(total, "files", "bytes", "tokens") == [(3, 49, 12)]
    assert [r.path for r in classify.read_order(listed).collect() if r.corpus == "l"][0] == "app/Models/U.php"
    assert rows(classify.count_source_files(df).where("corpus='l'")) == [("l", 3)]


def test_paths_predicates(spark):
    df = spark.createDataFrame([(p,) for p in ["a/node_modules/x", "node_modules2/x", "x/.DS_Store", "d.mmd", "db/migrate/1.rb", "db/migrate/s/1.rb", ".env", "lang/ja/a/b.php", "lang/ja/a.txt"]], "path STRING")
    p = F.col("path")
    assert rows(df.where(classify.is_excluded(p))) == [("a/node_modules/x",)]
    assert rows(df.where(classify.is_package_excluded(p))) == [("d.mmd",), ("x/.DS_Store",)]
    assert rows(df.where(classify.is_migration(p))) == [("db/migrate/1.rb",)]
    assert rows(df.where(classify.is_db_config(p))) == [(".env",)]
    assert rows(df.where(classify.is_language_file(p))) == [("lang/ja/a/b.php",)]


def test_frameworks(files):
    pkg = lambda **d: json.dumps(d)
    df = files(
        ("a", "package.json", pkg(dependencies={"vue": "^2.6.1", "nuxt": "~2.15.8", "vuex": "3"}, devDependencies={"tailwindcss": "1"})),
        ("a", "pages/index.vue", ""), ("a", "src/components/x/B.vue", ""), ("a", "store/i.js", ""), ("a", "pages/x.ts", ""),
        ("b", "package.json", pkg(peerDependencies={"react-dom": ">=17.0"}, dependencies={"@mui/material": "5"})),
        ("b", "src/router/index.ts", ""), ("b", "src/views/A.tsx", ""), ("b", "other/views/A.tsx", ""),
        ("c", "package.json", pkg(dependencies={"lodash": "1"})), ("d", "package.json", "nope"),
    )
    got = rows(frameworks.frontends(df))
    assert got == [
        ("a", "nuxt2", "2.15.8", "tailwindcss", "vuex", "file-based", 1, 1, 1),
        ("b", "react", "17.0", "material-ui", None, "config-based", 1, 0, 0),
    ]


def test_first_method(spark):
    a = spark.createDataFrame([("c", "p", "source")], "corpus STRING, path STRING, method STRING")
    b = spark.createDataFrame([("c", "p", "sibling"), ("c", "q", "sibling")], "corpus STRING, path STRING, method STRING")
    assert rows(frameworks.first_method(a, b)) == [("c", "p", "source"), ("c", "q", "sibling")]


def cat(spark):
    tables = spark.createDataFrame(
        [("c", t, "TABLE", n, "") for t, n in [("users", "12"), ("user_roles", "x"), ("m_pref", None), ("job_queue", "1"), ("orders", "3"), ("app_settings", "1")]],
        schemas.CATALOG_TABLES,
    )
    col = lambda t, i, n, k="", null="YES", d=None: ("c", t, i, n, "int", null, d, k)
    columns = spark.createDataFrame(
        [
            col("users", 1, "id", "PRI", "NO"), col("users", 2, "Name", d="NULL"), col("users", 3, "is_active", d="1"),
            col("user_roles", 1, "user_id", "PRI"), col("user_roles", 2, "role_id", "PRI"), col("m_pref", 1, "v"),
            col("job_queue", 1, "id"), col("orders", 1, "id"), col("orders", 2, "created_at"), col("orders", 3, "user_id"),
            col("app_settings", 1, "value"),
        ],
        schemas.CATALOG_COLUMNS,
    )
    fks = spark.createDataFrame(
        [("c", "user_roles", "user_id", "users", "id"), ("c", "user_roles", "role_id", "roles", "id"), ("c", "orders", "user_id", "users", "id")],
        schemas.CATALOG_FKS,
    )
    idx = spark.createDataFrame([("c", "users", "uq", 2, "b", "0"), ("c", "users", "uq", 1, "a", "0")], schemas.CATALOG_INDEXES)
    return tables, columns, fks, idx


def test_catalog(spark):
    c = catalog.assemble(*cat(spark)).cache()
    kinds = {r.table_name: r.kind for r in c.collect()}
    assert kinds == {"users": "M", "user_roles": "R", "m_pref": "M", "job_queue": "S", "orders": "T", "app_settings": "T"}
    u = c.where("table_name = 'users'").collect()[0]
    assert [x.name for x in u["columns"]] == ["id", "Name", "is_active"] and u.primary_key == ["id"]
    assert u["columns"][0].nullable is False and u["columns"][1].default is None and u["columns"][2].default == "1"
    assert u.indexes[0].columns == ["a", "b"] and u.indexes[0].unique and u.row_count == 12 and u.label_columns == ["Name"]
    assert ("c", "active_flag_tables", "users", "is_active") in rows(catalog.manifest_rows(c))
    assert ("c", "settings_tables", "app_settings", "") in rows(catalog.manifest_rows(c))
    assert rows(catalog.kind_counts(c)) == [("c", "M", 2), ("c", "R", 1), ("c", "S", 1), ("c", "T", 2)]
    assert json.loads(catalog.entry_json(c).where("table_name='users'").collect()[0].entry)["kind"] == "M"


def test_active_counts(spark):
    df = spark.createDataFrame([(1, 0, None, "a"), (0, 1, "2024", "b"), (None, 0, None, "c")], "is_active INT, is_deleted INT, deleted_at STRING, name STRING")
    got = rows(catalog.active_counts(df, "t", ["is_active", "is_deleted", "deleted_at"]))
    assert got == [("t", "deleted_at", 3, 2, 1, False), ("t", "is_active", 3, 1, 1, True), ("t", "is_deleted", 3, 2, 1, False)]
    assert [r.name for r in catalog.label_values(df, ["is_active"], ["name"]).collect()] == ["a", "b", "c"]


DDL = """CREATE TABLE IF NOT EXISTS `users` (
  `id` bigint NOT NULL,
  `price` decimal(10,2) DEFAULT '0.00',
  `is_active` tinyint(1) DEFAULT 1,
  PRIMARY KEY (`id`),
  UNIQUE KEY `uq_x` (`id`,`price`),
  CONSTRAINT fk FOREIGN KEY (`price`) REFERENCES `prices` (`id`)
);
create table "logs" (id int, note text);"""


def test_dump(files):
    older = 'create table logs (gone int);'
    got = catalog.dump_catalog(files(("c", "dump.sql", DDL), ("c", "a.sql", older))).orderBy("table_name").collect()
    assert [r.table_name for r in got] == ["logs", "users"]
    u = got[1]
    assert [x.name for x in got[0]["columns"]] == ["id"]  # one definition per line
    assert [(x.name, x.type, x.nullable, x.default) for x in u["columns"]] == [
        ("id", "bigint", False, None), ("price", "decimal(10,2)", True, "0.00"), ("is_active", "tinyint(1)", True, "1"),
    ]
    assert u.primary_key == ["id"] and u.kind == "M"
    assert tuple(u.foreign_keys[0]) == ("price", "prices", "id")
    assert u.indexes[0].name == "uq_x" and u.indexes[0].columns == ["id", "price"] and u.indexes[0].unique


def test_source_precedence(spark):
    mk = lambda *r: spark.createDataFrame(list(r), "corpus STRING, table_name STRING")
    got = catalog.pick_source(mk(("a", "live")), mk(("a", "dump"), ("b", "dump")), mk(("b", "mig"), ("c", "mig")))
    assert rows(got, "corpus", "table_name") == [("a", "live"), ("b", "dump"), ("c", "mig")]


def test_migrations(files):
    df = files(
        ("c", "m/001.php", "Schema::create('users'); CREATE TABLE IF NOT EXISTS logs (x)"),
        ("c", "m/002.sql", "ALTER TABLE users ADD x; alter table users add y; ALTER TABLE ghosts ADD z"),
        ("c", "m/003.rb", "drop_table :logs\nchange_table :users"),
        ("c", "m/004.txt", "CREATE TABLE no"),
        ("c", "m/000.sql", "ALTER TABLE users ADD early; DROP TABLE IF EXISTS logs"),
    )
    ev = migrations.migration_events(df)
    assert rows(migrations.table_history(ev)) == [("c", "logs", "001.php", 0, True, "003.rb"), ("c", "users", "001.php", 2, False, None)]
    assert rows(migrations.changes(ev)) == [("c", "users", "002.sql"), ("c", "users", "003.rb")]
    assert rows(migrations.live_tables(migrations.table_history(ev))) == [("c", "users")]


def test_db_configs(files, spark):
    df = files(
        ("c", ".env", "DB_CONNECTION=mysql\nDB_HOST='h'\nDB_PASSWORD=top\nDB_PORT=3306"),
        ("c", ".env.local", "DB_HOST=x\nDB_PASSWORD=\n"), ("c", ".env.production", "APP=1"),
        ("c", "prisma/schema.prisma", 'provider = "postgresql"\nurl = env("DB_URL")'),
        ("c", "src/main/resources/application.properties", "spring.datasource.url=jdbc:mariadb://u:p@h/db\nspring.datasource.username=bob"),
        ("c", "config/settings.py", "DATABASES = {\n 'default': {\n 'ENGINE': 'django.db.backends.sqlite3',\n },\n 'two': {'ENGINE': 'x.oracle'}\n}\n"),
    )
    got = rows(dbconfig.db_configs(df), "source_file", "type", "host", "username", "has_password", "detail")
    assert got == [
        (".env", "mysql", "h", None, True, None), (".env.local", "unknown", "x", None, None, None),
        ("config/settings.py", "oracle", None, None, None, "two"), ("config/settings.py", "sqlite", None, None, None, "default"),
        ("prisma/schema.prisma", "postgresql", None, None, None, "DB_URL"),
        ("src/main/resources/application.properties", "mysql", None, "bob", False, "jdbc:mariadb://<redacted>@h/db"),
    ]
    d = spark.createDataFrame([("postgres://bob:pw@h:5432/shop",), ("x://a:b@",)], "d STRING").select(dbconfig.parse_dsn(F.col("d")).alias("p")).select("p.*")
    assert rows(d) == [("postgresql", "bob", "h", "5432", "shop", True, None), (None, None, None, None, None, None, "x://<redacted>@")]
    drivers = [("mysql", "mysql"), ("MariaDB", "mysql"), ("pgsql", "postgresql"), ("mssql", "sqlserver"), ("MongoDB", "mongodb"), ("", "unknown"), ("db2", "db2")]
    df = spark.createDataFrame(drivers, "d STRING, want STRING").select("want", dbconfig.normalise_driver(F.col("d")).alias("got"))
    assert rows(df.where("got <> want")) == []
