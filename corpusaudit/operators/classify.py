"""Files of a source tree: exclusion, project types, priority class, manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusaudit import schemas
from corpusaudit.functions import globs, paths
from corpusaudit.functions.text import estimate_tokens
from corpusaudit.operators.joins import join_per_corpus

# Fixed values.
EXCLUDED_DIRS = [
    "node_modules", "vendor", ".git", "dist", "build", "__pycache__", ".next", ".nuxt", ".output", ".cache",
    "coverage", ".idea", ".vscode",
]
COUNT_SKIP_DIRS = ["node_modules", "vendor", ".git", "dist", "build", "__pycache__", ".next", ".nuxt", ".cache"]
CATEGORIES = ["critical", "high", "medium", "low"]
ASSET_EXTENSIONS = [
    ".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".webp", ".woff", ".woff2", ".ttf", ".eot", ".otf",
    ".mp3", ".mp4", ".avi", ".mov", ".webm", ".pdf", ".zip", ".tar", ".gz",
]
LOW_FILES = [
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "composer.lock", "Gemfile.lock", "poetry.lock",
    "Pipfile.lock", ".env.example", ".env.local", ".gitignore", ".gitattributes", ".editorconfig",
    ".prettierrc", ".prettierrc.json", ".eslintrc", ".eslintrc.json", ".eslintrc.js", "tsconfig.json",
    "tailwind.config.js", "tailwind.config.ts", "postcss.config.js", "postcss.config.mjs",
    "babel.config.js", "webpack.config.js", "vite.config.js", "vite.config.ts",
]
ENTRY_POINTS = ["main.py", "main.ts", "main.js", "index.ts", "index.js", "app.py", "app.ts", "app.js"]
CODE_EXTENSIONS = [
    ".py", ".js", ".ts", ".jsx", ".tsx", ".vue", ".php", ".rb", ".go", ".rs", ".java", ".kt", ".swift", ".c",
    ".cpp", ".h", ".css", ".scss", ".sass", ".less", ".html", ".htm", ".xml", ".sql", ".graphql", ".gql", ".sh",
    ".bash", ".zsh", ".yaml", ".yml", ".toml", ".ini", ".cfg", ".md", ".mdx", ".txt", ".rst", ".json",
]
PACKAGE_EXCLUDED_NAMES = [".DS_Store", "__pycache__", "Thumbs.db"]
PACKAGE_EXCLUDED_EXTENSIONS = [".mmd"]
MIGRATION_DIRS = [
    "database/migrations", "migrations", "db/migrate", "db/migrations", "alembic/versions", "src/migrations",
    "prisma/migrations", "drizzle/migrations", "knex/migrations", "typeorm/migrations",
]
DB_CONFIG_FILES = [
    ".env", ".env.local", ".env.development", ".env.production", "config/database.php", "config/database.yml",
    "config/database.yaml", "knexfile.js", "knexfile.ts", "prisma/schema.prisma", "drizzle.config.ts",
    "drizzle.config.js", "typeorm.config.ts", "ormconfig.json", "ormconfig.ts", "sequelize.config.js",
    "config/config.json", "database.yml", "alembic.ini", "sqlalchemy.url", "settings.py", "config/settings.py",
    "config/application.yml", "src/main/resources/application.properties", "src/main/resources/application.yml",
]
LANGUAGE_DIRS = ["languages/ja_jp", "lang/ja", "locales/ja", "i18n/ja", "resources/lang/ja"]

# project type -> classes of paths below the corpus root, tested in the order of the classes
CRITICAL_PREFIXES = {
    "laravel": ["routes/", "app/Models/", "app/Http/Controllers/"],
    "nuxt": ["pages/"],
    "vue": ["pages/"],
    "nextjs": ["pages/"],
    "express": ["routes/"],
}
HIGH_PREFIXES = {
    "laravel": ["app/Services/", "app/Repositories/", "app/Http/Middleware/", "database/migrations/"],
    "nuxt": ["store/", "stores/", "composables/"],
    "vue": ["store/", "stores/", "composables/"],
    "nextjs": ["lib/", "src/lib/"],
    "express": ["middleware/"],
}
GENERIC_CRITICAL = "models?|schemas?|entities"
GENERIC_HIGH = "services?|repositories|middleware|store|redux|hooks|migrations?|seeds?|factories"
GENERIC_MEDIUM = "components?|utils?|helpers?|lib|tests?|spec|__tests__|views?|layouts?|templates?"


def in_dirs(path: Column, names: list[str]) -> Column:
    """Some segment of the path is one of the names."""
    return path.rlike("(^|/)(" + "|".join(globs.literal(n) for n in names) + ")(/|$)")


def is_excluded(path: Column) -> Column:
    return in_dirs(path, EXCLUDED_DIRS)


def is_package_excluded(path: Column) -> Column:
    return in_dirs(path, PACKAGE_EXCLUDED_NAMES) | paths.extension(path).isin(PACKAGE_EXCLUDED_EXTENSIONS)


def is_migration(path: Column) -> Column:
    return paths.dirname(path).isin(MIGRATION_DIRS)


def is_db_config(path: Column) -> Column:
    return path.isin(DB_CONFIG_FILES)


def is_language_file(path: Column) -> Column:
    return path.rlike("^(" + "|".join(LANGUAGE_DIRS) + r")/.*\.(php|json|js)$")


def _folder(words: str, anchored: bool) -> str:
    return f"(?i){'(^|/)' if anchored else ''}({words})/"


def _under(path: Column, types: Column, table: dict[str, list[str]]) -> Column:
    hit = F.lit(False)
    for kind, prefixes in table.items():
        hit = hit | (F.array_contains(types, kind) & path.rlike(globs.prefix_of(prefixes)))
    return hit


def category(path: Column, types: Column, anchored: bool = False) -> Column:
    """critical / high / medium / low. First class that matches wins.

    The generic folder words are searched anywhere, so ``latest/`` reads as ``test/``; ``anchored`` makes
    them whole segments.
    """
    name, ext = paths.basename(path), paths.extension(path)
    low = (
        name.isin(LOW_FILES)
        | ext.isin(ASSET_EXTENSIONS)
        | path.rlike("^public/(css|js)/")
        | F.startswith(name, F.lit(".env"))
    )
    next_page = F.array_contains(types, "nextjs") & path.rlike("^app/") & name.rlike(r"^(page|route|layout)\.")
    critical = (
        _under(path, types, CRITICAL_PREFIXES)
        | next_page
        | (name.isin(ENTRY_POINTS) & ~F.contains(path, F.lit("/")))
        | (path.rlike(_folder(GENERIC_CRITICAL, anchored)) & ~F.array_contains(types, "laravel"))
    )
    high = _under(path, types, HIGH_PREFIXES) | path.rlike(_folder(GENERIC_HIGH, anchored))
    medium = (
        path.rlike(_folder(GENERIC_MEDIUM, anchored))
        | name.rlike(r"\.(test\.ts|test\.js|spec\.ts)$")
        | ext.isin(CODE_EXTENSIONS)
    )
    return F.when(low, "low").when(critical, "critical").when(high, "high").when(medium, "medium").otherwise("low")


def manifest_json(content: Column) -> Column:
    """Dependency maps of a package file; NULL when it is not JSON."""
    return F.from_json(content, schemas.PACKAGE_MANIFEST)


MARKER_FILES = [
    "composer.json", "package.json", "nuxt.config.js", "nuxt.config.ts", "vue.config.js", "next.config.js",
    "next.config.mjs", "next.config.ts",
]


def project_types(files: DataFrame) -> DataFrame:
    """corpus, project_types of the corpora that have marker files at their root."""
    p = F.col("path")
    named = lambda *names: F.bool_or(p.isin(*names))
    deps = manifest_json(F.col("content"))
    keys = lambda k: F.coalesce(F.map_keys(deps[k]), F.array().cast("array<string>"))
    laravel = F.exists(F.concat(keys("require"), keys("require-dev")), lambda k: F.contains(k, F.lit("laravel")))
    express = F.array_contains(F.concat(keys("dependencies"), keys("devDependencies")), "express")
    flags = (
        files.where(p.isin(MARKER_FILES))
        .groupBy("corpus")
        .agg(
            F.bool_or((p == "composer.json") & laravel).alias("laravel"),
            named("nuxt.config.js", "nuxt.config.ts").alias("nuxt"),
            named("vue.config.js").alias("vue"),
            named("next.config.js", "next.config.mjs", "next.config.ts").alias("nextjs"),
            F.bool_or((p == "package.json") & express).alias("express"),
        )
    )
    kinds = F.array_compact(
        F.array(
            F.when(F.col("laravel"), "laravel"),
            F.when(F.col("nuxt"), "nuxt"),
            F.when(F.col("vue") & ~F.col("nuxt"), "vue"),
            F.when(F.col("nextjs"), "nextjs"),
            F.when(F.col("express"), "express"),
        )
    )
    return flags.select("corpus", kinds.alias("project_types")).where(F.size("project_types") > 0)


def with_project_types(files: DataFrame) -> DataFrame:
    """Files with the types of their corpus (``[generic]`` without markers), safe for a large corpus."""
    typed = join_per_corpus(files, project_types(files), ["path"])
    return typed.withColumn("project_types", F.coalesce("project_types", F.array(F.lit("generic"))))


def manifest(files: DataFrame, anchored: bool = False) -> DataFrame:
    """corpus, path, size, tokens_est, category, read_rank of the files that are not excluded.

    Needs ``project_types``. The reading order of a corpus is ``read_rank, path``.
    """
    kept = files.where(~is_excluded(F.col("path")))
    cat = category(F.col("path"), F.col("project_types"), anchored)
    return kept.select(
        "corpus", "path", "size", estimate_tokens(F.col("size")).alias("tokens_est"), cat.alias("category")
    ).withColumn("read_rank", F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), F.col("category")))


def manifest_totals(listed: DataFrame) -> DataFrame:
    """Files and tokens per category and, with category NULL, per corpus."""
    return listed.groupingSets(
        [[F.col("corpus"), F.col("category")], [F.col("corpus")]], "corpus", "category"
    ).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.sum("tokens_est").alias("tokens"))


def read_order(listed: DataFrame) -> DataFrame:
    return listed.orderBy("corpus", "read_rank", "path")


def count_source_files(files: DataFrame) -> DataFrame:
    return files.where(~in_dirs(F.col("path"), COUNT_SKIP_DIRS)).groupBy("corpus").agg(F.count("*").alias("file_count"))


def directory_listing(files: DataFrame) -> DataFrame:
    """Folder listing as rows in order: corpus, folder, name. A folder may hold any number of files."""
    return files.where(~in_dirs(F.col("path"), COUNT_SKIP_DIRS)).select(
        "corpus",
        F.when(F.contains("path", F.lit("/")), paths.dirname(F.col("path"))).otherwise(".").alias("folder"),
        paths.basename(F.col("path")).alias("name"),
    )


def project_of(path: Column) -> Column:
    """Project a documentation file belongs to, by the fixed path templates; NULL when it has none."""
    templates = [
        r"^architecture/([^/]+?)(?:\.rag)?\.md$",
        r"^(?:manual|explanations)/([^/]+)/.*\.md$",
        r"^decisions/([^/]+)\.md$",
        r"^([^/]+)-(?:index\.md|llms\.txt|AGENTS\.md)$",
        r"^meta/([^/]+)\.yaml$",
    ]
    return F.coalesce(*[F.nullif(F.regexp_extract(path, t, 1), F.lit("")) for t in templates])


def indexed_projects(files: DataFrame) -> DataFrame:
    """Projects that have an index page at the top: corpus, name."""
    name = F.regexp_extract("path", r"^([^/]+)-index\.md$", 1)
    return files.select("corpus", name.alias("name")).where(F.col("name") != "").distinct()


# kinds of stored files; a check reads the partitions of its kinds
KINDS = [".md", ".mmd", ".svg", ".yaml", ".yml", ".json"]


def kind_of(path: Column) -> Column:
    """Partition of a stored file: the checks read different ones."""
    ext = paths.extension(path)
    chain = F.when(ext.isin(*KINDS), F.substring(ext, 2, 8))
    return chain.otherwise("other")


def with_suffix(files: DataFrame, suffixes: Sequence[str]) -> DataFrame:
    """Files with one of the suffixes. A stored table is pruned to the partitions that can hold them."""
    keep = F.lit(False)
    for s in suffixes:
        keep = keep | F.col("path").endswith(s)
    if "kind" in files.columns:
        files = files.where(F.col("kind").isin(*{s[1:] if s in KINDS else "other" for s in suffixes}))
    return files.where(keep)
