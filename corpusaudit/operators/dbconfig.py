"""Database connection settings found in configuration files. Secrets are reduced to a flag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values: (words contained in a driver name, type), first match wins.
DRIVERS = [
    ("mysql|mariadb", "mysql"),
    ("postgres|pgsql|pg", "postgresql"),
    ("sqlite", "sqlite"),
    ("sqlserver|mssql", "sqlserver"),
    ("oracle", "oracle"),
    ("mongo", "mongodb"),
    ("redis", "redis"),
]
ENV_KEYS = {"host": "DB_HOST", "port": "DB_PORT", "database": "DB_DATABASE", "username": "DB_USERNAME", "driver": "DB_CONNECTION"}
DSN = r"^(\w+)://(?:(\w+)(?::([^@]*))?@)?([^/:]+)(?::(\d+))?/(\w+)"
SCHEMA = ["corpus", "source_file", "type", "host", "port", "database", "username", "has_password", "detail"]


def normalise_driver(driver: Column) -> Column:
    low = F.lower(driver)
    chain = F.when(low.isNull() | (low == ""), "unknown")
    for words, name in DRIVERS:
        chain = chain.when(low.rlike(words), name)
    return chain.otherwise(low)


def _found(text: Column, regex: str, group: int = 1) -> Column:
    return F.when(text.rlike(regex), F.regexp_extract(text, regex, group))


def _env(key: str) -> Column:
    value = _found(F.col("content"), rf"(?m)^{key}[ \t]*=[ \t]*(\S[^\n]*)$")
    return F.regexp_replace(F.trim(value), "^[\"']+|[\"']+$", "")


def _entry(**cols: Column) -> Column:
    null = F.lit(None).cast("string")
    cols.setdefault("has_password", F.lit(None).cast("boolean"))
    return F.struct(*[cols.get(c, null).alias(c) for c in SCHEMA[2:]])


def db_configs(files: DataFrame) -> DataFrame:
    """One row per connection: source file, type, host, port, database, user, has_password, detail. One pass over the files."""
    path, text = F.col("path"), F.col("content")
    is_env = path.rlike(r"^\.env(\.[a-z]+)?$") & text.rlike(r"(?m)^DB_(HOST|PORT|DATABASE|USERNAME|PASSWORD|CONNECTION)[ \t]*=[ \t]*\S")
    values = {k: _env(v) for k, v in ENV_KEYS.items() if k != "driver"}
    env = _entry(type=normalise_driver(_env(ENV_KEYS["driver"])), has_password=_env("DB_PASSWORD") != "", **values)

    provider = r'provider\s*=\s*"(\w+)"'
    is_prisma = (path == "prisma/schema.prisma") & text.rlike(provider)
    env_var = F.coalesce(_found(text, r'url\s*=\s*env\("(\w+)"\)'), F.lit("DATABASE_URL"))
    prisma = _entry(type=normalise_driver(F.regexp_extract(text, provider, 1)), detail=env_var)

    url = r"spring\.datasource\.url\s*=\s*(\S[^\n]*)"
    is_spring = path.endswith(".properties") & text.rlike(url)
    address = F.trim(F.regexp_extract(text, url, 1))
    spring = _entry(
        type=normalise_driver(F.regexp_extract(address, r"jdbc:(\w+):", 1)),
        username=F.trim(_found(text, r"spring\.datasource\.username\s*=\s*(\S[^\n]*)")),
        has_password=text.rlike(r"spring\.datasource\.password\s*=\s*\S"),
        detail=F.regexp_replace(address, "://[^@]+@", "://<redacted>@"),
    )

    block = r"(?s)DATABASES\s*=\s*\{(.+?)\n\}"
    engine = r"""(?s)['"](\w+)['"]\s*:\s*\{[^{}]*?['"]ENGINE['"]\s*:\s*['"]([^'"]+)['"]"""
    is_django = path.endswith("settings.py") & text.rlike(block)
    found = F.regexp_extract_all(F.regexp_extract(text, block, 1), F.lit(engine), F.lit(0))
    django = F.transform(found, lambda x: _entry(type=normalise_driver(F.substring_index(F.regexp_extract(x, engine, 2), ".", -1)), detail=F.regexp_extract(x, engine, 1)))

    entries = F.when(is_env, F.array(env)).when(is_prisma, F.array(prisma)).when(is_spring, F.array(spring)).when(is_django, django)
    each = files.select("corpus", path.alias("source_file"), F.explode_outer(entries).alias("r")).where(F.col("r").isNotNull())
    return each.select("corpus", "source_file", "r.*")


def parse_dsn(dsn: Column) -> Column:
    """Parts of an address; the password is not among them. ``redacted`` is set when it cannot be read."""
    part = lambda n: F.nullif(F.regexp_extract(dsn, DSN, n), F.lit(""))
    ok = dsn.rlike(DSN)
    return F.struct(
        F.when(ok, normalise_driver(part(1))).alias("type"),
        part(2).alias("username"),
        part(4).alias("host"),
        part(5).alias("port"),
        part(6).alias("database"),
        F.when(ok, part(3).isNotNull()).alias("has_password"),
        F.when(~ok, F.regexp_replace(dsn, "://[^@]+@", "://<redacted>@")).alias("redacted"),
    )
