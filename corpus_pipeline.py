"""From documents to token files: language, near-duplicates, benchmark, mixture, tokens.

Stages decide by row: a document is known by its id, a hash of its whole text and one of its other columns, so rows
with null or repeated ids but other texts are documents of their own, and only rows equal in all columns are one.
Each stage works on all that the one before kept, and passes on the columns of ``documents``; the last returns what
it reads back from the files it wrote. A null text counts as empty and is rejected by the first stage, as is a text
without letters; an empty table gives an empty result at every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusaudit.llm import decontaminate, language, mixing, simhash_wide, token_files
from corpusaudit.llm.common import shared_path, table, written
from corpusaudit.session import configure

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
KEY = "document_key"


def keyed(docs: DataFrame) -> DataFrame:
    """``document_key``, ordered by id, null ids last, then by text; what the operators read; and ``document``, all
    columns of a document in one, so that none meets a column of the work on them, whatever its name."""
    whole = [F.col(f"`{c}`") for c in docs.columns]
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.sha2("text", 256).alias("text"), F.xxhash64(F.lit(0), *others).alias("others"))
    return docs.select(key.alias(KEY), "doc_id", "text", "source", F.struct(*whole).alias("document"))


def unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` out of keyed rows."""
    return rows.select(*[F.col("document").getField(c).alias(c) for c in docs.columns])


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labels teach; the rest goes."""
    model = language.fit_language_model(docs, calibrate=True)
    return language.keep_known_languages(docs, model)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are near by their shingles of five words the one with the smallest key; of equal rows, one."""
    rows = keyed(docs)
    kept = simhash_wide.similar_documents(rows, id_col=KEY).where(F.col(KEY) == F.col("component_id"))
    kept = kept.select(F.col(KEY).alias("kept_key")).distinct()
    return unpacked(rows.join(kept, F.col(KEY) == F.col("kept_key"), "left_semi").dropDuplicates([KEY]), docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item; one of fewer than five words, such as a bare answer, has to be all the text."""
    rows = keyed(docs)
    hits = decontaminate.contaminated(rows, table(spark, sf_dir, "benchmark"), id_col=KEY, least_words=decontaminate.SHINGLE)
    hits = written(hits.select(F.col(KEY).alias("hit_key")).distinct(), "hits")
    return unpacked(rows.join(hits, F.col(KEY) == F.col("hit_key"), "left_anti"), docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; documents that it leaves out go."""
    rows = keyed(docs)
    mix = mixing.mix_sources(rows, table(spark, sf_dir, "labels"), id_col=KEY, label_col="doc_id")
    taken = mix.groupBy(F.col(KEY).alias("taken_key")).agg(F.sum("copies").alias("copies")).where("copies > 0")
    rows = rows.join(taken, F.col(KEY) == F.col("taken_key")).dropDuplicates([KEY])
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return unpacked(rows, docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and what they hold for each document."""
    path = shared_path(spark, "pipeline-tokens")
    token_files.write_token_files(docs, path, public_tokenizers.path(TOKENIZER), END_ID)
    return token_files.read_token_files(spark, path)


STAGES = [
    ("language", known_languages),
    ("near_duplicates", one_of_each_group),
    ("benchmark", without_benchmark),
    ("mixture", mixed),
    ("tokens", token_output),
]

#: Fitted models, samples and token files are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each result is written and read again."""
    configure(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
