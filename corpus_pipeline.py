"""A training-data pipeline over ``documents``: five operators in a row.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet to the shared folder and read again as the next stage's
``docs``.  All stages but the last return the columns of ``documents``.

* ``language``: drops texts that have no letter, texts whose best language is
  not more likely than all others together, and texts that take more bits a
  byte under their best language than its labelled texts do.
* ``near_duplicates``: keeps one document of each near-duplicate class.
* ``personal_data``: replaces found spans by the name of their kind.
* ``mixture``: repeats, cuts and drops documents to meet the source weights.
* ``packing``: tokens of the mix in windows of 1024, one row per piece.

Language ID and banded alignment cannot be said in SQL, so ``ORACLE_SQL`` is
None; ``tests/llm`` holds the pipeline against the operators run one by one
and against plain Python versions.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm import mixing, order_minhash, packing, pii, ppm
from marketlens.llm.common import read_table
from marketlens.session import scratch_path
from marketlens.sources.store import materialize

MIN_LANGUAGE_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    names = docs.columns
    model = ppm.train(docs, F.lit(True))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    known = materialize(spark, ppm.predict(rows, model, ["row"], "row.text"), "languages")
    limits = ppm.rate_limits(known.select("row.lang", "rate"))
    good = (F.col("lang_pred") != ppm.UNDECIDED) & (F.col("score") > MIN_LANGUAGE_SCORE) & (F.col("rate") <= F.col("rate_limit"))
    # one row for each learned language
    return known.join(F.broadcast(limits), F.col("lang_pred") == F.col("limit_lang")).where(good).select(*[F.col(f"row.`{c}`").alias(c) for c in names])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return order_minhash.deduplicated(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    names = docs.columns
    clean = pii.redacted(docs)
    return clean.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in names])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    names = docs.columns
    mix = mixing.mixed(docs)
    return mix.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in names])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, with_ids=True)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
