"""The enriched order-line fact that every analytic reads.

Built once per (session, input folder): the joined source columns and the
features that need other rows are written to the shared folder.  Everything
else follows row by row from them and from the written medians, so it is not
written: queries scan only the source columns that they need.
"""
from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession

from marketlens.operators import enrich
from marketlens.sources.master import line_sources
from marketlens.sources.store import materialize

_lock = threading.Lock()
_cache: dict[tuple[str, str], DataFrame] = {}


def build_enriched(spark: SparkSession, sf_dir: str, write: bool = True) -> DataFrame:
    texts = enrich.review_text_dim(spark, sf_dir).select("review_key", "has_comment", "comment_length")
    if write:       # the planner sizes it from its files, without the texts
        texts = materialize(spark, texts, "text-lengths")
    lines = enrich.order_lines(line_sources(spark, sf_dir), texts)
    if write:
        lines = materialize(spark, lines, "fact-lines")
    return enrich.finish(enrich.row_features(lines), spark if write else None)


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    with _lock:
        df = _cache.get(key)
        if df is None:
            df = build_enriched(spark, sf_dir)
            _cache[key] = df
    return df


def reset() -> None:
    with _lock:
        _cache.clear()
