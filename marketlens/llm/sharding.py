"""Uniform shuffle of a table into shards by a two-pass external shuffle.

Pass 1 scatters the records over memory-sized buckets by a seeded hash; pass 2
shuffles each bucket by Fisher-Yates (Spark's ``shuffle``) in one task and lays
the buckets end to end.  The resulting order is cut into shards of equal
counts (at most one row apart), so each bucket feeds one or two shards.

* Equal records are counted first (with map-side sums) and told apart by a
  copy number, so a record that makes up a third of the table is scattered
  over all buckets like any other row.
* A bucket gets about ``BUCKET_ROWS`` rows whatever the keys are, since the
  hash covers the record and its copy number.
* Bucket ``b`` is task ``b`` of the second pass, and its generator starts from
  ``seed + b``; its rows are sorted before.  The order therefore depends on
  the records and the seed alone, not on the layout of the input, the cluster
  or a lost executor.
* The only table that goes everywhere is the list of bucket offsets: one row
  per ``BUCKET_ROWS`` records.

Everything is DataFrame expressions.  Defined cases: nulls are values like any
other; an empty table gives an empty result; shards may be empty if there are
fewer rows than shards.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.sources.store import materialize

BUCKET_ROWS = 131_072
MIN_BUCKETS = 96
#: Copies of one record that a task expands.
COPY_BLOCK = 4_096


def record_hash(seed: int, names: list[str]) -> Column:
    """Seeded 64-bit hash of all values; nulls count (``xxhash64`` skips them)."""
    return F.xxhash64(F.lit(seed).cast("long"), *[x for c in names for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())])


def scattered(records: DataFrame, seed: int, buckets: int) -> DataFrame:
    """Pass 1: one row per copy of every record, with ``_copy`` and ``_bucket``."""
    names = records.columns
    counted = records.groupBy(*[F.col(f"`{c}`") for c in names]).agg(F.count(F.lit(1)).alias("_n"))
    blocks = counted.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_n - 1) div {COPY_BLOCK}"))))
    # blocks of a very frequent record leave the task that counted it before they are expanded
    dealt = blocks.repartition(record_hash(seed, [*names, "_block"]))
    first = F.col("_block") * COPY_BLOCK
    copies = F.sequence(first, F.least(first + COPY_BLOCK, F.col("_n")) - 1)
    rows = dealt.select(*[F.col(f"`{c}`") for c in names], F.explode(copies).alias("_copy"))
    return rows.withColumn("_bucket", F.pmod(record_hash(seed, [*names, "_copy"]), F.lit(buckets)).cast("int"))


def shuffled(records: DataFrame, seed: int = 1, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The records in a random order: their columns, ``_place`` (from 0) and
    ``_rows`` (how many there are)."""
    names = records.columns
    buckets = max(MIN_BUCKETS, -(-records.count() // bucket_rows))
    rows = materialize(records.sparkSession, scattered(records, seed, buckets), "scattered")
    sizes = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
                           F.sum("_n").over(Window.partitionBy(F.lit(0))).alias("_rows"))
    kept = F.struct(*[F.col(f"`{c}`") for c in names], F.col("_copy"))
    # task b holds bucket b and nothing else, so that the generator's start does not depend on the layout
    held = rows.repartitionById(buckets, F.col("_bucket")).groupBy("_bucket").agg(F.collect_list(kept).alias("_held"))
    dealt = held.select("_bucket", F.posexplode(F.shuffle(F.array_sort("_held"), seed)).alias("_at", "_r"))
    placed = dealt.join(F.broadcast(offsets), F.col("_bucket") == F.col("_b"))
    return placed.select(*[F.col("_r")[c].alias(c) for c in names], (F.col("_offset") + F.col("_at")).alias("_place"), "_rows")


def sharded(records: DataFrame, shards: int = 24, seed: int = 1, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The records with ``_shard`` (0 to ``shards - 1``; counts differ by one
    at most) and ``_slot`` (gapless from 0 in each shard)."""
    placed = shuffled(records, seed, bucket_rows)
    shard = F.expr(f"_place * {shards} div _rows")
    begin = F.expr(f"(_shard * _rows + {shards - 1}) div {shards}")
    return placed.withColumn("_shard", shard.cast("int")).withColumn("_slot", (F.col("_place") - begin).cast("long")) \
                 .drop("_place", "_rows")


def placements(docs: DataFrame, shards: int = 24, seed: int = 1) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every
    document.  ``size`` is the text's UTF-8 bytes (a null text has none) plus
    8.  The law is ``rows``; ``grown_shard`` is null under it."""
    records = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
                          F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    return sharded(records, shards, seed).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("_shard").alias("shard"),
        F.col("_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 24, seed: int = 1) -> None:
    """Writes the whole documents as Parquet, one folder ``_shard=N`` a shard,
    rows by ``_slot`` within it.  Records are shuffled by a 128-bit key; the
    texts travel twice: to meet their places, then to their shard."""
    names = docs.columns
    keyed = docs.withColumns({"_k1": record_hash(1, names), "_k2": record_hash(2, names)})
    places = sharded(keyed.select("_k1", "_k2"), shards, seed)
    whole = keyed.groupBy("_k1", "_k2").agg(F.first(F.struct(*[F.col(f"`{c}`") for c in names])).alias("_r"))
    rows = places.join(whole, ["_k1", "_k2"]).select(*[F.col("_r")[c].alias(c) for c in names], "_shard", "_slot")
    rows.repartitionByRange("_shard", "_slot").sortWithinPartitions("_shard", "_slot") \
        .write.partitionBy("_shard").parquet(path)
