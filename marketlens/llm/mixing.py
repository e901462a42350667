"""Mixing sources to target weights by Sainte-Lague apportionment.

Sizes are words.  Each source has a weight; its target is its share of the
total, but at most ``epochs`` times its own size, the excess going to the
other sources by weight (water filling).  The total is cut into equal blocks
of ``block_words`` words.  Blocks go to sources by the highest quotients
``target / (2 s - 1)``, then a source's blocks go to its shards in the same
way by shard size: integer quotas per shard.  A shard lays its documents out
in a seeded order, repeated up to ``epochs`` times, and gives the first
``quota`` blocks of that layout; at most one document of a shard is taken in
part.

No list of all blocks is ever made.  Seats far below a party's quota of
``seats * votes / total`` are certain: with n parties, the divisor that hands
out all seats moves a party by at most ``1.5 n * share + 1`` seats, so only
that many quotients around the quota are ranked, O(n) rows.  A shard has about
``shard_words`` words, so a source that holds a third of all rows is many
shards, and no window holds more than one shard, one row per shard of a
source, or one row per source.

DataFrame functions only.  Defined cases: null texts have size 0 and are taken
0 times; the null source is a source of its own and comes last; equal rows are
taken as often as their places say, whichever of them it is; an empty table
gives no rows.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.common import WORD_PATTERN, text_or_empty
from marketlens.sources.store import materialize

WEIGHTS = (5, 2, 1)
EPOCHS = 3
BLOCK_WORDS = 32
SHARD_WORDS = 1 << 20
SEED = "mix-1"


def word_count(col: str = "text") -> Column:
    """Words of a text.  Each word with the space before it becomes one letter,
    so no array of the words is made (as ``regexp_count`` does)."""
    letters = F.regexp_replace(text_or_empty(col), r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++", "w")
    return F.length(F.rtrim(letters, F.lit(" \t\n\x0b\x0c\r"))).cast("long")


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & a[k].eqNullSafe(b[k])
    return on


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """``sizes(source, size)`` -> one row per source with its ``place``,
    ``source_size`` and ``target`` (sum of targets = sum of sizes)."""
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("place"), F.lit(len(weights))) + 1)
    src = src.withColumn("place", place).withColumn("w", weight).withColumn("top", F.col("source_size") * epochs)
    by_ratio = Window.orderBy(F.col("top") / F.col("w"), "place")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    src = src.withColumns({
        "left_size": F.sum("source_size").over(everything) - F.coalesce(F.sum("top").over(before), F.lit(0)),
        "left_w": F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))})
    open_ = F.col("left_size") * F.col("w") <= F.col("top") * F.col("left_w")
    level = F.when(open_, F.col("left_size") / F.col("left_w"))
    # sources come in order of the level at which they are full; the first that is not gives the level of the rest
    src = src.withColumn("level", F.first(level, ignorenulls=True).over(
        by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.when(open_, F.col("level") * F.col("w")).otherwise(F.col("top").cast("double"))
    return src.select("source", "place", "source_size", target.alias("target"))


def sainte_lague(parties: DataFrame, votes: str, seats: Column, order: Sequence[str],
                 within: Sequence[str] = ()) -> DataFrame:
    """Adds ``quota``: the seats of each party (row) among those of its group."""
    group = Window.partitionBy(*within)
    p = parties.withColumns({"_all": F.sum(votes).over(group), "_n": F.count(F.lit(1)).over(group), "_seats": seats})
    share = F.coalesce(F.try_divide(F.col(votes).cast("double"), F.col("_all")), F.lit(0.0))
    p = p.withColumn("_share", share)
    near = F.floor(F.col("_seats") * F.col("_share"))
    reach = F.ceil(1.5 * F.col("_n") * F.col("_share")) + 1
    p = p.withColumns({"_sure": F.greatest(F.lit(0), near - reach).cast("long"),
                       "_most": (near + reach + 1).cast("long")})
    p = p.withColumn("_open", F.col("_seats") - F.sum("_sure").over(group))
    tried = p.withColumn("_seat", F.explode(F.sequence(F.col("_sure") + 1, F.col("_most")))) \
             .withColumn("_quotient", F.col(votes) / (2 * F.col("_seat") - 1))
    best = Window.partitionBy(*within).orderBy(F.col("_quotient").desc(), *order, "_seat")
    won = F.count(F.when(F.col("_at") <= F.col("_open"), 1))
    kept = [c for c in parties.columns]
    return tried.withColumn("_at", F.row_number().over(best)) \
                .groupBy(*kept, "_sure").agg(won.alias("_won")) \
                .select(*kept, (F.col("_sure") + F.col("_won")).alias("quota"))


def _laid_out(sizes: DataFrame, block_words: int, shard_words: int, epochs: int,
              weights: Sequence[int], seed: str) -> DataFrame:
    """``sizes(source, size, order_id, ...)`` with ``source_size``, ``target``,
    ``taken``."""
    src = targets(sizes, weights, epochs)
    total = F.sum("source_size").over(Window.partitionBy())
    src = sainte_lague(src, "target", F.floor((total + block_words / 2) / block_words).cast("long"), ["place"])
    src = src.withColumnRenamed("quota", "source_quota").withColumn(
        "shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long"))
    src = materialize(src.sparkSession, src, "mix-sources")
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("order_id").cast("string"), F.lit("-"))))
    docs = sizes.withColumn("seeded", key).join(src.withColumnRenamed("source", "_source"),
                                                F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    docs = docs.withColumn("shard", F.pmod(F.conv(F.substring("seeded", 1, 8), 16, 10).cast("long"), F.col("shards")))
    shards = docs.groupBy("place", "source_quota", "shard").agg(F.sum("size").alias("shard_size"))
    shards = sainte_lague(shards, "shard_size", F.col("source_quota"), ["shard"], ["place"]) \
        .select(F.col("place").alias("_place"), F.col("shard").alias("_shard"), "shard_size", "quota")
    docs = docs.join(shards, (F.col("place") == F.col("_place")) & (F.col("shard") == F.col("_shard")))
    laid = Window.partitionBy("place", "shard").orderBy("seeded", "order_id", "size") \
                 .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    docs = docs.withColumn("_start", F.sum("size").over(laid) - F.col("size"))
    wanted = F.col("quota") * block_words
    whole = F.coalesce(F.floor(F.try_divide(wanted, F.col("shard_size"))), F.lit(0)).cast("long")
    rest = wanted - whole * F.col("shard_size")
    part = F.least(F.greatest(rest - F.col("_start"), F.lit(0)), F.col("size"))
    taken = F.when(whole >= epochs, epochs * F.col("size")).otherwise(whole * F.col("size") + part)
    return docs.withColumn("taken", taken.cast("long"))


def quotas(docs: DataFrame, id_col: str = "doc_id", block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS,
           epochs: int = EPOCHS, weights: Sequence[int] = WEIGHTS, seed: str = SEED) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken``.
    The texts are read once; everything after works on ids and sizes."""
    sizes = docs.select(F.col(id_col).alias("order_id"), F.col("source"), word_count().alias("size"))
    sizes = materialize(docs.sparkSession, sizes, "mix-sizes")
    out = _laid_out(sizes, block_words, shard_words, epochs, weights, seed)
    return out.select(F.col("order_id").alias(id_col), "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The mix itself: each document as often as it is taken whole, and its
    first words once more where a block ends inside it.  Columns of ``docs``."""
    plan = quotas(docs, id_col, **options)
    plan = plan.groupBy(id_col, "size").agg(F.sort_array(F.collect_list("taken")).alias("_taken"))
    # rows that share id and size are numbered so that each has its own count
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(id_col).alias("_id"),
                       word_count().alias("_size"))
    numbered = Window.partitionBy("_id", "_size").orderBy(F.xxhash64(F.col("row.text")))
    rows = rows.withColumn("_nth", F.row_number().over(numbered))
    plan = plan.select(F.col(id_col).alias("_pid"), F.col("size").alias("_psize"), "_taken")
    rows = rows.join(plan, F.col("_id").eqNullSafe(F.col("_pid")) & (F.col("_size") == F.col("_psize"))) \
               .withColumn("taken", F.element_at("_taken", F.col("_nth")))
    copies = F.when(F.col("_size") > 0, F.floor(F.try_divide("taken", "_size"))).otherwise(0).cast("int")
    part = (F.col("taken") - copies * F.col("_size")).cast("int")
    head = F.concat_ws("", F.slice(F.regexp_extract_all(
        F.col("row.text"), F.lit(r"[\x20\x09-\x0D]*" + WORD_PATTERN), F.lit(0)), F.lit(1), part))
    texts = F.concat(F.array_repeat(F.col("row.text"), copies), F.when(part > 0, F.array(head)).otherwise(F.array()))
    out = rows.select("row", F.explode(texts).alias("_text"))
    return out.select(*[F.col("_text").alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in names])
