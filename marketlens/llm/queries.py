"""The ``opN_<name>`` queries: each applies its operator with production
parameters to a whole given table and returns the full result."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm import (conversations, ctph, fim, mixing, order_minhash, ordinal, packing, pii, polytope, ppm, secrets,
                            semantic_knn, sharding)
from marketlens.llm.common import read_table


def op1_ctph_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctph.successive(read_table(spark, sf_dir, "documents"))


def op2_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return polytope.nearest(index.where(F.col("id") % 100 == 0), index, k=10)


def op3_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.quotas(read_table(spark, sf_dir, "documents"))


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.classes(read_table(spark, sf_dir, "documents")).drop("node")


def op5_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.identify(read_table(spark, sf_dir, "documents"))


def op6_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read_table(spark, sf_dir, "documents"))


def op7_minimum_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(read_table(spark, sf_dir, "documents"))


def op8_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordinal.severity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic_knn.quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op10_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find(read_table(spark, sf_dir, "documents"))


def op11_run_length_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations")
    return conversations.summary(rows, conversations.damaged(rows))


def op12_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.placements(read_table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_ctph_fingerprints, op2_cross_polytope, op3_sainte_lague_mix, op4_order_minhash, op5_ppm_language,
                                 op6_pii_spans, op7_minimum_slack_packing,
                                 op8_ordinal_toxicity, op9_knn_quality, op10_secret_ownership,
                                 op11_run_length_repair, op12_external_shuffle, op13_fill_in_middle)
}

#: DuckDB SQL for the queries that SQL can express.
ORACLES: dict[str, str] = {}

ORACLES["op3_sainte_lague_mix"] = r"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place
  FROM sizes GROUP BY source),
weighed AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, source_size * 3 AS top FROM src),
filled AS (
  SELECT *, (sum(source_size) OVER ())::BIGINT - coalesce(sum(top) OVER (ORDER BY top / w, place
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS left_size,
         (sum(w) OVER ())::BIGINT - coalesce(sum(w) OVER (ORDER BY top / w, place
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS left_w
  FROM weighed),
level AS (
  SELECT left_size / left_w AS level FROM filled WHERE left_size * w <= top * left_w
  ORDER BY top / w, place LIMIT 1),
goal AS (
  SELECT source, place, source_size,
         CASE WHEN left_size * w <= top * left_w THEN level * w ELSE top::DOUBLE END AS target
  FROM filled, level),
source_seats AS (SELECT floor((sum(source_size) + 16.0) / 32)::BIGINT AS n FROM src),
-- every quotient of every source that could win a seat
source_tries AS (
  SELECT place, s, target / (2 * s - 1) AS quotient
  FROM goal, source_seats, range(1, (floor(target / 32) + 2 * (SELECT count(*) FROM goal) + 3)::BIGINT) r(s)),
source_quota AS (
  SELECT place, count(*) AS quota FROM (
    SELECT place FROM source_tries ORDER BY quotient DESC, place, s LIMIT (SELECT n FROM source_seats)) GROUP BY place),
dealt AS (
  SELECT d.*, g.place, g.source_size, g.target, coalesce(q.quota, 0) AS source_quota,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, '-')) AS seeded,
         greatest(1, ceil(g.source_size / 1048576.0))::BIGINT AS shards
  FROM sizes d JOIN goal g ON d.source IS NOT DISTINCT FROM g.source LEFT JOIN source_quota q USING (place)),
sharded AS (SELECT *, ('0x' || substr(seeded, 1, 8))::BIGINT % shards AS shard FROM dealt),
shard_sizes AS (
  SELECT place, shard, any_value(source_quota) AS source_quota, sum(size)::BIGINT AS shard_size
  FROM sharded GROUP BY place, shard),
shard_tries AS (
  SELECT place, shard, s, source_quota, row_number() OVER (PARTITION BY place
           ORDER BY shard_size / (2 * s - 1) DESC, shard, s) AS pos
  FROM shard_sizes, range(1, source_quota + 1) r(s)),
shard_quota AS (SELECT place, shard, count(*) AS quota FROM shard_tries WHERE pos <= source_quota GROUP BY place, shard),
laid AS (
  SELECT d.*, z.shard_size, coalesce(q.quota, 0) * 32 AS wanted,
         (sum(size) OVER (PARTITION BY place, shard ORDER BY seeded, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT - size AS start
  FROM sharded d JOIN shard_sizes z USING (place, shard) LEFT JOIN shard_quota q USING (place, shard)),
counted AS (
  SELECT *, CASE WHEN shard_size > 0 THEN wanted // shard_size ELSE 0 END AS whole FROM laid)
SELECT doc_id, size, source_size, target,
       (CASE WHEN whole >= 3 THEN 3 * size
             ELSE whole * size + least(greatest(wanted - whole * shard_size - start, 0), size) END)::BIGINT AS taken
FROM counted
"""

ORACLES["op13_fill_in_middle"] = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (
  SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS tokens,
         ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
         ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4
  FROM t),
cuts AS (
  SELECT *, len(tokens) AS n, least(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS a,
         greatest(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90
              THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM u),
parts AS (
  SELECT *, array_to_string(tokens[1:a], '') AS pre, array_to_string(tokens[a + 1:b], '') AS mid,
         array_to_string(tokens[b + 1:], '') AS suf FROM cuts)
SELECT doc_id, n::BIGINT AS n, form,
       CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                   ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""
