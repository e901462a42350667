"""Document fingerprints: context-triggered piecewise hashing.

An eight-byte rolling hash runs over the UTF-8 bytes; where it falls below
``2**32 / block`` a chunk ends, so boundaries depend on local content and
survive insertions elsewhere.  Every chunk is hashed to 12 bits (two base-64
characters).  The block size is the smallest power of two, not below about
``n_bytes / 512``, that leaves at most 64 chunks; the fingerprint also holds
the signature at twice that size: ``block:signature:signature_at_2x``.

Two fingerprints compare only at a block size both have.  Their likeness is
``1 - d / (len_a + len_b)`` over the chunk signatures, where ``d`` is the edit
distance with unit insertions and deletions (a substitution costs two), found
as a bit-parallel longest common subsequence.

Defined cases: a null text counts as empty; the empty text has fingerprint
``0::``, which is like itself (1.0) and unlike everything else (0.0); equal
texts always have equal fingerprints; a text whose rolling hash never fires is
one chunk.  Work is linear in the text, the working memory about 30 bytes per
byte of the one text in hand.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import shuffle_width, text_or_empty

MAX_CHUNKS = 64
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_PAIRS = [a + b for a in _ALPHABET for b in _ALPHABET]
_ROLL = 0x01000193
_ROLL_POWERS = [np.uint32(pow(_ROLL, s, 1 << 32)) for s in (1, 2, 4)]
_ROLL_MIX = np.uint32(0x9E3779B1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_CHUNK_MIX = np.uint64(0xD6E8FEB86659FD93)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


class Fingerprint(NamedTuple):
    level: int                  # block size is 2**level; -1 for the empty text
    fine: list[int]
    coarse: list[int]

    def __str__(self) -> str:
        if self.level < 0:
            return "0::"
        return f"{1 << self.level}:{''.join(map(_PAIRS.__getitem__, self.fine))}:" \
               f"{''.join(map(_PAIRS.__getitem__, self.coarse))}"


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE**j`` and ``BASE**-j`` modulo 2**64 for j below n (grown on demand)."""
    if len(_powers["up"]) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def fingerprint(data: bytes) -> Fingerprint:
    n = len(data)
    if n == 0:
        return Fingerprint(-1, [], [])
    raw = np.frombuffer(data, np.uint8)
    roll = raw.astype(np.uint32)
    for shift, power in zip((1, 2, 4), _ROLL_POWERS):
        if n > shift:
            later = roll[:-shift] * power
            roll[shift:] += later
    roll *= _ROLL_MIX
    level = max(2, n.bit_length() - 9)
    ends = np.flatnonzero(roll < np.uint32((1 << 32) >> level)) + 1
    values = roll[ends - 1]
    while True:
        closed = len(ends) > 0 and ends[-1] == n
        if len(ends) + (not closed) <= MAX_CHUNKS:
            break
        level += 1
        keep = values < np.uint32((1 << 32) >> level) if level < 32 else np.zeros(len(values), bool)
        ends, values = ends[keep], values[keep]
    up, down = _power_tables(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(raw.astype(np.uint64) * up[:n] + up[:n], out=sums[1:])

    def tokens(cuts: np.ndarray) -> list[int]:
        if len(cuts) == 0 or cuts[-1] != n:
            cuts = np.append(cuts, n)
        starts = np.concatenate(([0], cuts[:-1]))
        h = (sums[cuts] - sums[starts]) * down[starts]
        h ^= h >> np.uint64(29)
        return ((h * _CHUNK_MIX) >> np.uint64(52)).tolist()

    half = values < np.uint32((1 << 32) >> (level + 1)) if level < 31 else np.zeros(len(values), bool)
    return Fingerprint(level, tokens(ends), tokens(ends[half]))


def _ratio(a: list[int], b: list[int]) -> float:
    """``1 - indel_distance / (len a + len b)``."""
    if a == b:
        return 1.0
    places: dict[int, int] = {}
    for i, t in enumerate(a):
        places[t] = places.get(t, 0) | (1 << i)
    full = (1 << len(a)) - 1
    open_ = full
    for t in b:
        hit = open_ & places.get(t, 0)
        open_ = ((open_ + hit) | (open_ - hit)) & full
    common = len(a) - open_.bit_count()
    return 2.0 * common / (len(a) + len(b))


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    if a.level < 0 or b.level < 0:
        return 1.0 if a.level == b.level else 0.0
    if a.level == b.level:
        return _ratio(a.fine, b.fine)
    if a.level == b.level + 1:
        return _ratio(a.fine, b.coarse)
    if b.level == a.level + 1:
        return _ratio(a.coarse, b.fine)
    return 0.0


def fingerprints(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with a ``fingerprint`` column (general interface)."""
    @F.pandas_udf("string")
    def fp(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: str(fingerprint((t or "").encode())))
    return docs.withColumn("fingerprint", fp(text_or_empty(text_col)))


def _slices(docs: DataFrame, order_key: str) -> list:
    """Up to ``shuffle partitions - 1`` ascending cut values of the order key:
    approximate quantiles, whose number does not depend on the rows."""
    n = shuffle_width(docs.sparkSession)
    if n < 2:
        return []
    probs = [i / n for i in range(1, n)]
    got = docs.agg(F.percentile_approx(order_key, probs, 10_000)).first()[0] or []
    return sorted(set(got))


def _slice_of(col, cuts: list):
    """How many cut values are <= the id, by one search over groups of cuts and
    one inside the group; a null id is in slice 0."""
    if not cuts:
        return F.lit(0)
    width = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i:i + width] for i in range(0, len(cuts), width)]
    whole = F.array(*[F.lit(g[-1]) for g in groups])
    full = F.size(F.filter(whole, lambda x: x <= col))
    inner = F.element_at(F.array(*[F.array(*map(F.lit, g)) for g in groups]),
                         F.least(full + 1, F.lit(len(groups))))
    part = F.when(full < len(groups), F.size(F.filter(inner, lambda x: x <= col))).otherwise(0)
    return F.when(col.isNull(), 0).otherwise(full * width + part).cast("int")


def successive(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text (last half of the
    code points replaced by the head of the next document in descending
    ``doc_id``), with both likenesses.

    Rows are dealt by ``doc_id`` slices; each slice also receives the first
    row of the next one (one extra row a slice), so every row meets its
    successor and the texts are shuffled once.  Null ids come last; rows of
    equal id are ordered by a hash of the text.  A single row succeeds itself.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")) \
               .withColumn("tie", F.xxhash64("text"))
    cuts = _slices(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id")
    rows = rows.withColumn("part", _slice_of(F.col("doc_id"), cuts))
    # the first row of each slice in descending order; a null id sorts lowest
    first = rows.groupBy("part").agg(F.max(F.struct(
        F.col("doc_id").isNotNull().alias("known"), F.col("doc_id"), (-F.col("tie")).alias("neg_tie"))).alias("top"))
    tops = sorted((r["part"], r["top"]["doc_id"], r["top"]["neg_tie"]) for r in first.collect())
    if not tops:
        halo = rows.where(F.lit(False))
    else:
        places = [(tops[(i + 1) % len(tops)][0], d, t) for i, (p, d, t) in enumerate(tops)]
        goes = docs.sparkSession.createDataFrame(places, "goes int, top_id long, top_neg long")
        halo = rows.join(F.broadcast(goes), F.col("doc_id").eqNullSafe(F.col("top_id"))
                         & (-F.col("tie") == F.col("top_neg")))
        halo = halo.select("doc_id", "text", "tie", F.col("goes").alias("part"))
    dealt = rows.withColumn("halo", F.lit(0)).unionByName(halo.withColumn("halo", F.lit(1))) \
        .repartitionById(max(1, len(cuts) + 1), F.col("part")) \
        .sortWithinPartitions("part", "halo", F.col("doc_id").desc_nulls_last(), "tie") \
        .select("part", "halo", "doc_id", "text")
    return dealt.mapInPandas(_walk, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                                    "edited_fingerprint string, near_edited double, near_next double")


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held = None
    out: list[tuple] = []
    columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
               "near_edited", "near_next"]

    def frame() -> pd.DataFrame:
        df = pd.DataFrame(out, columns=columns)
        df["doc_id"] = df["doc_id"].astype("Int64")
        return df

    for batch in batches:
        for part, halo, doc_id, text in zip(batch["part"], batch["halo"], batch["doc_id"].astype("Int64"), batch["text"]):
            data = text.encode()
            fp = fingerprint(data)
            if held is not None and held[0] == part and not held[1]:
                _, _, own_id, own, own_fp = held
                n = len(own)
                edited = (own[:n - n // 2] + text[:n // 2]).encode()
                edited_fp = fingerprint(edited)
                out.append((own_id, n, hashlib.sha256(edited).hexdigest(), str(own_fp), str(edited_fp),
                            likeness(own_fp, edited_fp), likeness(own_fp, fp)))
            held = (part, halo, doc_id, text, fp)
        if out:
            yield frame()
            out.clear()
