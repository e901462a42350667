"""Packing documents into windows of 1024 tokens by minimum bin slack.

Documents are tokenized (byte-level BPE, then id 0 as the end mark) and cut
into whole windows and one remainder shorter than a window.  Only the number
of remainders of each length matters for packing them: at most 1023 numbers,
whatever the corpus.  Those counts go to the driver, where windows are filled
one pattern at a time: the longest remaining length is placed, and a bitset
subset-sum dynamic programme over the multiset of the other lengths finds the
sum closest to the free space; backtracking gives the count of each length.  A
pattern is applied as often as the counts allow, so the number of patterns
stays near the number of lengths.  Remainders are then dealt to the slots of
the plan by their rank among those of equal length, on the executors.

Ranks need no ordering over all rows: a task numbers its own remainders of
each length, and prefix sums over (task, length) counts add the offset.  The
tokenized pieces are written before, so both sides see the same numbering.

A sequence is padded to the window unless its length is a power of two.

Defined cases: null texts count as empty; an empty text is the end mark alone;
equal rows are packed once each; the special token's string in a text is the
special token; an empty table gives no rows.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.common import lean_map, worker_state
from marketlens.sources.store import materialize

WINDOW = 1024
END = 0
VOCABULARY = "byte_bpe_50k"
SPECIAL = "<|endoftext|>"


def _library(name: str):
    """The ``tokenizers`` form of a vocabulary ."""
    import public_tokenizers
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))


def _fast(name: str):
    """The same vocabulary and merges through ``tiktoken``, which gives the
    same ids several times faster."""
    import base64

    import public_tokenizers
    import tiktoken
    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _kept(kind, name: str):
    """A tokenizer of this worker; another operator's task drops them."""
    held = worker_state("tokenizers", dict)
    if (kind, name) not in held:
        held[kind, name] = kind(name)
    return held[kind, name]


def token_ids(text: str, name: str = VOCABULARY) -> np.ndarray:
    """Ids of a text and the end mark."""
    if SPECIAL not in text:
        try:
            return np.append(_kept(_fast, name).encode_to_numpy(text, disallowed_special=()), np.uint32(END))
        except BaseException as e:      # the regular expression engine gives up on very long runs of spaces
            if isinstance(e, (KeyboardInterrupt, SystemExit)):
                raise
    ids = _kept(_library, name).encode(text, add_special_tokens=False).ids
    return np.array([*ids, END], np.uint32)


def pieces(docs: DataFrame, id_col: str = "doc_id", window: int = WINDOW, vocabulary: str = VOCABULARY,
           with_ids: bool = False) -> DataFrame:
    """Windows and remainders of every document, with the task that cut them
    and their number among that task's pieces of equal length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        made = np.zeros(window + 1, np.int64)
        for b in batches:
            rows: list[list] = [[] for _ in range(6)]
            kept = []
            for doc, text in zip(b.column(id_col).to_pylist(), b.column("_text").to_pylist()):
                ids = token_ids(text or "", vocabulary)
                for start in range(0, len(ids), window):
                    part = ids[start:start + window]
                    for column, value in zip(rows, (doc, start, len(part), zlib.crc32(part.astype("<u4").tobytes()),
                                                    len(ids), made[len(part)])):
                        column.append(value)
                    made[len(part)] += 1
                    if with_ids:
                        kept.append(part.astype(np.int32))
            columns = [pa.array(c, pa.int64()) for c in rows] + [pa.array(np.full(len(rows[0]), task, np.int32))]
            names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "nth", "task"]
            if with_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col("text").alias("_text"))
    return lean_map(rows, run, f"`{id_col}` long, start long, length long, ids_crc32 long, doc_tokens long, nth long, task int"
                               + (", ids array<int>" if with_ids else ""), state="tokenizers")


def fill(counts: dict[int, int], space: int) -> dict[int, int]:
    """The sub-multiset of ``counts`` (length -> how many) whose sum is the
    largest that fits ``space``, as length -> how many."""
    mask = (1 << (space + 1)) - 1
    reach, trail = 1, []
    for length in sorted((x for x in counts if counts[x] and x <= space), reverse=True):
        before, left, some = reach, min(counts[length], space // length), 1
        while left:
            take = min(some, left)
            reach |= (reach << (take * length)) & mask
            left, some = left - take, some * 2
        trail.append((length, before))
        if reach >> space & 1:
            break
    goal, used = reach.bit_length() - 1, {}
    for length, before in reversed(trail):
        n = 0
        while not before >> (goal - n * length) & 1:
            n += 1
        if n:
            used[length] = n
            goal -= n * length
    return used


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int, int]]:
    """Slots for all remainders: ``(length, first_rank, ranks, first_sequence,
    per_sequence, offset)``; sequences are numbered from 0."""
    left = {x: n for x, n in counts.items() if n and x < window}
    given = dict.fromkeys(left, 0)
    slots, sequence = [], 0
    while left:
        longest = max(left)
        rest = {**left, longest: left[longest] - 1}
        pattern = fill(rest, window - longest)
        pattern[longest] = pattern.get(longest, 0) + 1
        times = min(left[x] // n for x, n in pattern.items())
        offset = 0
        for x in sorted(pattern, reverse=True):
            n = pattern[x]
            slots.append((x, given[x], n * times, sequence, n, offset))
            given[x] += n * times
            left[x] -= n * times
            offset += n * x
            if not left[x]:
                del left[x]
        sequence += times
    return slots


def packed(docs: DataFrame, id_col: str = "doc_id", window: int = WINDOW, vocabulary: str = VOCABULARY,
           with_ids: bool = False) -> DataFrame:
    """One row per piece: its document, place there, sequence and offset."""
    spark = docs.sparkSession
    cut = materialize(spark, pieces(docs, id_col, window, vocabulary, with_ids), "packing")
    made = cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    made = made.select(F.col("length").alias("_length"), F.col("task").alias("_task"),
                       F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("earlier"))
    # bounded by the window: one count for each length
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = plan(counts, window)
    sequences = max((s[3] + s[2] // s[4] for s in slots), default=0)
    slots.append((window, 0, counts.get(window, 0), sequences, 1, 0))
    layout = spark.createDataFrame(slots, "_slot long, first_rank long, ranks long, first_sequence long, "
                                          "per_sequence long, offset0 long")
    ranked = cut.join(made, (F.col("length") == F.col("_length")) & (F.col("task") == F.col("_task"))) \
                .withColumn("rank", F.col("earlier") + F.col("nth"))
    at = F.col("rank") - F.col("first_rank")
    out = ranked.join(F.broadcast(layout), (F.col("length") == F.col("_slot"))
                      & (at >= 0) & (at < F.col("ranks")))
    return out.select(id_col, "start", "length", "ids_crc32", "doc_tokens",
                      (F.col("first_sequence") + F.floor(at / F.col("per_sequence"))).cast("long").alias("sequence_id"),
                      (F.col("offset0") + at % F.col("per_sequence") * F.col("length")).cast("long").alias("offset"),
                      *(["ids"] if with_ids else []))
