"""Approximate nearest neighbours by cross-polytope hashing.

Index: every vector is scaled to unit length, padded with zeros to a power of
two and put through ``tables`` independent pseudo-rotations (three rounds of
random signs and a fast Hadamard transform).  In each table its bucket is the
signed axis nearest to the rotated vector, and within the bucket its cell is
given by the next two nearest axes, so each table holds every vector once.

Search: a query probes, in each table, the ``probes`` buckets of the axes
nearest to it, and in them the cells of greatest expected cosine: the query's
scores on the cell's three axes, weighted by the mean scores that vectors have
on their own three.  The limit is the query's own: over the cells of a sample
of the index (``SAMPLE_ROWS`` rows, smallest id hashes, equal vectors once) it
is set so that all tables together visit the share ``share`` of the sample,
and each table at least ``LEAST_CELLS`` of its rows: a share of a few hundred
rows would find too little.
All members of a visited cell are compared with the query by their exact
Euclidean distance in double precision on the original vectors, the best k of
each block are kept, and a last ranking joins the blocks.  Queries for which
fewer than k rows were found visit every cell of the first table, which holds
all rows, so very small tables are searched whole.

Large buckets: the number of rows for each pair of nearest axes (at most
``tables * (2 * dim) ** 2`` numbers) decides into how many blocks a bucket is
cut, neighbouring cells together; a pair of more than ``block_rows`` rows is
spread over several by id.  A block of the index meets a block of the queries
in one task, each of at most about ``block_rows`` rows, so a bucket that holds
a third of all rows is spread over many tasks.  Nothing is capped: every
member of a visited cell is compared.

Defined cases: vectors that are null, empty, all zero or hold a null or
non-finite component take no part on either side; vectors of another length
are no candidates; rows that share an id count as one candidate (the nearest);
a query never finds its own id; ties go to the smaller id; an empty table
gives no rows.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.sources.store import materialize

TABLES = 4
PROBES = 48
SHARE = 0.33
LEAST_CELLS = 160
DEPTH = 3
SAMPLE_ROWS = 4096
BLOCK_ROWS = 8192
_ROUNDS = 3


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of the rows; the row length is a power of two."""
    n, step = x.shape[1], 1
    while step < n:
        pairs = x.reshape(len(x), n // (2 * step), 2, step)
        x = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(len(x), n)
        step *= 2
    return x


def _rotated(vectors: np.ndarray, table: int, seed: int) -> np.ndarray:
    """Scores of the rows on all signed axes of one table."""
    n, d = vectors.shape
    wide = 1 << max(0, d - 1).bit_length()
    x = np.zeros((n, wide))
    x[:, :d] = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rng = np.random.default_rng([seed, table, wide])
    for _ in range(_ROUNDS):
        x = _hadamard(x * rng.choice((-1.0, 1.0), wide))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    return np.concatenate((x, -x), axis=1)


def _by_length(vectors: pd.Series):
    lengths = vectors.map(len).to_numpy()
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        yield at, np.stack(vectors.iloc[at].to_numpy()).astype(np.float64)


def _axes(scores: np.ndarray, count: int) -> np.ndarray:
    return np.argsort(-scores, axis=1, kind="stable")[:, :count]


def _cells(tables: int, seed: int):
    """Pandas UDF: for each vector an array (by table) of its nearest axes."""
    @F.pandas_udf("array<array<int>>")
    def cells(vectors: pd.Series) -> pd.Series:
        out = np.empty(len(vectors), object)
        for at, x in _by_length(vectors):
            found = [_axes(_rotated(x, t, seed), DEPTH).astype(np.int32) for t in range(tables)]
            for i, row in zip(at, np.stack(found, axis=1)):
                out[i] = row.tolist()
        return pd.Series(out)
    return cells


def fit(vectors: np.ndarray, tables: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """By table the cells of sampled vectors of one length and the mean scores
    that they have on the axes of their own cells."""
    model = []
    for t in range(tables):
        scores = _rotated(vectors, t, seed)
        cells = _axes(scores, DEPTH)
        model.append((cells, np.take_along_axis(scores, cells, axis=1).mean(axis=0)))
    return model


def expected(scores: np.ndarray, cells: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Expected cosine of each query (its scores on all axes) with the members
    of each cell."""
    return sum(w * scores[:, cells[:, j]] for j, w in enumerate(weights))


def limits(scores: np.ndarray, axes: np.ndarray, model: tuple[np.ndarray, np.ndarray], share: float) -> np.ndarray:
    """Least expected cosine of the cells that each query visits in a table,
    among those in the buckets ``axes`` that it probes."""
    cells, weights = model
    probed = np.zeros(scores.shape, bool)
    np.put_along_axis(probed, axes, True, axis=1)
    known = np.where(probed[:, cells[:, 0]], expected(scores, cells, weights), -np.inf)
    nth = min(len(cells), max(LEAST_CELLS, int(np.ceil(share * len(cells)))))
    return np.partition(known, len(cells) - nth, axis=1)[:, len(cells) - nth]


def _probes(models: dict[int, list], tables: int, probes: int, share: float | None, seed: int):
    """Pandas UDF: for each query an array (by table) of the axes that it
    probes and its limit; without a share every cell is visited."""
    @F.pandas_udf("array<struct<axes:array<int>,least:double>>")
    def ask(vectors: pd.Series) -> pd.Series:
        out = np.empty(len(vectors), object)
        for at, x in _by_length(vectors):
            for lo in range(0, len(at), 256):
                some = at[lo:lo + 256]
                found: list[list] = [[] for _ in some]
                for t in range(tables):
                    scores = _rotated(x[lo:lo + 256], t, seed)
                    axes = _axes(scores, probes)
                    least = np.full(len(some), -np.inf) if share is None or x.shape[1] not in models \
                        else limits(scores, axes, models[x.shape[1]][t], share / tables)
                    for own, a, v in zip(found, axes, least):
                        own.append({"axes": a.tolist(), "least": float(v)})
                for i, own in zip(some, found):
                    out[i] = own
        return pd.Series(out)
    return ask


def usable(vec: Column) -> Column:
    """True for vectors that take part."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vec.isNotNull() & finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def _block_best(k: int, models: dict[int, list], seed: int):
    def best(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"qid": pd.Series([], dtype="int64"), "cid": pd.Series([], dtype="int64"),
                              "score": pd.Series([], dtype="float64")})
        if index.empty or queries.empty:
            return empty
        table = int(index["t"].iloc[0])
        cell = np.stack(index["cell"].to_numpy())
        order = np.lexsort(cell.T[::-1])
        cell, cid = cell[order], index["id"].to_numpy()[order]
        c = np.stack(index["vec"].to_numpy())[order]
        c2 = (c * c).sum(axis=1)
        starts = np.flatnonzero(np.append(True, (cell[1:] != cell[:-1]).any(axis=1)))
        members = np.diff(np.append(starts, len(cell)))
        weights = models[c.shape[1]][table][1]
        parts = [empty]
        for at in range(0, len(queries), 256):
            some = queries.iloc[at:at + 256]
            q = np.stack(some["qvec"].to_numpy())
            visited = expected(_rotated(q, table, seed), cell[starts], weights) >= some["least"].to_numpy()[:, None] - 1e-9
            for qid, vec, cells in zip(some["qid"].to_numpy(), q, visited):
                rows = np.flatnonzero(np.repeat(cells, members))
                rows = rows[cid[rows] != qid]
                if not len(rows):
                    continue
                q2 = vec @ vec
                rough = c2[rows] + q2 - 2.0 * (c[rows] @ vec)
                if len(rows) > k:
                    kth = np.partition(rough, k - 1)[k - 1]
                    rows = rows[rough <= kth + 1e-9 * (c2.max() + q2)]
                d = np.sqrt(((c[rows] - vec) ** 2).sum(axis=1))
                first = np.lexsort((cid[rows], d))[:k]
                parts.append(pd.DataFrame({"qid": qid, "cid": cid[rows][first], "score": d[first]}))
        return pd.concat(parts, ignore_index=True)
    return best


def _blocks(counts: list, block_rows: int) -> list[tuple]:
    """``(dim, t, axis, second, first block, blocks)`` of each pair of axes:
    neighbouring pairs of a bucket share a block until it is full, a larger
    pair has several of its own."""
    out, bucket, block, room = [], None, 0, 0
    for r in sorted(counts, key=lambda r: (r["dim"], r["t"], r["axis"], r["second"])):
        key = (r["dim"], r["t"], r["axis"])
        if key != bucket or r["n"] > room:
            block = 0 if key != bucket else block + 1
            bucket, room = key, block_rows
        own = max(1, -(-r["n"] // block_rows))
        out.append((*key, r["second"], block, own))
        block, room = block + own - 1, (room - r["n"] if own == 1 else 0)
    return out


def _models(index: DataFrame, tables: int, seed: int) -> dict[int, list]:
    """By vector length, ``fit`` of the sampled rows."""
    rows = index.withColumn("dim", F.size("vec")).withColumn("_slice", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(64)))
    for keys in (["dim", "_slice"], ["dim"]):          # in slices first: one task gets at most 64 samples
        order = Window.partitionBy(*keys).orderBy(F.xxhash64("id"), "id")
        rows = rows.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= SAMPLE_ROWS).drop("_nth")
    found: dict[int, list] = {}
    for r in rows.orderBy("dim", F.xxhash64("id"), "id").select("dim", "vec").toArrow().to_pylist():
        found.setdefault(r["dim"], []).append(r["vec"])
    return {dim: fit(np.unique(np.array(x), axis=0), tables, seed) for dim, x in found.items()}


def _search(queries: DataFrame, index: DataFrame, k: int, models: dict[int, list], tables: int, probes: int,
            share: float | None, seed: int, block_rows: int) -> DataFrame:
    """Best rows of every visited block: ``(qid, cid, score)`` with repeats."""
    held = index.select("id", "vec", F.posexplode(_cells(tables, seed)("vec")).alias("t", "cell")) \
                .select("id", "vec", "t", F.size("vec").alias("dim"), F.col("cell")[0].alias("axis"), F.col("cell")[1].alias("second"), "cell")
    asked = queries.select("id", "vec", F.posexplode(_probes(models, tables, probes, share, seed)("vec")).alias("t", "ask")) \
                   .select("id", "vec", "t", F.size("vec").alias("dim"), F.col("ask.least").alias("least"),
                           F.explode("ask.axes").alias("axis"))
    # bounded: one count for each table and pair of axes (and vector length)
    count = lambda df, keys: df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).collect()
    asks = {(r["dim"], r["t"], r["axis"]): -(-r["n"] // block_rows) for r in count(asked.drop("vec"), ["dim", "t", "axis"])}
    cells = [(*c, asks[c[:3]]) for c in _blocks(count(held.drop("vec", "cell"), ["dim", "t", "axis", "second"]), block_rows)
             if c[:3] in asks]
    if not cells:
        return index.select(F.col("id").alias("qid"), F.col("id").alias("cid"),
                            F.lit(0.0).alias("score")).where(F.lit(False))
    spark = index.sparkSession
    grid = F.broadcast(spark.createDataFrame(cells, "dim int, t int, axis int, second int, first int, blocks int, asks int"))
    last = {}
    for dim, t, axis, _, first, blocks, _ in cells:
        last[dim, t, axis] = max(last.get((dim, t, axis), 0), first + blocks)
    buckets = F.broadcast(spark.createDataFrame([(*key, n, asks[key]) for key, n in last.items()],
                                                "dim int, t int, axis int, blocks int, asks int"))
    keys = ["dim", "t", "axis", "c", "q"]
    left = held.join(grid, ["dim", "t", "axis", "second"]).select(
        "dim", "t", "axis", "id", "vec", "cell", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("blocks"))).cast("int").alias("c"),
        F.explode(F.sequence(F.lit(0), F.col("asks") - 1)).alias("q"))
    right = asked.join(buckets, ["dim", "t", "axis"]).select(
        "dim", "t", "axis", "least", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("c"),
        F.pmod(F.xxhash64("id"), F.col("asks")).cast("int").alias("q"), F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)) \
               .applyInPandas(_block_best(k, models, seed), "qid long, cid long, score double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    once = found.groupBy("qid", "cid").agg(F.min("score").alias("score"))
    order = Window.partitionBy("qid").orderBy("score", "cid")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(queries: DataFrame, index: DataFrame, k: int = 10, tables: int = TABLES, probes: int = PROBES,
            share: float = SHARE, seed: int = 17, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``queries(id, vec)`` against ``index(id, vec)`` -> ``(query_id, rank,
    vec_id, score)``, the k nearest found of each query."""
    spark = index.sparkSession
    clean = lambda df: df.where(F.col("id").isNotNull() & usable(F.col("vec"))) \
                         .select("id", F.col("vec").cast("array<double>").alias("vec"))
    queries, index = clean(queries), clean(index)
    models = _models(index, tables, seed)
    found = materialize(spark, _ranked(_search(queries, index, k, models, tables, probes, share, seed, block_rows), k), "ann")
    counts = found.groupBy("qid").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == k)
    short = queries.join(counts, queries["id"] == counts["qid"], "left_anti")
    if not short.isEmpty():
        short = materialize(spark, short, "ann-short")
        whole = _ranked(_search(short, index, k, models, 1, 1 << 30, None, seed, block_rows), k)
        found = found.join(short.select(F.col("id").alias("qid")).distinct(), "qid", "left_anti").unionByName(whole)
    return found.select(F.col("qid").alias("query_id"), F.col("rank").cast("int").alias("rank"),
                        F.col("cid").alias("vec_id"), "score")
