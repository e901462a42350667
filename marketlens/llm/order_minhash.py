"""Near-duplicate detection by Order MinHash, confirmed by banded alignment.

A text is the sequence of its five-word shingles (lower-cased words; a shorter
text is one shingle).  Each shingle is labelled with its occurrence number.
For each of ``SKETCHES`` random orders the ``KEPT`` smallest labelled shingles
are taken and put back in text order; their hash is a bucket key.  Two texts
share a key with a chance that falls with their edit distance and not only
with the overlap of their sets.  ``similarity = 1 - d / longest`` where d is
the edit distance of the two shingle sequences; at 0.8, the least similarity
of a link, a pair shares a key with a chance of at least 0.3 per order, so all
32 miss with a chance of about 1e-5, and far less above.

Equal texts are one node, named by a 64-bit hash.  Inside a bucket not all
pairs are made: each row carries 32 four-bit marks of its smallest shingles,
and only a spanning forest of the pairs whose marks agree in at least ``AGREE``
places is tested, a number linear in the rows (see ``forest``; trees that do
not fit one comparison meet whole in tiles, see ``between``).  A row is left
out of that only for two others that are candidates of all that it could be a
candidate of (see ``standing``); each task first does so for its own rows.
Candidates are confirmed by banded alignment of the whole texts.  A refused edge of a forest
does not separate texts that another pair joins: where the texts of one tree
are not all joined, those outside its largest component are compared with all
of them in blocks, by an exact bound (how many shingles they share) and then by
alignment, and only the links that join components are returned.  Components come from alternating stars over the links;
links and components stay distributed.

Defined cases: null texts and texts without a word are never grouped; rows
without an id take part and are kept only if no row of their class has one;
equal rows (same id and text) are one document for ``deduplicated``; an empty
table gives no rows.
"""
from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm.common import lean_map, utf8_buffer
from marketlens.sources.store import materialize

SIMILARITY = 0.8
AGREE = 15
FOREST = 1024
TILE = 8192
COMPARED = 512
#: Texts whose sketches a task holds at a time.
SKETCHED = 8192
COLUMNS = 2048

SHINGLE = 5
SKETCHES = 32
KEPT = 3
BLOCK = 1 << 15
_BYTE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_SEEDS = np.random.default_rng(41).integers(1, 1 << 63, SKETCHES, dtype=np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * _MIX
    return x ^ (x >> np.uint64(29))


def word_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of each word (run of bytes above 32)."""
    inside = data > 32
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    starts, stops = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    place = np.arange(len(data), dtype=np.uint64)
    place[starts[0]:] -= np.repeat(place[starts], np.diff(np.append(starts, len(data))))
    values = _mix((data.astype(np.uint64) + np.uint64(1)) * _BYTE + place * np.uint64(0xBF58476D1CE4E5B9)) * inside
    return _mix(np.add.reduceat(values, starts) + (stops - starts).astype(np.uint64))


def shingles(words: np.ndarray) -> np.ndarray:
    """Hash of each run of five words (of all words, if fewer)."""
    k = min(SHINGLE, len(words))
    n = len(words) - k + 1 if k else 0
    s = np.zeros(n, np.uint64)
    for j in range(k):
        s = _mix(s + words[j:j + n])
    return s


def labelled(s: np.ndarray) -> np.ndarray:
    """Shingle hashes made distinct by their occurrence number."""
    order = np.argsort(s, kind="stable")
    run = s[order]
    new = np.concatenate(([True], run[1:] != run[:-1]))
    nth = np.arange(len(s)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    occurrence = np.empty(len(s), np.uint64)
    occurrence[order] = nth.astype(np.uint64)
    return _mix(s + occurrence * _BYTE)


def sketch(s: np.ndarray) -> tuple[np.ndarray, np.uint64, np.uint64]:
    """Bucket keys, and the 32 four-bit marks as two integers."""
    names = labelled(s)
    n = len(names)
    best_v = best_i = None
    for at in range(0, n, BLOCK):
        v = (names[at:at + BLOCK] ^ (names[at:at + BLOCK] >> np.uint64(31)))[None, :] * _SEEDS[:, None]
        v ^= v >> np.uint64(32)
        k = min(KEPT, v.shape[1])
        i = np.argpartition(v, k - 1, axis=1)[:, :k] if k < v.shape[1] else np.tile(np.arange(k), (SKETCHES, 1))
        v = np.take_along_axis(v, i, axis=1)
        i = i + at
        if best_v is not None:
            v, i = np.concatenate((best_v, v), axis=1), np.concatenate((best_i, i), axis=1)
        best_v, best_i = v, i
    order = np.argsort(best_v, axis=1, kind="stable")[:, :KEPT]
    best_v, best_i = np.take_along_axis(best_v, order, axis=1), np.take_along_axis(best_i, order, axis=1)
    least = names[best_i[:, 0]]
    key = np.arange(SKETCHES, dtype=np.uint64)
    inorder = np.sort(best_i, axis=1)
    for j in range(inorder.shape[1]):
        key = _mix(key * _BYTE + names[inorder[:, j]])
    nib = (_mix(least) >> np.uint64(60))
    half = np.uint64(4) * np.arange(16, dtype=np.uint64)
    return key, (nib[:16] << half).sum(dtype=np.uint64), (nib[16:] << half).sum(dtype=np.uint64)


def agreement(a1: np.ndarray, a2: np.ndarray, b1: np.ndarray, b2: np.ndarray) -> np.ndarray:
    """How many of the 32 four-bit marks are equal."""
    out = np.int64(2 * 16)
    for a, b in ((a1, b1), (a2, b2)):
        x = a ^ b
        x = x | (x >> np.uint64(1))
        x = x | (x >> np.uint64(2))
        out = out - np.bitwise_count(x & np.uint64(0x1111111111111111)).astype(np.int64)
    return out


def likeness(n: np.ndarray, s1: np.ndarray, s2: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Equal marks of all rows ``x`` with all rows ``y``; 0 where they are
    fewer than ``AGREE`` or the lengths rule the similarity out."""
    like = agreement(s1[x][:, None], s2[x][:, None], s1[y][None, :], s2[y][None, :])
    m, k = n[x][:, None], n[y][None, :]
    like[(like < AGREE) | (np.minimum(m, k) < SIMILARITY * np.maximum(m, k))] = 0
    return like


def standing(key: np.ndarray, node: np.ndarray, n: np.ndarray, s1: np.ndarray, s2: np.ndarray) \
        -> tuple[np.ndarray, np.ndarray]:
    """Which rows stand for the others, and for each row the one it is linked
    to.  Rows of one bucket with equal marks and lengths within one band (the
    longest at most ``1 / SIMILARITY`` times the shortest) are candidates of
    each other, and any row near enough in length to one of them is so to the
    shortest or to the longest: these two stand for all."""
    band = np.floor(np.log(n) / -np.log(SIMILARITY)).astype(np.int64)
    order = np.lexsort((node, n, band, s2, s1, key))
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[order][1:] != c[order][:-1] for c in (key, s1, s2, band)], axis=0)
    stands, first = np.empty(len(order), bool), np.empty(len(order), np.int64)
    stands[order] = new | np.append(new[1:], True)
    first[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    return stands, first


def forest(n: np.ndarray, s1: np.ndarray, s2: np.ndarray, size: int = FOREST) \
        -> tuple[list[tuple[int, int]], list[list[int]]]:
    """A spanning forest of one bucket's candidate pairs (marks agree in at
    least ``AGREE`` places and lengths allow the similarity), the best pairs
    first, and its rows in blocks.  Rows come by length.  At most ``size`` rows
    are compared at a time, together with one row of each earlier tree, which
    joins most of them.  Up to ``size`` rows are one block and done; of more,
    each tree is a block of all its rows, and rows of different blocks are left
    for ``between``."""
    edges: list[tuple[int, int]] = []
    reps: list[int] = []
    for at in range(0, len(n), size):
        reps = [r for r in reps if n[r] >= SIMILARITY * n[at]]
        if len(reps) > size:
            reps = []
        rows = np.array([*reps, *range(at, min(len(n), at + size))])
        like = likeness(n, s1, s2, rows, rows)
        np.fill_diagonal(like, 0)
        degree = like.sum(axis=1)
        open_ = np.ones(len(rows), bool)
        reps = []
        while open_.any():
            root = int(np.argmax(np.where(open_, degree, -1)))
            reps.append(int(rows[root]))
            open_[root] = False
            best, parent = np.where(open_, like[root], 0), np.full(len(rows), root)
            while True:
                v = int(best.argmax())
                if best[v] == 0:
                    break
                edges.append((int(rows[parent[v]]), int(rows[v])))
                open_[v], best[v] = False, 0
                closer = open_ & (like[v] > best)
                best[closer], parent[closer] = like[v][closer], v
    if len(n) <= size:
        return edges, [list(range(len(n)))]
    up = list(range(len(n)))

    def top(v: int) -> int:
        while up[v] != v:
            up[v] = up[up[v]]
            v = up[v]
        return v
    for p, q in edges:
        up[top(p)] = top(q)
    trees: dict[int, list[int]] = {}
    for v in range(len(n)):
        trees.setdefault(top(v), []).append(v)
    return edges, list(trees.values())


def tiles(n: np.ndarray, blocks: list[list[int]], size: int = TILE) -> Iterator[tuple[np.ndarray, np.ndarray, list[int]]]:
    """The rows of several blocks by length in tiles of ``size``: rows, their
    blocks, and the tiles (itself included) near enough in length.  The largest
    block is in tiles of its own, which need not meet each other."""
    main = max(range(len(blocks)), key=lambda b: len(blocks[b]))
    every = np.array([r for b in blocks for r in b])
    owner = np.repeat(np.arange(len(blocks)), [len(b) for b in blocks])
    cut = []
    for part in (owner != main, owner == main):
        rows, block = every[part], owner[part]
        order = np.argsort(n[rows], kind="stable")
        cut += [(rows[order[i:i + size]], block[order[i:i + size]]) for i in range(0, len(order), size)]
    low, top = (np.array([n[rows[i]] for rows, _ in cut]) for i in (0, -1))
    largest = np.array([block[0] == main for _, block in cut])
    for t, (rows, block) in enumerate(cut):
        reach = (top >= SIMILARITY * low[t]) & (low * SIMILARITY <= top[t]) & ~(largest & largest[t])
        yield rows, block, np.flatnonzero(reach).tolist()


def between(tile: np.ndarray, block: np.ndarray, n: np.ndarray, s1: np.ndarray, s2: np.ndarray,
            size: int = FOREST) -> list[tuple[int, int]]:
    """Candidate edges of the rows of two tiles (or of one with itself) that
    join blocks: a spanning forest of the blocks, the best pairs first."""
    edges: list[tuple[int, int]] = []
    own = np.unique(block, return_inverse=True)[1]
    first, last = np.flatnonzero(tile == tile.min()), np.flatnonzero(tile == tile.max())
    for i in range(0, len(first), size):
        x = first[i:i + size]
        for j in range(i if first[0] == last[0] else 0, len(last), size):
            y = last[j:j + size]
            if min(n[x].max(), n[y].max()) < SIMILARITY * max(n[x].min(), n[y].min()):
                continue
            like = likeness(n, s1, s2, x, y)
            like[own[x][:, None] == own[y][None, :]] = 0
            u, v = np.nonzero(like)
            best = np.argsort(-like[u, v], kind="stable")
            u, v = x[u[best]], y[v[best]]
            for k in np.sort(np.unique(own[u] * len(own) + own[v], return_index=True)[1]).tolist():
                p, q = int(u[k]), int(v[k])
                if own[p] != own[q]:
                    own[own == own[q]] = own[p]
                    edges.append((p, q))
    return edges


def distance(a: np.ndarray, b: np.ndarray, limit: int) -> int | None:
    """Edit distance of two sequences if at most ``limit``, else None.
    Diagonal by diagonal inside the band of half-width ``limit``; the work is
    about the length plus the square of the distance."""
    na, nb = len(a), len(b)
    if abs(na - nb) > limit:
        return None
    if na == nb and (a == b).all():
        return 0
    ua, ca = np.unique(a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    if max(na, nb) - int(np.minimum(ca[ia], cb[ib]).sum()) > limit:
        return None                     # what the two do not share has to be edited
    first, second = a.tolist(), b.tolist()

    def slide(i: int, d: int) -> int:
        """First place in a from i on where diagonal d stops matching."""
        stop = min(na, nb - d)
        if i >= stop or first[i] != second[i + d]:
            return i
        size = 32
        while i < stop:
            size = min(2 * size, stop - i)
            differs = a[i:i + size] != b[i + d:i + d + size]
            k = int(differs.argmax())
            if differs[k]:
                return i + k
            i += size
        return i

    goal = nb - na
    far = {0: slide(0, 0)}              # diagonal (place in b minus place in a) -> furthest place in a
    if goal == 0 and far[0] == na:
        return 0
    for e in range(1, limit + 1):
        new = {}
        for d in range(-e, e + 1):
            # the rest of the way costs at least the distance to the goal's diagonal
            if abs(goal - d) > limit - e:
                continue
            i = max(far.get(d, -9) + 1, far.get(d + 1, -9) + 1, far.get(d - 1, -9))
            if i < 0 or i < -d:
                continue
            i = min(i, na, nb - d)
            if i < 0:
                continue
            new[d] = slide(i, d)
        if new.get(goal, -1) >= na:
            return e
        far = new
    return None


def _rows_of(text: bytes) -> np.ndarray:
    return shingles(word_hashes(np.frombuffer(text, np.uint8)))


def alike(a: bytes, b: bytes) -> float:
    """Similarity of two texts if it reaches ``SIMILARITY``, else 0."""
    x, y = _rows_of(a), _rows_of(b)
    longest = max(len(x), len(y))
    if not longest:
        return 0.0
    d = distance(x, y, int((1 - SIMILARITY) * longest + 1e-9))
    return 0.0 if d is None else 1.0 - d / longest


_ROWS = "key long, node long, n int, s1 long, s2 long, other long"


def _signed(x) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sketches of texts that stand for the others, ``SKETCHED`` texts of a
    task at a time, and the links of the others to them (rows with ``other``)."""
    seen: set[int] = set()
    held: list[tuple] = []
    for batch in batches:
        data, offsets = utf8_buffer(batch.column("words"))
        for i, node in enumerate(batch.column("node").to_pylist()):
            if node in seen:
                continue
            seen.add(node)
            s = shingles(word_hashes(data[offsets[i]:offsets[i + 1]]))
            if len(s):
                held.append((node, len(s), *sketch(s)))
            if len(held) == SKETCHED:
                yield from _standing_rows(held)
                seen.clear()
                held.clear()
    if held:
        yield from _standing_rows(held)


def _standing_rows(held: list[tuple]) -> Iterator[pa.RecordBatch]:
    nodes, counts, keys, s1, s2 = zip(*held)
    node, n = np.array(nodes, np.int64), np.array(counts, np.int64)
    a, b = np.array(s1, np.uint64), np.array(s2, np.uint64)
    key = np.concatenate(keys)
    row = np.repeat(np.arange(len(nodes)), SKETCHES)
    stands, first = standing(key, node[row], n[row], a[row], b[row])
    links = np.unique(np.stack((row[~stands], row[first[~stands]]), axis=1), axis=0)
    key, row = key[stands], row[stands]
    yield _table(key, node[row], n[row], a[row], b[row], np.full(len(key), None))
    if len(links):
        x, y = links.T
        yield _table(np.zeros(len(x), np.uint64), node[x], n[x], a[x], b[x], node[y])


def _runs(key: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of the runs of equal keys of more than one row."""
    cuts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    long = np.flatnonzero(np.diff(cuts) > 1)
    return zip(cuts[long].tolist(), cuts[long + 1].tolist())


def _table(key, node, n, s1, s2, other) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(_signed(key)), pa.array(node), pa.array(n.astype(np.int32)), pa.array(_signed(s1)),
         pa.array(_signed(s2)), pa.array(other, pa.int64())],
        ["key", "node", "n", "s1", "s2", "other"])


_PAIRS = "a long, b long, key long, tile int, block int, n int, s1 long, s2 long, near array<int>"


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate edges ``(a, b)`` among the standing rows of all tasks, and
    rows without ``b`` for what ``_between`` has still to compare.  Rows come
    sorted by key and length, the last key of a batch waits for the next one."""
    held = None
    names = ("key", "node", "n", "s1", "s2")
    schema = pa.schema([(c, pa.int64()) for c in ("a", "b", "key")] + [(c, pa.int32()) for c in ("tile", "block", "n")]
                       + [("s1", pa.int64()), ("s2", pa.int64()), ("near", pa.list_(pa.int32()))])
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            rows = [batch.column(c).to_numpy() for c in names]
            held = rows if held is None else [np.concatenate(p) for p in zip(held, rows)]
        if held is None or not len(held[0]):
            continue
        cut = len(held[0]) if batch is None else int(np.searchsorted(held[0], held[0][-1]))
        key, node, n, s1, s2 = (c[:cut] for c in held)
        held = [c[cut:] for c in held]
        stands, first = standing(key, node, n, s1, s2)
        out = list(zip(node[~stands].tolist(), node[first[~stands]].tolist()))
        key, node, n, s1, s2 = (c[stands] for c in (key, node, n, s1, s2))
        for lo, hi in _runs(key):
            m = n[lo:hi].astype(np.int64)
            pairs, blocks = forest(m, s1[lo:hi].view(np.uint64), s2[lo:hi].view(np.uint64))
            out += [(int(node[lo + x]), int(node[lo + y])) for x, y in pairs]
            if len(blocks) > 1:
                for t, (own, block, near) in enumerate(tiles(m, blocks)):
                    at, k = lo + own, len(own)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(c, f.type) for c, f in zip(
                            (node[at], [None] * k, key[at], np.full(k, t), block, n[at], s1[at], s2[at], [near] * k), schema)],
                        schema=schema)
        if out:
            a, b = zip(*out)
            rest = [pa.nulls(len(a), f.type) for f in list(schema)[2:]]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), *rest], schema=schema)


def _between(rows: DataFrame) -> DataFrame:
    """Candidate edges between the blocks of buckets with very many unlike
    texts: each tile meets each other tile near enough in length in a group of
    its own, so such a bucket is spread over many tasks and nothing is left out."""
    met = rows.withColumn("other", F.explode("near")).drop("near")
    met = met.withColumn("i", F.least("tile", "other")).withColumn("j", F.greatest("tile", "other"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tile", "n", "a"], kind="stable")
        node = pdf["a"].to_numpy()
        pairs = between(pdf["tile"].to_numpy(), pdf["block"].to_numpy(), pdf["n"].to_numpy().astype(np.int64),
                        pdf["s1"].to_numpy().view(np.uint64), pdf["s2"].to_numpy().view(np.uint64))
        return pd.DataFrame([(node[x], node[y]) for x, y in pairs], columns=["a", "b"], dtype="int64")
    return met.groupBy("key", "i", "j").applyInPandas(compare, "a long, b long")


def _verified(pairs: DataFrame, used: DataFrame) -> DataFrame:
    """``pairs(a, b)`` with ``near``: whether banded alignment confirms them.
    ``used(node, words)`` has one text of each node that is in a pair."""
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [alike(x, y) >= SIMILARITY for x, y in zip(
                batch.column("words_a").cast(pa.binary()).to_pylist(),
                batch.column("words_b").cast(pa.binary()).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(near, pa.bool_())],
                                             ["a", "b", "near"])
    left = used.select(F.col("node").alias("a"), F.col("words").alias("words_a"))
    right = used.select(F.col("node").alias("b"), F.col("words").alias("words_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "words_a", "words_b")
    return lean_map(both, check, "a long, b long, near boolean")


def _shared(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of ``x`` with all of ``y``."""
    common = np.intersect1d(np.concatenate(x), np.concatenate(y))
    out = np.zeros((len(x), len(y)), np.float32)
    places = []
    for sets in (x, y):
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        values = np.concatenate(sets)
        at = np.minimum(np.searchsorted(common, values), max(0, len(common) - 1))
        hit = common[at] == values if len(common) else np.zeros(len(values), bool)
        at, row = at[hit], row[hit]
        order = np.argsort(at, kind="stable")
        places.append((at[order], row[order]))
    for start in range(0, len(common), COLUMNS):
        parts = []
        for (at, row), sets in zip(places, (x, y)):
            lo, hi = np.searchsorted(at, (start, start + COLUMNS))
            m = np.zeros((len(sets), COLUMNS), np.float32)
            m[row[lo:hi], at[lo:hi] - start] = 1.0
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out


def _joining(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Links between texts of different components in two blocks: all pairs
    are bounded by what they share, the possible ones aligned, best first,
    until the components they would join are joined."""
    found: list[tuple[int, int]] = []
    if len(left) and len(right):
        seqs = [[_rows_of(w.encode()) for w in side["words"]] for side in (left, right)]
        both = _shared(*[[np.unique(labelled(s)) for s in side] for side in seqs])
        n, m = (np.array([len(s) for s in side], float) for side in seqs)
        r, q = left["root"].to_numpy(), right["root"].to_numpy()
        most = np.maximum(n[:, None], m[None, :])
        ok = (both >= most * SIMILARITY - 1e-6) & (r[:, None] != q[None, :])
        i, j = np.nonzero(ok)
        order = np.argsort(-(both[i, j] / most[i, j]), kind="stable")
        parent: dict[int, int] = {}

        def top(v: int) -> int:
            while parent.get(v, v) != v:
                v = parent[v]
            return v
        for x, y in zip(i[order].tolist(), j[order].tolist()):
            u, v = top(int(r[x])), top(int(q[y]))
            if u != v:
                longest = int(most[x, y])
                if distance(seqs[0][x], seqs[1][y], int((1 - SIMILARITY) * longest + 1e-9)) is not None:
                    parent[max(u, v)] = min(u, v)
                    found.append((int(r[x]), int(q[y])))
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def _rejoined(spark: SparkSession, found: DataFrame, roots: DataFrame, used: DataFrame) -> DataFrame:
    """Links ``(a, b)`` between roots that the tested pairs have missed.

    Any two texts with a common bucket and enough equal marks are in one
    component of the candidate pairs, tested or not.  Where such a component
    has fallen into several confirmed ones, the texts outside its largest are
    compared with all of its texts, a block of at most about ``COMPARED`` rows
    with a block."""
    loose = components(spark, found.select("a", "b")).withColumnRenamed("root", "group") \
        .join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    loose = materialize(spark, loose, "omh-groups")
    parts = loose.groupBy("group", "root").agg(F.count(F.lit(1)).alias("n"))
    whole = parts.groupBy("group").agg(F.sum("n").alias("n"), F.max("n").alias("top"), F.count(F.lit(1)).alias("roots"),
                                       F.max_by("root", F.struct("n", "root")).alias("main")).where(F.col("roots") > 1)
    whole = whole.select("group", "main", F.ceil(F.col("n") / COMPARED).cast("int").alias("blocks"),
                         F.ceil((F.col("n") - F.col("top")) / COMPARED).cast("int").alias("rests"))
    rows = loose.join(whole, "group").join(used, "node")
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.where(F.col("root") != F.col("main")).select(
        "group", own("rests").alias("i"), "root", "words", every("blocks").alias("j"))
    right = rows.select(F.col("group").alias("g"), own("blocks").alias("jj"), F.col("root").alias("root"),
                        F.col("words").alias("words"), every("rests").alias("ii"))
    right = right.select("g", "ii", "jj", F.col("root").alias("root_"), F.col("words").alias("words_"))

    def join(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        return _joining(x, y.rename(columns={"root_": "root", "words_": "words"}))
    return left.groupBy("group", "i", "j").cogroup(right.groupBy("g", "ii", "jj")).applyInPandas(join, "a long, b long")


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` -> ``(node, root)``, the smallest node of each connected
    component, by alternating large and small stars until nothing changes."""
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    print_of = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    edges = materialize(spark, edges.where(F.col("a") != F.col("b")).distinct(), "omh-stars")
    mark = print_of(edges)
    while mark[0]:
        e = both(edges)
        least = e.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = e.join(least, "a").where(F.col("b") > F.col("a")) \
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).distinct()
        # every edge now points from a larger to a smaller node
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(
            F.struct(F.col("a").alias("x"), F.col("m").alias("y")),
            F.struct(F.col("b").alias("x"), F.col("m").alias("y")))).alias("e")) \
            .select(F.col("e.x").alias("a"), F.col("e.y").alias("b")).where(F.col("a") != F.col("b")).distinct()
        edges = materialize(spark, small, "omh-stars")
        after = print_of(edges)
        if after == mark:
            break
        mark = after
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def linked(docs: DataFrame) -> DataFrame:
    """``(node, root)`` of every text that is linked to another one; nodes are
    distinct texts, named by a 64-bit hash."""
    spark = docs.sparkSession
    texts = docs.select(node_of("text").alias("node"), F.lower("text").alias("words")).where(F.col("node").isNotNull())
    rows = materialize(spark, lean_map(texts, _local, _ROWS), "omh-sketches")
    mine = rows.where(F.col("other").isNotNull()).select(F.col("node").alias("a"), F.col("other").alias("b"))
    stand = rows.where(F.col("other").isNull()).select("key", "node", "n", "s1", "s2").repartition(F.col("key")) \
                .sortWithinPartitions("key", "n", "node")
    stand = materialize(spark, lean_map(stand, _across, _PAIRS), "omh-across")
    more = _between(stand.where(F.col("b").isNull()))
    found = mine.unionByName(stand.where(F.col("b").isNotNull()).select("a", "b")).unionByName(more).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")) \
                .where(F.col("a") != F.col("b")).distinct()
    found = materialize(spark, found, "omh-candidates")
    ends = found.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    # one text of each node that is in a pair; by shuffle at every size, as the pairs grow with the input
    used = texts.join(ends.hint("merge"), "node", "left_semi").groupBy("node").agg(F.first("words").alias("words"))
    used = materialize(spark, used, "omh-texts")
    tested = materialize(spark, _verified(found, used), "omh-verified")
    roots = materialize(spark, components(spark, tested.where("near").select("a", "b")), "omh-roots")
    more = materialize(spark, _rejoined(spark, found, roots, used), "omh-rejoined")
    upper = components(spark, more).select(F.col("node").alias("root"), F.col("root").alias("_top"))
    joined = roots.join(upper, "root", "left").select("node", F.coalesce("_top", "root").alias("root"))
    # a text without a confirmed pair of its own may be joined by the last step
    return joined.unionByName(upper.join(roots, upper["root"] == roots["node"], "left_anti")
                              .select(F.col("root").alias("node"), F.col("_top").alias("root")))


def node_of(text: str) -> Column:
    """Hash that names a distinct text; null for texts without a word."""
    return F.when(F.col(text).rlike(r"[^\x00-\x20]"), F.xxhash64(text))


def classes(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document: ``id, class_id`` (smallest id of its class),
    ``class_size`` (rows), ``node`` and ``kept`` (it is the row of that id)."""
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), node_of("text").alias("node"))
    roots = linked(docs)
    each = rows.where(F.col("node").isNotNull()).groupBy("node").agg(
        F.min(id_col).alias("least"), F.count(F.lit(1)).alias("rows"))
    each = each.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    whole = each.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("rows").alias("class_size"),
                                     F.min_by("node", F.struct(F.col("least").isNull(), "least", "node")).alias("first"))
    each = each.join(whole, "root").select(F.col("node").alias("_node"), "class_id", "class_size", "first")
    out = rows.join(each, F.col("node") == F.col("_node"), "left")
    alone = F.col("_node").isNull()
    return out.select(id_col, F.when(alone, F.col(id_col)).otherwise(F.col("class_id")).alias("class_id"),
                      F.when(alone, 1).otherwise(F.col("class_size")).cast("long").alias("class_size"), "node",
                      (alone | ((F.col("node") == F.col("first"))
                                & F.col(id_col).eqNullSafe(F.col("class_id")))).alias("kept"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each class; texts without a word all stay."""
    names = docs.columns
    kept = classes(docs, id_col).where("kept").where(F.col("node").isNotNull()) \
        .select(F.col(id_col).alias("_id"), F.col("node").alias("_node")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
                       F.col(id_col).cast("long").alias("_doc"), node_of("text").alias("_text_node"))
    one = rows.join(kept, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_text_node") == F.col("_node")), "left_semi") \
              .groupBy("_doc", "_text_node").agg(F.first("row").alias("row")).select("row")
    out = one.unionByName(rows.where(F.col("_text_node").isNull()).select("row"))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in names])
