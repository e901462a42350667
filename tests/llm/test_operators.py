"""Corpus operators against plain Python versions on small tables."""
import hashlib
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlens.llm import (ctph, mixing, order_minhash, ordinal, packing, pii, polytope, ppm, queries, secrets,
                            semantic_knn)
from tests.conftest import SF

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, part int, halo string"
ODD = [
    (1, "", "en", "a"), (2, None, None, None), (3, "one two three four five six seven", "en", "a"),
    (3, "one two three four five six seven", "en", "a"), (4, "one two three four five six seven", "fr", None),
    (None, "é😀 write to a@b.c now 4111111111111111", None, "b"), (6, " \n\t ", "en", "b"),
    (7, "word " * 30_000, "en", "a"), (8, "9" * 30_000 + " x", "de", "c"),
    (9, "GB82 WEST 1234 5698 7654 32 and ssn 123-45-6789, then a long way further on plain 123-45-6780", "en", "a"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, g, s, None, "x", 0, "y") for i, t, g, s in ODD], SCHEMA)


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("1 = 0")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(SF + "/documents.parquet")


def same_as_plain_order(rows, got):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    want = []
    for k, (i, text) in enumerate(rows):
        follow, n = rows[(k + 1) % len(rows)][1], len(text)
        edited = text[:n - n // 2] + follow[:n // 2]
        want.append((i, n, hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_chars, r.edited_sha256)) for r in got)


def test_fingerprints_follow_the_id_order(docs):
    got = queries.op1_ctph_fingerprints(docs.sparkSession, SF).collect()
    same_as_plain_order([(r.doc_id, r.text) for r in docs.collect()], got)
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert np.mean([r.near_edited for r in got]) > 0.4 > 0.1 > np.mean([r.near_next for r in got])


def test_fingerprints_of_odd_rows(odd, none):
    rows = [(i, t or "") for i, t, *_ in ODD if i != 3]
    same_as_plain_order(rows, ctph.successive(odd.where("doc_id is null or doc_id <> 3")).collect())
    assert len(ctph.successive(odd).collect()) == len(ODD)
    assert ctph.successive(none).count() == 0
    alone = ctph.successive(odd.where("doc_id = 7")).first()
    assert alone.near_next == 1.0
    assert str(ctph.fingerprint(b"")) == "0::"


def test_fingerprint_likeness_is_an_edit_distance():
    rng = np.random.default_rng(5)
    for _ in range(200):
        a, b = (rng.integers(0, 6, rng.integers(1, 64)).tolist() for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            last, row = row, [0]
            for j, y in enumerate(b, 1):
                row.append(last[j - 1] + 1 if x == y else max(last[j], row[-1]))
        assert ctph._ratio(a, b) == pytest.approx(2 * row[-1] / (len(a) + len(b)))


def _brute_neighbours(rows, queries_, k):
    out = {}
    for q, v in queries_:
        d = sorted((float(np.sqrt(((np.array(w) - np.array(v)) ** 2).sum())), i) for i, w in rows if i != q)
        out[q] = [i for _, i in d[:k]]
    return out


def test_nearest_neighbours_recall(spark):
    got = defaultdict(list)
    for r in queries.op2_cross_polytope(spark, SF).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(SF + "/embeddings.parquet").collect()]
    want = _brute_neighbours(rows, [x for x in rows if x[0] % 100 == 0], 10)
    hits = sum(len(set(got[q]) & set(w)) for q, w in want.items())
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_nearest_neighbours_visit_a_third_of_the_rows_and_find_nine_tenths(spark):
    """Against the cells visited by a plain version, and against all rows."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    rows = sorted((r.id, r.vec) for r in table.collect())
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    asked = np.flatnonzero(ids % 50 == 0)
    kept = F.col("id") % 50 == 0
    got = defaultdict(list)
    for r in polytope.nearest(table.where(kept), table, block_rows=300).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert len(x) <= polytope.SAMPLE_ROWS
    model = polytope.fit(np.unique(x, axis=0), polytope.TABLES, 17)
    seen, compared = np.zeros((len(asked), len(x)), bool), 0
    for t, (cells, weights) in enumerate(model):
        scores = polytope._rotated(x, t, 17)
        own = np.argsort(-scores, axis=1, kind="stable")
        for n, q in enumerate(asked):
            probed = set(own[q, :polytope.PROBES])
            cosine = lambda cell: sum(w * scores[q, a] for w, a in zip(weights, cell))  # noqa: B023, E731
            known = sorted((cosine(c) for c in cells if c[0] in probed), reverse=True)
            least = known[max(polytope.LEAST_CELLS, int(np.ceil(polytope.SHARE / polytope.TABLES * len(cells)))) - 1]
            visited = np.array([own[i, 0] in probed and cosine(own[i, :3]) >= least - 1e-9 for i in range(len(x))])
            seen[n] |= visited
            compared += visited.sum()
    distance = np.sqrt(((x[asked][:, None] - x[None]) ** 2).sum(axis=2))
    distance[np.arange(len(asked)), asked] = np.inf
    hits = 0
    for n, q in enumerate(asked):
        plain = sorted((distance[n, i], ids[i]) for i in np.flatnonzero(seen[n]) if i != q)[:10]
        assert got[ids[q]] == [i for _, i in plain]
        hits += len(set(got[ids[q]]) & set(ids[np.argsort(distance[n], kind="stable")[:10]]))
    assert compared <= len(asked) * len(x) / 3 and hits >= 0.9 * 10 * len(asked)


def test_nearest_neighbours_among_many_copies(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 8))
    x[:150] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    some = df.where("id % 40 = 0")
    got = defaultdict(list)
    for r in polytope.nearest(some, df, k=10, block_rows=16).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert got[0] == [(i, 0.0) for i in range(1, 11)] and got[40][:2] == [(0, 0.0), (1, 0.0)]
    want = _brute_neighbours(rows, [r for r in rows if r[0] % 40 == 0], 10)
    hits = sum(len({i for i, _ in got[q]} & set(w)) for q, w in want.items())
    assert all(len(v) == 10 for v in got.values()) and hits >= 0.8 * 100


def test_nearest_neighbours_of_odd_and_few_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0, 0.0]), (1, [0.0, 0.0, 0.0]), (2, None), (3, [1.0, None, 0.0]), (4, [nan, 1.0, 0.0]),
            (5, [inf, 1.0, 0.0]), (6, [0.0, 2.0, 0.0]), (7, [0.0, 2.0, 0.0]), (7, [0.0, 2.0, 0.0]), (8, [-1.0, 0.0, 1.0]),
            (9, [1.0, 1.0]), (None, [1.0, 0.0, 0.0]), (10, [])]
    df = spark.createDataFrame(rows, "id long, vec array<float>")
    got = polytope.nearest(df.where("id = 0"), df, k=10, block_rows=1).orderBy("rank").collect()
    assert [(r.rank, r.vec_id) for r in got] == [(1, 6), (2, 7), (3, 8)] or \
        sorted(r.vec_id for r in got) == [6, 7, 8]
    assert got[0].score == min(r.score for r in got)
    assert polytope.nearest(df.where("1 = 0"), df).count() == 0
    assert polytope.nearest(df, df.where("1 = 0")).count() == 0


def test_mix_meets_targets_and_repeats_no_more_than_allowed(spark, docs):
    rows = queries.op3_sainte_lague_mix(spark, SF).toPandas()
    again = queries.op3_sainte_lague_mix(spark, SF).toPandas()
    assert rows.sort_values("doc_id").reset_index(drop=True).equals(again.sort_values("doc_id").reset_index(drop=True))
    assert (rows["taken"] <= 3 * rows["size"]).all()
    rows = rows.merge(docs.select("doc_id", "source", "text").toPandas(), on="doc_id")
    assert (rows["size"] == [len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in rows["text"]]).all()
    by = rows.groupby("source").agg(s=("source_size", "first"), t=("target", "first"), k=("taken", "sum"))
    assert by["t"].sum() == pytest.approx(rows["size"].sum())
    assert ((by["k"] - by["t"]).abs() <= 64).all() and (by["t"] <= 3 * by["s"] + 1e-6).all()
    weights = [(5, 2, 1)[i % 3] for i in range(len(by))]
    level = [t / w for t, w, s in zip(by["t"], weights, by["s"]) if t < 3 * s - 1e-6]
    assert max(level) == pytest.approx(min(level))


def test_apportionment_is_highest_quotients(spark):
    rng = np.random.default_rng(8)
    for seats in (0, 1, 7, 500):
        votes = [int(v) for v in rng.integers(0, 1000, 12)]
        df = spark.createDataFrame(list(enumerate(votes)), "place int, votes long")
        got = {r.place: r.quota for r in mixing.sainte_lague(df, "votes", F.lit(seats), ["place"]).collect()}
        best = sorted(((-v / (2 * s - 1), i) for i, v in enumerate(votes) for s in range(1, seats + 1)))[:seats]
        assert got == {i: sum(j == i for _, j in best) for i in range(12)}


def test_mix_of_odd_rows(odd, none):
    assert mixing.quotas(odd).count() == len(ODD)
    assert mixing.quotas(none).count() == 0 and mixing.mixed(none).count() == 0
    out = mixing.mixed(odd, block_words=2)
    assert out.columns == odd.columns
    taken = mixing.quotas(odd, block_words=2).agg(F.sum("taken")).first()[0]
    assert out.agg(F.sum(mixing.word_count())).first()[0] == taken


def test_edit_distance_in_a_band():
    rng = np.random.default_rng(3)
    for t in range(400):
        a = rng.integers(0, 4 if t % 2 else 40, rng.integers(0, 30)).tolist()
        b = [x for x in a if rng.random() > 0.1] + rng.integers(0, 40, rng.integers(0, 4)).tolist()
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        limit = int(rng.integers(0, 12))
        got = order_minhash.distance(np.array(a, np.uint64), np.array(b, np.uint64), limit)
        assert got == (row[-1] if row[-1] <= limit else None)


def _brute_classes(rows):
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x
    text = [(t or "").lower().encode() for _, t in rows]
    seqs = [order_minhash._rows_of(t) for t in text]
    sets = [set(s.tolist()) for s in seqs]
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] & sets[j] and top(i) != top(j) and order_minhash.alike(text[i], text[j]) > 0:
                parent[top(i)] = top(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[top(i)].append(rows[i][0])
    return sorted((i, min(g)) for g in groups.values() for i in g)


def test_near_duplicates_match_brute_force(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(3000)]
    hub = [words[i] for i in rng.integers(0, 3000, 150)]
    for k in range(40):                     # a group of near copies, some too far from most others
        own = list(hub)
        for p in rng.integers(0, 150, 1 + k % 9):
            own[p] = words[rng.integers(0, 3000)]
        rows.append((10_000 + k, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = order_minhash.classes(df).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == _brute_classes(rows)
    assert sum(r.kept for r in got) == len({r.class_id for r in got})
    assert order_minhash.deduplicated(df).count() == len({r.class_id for r in got})


def test_blocks_join_what_the_tested_pairs_miss():
    import pandas as pd
    base = [f"w{i}" for i in range(100)]
    near = base[:50] + ["new"] + base[51:]
    side = lambda *rows: pd.DataFrame(rows, columns=["root", "words"])
    got = order_minhash._joining(side((1, " ".join(base)), (5, "nothing in common with these")),
                                 side((2, " ".join(near)), (1, " ".join(base))))
    assert got.values.tolist() == [[1, 2]]


def _joined(n, edges):
    parent = list(range(n))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        parent[top(a)] = top(b)
    return [top(x) for x in range(n)]


def test_full_buckets_lose_no_candidate():
    rng = np.random.default_rng(8)
    s1, s2 = (rng.integers(0, 1 << 63, 900, dtype=np.uint64) for _ in range(2))
    s1[600:], s2[600:] = s1[:300], s2[:300]             # equal marks under other lengths, among unlike ones
    s1[700:750] ^= np.uint64(0xFFFF)
    n = np.sort(rng.integers(50, 400, 900))
    mixed = rng.permutation(900)
    s1, s2 = s1[mixed], s2[mixed]
    edges, blocks = order_minhash.forest(n, s1, s2, size=16)
    assert len(blocks) > 2
    met = list(order_minhash.tiles(n, blocks, size=40))
    assert any(len(near) < len(met) for _, _, near in met)
    for t, (rows, block, near) in enumerate(met):
        for u in (u for u in near if u >= t):
            both = rows if u == t else np.concatenate((rows, met[u][0]))
            tile = np.repeat([t, u], [len(rows), len(both) - len(rows)])
            owner = block if u == t else np.concatenate((block, met[u][1]))
            edges += [(int(both[a]), int(both[b])) for a, b in
                      order_minhash.between(tile, owner, n[both], s1[both], s2[both], size=16)]
    every = np.arange(900)
    like = order_minhash.likeness(n, s1, s2, every, every)
    a, b = np.nonzero(like)
    groups = _joined(900, edges)
    assert len(a) > 1000 and all(groups[x] == groups[y] for x, y in zip(a.tolist(), b.tolist()))
    assert all(like[x, y] for x, y in edges)


def test_full_buckets_of_graded_rows_lose_no_candidate():
    """Trees whose ends are no candidates of their middle."""
    rng = np.random.default_rng(12)
    n, s1, s2 = [], [], []
    for _ in range(40):
        marks, length = rng.integers(0, 16, 32), 40.0
        for _ in range(int(rng.integers(1, 25))):
            marks[rng.integers(0, 32, 4)] = rng.integers(0, 16, 4)
            length *= rng.choice([1.0, 1.05, 1.2, 1.3])
            n.append(int(length))
            for s, half in ((s1, marks[:16]), (s2, marks[16:])):
                s.append(sum(int(m) << (4 * k) for k, m in enumerate(half)))
    order = np.argsort(n, kind="stable")
    n, s1, s2 = np.array(n)[order], np.array(s1, np.uint64)[order], np.array(s2, np.uint64)[order]
    edges, blocks = order_minhash.forest(n, s1, s2, size=16)
    met = list(order_minhash.tiles(n, blocks, size=40))
    for t, (rows, block, near) in enumerate(met):
        for u in (u for u in near if u >= t):
            both = rows if u == t else np.concatenate((rows, met[u][0]))
            tile = np.repeat([t, u], [len(rows), len(both) - len(rows)])
            owner = block if u == t else np.concatenate((block, met[u][1]))
            edges += [(int(both[a]), int(both[b])) for a, b in
                      order_minhash.between(tile, owner, n[both], s1[both], s2[both], size=16)]
    every = np.arange(len(n))
    groups = _joined(len(n), edges)
    a, b = np.nonzero(order_minhash.likeness(n, s1, s2, every, every))
    assert all(groups[x] == groups[y] for x, y in zip(a.tolist(), b.tolist()))


def test_near_duplicates_of_graded_versions_in_several_tasks(spark):
    """Truncated, extended and edited versions whose links run from task to task."""
    rng = np.random.default_rng(14)
    parts = [[], [], []]
    for family in range(60):
        base = [f"f{family}w{i}" for i in range(154)]
        # one task has a text and longer versions of it, another what is near to the shortest only
        longer = base + [f"f{family}v{i}" for i in range(3)]
        parts[family % 3] += [" ".join(base)] + [" ".join(longer + [f"end{k}"]) for k in range(3)]
        parts[(family + 1) % 3].append(" ".join(base[:126]))
    for family in range(12):
        own = [f"g{family}w{i}" for i in range(300)]
        for k in range(12):                             # each version is made from the one before
            own = own + [f"g{family}v{k}w{i}" for i in range(int(rng.integers(0, 50)))]
            own = own[int(rng.integers(0, 30)):]
            own[int(rng.integers(0, len(own)))] = "new"
            parts[int(rng.integers(0, 3))].append(" ".join(own))
    rows = [(i, t) for i, t in enumerate(t for part in parts for t in part)]
    cut = np.cumsum([0] + [len(p) for p in parts]).tolist()
    dealt = spark.sparkContext.parallelize([rows[lo:hi] for lo, hi in zip(cut, cut[1:])], 3).flatMap(lambda part: part)
    df = spark.createDataFrame(dealt, "doc_id long, text string")
    assert df.rdd.getNumPartitions() == 3
    got = sorted((r.doc_id, r.class_id) for r in order_minhash.classes(df).collect())
    assert got == _brute_classes(rows)


def test_near_duplicates_among_texts_with_one_passage(spark):
    """Buckets of more unlike texts than one comparison holds."""
    rng = np.random.default_rng(6)
    shared = [f"p{i}" for i in range(24)]
    rows = []
    for k in range(3000):
        own = [f"w{i}" for i in rng.integers(0, 100_000, 24)]
        rows.append((k, " ".join(shared + own)))
        if k % 50 == 0:                                 # a copy with another last word
            rows.append((100_000 + k, " ".join(shared + own[:-1] + ["end"])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.class_id for r in order_minhash.classes(df).collect()}
    assert got == {i: i % 100_000 for i, _ in rows}


def test_class_with_a_text_without_id_keeps_one_document(spark):
    base = [f"w{i}" for i in range(100)]
    rows = [(None, " ".join(base)), (5, " ".join(base[:-1] + ["end"])), (7, " ".join(base[:-1] + ["last"])),
            (None, "some other text without an id"), (None, "some other text without an id")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = order_minhash.classes(df).collect()
    assert sorted((r.doc_id or 0, r.class_id or 0, r.class_size, r.kept) for r in got) == [
        (0, 0, 2, True), (0, 0, 2, True), (0, 5, 3, False), (5, 5, 3, True), (7, 5, 3, False)]
    assert sorted(r.doc_id or 0 for r in order_minhash.deduplicated(df).collect()) == [0, 5]


def test_near_duplicates_of_odd_rows(odd, none):
    got = {(r.doc_id, r.class_id, r.kept) for r in order_minhash.classes(odd).collect()}
    assert {(3, 3, True), (4, 3, False), (1, 1, True), (2, 2, True), (6, 6, True)} <= got
    kept = order_minhash.deduplicated(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 6, 7, 8, 9]
    assert order_minhash.classes(none).count() == 0


def test_language_is_learned(spark, docs):
    rows = queries.op5_ppm_language(spark, SF).toPandas().merge(docs.select("doc_id", "lang", "text").toPandas(), on="doc_id")
    held = [zlib.crc32(str(i).encode()) % 4 == 2 for i in rows["doc_id"]]
    assert (rows["held_out"] == held).all()
    assert (rows[held]["lang_pred"] == rows[held]["lang"]).mean() >= 0.95


def test_code_lengths_match_a_plain_model():
    train = {"a": ["abab abba", "aab"], "b": ["xyx yyx ab"]}
    model = ppm.fit(train)
    counts = {g: defaultdict(lambda: defaultdict(int)) for g in train}
    for g, texts in train.items():
        for t in texts:
            line = [-1] * 3 + list(t.encode())
            for i in range(3, len(line)):
                for k in range(4):
                    counts[g][tuple(line[i - k:i])][line[i]] += 1

    def bits(g, t):
        line, total = [-1] * 3 + list(t.encode()), 0.0
        for i in range(3, len(line)):
            for k in (3, 2, 1, 0):
                seen = counts[g].get(tuple(line[i - k:i]))
                if not seen:
                    continue
                n, u = sum(seen.values()), len(seen)
                if line[i] in seen:
                    total -= np.log2(seen[line[i]] / (n + u))
                    break
                total -= np.log2(u / (n + u))
            else:
                total += 8
        return total
    texts = ["abx", "", "zzz yx", "ab" * 20]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t) for t in texts])
    old, ppm.WINDOW = ppm.WINDOW, 5
    try:
        got = ppm.code_lengths(data, offsets, model["tables"])
    finally:
        ppm.WINDOW = old
    assert got == pytest.approx(np.array([[bits(g, t) for g in ("a", "b")] for t in texts]), rel=1e-4)


def test_language_of_odd_rows(odd, none):
    got = {r.doc_id: r for r in ppm.identify(odd).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[6].lang_pred == "und" and got[2].score == 0
    assert got[7].lang_pred in ("en", "fr", "de")
    assert ppm.identify(none).count() == 0
    assert {r.lang_pred for r in ppm.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def _spans(text, rules):
    found = []
    for place, (kind, pattern, good) in enumerate(rules):
        found += [(m.start(), place, kind, m.end()) for m in re.finditer(pattern, text or "") if good(m)]
    found.sort()
    counts = [sum(f[2] == kind for f in found) for kind, *_ in rules]
    return counts, hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, k, e in found).encode()).hexdigest()


def _luhn(m):
    d = [int(c) for c in re.sub("[^0-9]", "", m.group())][::-1]
    return 14 <= len(d) <= 19 and sum(d[::2] + [sum(divmod(2 * x, 10)) for x in d[1::2]]) % 10 == 0


PERSONAL = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.group().split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", _luhn),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15)]
SECRET = [
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
     lambda m: len(m.group(1)) >= 6),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m.group()) >= 20),
    ("hex", r"[0-9a-f]+", lambda m: len(m.group()) >= 24)]
TRICKY = ["", None, "a@b.com_x@y.org", "a@b.co.@c.d x+y@z.w.", "1.2.3.4.5.6.7.8 999.1.1.1 001.002.003.0004",
          "+1 (555) 123-4567 +123 +4912345678901234567", "4111 1111 1111 1111 4111-1111-1111-1111 41111111111111112",
          "1 " * 20_000, "x" * 20_000 + "@", "9" * 20_000, "é😀 a@b.c é 4111111111111111",
          "secret=token:abcdefgh password==abc API_KEY : 'abcdef' apikey=x token=\"zzzzzz", "AKIAAKIA" + "Z" * 20,
          "deadbeef" * 4 + "g" + "a" * 23 + " " + "f" * 20_000, "a%" * 10_000, "a@b" + ".c" * 10_000, "password" * 3000]


@pytest.mark.parametrize("find, rules", [(pii.find, PERSONAL), (secrets.find, SECRET)])
def test_spans_match_plain_regular_expressions(spark, docs, find, rules):
    rows = list(enumerate(TRICKY)) + [(r.doc_id + 1000, r.text) for r in docs.collect()]
    df = spark.createDataFrame([(i, t, f"s{i % 3}") for i, t in rows], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in find(df).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        counts, digest = _spans(t, rules)
        assert ([got[i][f"n_{k}"] for k, *_ in rules], got[i].base_sha256) == (counts, digest), (i, t and t[:80])


def test_personal_data_added_by_checksum_and_context(odd, none):
    got = {r.doc_id: r for r in pii.find(odd).collect()}
    assert got[9].spans == "iban:0:27,national:36:47"
    out = {r.doc_id: r.text for r in pii.redacted(odd).collect()}
    assert out[9] == "[IBAN] and ssn [NATIONAL], then a long way further on plain 123-45-6780"
    assert out[None] == "é😀 write to [EMAIL] now [CARD]" and out[2] is None
    assert pii.redacted(odd).columns == odd.columns
    assert pii.find(none).count() == 0


def test_spans_of_a_text_with_very_many_matches(spark):
    rng = np.random.default_rng(5)
    words = ["mail", "é😀", "card 4111111111111111", "a@b.cd", "+49 30 1234567", "10.1.2.3", "host", "iban DE89370400440532013000", "x" * 70]
    texts = ["", " ".join(rng.choice(words, 16_000)), " ".join(rng.choice(words, 700)), "a@b.cd"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    started = time.monotonic()
    got = {r.doc_id: r for r in pii.find(df).collect()}
    clean = {r.doc_id: r.text for r in pii.redacted(df).collect()}
    assert time.monotonic() - started < 60
    for i, t in enumerate(texts):
        assert got[i].base_sha256 == _spans(t, PERSONAL)[1]
        want, at = [], 0
        spans = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in got[i].spans.split(",") if x)]
        for (kind, start, stop), score in zip(spans, got[i].scores):
            points, near = pii.KINDS[kind]
            gain = 0.35 if re.search(near, t[max(0, start - 40):start].lower()) else 0.0
            assert score == pytest.approx(min(1.0, points + gain))
            if start >= at:
                want += [t[at:start], f"[{kind.upper()}]"]
            at = max(at, stop)
        assert clean[i] == "".join(want) + t[at:]


def test_secrets_copied_to_many_repositories_of_one_owner_are_examples(spark):
    copied, own = "k " + "Zx9" * 12 + "Q", "k " + "Yy7" * 12 + "R"
    rows = [(i, copied, "a") for i in range(secrets.EXAMPLE_REPOS)] + [(500, own, "a")] * 40 + [(None, own, "a")] * 2
    got = secrets.find(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {(r.spans, r.n_live) for r in got if r.doc_id is not None and r.doc_id < 500} == {("", 0)}
    assert {r.classes for r in got if r.doc_id is None or r.doc_id == 500} == {"live"}


def test_secrets_by_ownership(spark, none):
    live, copied = "Zx9" * 12 + "Q", "password=hunter2hunter2"
    rows = [(1, f"k {live}", "a"), (2, copied, "a"), (3, copied, "b"), (4, copied + " " + copied, None), (5, copied, "c"),
            (5, copied, "c"), (6, "token=abcdef123", "a"), (7, "k " + "Yy7" * 12, "a"), (8, "k " + "Yy7" * 12, "b")]
    got = secrets.find(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert by[1].spans.startswith("token:") and by[1].n_live == 1 and by[1].n_assign == 0
    assert by[2].classes == "example" and by[4].n_assign == 2 and by[6].classes == "live"
    assert by[7].spans == "" and by[8].spans == ""
    assert secrets.find(none).count() == 0


def _packing_holds(rows, texts):
    from public_tokenizers import path
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(path("byte_bpe_50k.json"))
    want = [np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for t in texts]
    assert sum(r.length for r in rows) == sum(map(len, want))
    pieces = sorted((zlib.crc32(w[s:s + 1024].tobytes()), len(w[s:s + 1024])) for w in want for s in range(0, len(w), 1024))
    assert sorted((r.ids_crc32, r.length) for r in rows) == pieces
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    return len(sequences), sum(map(len, want))


def test_packing_round_trip(spark, docs):
    rows = queries.op7_minimum_slack_packing(spark, SF).collect()
    used, tokens = _packing_holds(rows, [r.text for r in docs.collect()])
    assert used <= -(-tokens // 1024) + 4


def test_packing_of_odd_rows(odd, none):
    rows = packing.packed(odd, with_ids=True).collect()
    _packing_holds(rows, [t for _, t, *_ in ODD])
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
    assert packing.packed(none).count() == 0
    for text in ("x<|endoftext|>y", " " * 5000 + "a", "é😀\r\n\t 12 '''s"):
        assert packing.token_ids(text).tolist() == [
            *packing._library(packing.VOCABULARY).encode(text, add_special_tokens=False).ids, 0]


def test_fill_is_the_best_subset_sum():
    rng = np.random.default_rng(4)
    for _ in range(200):
        counts = {int(x): int(n) for x, n in zip(rng.integers(1, 30, 4), rng.integers(0, 4, 4))}
        space = int(rng.integers(0, 60))
        sums = {0}
        for x, n in counts.items():
            sums = {s + k * x for s in sums for k in range(n + 1)}
        used = packing.fill(counts, space)
        assert sum(x * n for x, n in used.items()) == max(s for s in sums if s <= space)
        assert all(n <= counts[x] for x, n in used.items())


def test_ordinal_regression_learns_ordered_grades(spark):
    rng = np.random.default_rng(6)
    words = [f"w{''.join(chr(97 + int(c)) for c in str(i))}" for i in range(200)]
    rows = []
    for i in range(600):
        g = int(rng.integers(0, 3))
        text = " ".join(words[j] for j in rng.integers(0, 200, 30)) + " " + " ".join(["mild", "vile"][:g] * 2)
        rows.append((i, text, g))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, g) for i, _, g in rows], "doc_id long, sev int")
    model = ordinal.train(docs, labels, "sev")
    assert (np.diff(model["thresholds"]) > 0).all()
    got = {r.doc_id: r for r in ordinal.grade(docs, model).collect()}
    assert np.mean([got[i].grade == g for i, _, g in rows]) > 0.95
    means = [np.mean([got[i].severity for i, _, h in rows if h == g]) for g in range(3)]
    assert means[0] < 0.5 < means[1] < 1.5 < means[2]


def test_toxic_and_quality_on_the_tables(spark):
    labels = spark.read.parquet(SF + "/labels.parquet").toPandas()
    sev = queries.op8_ordinal_toxicity(spark, SF).toPandas().merge(labels, on="doc_id")
    assert (sev[sev["toxic_y"] == 0]["toxic_x"] == 0).mean() > 0.95
    q = queries.op9_knn_quality(spark, SF).toPandas()
    assert (q["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in q["doc_id"]]).all()
    q = q.merge(labels, on="doc_id")
    assert ((q["score"] >= 0.3).astype(int) == q["predicted"]).all()
    assert (q["predicted"] == q["quality"]).mean() > 0.85


def test_models_on_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1), (7, 1, 0), (7, 0, 1), (None, 1, 1), (99, 1, 1), (9, None, None)],
                                   "doc_id long, quality int, toxic int")
    for few in (labels, labels.where("1 = 0")):
        assert ordinal.severity(odd, few).count() == len(ODD)
        got = semantic_knn.quality(odd, few).collect()
        assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert ordinal.severity(none, labels).count() == 0 and semantic_knn.quality(none, labels).count() == 0


def test_votes_are_exact_cosines():
    rng = np.random.default_rng(1)
    own, x = (semantic_knn._unit(rng.normal(size=(n, 6))) for n in (80, 50))
    labels = rng.integers(0, 2, 80).astype(float)
    got = semantic_knn.vote(x, {"vectors": own, "labels": labels, "prior": 0.5})
    for row, score in zip(x, got):
        near = np.argsort(-(own @ row))[:semantic_knn.NEIGHBOURS]
        weight = np.exp(semantic_knn.SHARPNESS * ((own @ row)[near] - 1))
        assert score == pytest.approx((weight * labels[near]).sum() / weight.sum())


def test_sums_by_row_across_windows():
    from marketlens.llm.common import sum_rows
    offsets = np.array([0, 0, 3, 3, 10, 12])
    out = np.zeros((5, 1))
    for start in range(0, 12, 4):
        sum_rows(np.arange(start, min(12, start + 4), dtype=float)[:, None], offsets, start, out)
    assert out[:, 0].tolist() == [0, 3, 0, 42, 21]


def test_words_of_windows_are_those_of_the_whole_text():
    texts = ["Aa aa ab, word-word x", "", "é😀 Straße 1a", "y" * 63 + " " + "z" * 64 + " " + "w" * 300, "end", "Next end"]
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    offsets = np.cumsum([0] + [len(r) for r in raw])
    ends, terms = semantic_knn._words(data, offsets, 0, len(data))
    plain = [(offsets[i] + m.end() - 1, bytes(m.group()).lower()) for i, r in enumerate(raw)
             for m in re.finditer(rb"[A-Za-z0-9\x80-\xff]+", r)]
    assert ends.tolist() == [e for e, _ in plain]
    by_word = defaultdict(set)
    for term, (_, w) in zip(terms.tolist(), plain):
        by_word["long" if len(w) >= semantic_knn.LONG_WORD else w].add(term)
    assert all(len(v) == 1 for v in by_word.values()) and len(set.union(*by_word.values())) == len(by_word)
    for step in (1, 5, 64, 100):
        cut = [semantic_knn._words(data, offsets, lo, min(len(data), lo + step)) for lo in range(0, len(data), step)]
        assert np.concatenate([e + lo for (e, _), lo in zip(cut, range(0, len(data), step))]).tolist() == ends.tolist()
        assert np.concatenate([t for _, t in cut]).tolist() == terms.tolist()


def test_quality_tells_texts_apart_that_differ_in_words_only(spark):
    rng = np.random.default_rng(8)
    good, poor = (["".join(chr(97 + c) for c in rng.integers(0, 26, 5)) for _ in range(40)] for _ in range(2))
    rows = [(i, " ".join(rng.choice(good if i % 2 else poor, 30)) + ".") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    got = semantic_knn.quality(docs, labels).where("held_out").collect()
    assert len(got) > 30 and all((r.score > 0.5) == (r.doc_id % 2 == 1) for r in got)


def test_quality_vectors_and_votes_by_a_plain_version(spark):
    """Terms counted byte by byte, idf, cosine to the projected sample, votes."""
    rows = spark.read.parquet(SF + "/documents.parquet").where("doc_id < 40").select("doc_id", "text").collect()
    texts = [r.text for r in rows] + ["", "so so so"]
    labels = [i % 2 for i in range(len(texts))]
    model = semantic_knn.fit(texts, labels)
    cls = [0 if b == -1 else int(semantic_knn.CLASS[b]) for b in range(256)]

    def plain(text):
        raw, total = text.encode(), np.zeros(model["project"].shape[1])
        padded = [0, 0] + [cls[b] for b in raw]
        for i in range(len(raw)):
            total += model["project"][(padded[i] * semantic_knn.CLASSES + padded[i + 1]) * semantic_knn.CLASSES + padded[i + 2]]
        tokens = re.findall(rb"[^\x00-\x20]+", raw)
        total += sum(a == b for a, b in zip(tokens, tokens[1:])) * model["project"][semantic_knn.AGAIN]
        for w in re.findall(rb"[A-Za-z0-9\x80-\xff]+", raw):
            own = np.frombuffer(w, np.uint8)
            total += model["project"][semantic_knn._words(own, np.array([0, len(own)]), 0, len(own))[1][0]]
        norm = np.linalg.norm(total)
        return total / norm if norm > 1e-12 else total
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw])
    x = semantic_knn.vectors(data, offsets, model["project"])
    want = np.array([plain(t) for t in texts])
    assert np.abs(x - want).max() < 1e-3
    for row, score in zip(x, semantic_knn.vote(x, model)):
        if not row.any():
            assert score == model["prior"]
            continue
        cosine = np.round(row @ model["vectors"].T, 12)
        near = sorted(range(len(texts)), key=lambda i: (-cosine[i], i))[:semantic_knn.NEIGHBOURS]
        weight = [np.exp(semantic_knn.SHARPNESS * (cosine[i] - 1)) for i in near]
        assert score == pytest.approx(np.dot(weight, [labels[i] for i in near]) / sum(weight))


def _plain_fingerprint(text):
    """Byte by byte: an eight-byte window, a chunk hash, levels tried in turn."""
    raw, wide, long = text.encode(), 1 << 32, 1 << 64
    if not raw:
        return "0::"
    rolls = []
    for i in range(len(raw)):
        window = sum(raw[i - j] * pow(ctph._ROLL, j, wide) for j in range(min(8, i + 1)))
        rolls.append(window * int(ctph._ROLL_MIX) % wide)

    def chunks(level):
        out, begin = [], 0
        for i, r in enumerate(rolls):
            if r < wide >> level or i == len(raw) - 1:
                out.append(raw[begin:i + 1])
                begin = i + 1
        return out

    def signature(level):
        out = ""
        for chunk in chunks(level):
            h = sum((b + 1) * pow(ctph._BASE, j, long) for j, b in enumerate(chunk)) % long
            h = (h ^ h >> 29) * int(ctph._CHUNK_MIX) % long >> 52
            out += ctph._ALPHABET[h // 64] + ctph._ALPHABET[h % 64]
        return out
    level = max(2, len(raw).bit_length() - 9)
    while len(chunks(level)) > 64:
        level += 1
    return f"{1 << level}:{signature(level)}:{signature(level + 1)}"


def _plain_likeness(a, b):
    """Indel distance by the table of all prefixes, at the first common block size."""
    sizes = []
    for f in (a, b):
        block, fine, coarse = f.split(":")
        pairs = lambda s: [s[i:i + 2] for i in range(0, len(s), 2)]
        sizes.append({int(block): pairs(fine), int(block) * 2: pairs(coarse)} if int(block) else {})
    if not sizes[0] or not sizes[1]:
        return float(sizes[0] == sizes[1])
    common = sorted(set(sizes[0]) & set(sizes[1]))
    if not common:
        return 0.0
    x, y = sizes[0][common[0]], sizes[1][common[0]]
    row = list(range(len(y) + 1))
    for i, p in enumerate(x, 1):
        diagonal, row[0] = row[0], i
        for j, q in enumerate(y, 1):
            diagonal, row[j] = row[j], diagonal if p == q else 1 + min(row[j], row[j - 1])
    return 1 - row[-1] / (len(x) + len(y))


def test_fingerprints_and_likeness_by_a_plain_version(spark):
    rows = spark.read.parquet(SF + "/documents.parquet").where("doc_id < 60").select("text").collect()
    texts = [r.text for r in rows] + ["", "a", "ab" * 700, "é😀 " * 50, "\x00\x00", "x" * 3000]
    texts += [t[:len(t) // 2] + t[:len(t) // 2] for t in texts[:20]] + [t + t for t in texts[:10]]
    prints = [ctph.fingerprint(t.encode()) for t in texts]
    plain = [_plain_fingerprint(t) for t in texts]
    assert [str(p) for p in prints] == plain
    for i in range(len(texts)):
        for j in (i, (i + 1) % len(texts), (i + 66) % len(texts), (i * 7 + 3) % len(texts)):
            assert ctph.likeness(prints[i], prints[j]) == pytest.approx(_plain_likeness(plain[i], plain[j]), abs=1e-12)


def test_op1_equals_the_plain_version_on_the_table(spark):
    rows = spark.read.parquet(SF + "/documents.parquet").select("doc_id", "text").where("doc_id < 40")
    got = ctph.successive(rows).orderBy(F.desc("doc_id")).collect()
    texts = [r.text for r in rows.orderBy(F.desc("doc_id")).collect()]
    for n, r in enumerate(got):
        own, following = texts[n], texts[(n + 1) % len(texts)]
        cut = len(own) // 2
        edited = own[:len(own) - cut] + following[:cut]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (r.fingerprint, r.edited_fingerprint) == (_plain_fingerprint(own), _plain_fingerprint(edited))
        assert r.near_edited == pytest.approx(_plain_likeness(r.fingerprint, r.edited_fingerprint))
        assert r.near_next == pytest.approx(_plain_likeness(r.fingerprint, _plain_fingerprint(following)))


def test_word_counts_follow_the_pattern(spark):
    texts = ["", " ", "a", " a", "a ", "\n\ta  b\r\n", "é\u00a0ü x", "w w w", "\x0b\x0c", "a\x1cb\x85c", "$1 \\2 😀", None, "x " * 50_000]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r.n for r in df.select(mixing.word_count().alias("n")).collect()]
    assert got == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
