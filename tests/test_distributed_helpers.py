"""Distributed helpers checked against brute force on small inputs."""
import numpy as np
import pyarrow as pa
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketlens.functions.chunking import split_text
from marketlens.functions import quantiles as quantiles_module
from marketlens.functions.quantiles import quantiles
from marketlens.functions.ranking import next_in_order, ntile_of, ranked
from marketlens.functions.vectors import _scorer, _sent, _vectors, _visits, build, search, top_k


def test_quantiles_match_pandas(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": rng.choice(["x", "y", "z"], 500, p=[0.7, 0.2, 0.1]),
                        "v": rng.integers(0, 50, 500).astype(float)})
    df = spark.createDataFrame(pdf)
    got = {r.g: (r.q1, r.med) for r in quantiles(df, "v", {"q1": 0.25, "med": 0.5}, ["g"]).collect()}
    for g, sub in pdf.groupby("g"):
        assert abs(got[g][0] - sub.v.quantile(0.25)) < 1e-9
        assert abs(got[g][1] - sub.v.median()) < 1e-9


def test_quantiles_of_uneven_groups(spark):
    pdf = pd.DataFrame({"g": ["a"] * 300 + ["b"] * 7, "v": np.arange(307, dtype=float)})
    got = {r.g: r.m for r in quantiles(spark.createDataFrame(pdf), "v", {"m": 0.5}, ["g"]).collect()}
    assert got == {"a": 149.5, "b": 303.0}


def test_ranked_and_ntile_match_window(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"k": rng.choice(["hot", "cold"], 400, p=[0.9, 0.1]), "id": np.arange(400),
                        "x": rng.integers(0, 20, 400)})
    df = spark.createDataFrame(pdf)
    r = ranked(df, [F.asc("x"), F.asc("id")], ["k"], running_sums=["x"], num_partitions=6)
    r = r.withColumn("t", ntile_of(F.col("_rn"), F.col("_n"), 5))
    got = r.toPandas().sort_values(["k", "x", "id"]).reset_index(drop=True)
    exp = spark.sql("select 1").sparkSession.createDataFrame(pdf).selectExpr(
        "k", "id", "row_number() over (partition by k order by x, id) as rn",
        "ntile(5) over (partition by k order by x, id) as t",
        "sum(x) over (partition by k order by x, id rows between unbounded preceding and current row) as c",
        "x").toPandas().sort_values(["k", "x", "id"]).reset_index(drop=True)
    assert (got["_rn"].values == exp["rn"].values).all()
    assert (got["t"].values == exp["t"].values).all()
    assert (got["_cum_x"].values == exp["c"].values).all()


def test_next_in_order(spark):
    df = spark.createDataFrame([(1, 10, 1), (1, 11, 5), (1, 12, 3), (2, 20, 1)], "c int, o int, t int")
    got = {(r.c, r.o): r.next_o for r in next_in_order(df, ["c"], [F.asc("t"), F.asc("o")], ["o"]).collect()}
    assert got == {(1, 10): 12, (1, 12): 11, (1, 11): None, (2, 20): None}


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    X = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, X[i].tolist()) for i in range(60)], "id long, vec array<double>")
    hits = top_k(df.withColumnRenamed("id", "qid"), df.withColumnRenamed("id", "cid"), 3, exclude_self=True).collect()
    Xn = X / np.linalg.norm(X, axis=1, keepdims=True)
    S = Xn @ Xn.T
    np.fill_diagonal(S, -np.inf)
    for q in range(60):
        exp = list(np.argsort(-np.round(S[q], 6), kind="stable")[:3])
        got = [h.cid for h in sorted((h for h in hits if h.qid == q), key=lambda h: h.rank)]
        assert got == exp


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_pruned_search_is_exact_and_skips_most_pairs(spark, metric):
    """Clustered rows, far rows, zero rows, copies and queries that are not in
    the table; every leaf and shard is small."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(20, 6)) * 8
    X = np.concatenate([centres[rng.integers(0, 20, 500)] + rng.normal(size=(500, 6)) * 0.3, np.zeros((3, 6)), np.ones((40, 6))])
    Q = np.concatenate([X[::9], rng.normal(size=(10, 6)) * 8, np.zeros((1, 6))])
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(X)] + [(10_000, None)], "cid long, vec array<double>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(Q)], "qid long, vec array<double>")
    hits, work = search(queries, build(corpus, metric, leaf_rows=16, shard_rows=100), 7)
    unit = lambda a: a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-300)
    S = unit(Q) @ unit(X).T if metric == "cosine" else -np.sqrt(((Q[:, None] - X[None]) ** 2).sum(-1))
    got = {}
    for h in hits.collect():
        got.setdefault(h.qid, {})[h.rank] = (h.cid, h.score)
    for q in range(len(Q)):
        want = np.argsort(-np.round(S[q], 6), kind="stable")[:7]
        assert [got[q][r][0] for r in range(1, 8)] == want.tolist()
        assert [got[q][r][1] for r in range(1, 8)] == pytest.approx(S[q][want], abs=1e-6)
    scored = {r.qid: r.n for r in work.groupBy("qid").agg(F.sum("scored").alias("n")).collect()}
    assert max(scored.values()) <= len(X) and sum(scored.values()) < 0.4 * len(Q) * len(X)


def test_scorer_gives_nothing_below_the_floor_and_all_ties_at_it():
    """A query's k-th hit of the first round limits what the second returns."""
    pack = lambda m: pa.array([v.tobytes() for v in np.asarray(m, float)], pa.binary())
    rng = np.random.default_rng(5)
    X = rng.normal(size=(300, 16))
    X[100:110] = X[7]                                           # copies of one row
    X /= np.linalg.norm(X, axis=1, keepdims=True)
    Q = X[:3] + rng.normal(size=(3, 16)) * 0.1
    Q /= np.linalg.norm(Q, axis=1, keepdims=True)
    for metric in ("cosine", "euclidean"):
        S = np.round(Q @ X.T if metric == "cosine" else -np.sqrt(((Q[:, None] - X[None]) ** 2).sum(-1)), 6)
        floor = [-np.inf, np.sort(S[1])[-3], S[2, 7]]
        corpus = pa.table({"leaf": pa.array(np.arange(300) // 50, pa.int32()), "cid": np.arange(300), "vec": pack(X)})
        queries = pa.table({"qid": [0, 1, 2], "floor": floor, "vec": pack(Q), "leaves": pa.array([list(range(6))] * 3, pa.list_(pa.int32()))})
        got = _scorer(5, False, metric)(corpus, queries).to_pylist()
        for q in range(3):
            want = [c for c in np.argsort(-S[q], kind="stable")[:5] if S[q, c] >= floor[q]]
            assert [r["cid"] for r in got if r["qid"] == q] == want


def test_a_shard_is_sent_once_for_each_block_of_its_own_queries(spark):
    """Queries beside one corner of the table do not multiply the rest of it."""
    rng = np.random.default_rng(2)
    X = np.concatenate([rng.normal(size=(400, 3)) * 0.1 + c for c in ([0, 0, 0], [50, 0, 0], [0, 50, 0])])
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(X)], "cid long, vec array<double>")
    index = build(corpus, "euclidean", shard_rows=400)
    q = _vectors(corpus.where("cid < 400").withColumnRenamed("cid", "qid"), "qid", "euclidean")
    asked = q.select("qid", "vec", F.lit(0.0).alias("reach"), F.lit(float("-inf")).alias("floor"), F.lit(True).alias("first"))
    visits = _visits(asked, index, 1)
    sent = _sent(visits, index, 50)[0].groupBy("cid").count()
    assert sent.where("cid >= 400").count() == 0 and sent.agg(F.max("count")).first()[0] <= 8


def test_search_of_nothing(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0])], "cid long, vec array<double>")
    none, q = df.where("1 = 0"), df.withColumnRenamed("cid", "qid")
    assert top_k(q, none, 3).count() == 0 and top_k(q.where("1 = 0"), df, 3).count() == 0
    assert [r.cid for r in top_k(q, df, 3).collect()] == [1] and top_k(q, df, 3, exclude_self=True).count() == 0


def test_chunking_geometry():
    assert split_text("") == []
    short = "a short text"
    assert split_text(short) == [short]
    words = " ".join(f"w{i:04d}" for i in range(400))           # 2,399 chars, no newlines
    chunks = split_text(words, 500, 20)
    assert all(len(c) <= 500 for c in chunks)
    assert chunks[0].startswith("w0000") and chunks[-1].endswith("w0399")
    joined = set(" ".join(chunks).split())
    assert joined == set(words.split())                          # whole text covered
    exact = "x" * 500
    assert split_text(exact) == [exact]


def test_top_k_over_several_blocks_and_buckets_breaks_ties_by_id(spark):
    rows = [(i, [1.0, float(i % 3)]) for i in range(40)]
    df = spark.createDataFrame(rows, "cid long, vec array<double>")
    index = build(df, leaf_rows=6, shard_rows=15)
    got, _ = search(df.withColumnRenamed("cid", "qid"), index, 5, exclude_self=True, block_rows=7)
    best = {}
    for r in got.collect():
        best.setdefault(r.qid, {})[r.rank] = r.cid
    for q, _ in rows:
        same = [c for c in range(40) if c % 3 == q % 3 and c != q][:5]
        assert [best[q][k] for k in range(1, 6)] == same


def test_catalogue_lookup_gives_nothing_for_an_unknown_id(spark):
    from marketlens.operators.recommend import lookup
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "product_id long, name string")
    wanted = spark.createDataFrame([(2,), (2,), (9,)], "product_id long")
    assert [tuple(r) for r in lookup(rows, wanted).collect()] == [(2, "b")]


def test_quantiles_move_only_the_values_near_the_wanted_ranks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": np.arange(30000) % 3, "v": rng.lognormal(0, 1, 30000)})
    moved = []

    def counted(df, *args, **kw):
        moved.append(df.count())
        return ranked(df, *args, **kw)
    monkeypatch.setattr(quantiles_module, "ranked", counted)
    got = {r.g: (r.q1, r.q3) for r in quantiles(spark.createDataFrame(pdf), "v", {"q1": 0.25, "q3": 0.75}, ["g"]).collect()}
    for g, v in pdf.groupby("g")["v"]:
        assert got[g] == pytest.approx((v.quantile(0.25), v.quantile(0.75)), rel=1e-12)
    assert sum(moved) < 3000            # all 30,000 before


def test_quantiles_of_values_that_no_equal_parts_fit(spark):
    cases = {1: [1.0, 2.0, 3.0, 1e300, -1e300], 2: [7.0] * 5, 3: [1.0, 2.0, 3.0, float("inf"), float("-inf")], 4: [0.0, -0.0, 1.0]}
    df = spark.createDataFrame([(g, x) for g, xs in cases.items() for x in xs] + [(5, None)], "g int, v double")
    got = {r.g: r.m for r in quantiles(df, "v", {"m": 0.5}, ["g"]).collect()}
    assert got == {g: float(np.median(xs)) for g, xs in cases.items()}
    assert quantiles(df.where("g = 5"), "v", {"m": 0.5}).first().m is None


def test_quantiles_read_the_values_twice(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b
    df = spark.range(90).selectExpr("id % 3 AS g", "double(id) AS v").mapInPandas(counted, "g long, v double")
    assert {r.g: r.m for r in quantiles(df, "v", {"m": 0.5}, ["g"]).collect()} == {0: 43.5, 1: 44.5, 2: 45.5}
    assert read.value == 2 * 90         # three times before


def test_quantile_parts_grow_with_the_values(spark):
    values = [float("-inf"), -1e308, -3.0, -2.9, -1e-9, -5e-324, -0.0, 0.0, 5e-324, 1e-9, 0.5, 1.0, 1.01, 2.0, 1e308, float("inf"), float("nan")]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v double")
    parts = [r.p for r in df.select("i", quantiles_module._bin(F.col("v")).alias("p")).orderBy("i").collect()]
    assert parts == sorted(parts) and len(set(parts)) == len(values) - 1        # both zeros are one value


def test_cleaning_drops_stopwords_of_any_list(spark):
    from marketlens.functions.text import clean_text, clean_tokens
    df = spark.createDataFrame([("Não <b>Recebi</b> o produto, 3x bom!ruim http://a.b c9d -- 1a",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(clean_text(F.col("t"))).collect()] == ["recebi produto bomruim cd", "", ""]
    for none in ((), None):
        assert df.select(clean_tokens(F.col("t"), none).alias("t")).first().t == ["não", "recebi", "produto", "bomruim", "cd"]


def test_order_lines_hold_source_columns_and_group_features(spark):
    """Repeated orders and texts multiply lines as the plain joins do; only
    source columns and group features are written."""
    from marketlens.operators import enrich
    li = spark.createDataFrame([(1, 1, 1, n, 5.0, 10.0, 0.1, 0.0, "F") for n in (1, 2)] + [(2, 1, 1, 1, 5.0, 10.0, 0.1, 0.0, "F"), (4, 9, 1, 1, 5.0, 10.0, 0.1, 0.0, "F")],
                               "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_linestatus string")
    orders = spark.createDataFrame([(1, 7, "F", "1", 7, "N", "R"), (1, 7, "F", "1", 7, "N", "R"), (2, 8, "F", "1", 8, "N", "R"), (4, 8, "F", "1", 8, "N", "R")],
                                   "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string, c_custkey long, n_name string, r_name string") \
        .withColumn("o_orderdate", F.lit("2020-01-01").cast("timestamp_ntz"))
    part = spark.createDataFrame([(1, "b", "t", 3)], "p_partkey long, p_brand string, p_type string, p_size int")
    texts = spark.createDataFrame([(1, 1, 4), (1, 1, 5), (2, 0, 0)], "review_key long, has_comment int, comment_length int")
    lines = enrich.order_lines((li, orders, part, spark.createDataFrame([(3,)], "n_texts long")), texts)
    assert set(lines.columns) == {*enrich.LINE_COLUMNS, *enrich.GROUP_FEATURES}
    rows = sorted((r.l_orderkey, r.l_linenumber, r.payment_methods_per_order, r.customer_orders, r.comment_length) for r in lines.collect())
    # order 1: two lines x two order rows x two texts; order 4 has no product, so customer 8 has one order
    assert rows == sorted([(1, n, 2, 1, c) for n in (1, 2) for c in (4, 5) for _ in range(2)] + [(2, 1, 1, 1, 0)])


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_neighbours_of_each_group_are_those_of_brute_force(spark, monkeypatch, metric):
    """Clusters, copies, zero and far rows in three groups and one row alone;
    cells are small, and one of equal rows is cut."""
    from marketlens.functions import neighbours as nb
    monkeypatch.setattr(nb, "MIN_CELL_ROWS", 40)
    monkeypatch.setattr(nb, "LEAF_ROWS", 8)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(20, 6)) * 8
    X = np.concatenate([centres[rng.integers(0, 20, 300)] + rng.normal(size=(300, 6)) * 0.3, np.zeros((3, 6)), np.ones((60, 6)),
                        rng.normal(size=(10, 6)) * 1e6])
    group = rng.integers(0, 3, len(X))
    group[5] = 7
    rows = [(int(g), i, v.tolist()) for i, (g, v) in enumerate(zip(group, X))] + [(1, 9999, None), (1, 9998, [float("nan")] * 6), (2, 9997, [None] * 6)]
    got = {}
    for h in nb.neighbours(spark.createDataFrame(rows, "grp int, id long, vec array<double>"), 7, metric, task_rows=30).collect():
        got.setdefault(h.qid, {})[h.rank] = (h.cid, h.score)
    unit = X / np.maximum(np.linalg.norm(X, axis=1, keepdims=True), 1e-300)
    S = unit @ unit.T if metric == "cosine" else -np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    S[group[:, None] != group[None]] = -np.inf
    np.fill_diagonal(S, -np.inf)
    for q in range(len(X)):
        want = [c for c in np.argsort(-np.round(S[q], 6), kind="stable")[:7] if S[q, c] > -np.inf]
        hits = [got.get(q, {})[r] for r in sorted(got.get(q, {}))]
        assert [h[0] for h in hits] == want and [h[1] for h in hits] == pytest.approx(S[q][want], abs=1e-6)
    assert set(got) == set(range(len(X))) - {5}


def test_neighbours_of_nothing(spark):
    from marketlens.functions.neighbours import neighbours
    df = spark.createDataFrame([(0, 1, [1.0, 0.0])], "grp int, id long, vec array<double>")
    assert neighbours(df.where("1 = 0"), 3).count() == 0 and neighbours(df, 3).count() == 0


def test_neighbours_compare_clustered_rows_with_few_others(monkeypatch):
    """Pairs screened by one task: a small part of all."""
    from marketlens.functions import neighbours as nb
    rng = np.random.default_rng(1)
    x = np.repeat(rng.normal(size=(64, 4)) * 20, 100, axis=0) + rng.normal(size=(6400, 4))
    pairs = []
    monkeypatch.setattr(nb, "_compare", lambda block, rows, left, wide, cids, C, f=nb._compare: pairs.append(len(rows) * len(cids)) or f(block, rows, left, wide, cids, C))
    ids = np.arange(len(x))
    qid, cid, _, _ = nb._nearest((ids, x), (ids, x, np.full(len(x), -np.inf)), 1, False)
    assert sum(pairs) < 0.15 * len(x) ** 2 and (qid != cid).all() and len(qid) == len(x)


def test_sparse_vectors_give_the_hits_of_dense_ones_and_stay_sparse(spark):
    rng = np.random.default_rng(4)
    X = ((rng.random((300, 40)) < 0.1) * rng.normal(size=(300, 40))).astype(np.float32)
    X[7:9] = 0
    X[20] = X[30]
    dense = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(X)], "cid long, vec array<float>")
    entries = [(i, (40, np.flatnonzero(v).tolist(), v[v != 0].tolist())) for i, v in enumerate(X)]
    sparse = spark.createDataFrame(entries, "cid long, vec struct<size: int, place: array<int>, value: array<float>>")
    for metric in ("cosine", "euclidean"):
        got = [sorted((h.qid, h.rank, h.cid, h.score) for h in top_k(df.withColumnRenamed("cid", "qid").where("qid % 3 = 0"), df, 4, True, metric).collect())
               for df in (dense, sparse)]
        assert [h[:3] for h in got[0]] == [h[:3] for h in got[1]] and len(got[0]) == 400
        assert [h[3] for h in got[1]] == pytest.approx([h[3] for h in got[0]], abs=1e-12)
    assert build(sparse).rows.schema["vec"].dataType.typeName() == "struct"


def test_queries_of_a_task_are_unpacked_part_by_part(spark, monkeypatch):
    """Blocks larger than what is unpacked at a time give the same hits."""
    from marketlens.functions import vectors
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(200, 5)))], "cid long, vec array<double>")
    index, queries = build(df, leaf_rows=16), df.withColumnRenamed("cid", "qid")
    want = sorted(map(tuple, search(queries, index, 3, True)[0].collect()))
    monkeypatch.setattr(vectors, "TASK_NUMBERS", 60)            # twelve queries
    scorer = _scorer(3, True, "cosine")
    packed = _vectors(queries, "qid", "cosine").toArrow()
    leaves = pa.array([list(range(len(index.leaves)))] * 200, pa.list_(pa.int32()))
    asked = pa.table({"qid": packed.column("qid"), "floor": np.full(200, -np.inf), "vec": packed.column("vec"), "leaves": leaves})
    sizes, matrix = [], vectors._matrix
    monkeypatch.setattr(vectors, "_matrix", lambda c: sizes.append(len(c)) or matrix(c))
    got = scorer(index.rows.toArrow(), asked).to_pylist()
    assert sorted((r["qid"], r["cid"]) for r in got) == sorted(w[:2] for w in want) and max(sizes) <= 16


def test_first_version_of_a_keyed_table_is_written_without_a_copy(spark, monkeypatch):
    from marketlens.sources import keyed
    rows = [(i % 50, i, f"t{i}") for i in range(120)] + [(None, 1, "n"), (None, 1, "n")]
    df = spark.createDataFrame(rows, "k long, v int, t string")
    copies = []
    monkeypatch.setattr(keyed, "materialize", lambda *a, f=keyed.materialize: copies.append(a[2]) or f(*a))
    empty = keyed.create(spark, "once", "k", lambda: F.pmod(F.col("k"), F.lit(8)))
    first = empty.upsert(df)
    want = sorted({k: (k, v, t) for k, v, t in rows if k is not None}.values()) + [(None, 1, "n")] * 2
    assert sorted(map(tuple, first.read().select("k", "v", "t").collect()), key=lambda r: (r[0] is None, r)) == want and not copies
    assert first.held == dict.fromkeys([-1, *range(8)], 1) and empty.upsert(df.where("1 = 0")).version == 0
