"""End-to-end: entry smoke, registry consistency, file sources and sinks."""
import math
import os
import tempfile

import numpy as np
from pyspark.sql import functions as F

from tests.conftest import SF


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.columns == ["month", "revenue"]
    assert df.count() > 0


def test_every_sql_query_has_a_callable():
    import __spark_entry__ as E
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 80


def test_kpi_queries_run_at_smoke_scale(spark):
    import __spark_entry__ as E
    qs = E.queries()
    for name in ("kpi_headline", "drill_summary", "cust_rfm_scores", "sent_distribution", "fc_daily_panel"):
        assert qs[name](spark, SF).count() > 0


def test_csv_master_reader_parses_dates_leniently(spark):
    from marketlens.sources.files import MASTER_COLUMNS, read_master_csv
    d = tempfile.mkdtemp(prefix="ml-csv-")
    header = ",".join(n for n, _ in MASTER_COLUMNS)
    vals = ["o1", "c1", "delivered", "2018-01-02 10:00:00", "not a date"] + [""] * (len(MASTER_COLUMNS) - 5)
    with open(os.path.join(d, "m.csv"), "w") as f:
        f.write(header + "\n" + ",".join(vals) + "\n")
    r = read_master_csv(spark, d).collect()[0]
    assert str(r.order_purchase_timestamp) == "2018-01-02 10:00:00" and r.order_approved_at is None


def test_text_dir_loader_and_json_sink(spark):
    from marketlens.sources.files import read_artifact, read_text_dir, write_json
    d = tempfile.mkdtemp(prefix="ml-txt-")
    for name, body in (("sales_kpis.txt", "Revenue\nline two"), ("other.md", "skip")):
        with open(os.path.join(d, name), "w") as f:
            f.write(body)
    docs = read_text_dir(spark, d).collect()
    assert [(r.source, r.text) for r in docs] == [("sales_kpis.txt", "Revenue\nline two")]
    out = os.path.join(tempfile.mkdtemp(prefix="ml-json-"), "doc")
    write_json(spark.createDataFrame([("a", [1, 2])], "k string, v array<int>"), out, single_file=True)
    back = read_artifact(spark, out, "json")
    assert back.collect()[0].v == [1, 2]
    assert read_artifact(spark, out + "-missing", "json") is None


def test_source_label(spark):
    from marketlens.operators.retrieval import source_label
    lbl = spark.createDataFrame([("dir/sales_kpis.txt",)], "s string").select(source_label(F.col("s"))).first()[0]
    assert lbl == "Sales Kpis"


def test_upsert_rewrites_only_touched_partitions(spark):
    from marketlens.sources.keyed import create, reopen
    place = lambda: F.pmod(F.col("k"), F.lit(8))
    schema = "k long, at int, text string"
    empty = create(spark, "keyed-test", "k", place)
    assert empty.read() is None and empty.upsert(spark.createDataFrame([], schema)) is empty
    first = empty.upsert(spark.range(800).selectExpr("id AS k", "0 AS at", "'old' AS text"))
    files = {p: first.read([p]).inputFiles() for p in range(8)}
    # a key sent twice (the later counts), a new key of the same partition, and rows without a key
    sent = [(11, 2, "newer"), (11, 1, "new"), (11, None, "older"), (803, 1, "more"), (None, 1, "x"), (None, 1, "x")]
    second = first.upsert(spark.createDataFrame(sent, schema), order="at")
    assert second.held == {-1: 2, **{p: 1 for p in range(8)}, 3: 2}
    for p in set(range(8)) - {3}:
        assert second.read([p]).inputFiles() == files[p]
    assert not set(second.read([3]).inputFiles()) & set(files[3])
    rows = second.read().collect()
    assert len(rows) == 803 and len(first.read().collect()) == 800
    by = {r.k: r.text for r in rows if r.k is not None}
    assert by[11] == "newer" and by[803] == "more" and sum(t == "old" for t in by.values()) == 799
    again = reopen(spark, second.root, "k", place, 2)
    assert again.held == second.held
    third = again.upsert(spark.createDataFrame([(11, 3, "last")], schema))
    assert {r.k: r.text for r in third.read([3]).collect()}[11] == "last" and third.held[3] == 3


def test_merged_sketches_are_near_the_exact_figures(spark):
    from marketlens.operators import profile as pr
    rows = spark.range(20_000).selectExpr("concat('m', id % 7) AS m", "id % 6000 AS k", "CASE WHEN id % 5 = 0 THEN NULL ELSE CAST(id AS STRING) END AS s",
                                          "CASE WHEN id % 10 = 0 THEN NULL ELSE sqrt(id) END AS v", "CAST(3 AS DOUBLE) AS same")
    kept = pr.sketches(rows, F.col("m"), ["k", "s"], ["v", "same"])
    assert kept.count() == 7
    exact = {"k": 6000, "s": 16_000}
    for r in pr.sketched_distinct(kept, ["k", "s"]).collect():
        assert abs(r.approximate - exact[r.column_name]) <= pr.DISTINCT_ERROR * exact[r.column_name]
    values = np.sort([math.sqrt(i) for i in range(20_000) if i % 10])
    for r in pr.sketched_quantiles(kept, ["v", "same"]).collect():
        if r.column_name == "same":
            assert r.approximate == 3.0 and r.rows == 20_000
        else:
            rank = np.searchsorted(values, r.approximate, "right") / len(values)
            assert abs(rank - r.probability) <= pr.RANK_ERROR and r.rows == 18_000
    none = pr.sketches(rows.where("1 = 0"), F.col("m"), ["k", "s"], ["v", "same"])
    assert {r.approximate for r in pr.sketched_distinct(none, ["k", "s"]).collect()} == {0}
    assert pr.sketched_quantiles(none, ["v", "same"]).count() == 0


def test_master_csv_is_written_compressed_and_once(spark, tmp_path):
    from marketlens.plans.io_queries import _raw_csv
    from marketlens.sources import files
    raw = _raw_csv(spark, SF)
    assert raw.inputFiles() and all(f.endswith(".csv.lz4") for f in raw.inputFiles())     # no second copy of the rows
    assert raw.count() == spark.read.parquet(f"{SF}/lineitem.parquet").count()
    odd = spark.createDataFrame([("1", "two\nlines, \"quoted\""), ("2", None)], "order_id string, review_comment_message string")
    files.write_master_csv(odd, str(tmp_path / "odd"))
    back = files.read_raw_master_csv(spark, str(tmp_path / "odd")).where(f"{files.CORRUPT} is null")
    assert {tuple(r) for r in back.select(*odd.columns).collect()} == {tuple(r) for r in odd.collect()}
