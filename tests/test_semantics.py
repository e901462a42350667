"""Hand-sized frames for the semantics the pipeline must pin down."""
import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from marketlens.functions.dates import floor_days
from marketlens.operators import enrich
from marketlens.operators.insights import five_level, insight_metrics, route


def ts(s):
    return dt.datetime.fromisoformat(s)


def test_floor_days_negative(spark):
    df = spark.createDataFrame([(ts("2020-01-02 10:00:00"), ts("2020-01-02 00:00:00")),
                                (ts("2020-01-01 00:00:00"), ts("2020-01-03 23:00:00"))],
                               "a timestamp_ntz, b timestamp_ntz")
    got = [r[0] for r in df.select(floor_days(F.col("a"), F.col("b"))).collect()]
    assert got == [-1, 2]          # floors like Timedelta.days (datediff would give 0)


def test_delivery_status_and_calendar(spark):
    rows = [(ts("2021-01-01 12:00:00"), ts("2021-01-10 22:00:00"), ts("2021-01-10 12:00:00")),   # 10 h late
            (ts("2021-01-02 00:00:00"), None, ts("2021-01-10 00:00:00")),
            (ts("2021-01-03 00:00:00"), ts("2021-01-12 01:00:00"), ts("2021-01-10 00:00:00"))]
    df = spark.createDataFrame(rows, "order_purchase_timestamp timestamp_ntz, order_delivered_customer_date timestamp_ntz,"
                                     " order_estimated_delivery_date timestamp_ntz")
    df = df.withColumns({"order_approved_at": F.col("order_purchase_timestamp"),
                         "order_delivered_carrier_date": F.col("order_purchase_timestamp")})
    out = enrich.add_durations(enrich.add_calendar(df)).orderBy("order_purchase_timestamp").collect()
    assert [r.delivery_status for r in out] == ["On Time", "Not Delivered Yet", "Late"]
    assert out[0].week == 53 and out[0].dayofweek == 4 and out[1].is_weekend == 1   # 2021-01-01 is ISO week 53, Friday


def test_sentiment_and_review_text(spark):
    df = spark.createDataFrame([(None, None), (2, "  ok \n"), (3, "No Review"), (5, "great")],
                               "score int, msg string")
    out = df.select(enrich.sentiment_of(F.col("score")).alias("s"),
                    enrich.review_text_of(F.lit(None).cast("string"), F.col("msg")).alias("t"),
                    five_level(F.col("score")).alias("l")).collect()
    assert [r.s for r in out] == ["Unknown", "Negative", "Neutral", "Positive"]
    assert [r.t for r in out] == ["", "ok", "", "great"]
    assert [r.l for r in out] == ["Unknown", "Negative", "Neutral", "Very Positive"]


def test_group_then_global_median_fill(spark):
    pdf = pd.DataFrame({"k": ["a", "a", "a", "b", "b", None], "v": [1.0, 3.0, None, None, None, None]})
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "k string, v double")
    out = enrich.group_median_fill(df, "v", "k").orderBy("k", "v").collect()
    # group a -> 2.0; group b (all null) and null key -> global median of the filled column [1, 3, 2] = 2
    assert sorted(r.v for r in out) == [1.0, 2.0, 2.0, 2.0, 2.0, 3.0]


def test_routing_first_match_and_substrings(spark):
    qs = spark.createDataFrame([("Which state sells most?",), ("hello",), ("What is the revenue trend?",),
                                ("zzz",)], "question string")
    got = [r.intent for r in route(qs).collect()]
    # "which" contains "hi" but the geography rule comes first; revenue beats forecast
    assert got == ["geography", "help", "revenue", "snapshot"]


def test_insight_cells_count_different_values_without_copying_lines(spark):
    names = ["product_category_name_english", "customer_state", "order_id", "customer_unique_id", "seller_id", "payment_value",
             "sentiment", "order_status", "delivery_status", "is_returning_customer", "delivery_days"]
    rows = [("a", "X", 1, 1, 1, 10.0, "Positive", "delivered", "Late", 1, 5), ("a", "X", 1, 1, 2, 5.0, "Positive", "delivered", "Late", 1, 7),
            ("b", "X", 1, 1, 1, 2.5, "Unknown", "delivered", "On Time", 1, 2), ("a", "Y", 2, None, 1, None, "Negative", "canceled", "Late", 0, None),
            ("b", None, 3, 2, 3, 4.0, "Neutral", "shipped", "On Time", 0, 9), ("b", None, 3, 2, 3, 4.0, "Neutral", "shipped", "On Time", 0, 9)]
    types = "string string bigint bigint bigint double string string string int int".split()
    out = insight_metrics(spark.createDataFrame(rows, ", ".join(f"{n} {t}" for n, t in zip(names, types))))
    got = {(r.category, r.state, r.metric): r.value for r in out.collect()}
    cells = {(c, s) for r in rows for c in (r[0], "ALL") for s in (r[1], "ALL")}
    assert len(got) == 12 * len(cells) == out.count()
    for c, s in cells:
        own = [r for r in rows if c in (r[0], "ALL") and (s == "ALL" or r[1] == s)]
        for at, metric in ((2, "total_orders"), (3, "total_customers"), (4, "total_sellers")):
            assert got[c, s, metric] == len({r[at] for r in own} - {None})
        money = [r[5] for r in own if r[5] is not None]
        assert got[c, s, "total_revenue"] == (sum(money) if money else None)
        assert got[c, s, "cancellation_rate_pct"] == round(100 * sum(r[7] == "canceled" for r in own) / len(own), 2)
    assert got["ALL", "ALL", "avg_delivery_days"] == 4.67 and got["a", "Y", "avg_delivery_days"] is None
    assert got["ALL", "ALL", "late_delivery_rate_pct"] == 66.67 and got["ALL", "ALL", "positive_pct"] == 40.0
    # the grouping sets multiply sums and counts of cells, not order lines
    plan = out._jdf.queryExecution().optimizedPlan().toString().split("\n")
    copied = [next(x for x in plan[i:] if "Expand" not in x and "Project" not in x) for i, line in enumerate(plan) if "Expand" in line]
    assert copied and all("Aggregate" in below for below in copied)
