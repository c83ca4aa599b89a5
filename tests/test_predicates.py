"""Filters built from arguments."""

import pytest
from pyspark.sql import functions as F

from panelscope.functions import predicates as p


def kept(spark, texts, condition):
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    return [r[0] for r in df.where(condition).collect()]


CODES = ["50", "100", "150", "200", "P100", "12.5", None]


@pytest.mark.parametrize(
    "expression, want",
    [
        ([">100"], ["150", "200"]),
        ([">= 100"], ["100", "150", "200"]),
        (["<100"], ["50", "12.5"]),
        (["<=100"], ["50", "100", "12.5"]),
        (["<>100"], ["50", "150", "200", "12.5"]),
        (["50<x<200"], ["100", "150"]),
        (["100-200"], ["100", "150", "200"]),
        (["100 - 150"], ["100", "150"]),
        (["100-x"], []),
        (["P100"], ["P100"]),
        (["100", "P100"], ["100", "P100"]),
        ([], CODES),
    ],
)
def test_process_filter(spark, expression, want):
    assert kept(spark, CODES, p.process_filter(expression, "c")) == want


TIMES = ["2026-01-01 00:00:00", "2026-01-01 23:59:59", "2026-01-02 00:00:00", "2026-01-03 12:00:00"]


@pytest.mark.parametrize(
    "condition, want",
    [
        (lambda: p.time_range("t", "2026-01-01", "2026-01-01"), TIMES[:2]),
        (lambda: p.time_range("t", "2026-01-01 23:59:59", "2026-01-02 00:00:00"), TIMES[1:3]),
        (lambda: p.time_range("t", None, "2026-01-02"), TIMES[:3]),
        (lambda: p.on_day("t", "2026-01-02"), TIMES[2:3]),
        (lambda: p.on_days("t", ["2026-01-03", "2026-01-01"]), [*TIMES[:2], TIMES[3]]),
        (lambda: p.on_days("t", []), TIMES),
    ],
)
def test_times(spark, condition, want):
    df = spark.createDataFrame([(t,) for t in TIMES], "c string").withColumn("t", F.col("c").cast("timestamp_ntz"))
    assert [r[0] for r in df.where(condition()).collect()] == want


def test_text_filters(spark):
    texts = ["SPOT-DARK", "SPOT%", "LINE", None]
    assert kept(spark, texts, p.starts_with("c", "SPOT")) == ["SPOT-DARK", "SPOT%"]
    assert kept(spark, texts, p.starts_with("c", "SPOT%")) == ["SPOT%"]
    assert kept(spark, texts, p.starts_with("c", "")) == texts
    assert kept(spark, ["café", "cafe"], p.equals_nfc("c", "café")) == ["café"]
    assert kept(spark, ["ETCH01", "cvd"], p.contains_ci("c", "etch")) == ["ETCH01"]
    assert kept(spark, ["EQ1", "EQ2"], p.in_group("c", {"critical": ["EQ1"]}, "critical")) == ["EQ1"]


def test_conditions(spark):
    df = spark.createDataFrame([("A", 1, "2026-01-02"), ("A", 2, "2026-01-02"), ("B", 3, "2026-02-02")], "f string, n int, d string")

    def count(**rules):
        return df.where(p.conditions(rules)).count()

    assert count(f="= 'A'") == 2
    assert count(n="> 1") == 2 and count(n=">= 1") == 3 and count(n="< 2") == 1 and count(n="<= 2") == 2
    assert count(d="begins_with '2026-01'") == 2
    assert count(f="= 'A'", n=">= 2") == 1
    assert count() == 3


def test_tuple_in(spark):
    df = spark.createDataFrame([("E1", "P1"), ("E1", "P2"), ("E2", "P1"), ("E1", "P1")], "equipment_line_id string, process_code string")
    assert p.tuple_in(df, [("E1", "P1"), ("E1", "P1")]).count() == 2
    assert p.tuple_in(df, []).count() == 4


def test_narrow(spark):
    df = spark.createDataFrame([("M1", "P10", "CVD01"), ("M2", "P10", "CVD01"), ("M1", "P20", "ETCH")], "product_type_code string, process_code string, equipment_line_id string")
    assert p.narrow(df, ["M1"], "p1", "cvd").count() == 1
    assert p.narrow(df).count() == 3
