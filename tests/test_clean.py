"""Cleaning rules."""

import datetime as dt
import hashlib

from conftest import rows
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from panelscope import schemas
from panelscope.functions import clean
from panelscope.sources.extract import conform_columns, ingest_history, ingest_inspection


def values(spark, texts, expr):
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string")
    return [r[1] for r in df.select("n", expr.alias("v")).orderBy("n").collect()]


def test_defect_name(spark):
    texts = ["TYPE1-SPOT-SIZE-DARK", "T - SPOT - S - DARK \t", "A-B-C", "A-B-C-", None, "", "A-B-C-D-E"]
    assert values(spark, texts, clean.defect_name("t")) == [
        "SPOT-DARK", "SPOT-DARK", None, "B-", None, None, "B-D",
    ]
    assert values(spark, texts, clean.defect_name("t", strict=False)) == [
        "SPOT-DARK", " SPOT - DARK \t", "A-B-C", "B-", None, "", "B-D",
    ]


def test_panel_columns(spark):
    df = spark.createDataFrame([("G1", "G1A1"), ("G1", "G1AB12"), ("G1", "X9"), ("G1", None)], "product_id string, panel_id string")
    got = rows(clean.panel_cols(df), "panel_addr", "panel_x", "panel_y")
    assert got == rows(spark.createDataFrame([("A1", "A", "1"), ("AB12", "AB1", "2"), (None,) * 3, (None,) * 3], "a string, b string, c string"))


def test_codes_inside_ids(spark):
    assert values(spark, ["G1M300000012", "G1", None], clean.model_code("t")) == ["M3", "", None]
    assert values(spark, ["G1M300000012", "G", None], clean.lot_id("t")) == ["G1M3000000", "", None]
    assert values(spark, ["A1CVD01", "B2ETCH03"], clean.equip_group("t")) == ["CVD0", "ETCH"]
    assert values(spark, ["M1", None], clean.model_code(F.lit("G1M2"), "t")) == ["M1", "UNKNOWN"]


def test_unreadable_values_are_null(spark):
    times = values(spark, ["2026-01-02 03:04:05", "2026-01-02", "soon", None], clean.parse_ts("t"))
    assert times == [dt.datetime(2026, 1, 2, 3, 4, 5), dt.datetime(2026, 1, 2), None, None]
    texts = ["1.5", " 2 ", "1e3", "1d", "2.5F", "x", "", None]
    assert values(spark, texts, clean.parse_num("t")) == [1.5, 2.0, 1000.0, None, None, None, None, None]
    assert values(spark, texts, clean.parse_num("t", null_as_zero=True)) == [1.5, 2.0, 1000.0, 0, 0, 0, 0, 0]
    assert values(spark, ["7.9", "-3", "x", None], clean.unsigned("t")) == [7, 0, 0, 0]


@settings(max_examples=5, deadline=None)
@given(keys=st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"], exclude_characters="\x00"), max_size=20), min_size=20, max_size=40), n=st.sampled_from([1, 7, 100, 4096]))
def test_hash_bucket_is_digest_modulo_n(spark, keys, n):
    width = max(2, len(str(n - 1)))
    want = [f"{int(hashlib.md5(k.encode()).hexdigest(), 16) % n:0{width}d}" for k in keys]
    assert values(spark, keys, clean.hash_bucket("t", n)) == want


def test_hash_bucket_without_key(spark):
    assert values(spark, [None], clean.hash_bucket("t")) == ["00"]


def test_empty_keys_and_defaults(spark):
    df = spark.createDataFrame([("G1", 3), ("G2", None), ("", 1), (None, 1)], "product_id string, defect_count int")
    assert rows(clean.defaults(clean.drop_empty_key(df))) == [("G1", 3), ("G2", 1)]
    assert rows(clean.defaults(df.drop("defect_count")).select("defect_count").distinct()) == [(1,)]


def test_source_columns(spark):
    df = spark.createDataFrame(
        [("G1", "P1", "LINE1", "2026-01-01"), ("", "P1", "LINE1", "2026-01-01")],
        "glass_id string, process_code string, equipment_line_id string, time_ymdhms string",
    )
    got = ingest_history(df)
    assert set(got.columns) == {"product_id", "process_code", "equipment_line_id", "equipment_id", "move_in_ymdhms"}
    assert [tuple(r) for r in got.select("product_id", "equipment_id").collect()] == [("G1", "LINE1")]
    both = spark.createDataFrame([("old", "new")], "glass_id string, product_id string")
    assert ingest_history(both).first()["product_id"] == "new"
    i = spark.createDataFrame([("G1", "A-B-C"), (None, "A-B-C-D")], "product_id string, def_latest_summary_defect_term_name_s string")
    assert [r["defect_name"] for r in ingest_inspection(i).collect()] == ["A-B-C"]


def test_conform_columns(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert conform_columns(df, ["b", "c", "a"]).collect()[0].asDict() == {"b": 2, "c": None, "a": 1}
    empty = conform_columns(df.limit(0), ["b", "c"])
    assert empty.columns == ["b", "c"] and empty.count() == 0


def test_safe_rate(spark):
    df = spark.createDataFrame([(1, 2), (1, 0), (None, 2), (1, None)], "a int, b int")
    assert rows(df.select(clean.safe_rate("a", "b"))) == [(0.0,), (0.0,), (0.0,), (0.5,)]


def test_clean_tables(spark):
    raw = spark.createDataFrame(
        [("G1M1000001", "G1M1000001B2", "T-SPOT-S-DARK", "2026-01-01 01:02:03", "x")],
        "product_id string, panel_id string, def_latest_summary_defect_term_name_s string, inspection_end_ymdhms string, def_size string",
    )
    row = clean.clean_inspection(raw).first()
    assert (row["defect_name"], row["panel_addr"], row["def_size"]) == ("SPOT-DARK", "B2", None)
    points = raw.withColumns({"def_pnt_g": F.lit("-3.5"), "def_pnt_d": F.lit("7.9"), "def_pnt_x": F.lit(None).cast("string")})
    row = clean.clean_inspection(points, zero_numbers=True).first()
    assert (row["def_size"], row["def_pnt_g"], row["def_pnt_d"], row["def_pnt_x"]) == (0.0, 0, 7, 0.0)
    h = clean.clean_history(spark.createDataFrame([("G1M1000001", "bad")], "product_id string, move_in_ymdhms string")).first()
    assert (h["model_code"], h["lot_id"], h["move_in_ymdhms"]) == ("M1", "G1M10000", None)


def test_declared_schemas():
    for schema, folders in ((schemas.INSPECTION, 4), (schemas.HISTORY, 4), (schemas.GLASS_STATS, 2)):
        names = {"facility_code", "model_code", "bucket_id", "load_day", "year", "month", "day", "stat_date"} & set(schema.names)
        assert len(names) >= folders and len(set(schema.names)) == len(schema)
