"""Steps whose cost must not grow faster than their input, read off plans."""

import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from panelscope.catalog import registry, tables, views  # noqa: F401  the tables register their queries
from panelscope.functions import clean
from panelscope.operators import cells, mart, positions, updates
from panelscope.plans import daily
from panelscope.sources import lake
from panelscope.streaming import jobs

TOTAL = "facility_code string, product_id string, defect_name string, stat_date string, lot_id string, total_defects long, panel_map array<long>, panel_addrs array<string>"


def executed(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_all_pages_in_one_job_equal_pages_one_by_one(spark):
    data = [(k % 7 or None, "a" if k % 3 else None) for k in range(60)]
    df = spark.createDataFrame(data, "n int, t string").repartition(3)
    one_by_one = [(*r, n) for n, page in enumerate(positions.pages(df, ("n", "t"), 8)) for r in page]
    assert sorted(map(str, (tuple(r) for r in positions.numbered_pages(df, ("n", "t"), 8).collect()))) == sorted(map(str, one_by_one))
    assert positions.numbered_pages(df.limit(0), ("n", "t"), 8).count() == 0


def test_hot_keys_are_not_shuffled_by_key(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(300).select((F.col("id") % 3).alias("k"), "id").where("k < 2 OR id < 9")
        out = positions.numbered_in_groups(df, [F.col("id")], "n", ["k"], hot_rows=50)
        assert "BroadcastHashJoin" in executed(out) and "LeftAnti" in executed(out)
        assert not re.search(r"SortMergeJoin.*LeftAnti", executed(out))
        assert out.groupBy("k").agg(F.max("n")).orderBy("k").collect() == [(0, 100), (1, 100), (2, 3)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_repeated_load_is_not_computed(spark, tmp_path):
    root = str(tmp_path / "totals")
    load = spark.createDataFrame([("A", f"P{n}", "D", "2026-01-01", "L", 1, [1], ["A1"]) for n in range(40)], TOTAL).drop("stat_date")
    assert len(daily.accumulate(load, root, "monday", buckets=3)) == 3
    broken = load.withColumn("lot_id", F.raise_error(F.lit("computed again")).cast("string"))
    assert daily.accumulate(broken, root, "monday", buckets=3) == []


def test_flag_sums_read_the_mart_once(spark):
    df = spark.createDataFrame([("P1", [0, 1, 1]), ("P2", [1]), ("P3", []), ("P4", None), ("P5", [None, 1])], "product_id string, panel_map array<int>")
    out = cells.sum_panel_flags(df)
    assert rows(out, "x", "y", "total_defects", "total_glasses") == [("A", "0", 1, 5), ("A", "1", 2, 5), ("A", "2", 1, 5)]
    assert out.inputFiles() and all("flag-sums" in f for f in out.inputFiles())


def test_matrix_and_intensity_compute_the_cells_once(spark):
    df = spark.createDataFrame([("Target", "A", "1", 0.5), ("Others", "B", "1", 0.25)], "group_type string, x string, y string, defect_rate double")
    for out in (cells.heatmap_matrix(df), cells.intensity(df)):
        assert out.inputFiles() and all("/cells-" in f for f in out.inputFiles())


def test_panel_address_is_computed_once(spark):
    df = spark.createDataFrame([("G1", "G1A1"), ("G1", "X9")], "product_id string, panel_id string")
    out = clean.panel_cols(df.select(F.concat("product_id", F.lit("")).alias("product_id"), "panel_id"))
    out = out.where("panel_x IS NOT NULL AND panel_y IS NOT NULL").groupBy("panel_x", "panel_y").count()
    assert out._jdf.queryExecution().optimizedPlan().toString().lower().count("startswith") == 1
    assert rows(out) == [("A", "1", 1)]


def test_counts_of_a_day_come_from_few_tasks(spark, history, inspection, tmp_path):
    found = [(f"P{n}", "1000", f"P{n}A1", "SPOT", f"2026-01-0{1 + n % 3}T00:00:00") for n in range(60)]
    i, paths = inspection(found).repartition(8), [str(tmp_path / p) for p in ("rows", "counts", "mart", "checkpoint")]
    i.write.parquet(paths[0])
    src = jobs.file_source(spark, paths[0], i.schema)
    jobs.mart_stream(src, history([("P1", "1000", "L1", "2026-01-01T00:00:00")]), *paths[1:]).awaitTermination()
    days = list((tmp_path / "counts" / "batch_id=0").glob("stat_date=*"))
    assert sorted(d.name for d in days) == [f"stat_date=2026-01-0{n}" for n in (1, 2, 3)] and all(len(list(d.glob("*.parquet"))) == 1 for d in days)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # every task of the counts stays
    try:
        i.write.mode("append").parquet(paths[0])
        jobs.mart_stream(jobs.file_source(spark, paths[0], i.schema), history([("P1", "1000", "L1", "2026-01-01T00:00:00")]), *paths[1:]).awaitTermination()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    days = list((tmp_path / "counts" / "batch_id=1").glob("stat_date=*"))
    assert len(days) == 3 and all(len(list(d.glob("*.parquet"))) == 1 for d in days)
    assert rows(lake.read_mart(spark, paths[2]).groupBy("stat_date").agg(F.sum("total_defects")), "sum(total_defects)") == [(40,)] * 3


def test_days_of_a_small_batch_are_written_by_several_tasks(spark, history, inspection, tmp_path):
    found = [(f"P{n}", "1000", f"P{n}A1", "SPOT", f"2026-{1 + n % 12:02d}-{1 + n % 28:02d}T00:00:00") for n in range(2000)]
    i, paths = inspection(found), [str(tmp_path / p) for p in ("rows", "counts", "mart", "checkpoint")]
    i.write.parquet(paths[0])
    before = spark.conf.get(jobs.SMALL_TASKS[0])
    jobs.mart_stream(jobs.file_source(spark, paths[0], i.schema), history([("P1", "1000", "L1", "2026-01-01T00:00:00")]), *paths[1:]).awaitTermination()
    for table in ("counts", "mart"):
        files = list((tmp_path / table).rglob("part-*.parquet"))
        assert len(files) == 84 and len({f.name[:10] for f in files}) > 1  # a file per day, from more than one task
    assert spark.conf.get(jobs.SMALL_TASKS[0]) == before
    assert rows(lake.read_mart(spark, paths[2]).agg(F.sum("total_defects"))) == [(2000,)]


def test_steps_of_many_products_are_not_joined(spark, history, inspection, monkeypatch):
    h, i = history([("P1", "1000", "L1", "2026-01-01T00:00:00"), ("P2", "1000", "L1", "2026-01-01T00:00:00")]), inspection([("P1", "1000", "P1A1", "SPOT")])
    monkeypatch.setattr("panelscope.operators.steps.FEW_KEYS", 0)
    out = mart.build_glass_stats(i, h, ["2026-01-05"])
    assert "LeftSemi" not in executed(out) and rows(out, "product_id", "equipment_line_id") == [("P1", "L1")]


DAILY = [
    ("A", "P1", "D", "2026-01-01", "L1", 3, [1, 2], ["A1", "B1"]),
    ("A", "P1", "D", "2026-01-02", "L2", 5, [4, 1], ["B1", "C1"]),
    ("A", "P2", "D", "2026-01-01", "L1", 3, [1, 2], ["B1", "A1"]),
    ("A", "P3", "D", "2026-01-01", "L1", 3, [3, None], [None, "A1"]),
    ("A", "P4", "D", "2026-01-01", "L1", 0, None, None),
    ("A", None, "D", "2026-01-01", "L1", 1, [1], ["A1"]),
    ("A", "P5", "D", "2026-01-01", "L1", 3, [1, 2], ["A1", "A1"]),
]


def test_days_are_added_up_in_one_shuffle(spark):
    out = updates.total_of_days(spark.createDataFrame(DAILY, TOTAL))
    assert executed(out).count("Exchange hashpartitioning") == 1
    assert rows(out, "product_id", "lot_id", "total_defects", "panel_addrs", "panel_map") == sorted(
        [
            ("P1", "L2", 8, ["A1", "B1", "C1"], [1, 6, 1]),
            ("P2", "L1", 3, ["A1", "B1"], [2, 1]),
            ("P3", "L1", 3, [None, "A1"], [3, None]),
            ("P4", "L1", 0, None, None),
            (None, "L1", 1, None, None),
            ("P5", "L1", 3, ["A1"], [3]),
        ],
        key=repr,
    )


def test_panels_of_an_upsert_are_merged_once(spark):
    sides = (
        [("P1", [1, 0], ["A1", "B1"]), ("P2", [1, None], ["A1", "B1"]), ("P3", [5], ["B1"]), ("P4", [1, 2], ["B1", "A1"]), ("P5", None, None)],
        [("P1", [2, 3], ["A1", "B1"]), ("P3", [1, 2], ["A1", "B1"]), ("P6", [7, 8], [None, "A1"]), ("P7", [4], ["A1"])],
    )
    old, new = (spark.createDataFrame([("A", p, "D", "2026-01-01", "L", 1, m, a) for p, m, a in side], TOTAL) for side in sides)
    out = updates.upsert_add(old, new)
    assert out._jdf.queryExecution().optimizedPlan().toString().lower().count("map_zip_with") == 1
    assert rows(out, "product_id", "panel_addrs", "panel_map") == [
        ("P1", ["A1", "B1"], [3, 3]),
        ("P2", ["A1", "B1"], [1, 0]),
        ("P3", ["A1", "B1"], [1, 7]),
        ("P4", ["A1", "B1"], [2, 1]),
        ("P5", [], []),
        ("P6", ["A1"], [8]),
        ("P7", ["A1"], [4]),
    ]


@pytest.fixture
def facts_dir(spark, tmp_path):
    """Small orders and lineitem tables."""
    spark.range(12).select(F.col("id").alias("o_orderkey"), (F.col("id") % 5).alias("o_custkey")).write.parquet(str(tmp_path / "orders.parquet"))
    line = """SELECT id % 12 AS l_orderkey, id % 9 AS l_suppkey, id % 17 AS l_partkey, CAST(id % 3 AS INT) AS l_linenumber,
      IF(id % 4 = 0, 'N', 'R') AS l_returnflag, 'F' AS l_linestatus, CAST(id % 30 AS DOUBLE) AS l_quantity,
      TIMESTAMP_NTZ '1997-06-01 00:00:00' + make_dt_interval(CAST(id % 6 AS INT)) AS l_shipdate FROM range(90)"""
    spark.sql(line).write.parquet(str(tmp_path / "lineitem.parquet"))
    return str(tmp_path)


def test_facts_of_many_reads_are_joined_once(spark, facts_dir):
    h, i = views.facts(spark, facts_dir)
    assert all("/base-" in f for df in (h, i) for f in df.inputFiles()) and h.inputFiles()
    assert rows(h) == rows(views.history(spark, facts_dir)) and rows(i) == rows(views.inspection(spark, facts_dir))


def test_history_tasks_grow_with_the_load(spark, facts_dir, monkeypatch):
    asked, write = [], lake.write_history

    def noted(*args, **options):
        asked.append(options.get("tasks"))
        return write(*args, **options)

    monkeypatch.setattr(lake, "write_history", noted)
    out = registry.QUERIES["lake_history_buckets"](spark, facts_dir)
    assert out.agg(F.sum("n")).first()[0] == 90 and asked == [None, None]
