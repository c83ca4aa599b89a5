"""Defect marts, hierarchy, layouts and table updates."""

import pytest
from conftest import at, rows
from pyspark.sql import functions as F

from panelscope.operators import cells, layout, mart as marts, nodes, updates
from panelscope.plans.daily import full_grid_stats
from panelscope.plans.hierarchy import HierarchyParams, hierarchy_analysis, hierarchy_filter, level_of

MART = (
    "product_id string, defect_name string, model_code string, work_time timestamp_ntz, process_code string, "
    "equipment_line_id string, equipment_machine_id string, equipment_path_id string, total_defects long, "
    "panel_map array<long>, panel_addrs array<string>, inspection_time timestamp_ntz"
)


@pytest.fixture
def four_rows(spark):
    """Two paths: one with panel arrays, one with empty arrays."""

    def row(product, hour, n, total, panel_map, addrs):
        time = at(f"2026-01-01T{hour}:00:00")
        node = (f"STEP{n}", f"EQ{n}", f"UNIT{n}", f"WAY{n}")
        return (product, "STAIN-WET", "Q7", time, *node, total, panel_map, addrs, time)

    data = [
        row("G-A", 16, 1, 9, [4, 5], ["C3", "D1"]),
        row("G-B", 17, 1, 3, [3], ["A7"]),
        row("G-C", 18, 2, 8, [], []),
        row("G-D", 19, 2, 6, [], []),
    ]
    return spark.createDataFrame(data, MART)


def test_hierarchy_of_four_rows(four_rows):
    got = {r["process_code"]: r for r in hierarchy_analysis(four_rows).collect()}
    one, two = got["STEP1"], got["STEP2"]
    assert (one["total_products"], one["total_defects"], one["dpu"]) == (2, 12, 6.0)
    assert (one["panel_addrs"], one["panel_map"]) == (["A7", "C3", "D1"], [3, 4, 5])
    assert [tuple(d) for d in one["daily_dpu"]] == [("2026-01-01", 6.0)]
    assert (two["total_products"], two["total_defects"], two["dpu"]) == (2, 14, 7.0)
    assert two["panel_addrs"] is None and two["panel_map"] is None
    assert [tuple(d) for d in two["daily_dpu"]] == [("2026-01-01", 7.0)]
    assert one["equipment_path_id"] == "WAY1"


def test_levels(four_rows):
    assert level_of(HierarchyParams()) == "path"
    assert level_of(HierarchyParams(process_code="1")) == "path"
    assert level_of(HierarchyParams(equipment_line_id="L")) == "line"
    assert level_of(HierarchyParams(equipment_line_id="L", equipment_machine_id="M")) == "machine"
    assert level_of(HierarchyParams(equipment_path_id="P", analysis_level="line")) == "line"
    for level, known in (("process", 1), ("line", 2), ("machine", 3), ("path", 4), ("nonsense", 1)):
        row = hierarchy_analysis(four_rows, HierarchyParams(analysis_level=level)).first()
        assert sum(row[c] is not None for c in nodes.NODE) == known


def test_unknown_nodes_stay(four_rows):
    blank = four_rows.withColumn("process_code", F.lit(None).cast("string")).withColumn("work_time", F.lit(None).cast("timestamp_ntz"))
    row = hierarchy_analysis(blank, HierarchyParams(analysis_level="process")).collect()
    assert len(row) == 1 and row[0]["panel_addrs"] == ["A7", "C3", "D1"] and row[0]["daily_dpu"][0]["work_date"] is None


def test_all_filters_apply(four_rows):
    def count(**params):
        return hierarchy_filter(four_rows, HierarchyParams(**params)).count()

    assert count() == 4
    assert count(product_ids=["G-A", "G-C"]) == 2
    assert count(product_ids=["G-A"], start="2026-01-01", end="2026-01-01", model_code="Q7") == 1
    assert count(product_ids=["G-A"], model_code="XX") == 0
    assert count(product_ids=["G-A"], start="2030-01-01", end="2030-01-02") == 0
    assert count(equipment_path_id="WAY2") == 2 and count(equipment_machine_id="UNIT1") == 2
    assert count(model_code="XX") == 0 and count(defect_name="STAIN-WET") == 4
    assert count(start="2026-01-01", end="2026-01-01") == 4 and count(start="2026-01-02", end="2026-01-03") == 0
    assert count(start="2026-01-01", end="2026-01-01", date_type="work") == 4


def test_trend_is_in_date_order_and_filled(four_rows):
    later = four_rows.withColumn("work_time", F.col("work_time") - F.expr("INTERVAL 2 DAYS"))
    found = hierarchy_analysis(four_rows.unionByName(later), HierarchyParams(analysis_level="process"))
    days = [d["work_date"] for d in found.first()["daily_dpu"]]
    assert days == ["2025-12-30", "2026-01-01"]
    filled = nodes.fill_days(found.where("process_code = 'STEP1'"), "2025-12-31", "2026-01-02").first()["daily_dpu"]
    assert [tuple(d) for d in filled] == [("2025-12-31", 0.0), ("2026-01-01", 6.0), ("2026-01-02", 0.0)]
    none = found.withColumn("daily_dpu", F.lit(None).cast("array<struct<work_date:string,dpu:double>>"))
    assert [d["dpu"] for d in nodes.fill_days(none, "2026-01-01", "2026-01-02").first()["daily_dpu"]] == [0.0, 0.0]


def test_filled_rows(spark):
    trend = spark.createDataFrame([("a", "2026-01-02", 5), (None, "2026-01-01", 1)], "k string, work_date string, n int")
    got = nodes.fill_day_rows(trend, "2026-01-01", "2026-01-02", ["k"], ["n"])
    assert rows(got) == rows(spark.createDataFrame([("a", "2026-01-01", 0), ("a", "2026-01-02", 5), (None, "2026-01-01", 1), (None, "2026-01-02", 0)], trend.schema))


STEPS = [
    ("P1M1001", "1000", "A1CVD000", "2026-01-01T00:00:00"),
    ("P1M1001", "2000", "A1CVD001", "2026-01-02T00:00:00"),
    ("P1M1002", "1000", "A1CVD000", "2026-01-01T00:00:00"),
    ("P1M1002", "1000", "A1CVD001", "2026-01-01T00:00:00"),
]
DEFECTS = [
    ("P1M1001", "1000", "P1M1001B2", "SPOT", "2026-01-05T01:00:00"),
    ("P1M1001", "1000", "P1M1001A1", "SPOT", "2026-01-05T03:00:00"),
    ("P1M1001", "2000", "P1M1001A1", "SPOT", "2026-01-05T02:00:00"),
    ("P1M1001", "1000", "P1M1001A1", "SPOT", "2026-01-06T00:00:00"),
    ("P1M1001", "1000", "P1M1001A1", None, "2026-01-05T00:00:00"),
    ("P1M1003", "1000", "P1M1003A10", "LINE", "2026-01-05T00:00:00"),
]


def test_one_mart_row_per_day_product_and_defect(history, inspection):
    got = marts.build_glass_stats(inspection(DEFECTS), history(STEPS))
    columns = ("product_id", "defect_name", "total_defects", "panel_addrs", "panel_map", "equipment_line_id", "inspection_time")
    assert rows(got, *columns) == [
        ("P1M1001", "SPOT", 1, ["A1"], [1], "A1CVD001", at("2026-01-06T00:00:00")),
        ("P1M1001", "SPOT", 3, ["A1", "B2"], [2, 1], "A1CVD001", at("2026-01-05T03:00:00")),
        ("P1M1003", "LINE", 1, ["A10"], [1], None, at("2026-01-05T00:00:00")),
    ]
    assert got.where("total_defects != aggregate(panel_map, 0L, (a, n) -> a + n)").count() == 0
    one_day = marts.build_glass_stats(inspection(DEFECTS), history(STEPS), ["2026-01-06"], "A1T")
    assert rows(one_day, "total_defects") == [(1,)]
    assert marts.build_glass_stats(inspection(DEFECTS), history(STEPS), facility="B2T").count() == 0


def test_equal_times_give_one_fixed_winner(history):
    got = [rows(marts.latest_steps(history(order)), "product_id", "equipment_line_id") for order in (STEPS, STEPS[::-1])]
    assert got[0] == got[1] == [("P1M1001", "A1CVD001"), ("P1M1002", "A1CVD001")]


def test_panel_index(spark):
    df = spark.createDataFrame([("A0",), ("A1",), ("A9",), ("B0",), ("Z9",), ("A10",), ("a1",), ("A",), (None,)], "panel_addr string")
    assert [r[0] for r in df.select(marts.panel_index()).collect()] == [1, 2, 10, 11, 260, None, None, None, None]


def test_flag_mart(history, inspection):
    h, i = history(STEPS), inspection(DEFECTS)
    assert rows(marts.panel_indices(i)) == [("P1M1001", [2, 13], 0), ("P1M1003", [], 1)]
    got = {r["product_id"]: r for r in marts.build_flag_mart(h, i).collect()}
    assert sorted(got) == ["P1M1001", "P1M1002"]
    assert got["P1M1001"]["total_defects"] == 5 and got["P1M1002"]["total_defects"] == 0
    assert [n + 1 for n, flag in enumerate(got["P1M1001"]["panel_map"]) if flag] == [2, 13]
    assert len(got["P1M1002"]["panel_map"]) == 260 and not any(got["P1M1002"]["panel_map"])
    # the product without history has the unreadable address
    assert got["P1M1001"]["unreadable"] == 0
    odd = marts.build_flag_mart(history([("P1M1003", "1000", "A1CVD000", "2026-01-01T00:00:00")]), i).first()
    assert (odd["total_defects"], sum(odd["panel_map"]), odd["unreadable"]) == (1, 0, 1)
    stats = marts.mart_stats(marts.build_flag_mart(h, i)).first()
    assert tuple(stats)[0] == 2 and stats["total_defects"] == 5 and stats["avg_defects_per_glass"] == 2.5
    assert marts.unique_lots(marts.glass_defects(marts.panel_counts(i)), h).first()[0] == 1


def test_flag_sums(spark):
    flags = [[1] + [0] * 258 + [1], [1, 1] + [0] * 258]
    df = spark.createDataFrame([(f,) for f in flags], "panel_map array<int>")
    got = cells.sum_panel_flags(df)
    assert got.count() == 260
    assert rows(got.where("total_defects > 0")) == [("A", "0", 2, 2, 1.0), ("A", "1", 1, 2, 0.5), ("Z", "9", 1, 2, 0.5)]
    assert cells.sum_panel_flags(df, cells=100).count() == 100
    assert cells.sum_panel_flags(df.limit(0)).count() == 0


def test_heatmap_forms(spark):
    df = spark.createDataFrame([("Target", "A", "1", 0.5), ("Target", "B", "2", 1.0)], "group_type string, x string, y string, defect_rate double")
    assert rows(cells.heatmap_matrix(df)) == [("Target", "1", 0.5, 0.0), ("Target", "2", 0.0, 1.0)]
    assert cells.heatmap_matrix(df, xs=["C", "A"]).columns == ["group_type", "y", "A", "C"]
    assert rows(cells.intensity(df.withColumn("defect_rate", F.col("defect_rate") / 2)), "intensity") == [(0.5,), (1.0,)]
    assert rows(cells.intensity(df.withColumn("defect_rate", F.lit(0.0))), "intensity") == [(0.0,), (0.0,)]


def test_masters(history, inspection):
    assert rows(marts.daily_masters(inspection(DEFECTS), "defect_name", "2026-01-05"), "defect_name") == [("LINE",), ("SPOT",)]
    assert rows(marts.daily_masters(inspection(DEFECTS), "defect_name", "2026-02-05"), "defect_name") == []


def test_layout_of_a_model(spark):
    parts = spark.createDataFrame([("M1", "a"), ("M1", "b"), ("M2", "c")], "model_code string, part_no_name string")
    maps = spark.createDataFrame([("a", None), ("b", ["A1", "A2"]), ("c", None)], "part_no_name string, ref_panels array<string>")
    assert rows(layout.model_layout(parts, maps), "model_code", "ref_panels") == [("M1", ["A1", "A2"])]


@pytest.mark.parametrize("order", [("panel_map", "panel_addrs"), ("panel_addrs", "panel_map")])
def test_full_grid(spark, order):
    data = [("M1", ["A1", "Z9"], [4, 7]), ("M2", ["B1"], [2]), ("M1", [], []), ("M1", None, None), (None, ["C1"], [1])]
    df = spark.createDataFrame(data, "model_code string, panel_addrs array<string>, panel_map array<long>")
    ref = spark.createDataFrame([("M1", ["A0", "A1", "A2"])], "model_code string, ref_panels array<string>")
    got = layout.full_grid(df.select("model_code", *order), ref)
    grid = ["A0", "A1", "A2"]
    assert rows(got, "model_code", "panel_addrs", "panel_map") == [
        ("M1", grid, [0, 0, 0]), ("M1", grid, [0, 0, 0]), ("M1", grid, [0, 4, 0]), ("M2", ["B1"], [2]), ("UNKNOWN", ["C1"], [1]),
    ]
    # what lies outside the layout is counted
    assert rows(got, "outside_defects") == [(0,)] * 4 + [(7,)]


def test_full_grid_of_built_rows(history, inspection, spark):
    ref = spark.createDataFrame([("M1", ["A0", "A1", "B2"])], "model_code string, ref_panels array<string>")
    got = full_grid_stats(inspection(DEFECTS), history(STEPS), ref, ["2026-01-05"])
    assert rows(got, "product_id", "panel_map", "outside_defects") == [("P1M1001", [0, 2, 1], 0), ("P1M1003", [0, 0, 0], 1)]
    whole = F.aggregate("panel_map", F.lit(0).cast("long"), lambda n, x: n + x) + F.col("outside_defects")
    assert got.where(whole != F.col("total_defects")).isEmpty()


def test_panel_rates(spark, four_rows):
    ref = spark.createDataFrame([("Q7", ["D1", "A7", "C3", "A0"])], "model_code string, ref_panels array<string>")
    found = hierarchy_analysis(four_rows, HierarchyParams(analysis_level="process"), by=("model_code",))
    got = {r["process_code"]: r for r in layout.panel_rates(found, ref).collect()}
    assert got["STEP1"]["panel_addrs"] == ["A0", "A7", "C3", "D1"]
    assert got["STEP1"]["panel_map"] == [0, 3, 4, 5] and got["STEP1"]["panel_rates"] == [0.0, 1.5, 2.0, 2.5]
    assert got["STEP2"]["panel_rates"] == [0.0] * 4


def test_unknown_models(spark, four_rows):
    master = spark.createDataFrame([("M1",)], "model_code string")
    kept, unknown = layout.known_models(four_rows, master)
    assert kept.count() == 0 and rows(unknown) == [("Q7",)]
    assert layout.known_requested(["M1", "Q7", "M1"], master) == (["M1", "M1"], ["Q7"])


# ---- updates -------------------------------------------------------------------------------------


def totals(inspection, history, part):
    return updates.total_of_days(marts.build_glass_stats(inspection(part), history(STEPS)).drop("created_at"))


def test_accumulated_mart_equals_one_build(history, inspection):
    first = [d for d in DEFECTS if d[4] < "2026-01-06"]
    second = [d for d in DEFECTS if d[4] >= "2026-01-06"]
    merged = updates.upsert_add(totals(inspection, history, first), totals(inspection, history, second))
    whole = totals(inspection, history, DEFECTS)
    assert rows(merged, *whole.columns) == rows(whole)
    assert rows(updates.upsert_add(whole, whole.limit(0)), *whole.columns) == rows(whole)


def test_upsert_keeps_the_first_work_time(spark):
    schema = "product_id string, defect_name string, work_time string, lot_id string, total_defects long, panel_map array<long>, panel_addrs array<string>"
    old = spark.createDataFrame([("P", "D", "old", "L1", 3, [1, 2], ["A1", "B1"])], schema)
    new = spark.createDataFrame([("P", "D", "new", "L2", 4, [4], ["B1"]), ("Q", "D", "new", "L2", 1, None, None)], schema)
    assert rows(updates.upsert_add(old, new, ["product_id", "defect_name"])) == [
        ("P", "D", "old", "L2", 7, [1, 6], ["A1", "B1"]), ("Q", "D", "new", "L2", 1, [], []),
    ]


def test_small_upserts(spark):
    old = spark.createDataFrame([("a", 1), ("b", 5)], "k string, updated_at int")
    new = spark.createDataFrame([("a", 2), ("c", 3)], "k string, updated_at int")
    assert rows(updates.upsert_touch(old, new, ["k"])) == [("a", 2), ("b", 5), ("c", 3)]
    assert rows(updates.upsert_replace(old, new, ["k"])) == [("a", 2), ("b", 5), ("c", 3)]
    assert rows(updates.evolve(old, new.withColumn("x", F.lit(1)))) == [("a", 1, None), ("a", 2, 1), ("b", 5, None), ("c", 3, 1)]
    assert updates.add_columns(old, z="int", k="string").columns == ["k", "updated_at", "z"]


def test_retention(history):
    h = history([("P", "1", "L", f"2026-01-{d:02d}T12:00:00") for d in (1, 9, 10, 20)])
    assert updates.retain(h, "move_in_ymdhms", 11, "2026-01-21").count() == 2
    for days in (0, -1):
        with pytest.raises(ValueError):
            updates.retain(h, "move_in_ymdhms", days, "2026-01-21")
