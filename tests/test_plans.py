"""What the physical plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

from panelscope.functions.predicates import on_day, time_range
from panelscope.operators import equipment, glass, mart as marts, nodes, steps
from panelscope.operators.glass import Request
from panelscope.operators.positions import page
from panelscope.plans.hierarchy import HierarchyParams, hierarchy_analysis
from panelscope.plans.ranking import ranking_rows
from panelscope.sources.facts import read_facts, write_facts


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("lake")
    from panelscope.catalog import views

    sf = "/root/testdata/sf0.001"
    views.history(spark, sf).write.parquet(f"{root}/history")
    views.inspection(spark, sf).write.parquet(f"{root}/inspection")
    h, i = spark.read.parquet(f"{root}/history"), spark.read.parquet(f"{root}/inspection")
    marts.build_glass_stats(i, h).write.parquet(f"{root}/mart")
    return h, i, spark.read.parquet(f"{root}/mart")


REQ = Request("1996-01-01", "1997-12-31", "SPOT-DARK", ["A1CVD000"], ["1000"], ["M1"])


def frames(lake):
    h, i, mart = lake
    stats = equipment.equipment_stats(steps.dedup_steps(h), i, "SPOT")
    return {
        "stats": stats,
        "ranking": ranking_rows(h, i, "1996-01-01", "1997-12-31"),
        "glass": glass.glass_level(h, i, REQ),
        "lot": glass.lot_level(h, i, REQ),
        "daily": glass.daily_level(h, i, REQ),
        "heatmap": glass.heatmap(h, i, REQ),
        "mart": marts.build_glass_stats(i, h, ["1997-06-15"], "A1T"),
        "flags": marts.build_flag_mart(h, i),
        "hierarchy": hierarchy_analysis(mart, HierarchyParams(model_code="M1")),
    }


def test_no_cross_joins_and_no_python(lake):
    for name, df in frames(lake).items():
        text = plan(df)
        for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "ArrowEval", "MapInPandas"):
            assert bad not in text, (name, bad)


def test_filters_reach_the_scan(lake):
    h, i, mart = lake
    for df in (
        h.where(time_range("move_in_ymdhms", "1996-01-01", "1996-12-31")),
        i.where(on_day("inspection_end_ymdhms", "1997-06-15")),
        hierarchy_analysis(mart, HierarchyParams(start="1996-01-01", end="1996-12-31", model_code="M1")),
    ):
        scans = re.findall(r"PushedFilters: \[([^\]]*)\]", plan(df))
        assert scans and all("GreaterThanOrEqual" in s and "LessThan" in s for s in scans), scans
    pushed = re.findall(r"PushedFilters: \[([^\]]*)\]", plan(marts.panel_counts(i, ["1997-06-15"])))
    assert "GreaterThanOrEqual(inspection_end_ymdhms" in pushed[0]


def test_only_needed_columns_are_read(lake):
    h, i, _ = lake
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan(glass.glass_level(h, i, Request(equipment_ids=["A1CVD000"]))))
    columns = {c.split(":")[0] for s in schemas for c in s.split(",")}
    assert columns <= {"product_id", "lot_id", "move_in_ymdhms", "panel_id", "equipment_line_id"}


def test_dedup_drops_rows_before_the_shuffle(lake):
    text = plan(steps.dedup_steps(lake[0]))
    above, below = text.split("Exchange hashpartitioning", 1)
    assert "WindowGroupLimit" in above and "WindowGroupLimit" in below


def test_aggregates_combine_before_the_shuffle(lake):
    for name in ("lot", "heatmap", "flags"):
        assert "partial_" in plan(frames(lake)[name]), name


def test_a_week_shuffles_its_products_only(lake):
    h, i, _ = lake
    week = Request("1997-06-01", "1997-06-07")
    for level in (glass.glass_level, glass.heatmap):  # the daily trend has pruned its panels in the plan it wrote
        df = level(h, i, week)
        joins = [x for x in plan(df).split("\n") if "BroadcastHashJoin [product_id" in x]
        assert any("LeftSemi" in x for x in joins), joins
    shuffled = glass.of_period(i, h, week)
    assert "Exchange hashpartitioning" not in plan(shuffled)
    products = h.where(time_range("move_in_ymdhms", week.start, week.end)).select("product_id").distinct()
    assert shuffled.count() == i.join(products, "product_id", "left_semi").count() < i.count() / 10


def test_the_mart_is_scanned_twice_for_a_hierarchy(lake):
    assert plan(hierarchy_analysis(lake[2])).count("Scan parquet") == 2


def test_pages_are_top_k(lake):
    assert "TakeOrderedAndProject" in plan(page(lake[0], [F.col("move_in_ymdhms").asc()], 10, 5))


def test_trend_and_maps_are_counted_before_lists_are_collected(lake):
    text = plan(nodes.node_maps(lake[2], "line"))
    assert text.index("collect_list") < text.index("sum(panel_map")


@pytest.fixture(scope="module")
def folders(lake, tmp_path_factory):
    from panelscope.sources import lake as store

    root, (h, i, _) = str(tmp_path_factory.mktemp("folders")), lake
    spark = i.sparkSession
    june = i.where(time_range("inspection_end_ymdhms", "1997-06-01", "1997-06-20"))
    store.write_inspection(june, f"{root}/inspection", tasks=4)
    read = store.read_inspection(spark, f"{root}/inspection")
    store.write_mart_days(marts.build_glass_stats(read, h), f"{root}/mart", tasks=4)
    return h, june, read, store.read_mart(spark, f"{root}/mart")


def files_of(df):
    """Folders that the scan of a plan has left after pruning."""
    return {n for f in re.findall(r"PartitionFilters: \[([^\]]*)\]", plan(df)) for n in re.findall(r"(year|month|day|stat_date)#", f)}


def test_days_reach_the_folders(folders):
    h, june, read, mart = folders
    for days in (["1997-06-03"], ["1997-06-03", "1997-06-04", "1997-06-09"]):
        counts = marts.panel_counts(read, days)
        assert files_of(counts) == {"year", "month", "day"}
        assert sorted(map(str, counts.collect())) == sorted(map(str, marts.panel_counts(june, days).collect()))
    assert files_of(marts.panel_counts(read)) == set()
    for found in (steps.inspections(read, "1997-06-03 10:00:00", "1997-06-05"), steps.inspections(read, start="1997-06-05"), steps.inspections(read, end="1997-06-05 01:00:00")):
        assert files_of(found) == {"year", "month", "day"}
    assert steps.inspections(read, "1997-06-03 10:00:00", "1997-06-05").count() == june.where(time_range("inspection_end_ymdhms", "1997-06-03 10:00:00", "1997-06-05")).count()
    assert files_of(marts.daily_masters(read, "defect_name", "1997-06-03")) == {"year", "month", "day"}


def test_dates_of_a_hierarchy_reach_the_folders(folders):
    mart = folders[3]
    week = hierarchy_analysis(mart, HierarchyParams(start="1997-06-03", end="1997-06-09"))
    assert files_of(week) == {"stat_date"}
    plain = mart.where(time_range("inspection_time", "1997-06-03", "1997-06-09"))
    assert sorted(map(str, week.collect())) == sorted(map(str, hierarchy_analysis(plain).collect()))
    assert files_of(hierarchy_analysis(mart, HierarchyParams(start="1997-06-03", end="1997-06-09", date_type="work"))) == set()


def test_rows_without_folder_values_pass(lake):
    from panelscope.functions.predicates import within_days

    i = lake[1].withColumns({c: F.lit(None).cast("int") for c in ("year", "month", "day")})
    days = ["1997-06-03", "1997-06-07"]
    assert i.where(within_days(i, "inspection_end_ymdhms", days)).count() == lake[1].where(on_day("inspection_end_ymdhms", days[0]) | on_day("inspection_end_ymdhms", days[1])).count()


def test_a_rebuilt_day_shuffles_the_steps_of_its_products_only(lake):
    h, i, _ = lake
    text = plan(marts.build_glass_stats(i, h, ["1997-06-15"], "A1T"))
    above, below = text.split("WindowGroupLimit", 1)
    assert "BroadcastHashJoin" in below and "LeftSemi" in below
    assert below.index("Exchange hashpartitioning") < below.index("LeftSemi")  # the join lies under the shuffle
    whole = marts.build_glass_stats(i, h).where("facility_code = 'A1T' AND stat_date = DATE '1997-06-15'").drop("created_at")
    one = marts.build_glass_stats(i, h, ["1997-06-15"], "A1T").drop("created_at")
    assert sorted(map(str, one.collect())) == sorted(map(str, whole.collect()))


def test_all_levels_come_from_one_pass_without_distinct(lake):
    from panelscope.session import settle

    mart = lake[2].withColumn("equipment_path_id", F.expr("nullif(equipment_path_id, 'A1CVD0040404')"))
    mart = mart.unionByName(mart.limit(3).withColumn("product_id", F.lit(None).cast("string")))
    bitmaps = settle(nodes.product_bitmaps(mart), "bitmaps")
    whole = nodes.totals_of_all_levels(bitmaps)
    text = plan(whole)
    assert text.count("Scan parquet") == 1 and "distinct" not in text and "Expand" in text
    for level in nodes.LEVELS:
        got = whole.where(F.col("level") == level).drop("level")
        assert sorted(map(str, got.collect())) == sorted(map(str, nodes.node_totals(mart, level).select(*got.columns).collect())), level
    halves = nodes.product_bitmaps(mart).hint("rebalance")  # merged in any order
    assert sorted(map(str, nodes.totals_of_all_levels(halves).collect())) == sorted(map(str, whole.collect()))


def test_bucketed_facts_meet_without_an_exchange(spark, lake, tmp_path):
    h, i, _ = lake
    root = str(tmp_path / "facts")
    facts = write_facts(h, i, root, buckets=8)
    with pytest.raises(ValueError):
        write_facts(h, i, root)
    other = spark.newSession()
    for session in (spark, other):
        session.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for opened in (facts, read_facts(other, root)):
            latest = steps.dedup_steps(opened.history)
            stats = equipment.equipment_stats(latest, opened.inspection, "SPOT", latest=True, shared=opened.shared)
            text = plan(stats)
            # the only exchange gathers the counts of an equipment, after the join
            assert len(re.findall(r"Exchange hashpartitioning\(", text)) == 1, text
            assert "Exchange" not in text[text.index("SortMergeJoin") :], text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plain = equipment.equipment_stats(steps.dedup_steps(h), i, "SPOT")
    assert sorted(map(tuple, stats.collect())) == sorted(map(tuple, plain.collect()))
