"""Equipment ranking and target against others, checked against brute force on small tables."""

import random
from collections import defaultdict

import pytest
from conftest import rows
from pyspark.sql import functions as F

from panelscope.operators import equipment, glass, steps
from panelscope.operators.glass import Request
from panelscope.operators.mart import build_glass_stats
from panelscope.plans.batch import batch_analysis
from panelscope.plans.hierarchy import HierarchyParams, hierarchy_filter
from panelscope.plans.ranking import equipment_ranking
from panelscope.plans.target import target_analysis
from panelscope.sources.export import ndjson_rows, result_json


def random_facts(seed, shared):
    """History and inspection with repeated steps, one hot product, and panels shared by products."""
    draw = random.Random(seed)
    products = ["P00"] + [f"P{n:02d}" for n in range(1, 25)]

    def product():
        return "P00" if draw.random() < 0.33 else draw.choice(products)

    h = [
        (product(), f"{draw.randrange(1, 4)}000", f"A1CVD{draw.randrange(4):03d}", f"2026-01-0{draw.randrange(1, 6)}T{draw.randrange(24):02d}:00:00", f"M{draw.randrange(2)}")
        for _ in range(250)
    ]
    i = []
    for _ in range(300):
        p = product()
        panel = f"{draw.choice('AB')}{draw.randrange(5)}" if shared else f"{p}{draw.choice('AB')}{draw.randrange(5)}"
        i.append((p, f"{draw.randrange(1, 4)}000", panel, draw.choice(["SPOT-DARK", "LINE-DARK", None])))
    return h, i


def latest(h, key):
    """Newest row per key, ties broken as in the operator: newest type or line wins."""
    best = {}
    for row in sorted(h, key=lambda r: (r[3], r[4], r[2], r[1])):
        best[key(row)] = row
    return list(best.values())


@pytest.mark.parametrize("seed, shared", [(1, False), (2, True), (3, True)])
def test_equipment_stats(history, inspection, seed, shared):
    h, i = random_facts(seed, shared)
    steps_ = latest(h, lambda r: (r[0], r[1], r[2]))
    want = {}
    for p, process, line, _, kind in steps_:
        products, panels = want.setdefault((process, line, kind), (set(), set()))
        products.add(p)
        panels.update(panel for q, c, panel, d in i if q == p and c == process and d and d.startswith("SPOT"))
    got = equipment.equipment_stats(
        steps.dedup_steps(history(h).select("product_id", "process_code", "equipment_line_id", "product_type_code", "move_in_ymdhms")),
        inspection(i),
        "SPOT",
    )
    columns = ("process_code", "equipment_line_id", "product_type_code", "product_count", "total_defects")
    assert rows(got, *columns) == sorted((*k, len(a), len(b)) for k, (a, b) in want.items())
    assert {r[0] for r in got.select("equipment_group_id").collect()} == {"CVD0"}


@pytest.mark.parametrize("seed, shared", [(4, False), (5, True)])
def test_daily_level(history, inspection, seed, shared):
    h, i = random_facts(seed, shared)
    line = "A1CVD001"
    target = {r[0] for r in h if r[2] == line}
    days = defaultdict(lambda: (set(), set()))
    for p, process, _, time, _ in latest(h, lambda r: (r[0], r[1], r[2])):
        products, panels = days[time[:10], "Target" if p in target else "Others"]
        products.add(p)
        panels.update(panel for q, c, panel, d in i if q == p and c == process and d == "SPOT-DARK")
    got = glass.daily_level(history(h), inspection(i), Request(defect_name="SPOT-DARK", equipment_ids=[line]))
    want = sorted((*k, len(panels), len(products)) for k, (products, panels) in days.items())
    assert rows(got, "work_date", "group_type", "total_defects", "glass_count") == want


def equipment_facts(sizes):
    """One line per entry with so many products, each with one defective panel on every third product."""
    h, i = [], []
    for line, n in enumerate(sizes):
        for k in range(n):
            p = f"P{line}{k:03d}"
            h.append((p, "1000", f"A1CVD{line:03d}", "2026-01-01T00:00:00"))
            if k % (line + 2) == 0:
                i.append((p, "1000", f"{p}A1", "SPOT-DARK"))
    return h, i


def test_ranking_needs_ten_products(history, inspection):
    h, i = equipment_facts([9, 10, 12])
    got = equipment_ranking(history(h), inspection(i))
    assert rows(got, "rank", "equipment_line_id") == [(1, "A1CVD001"), (2, "A1CVD002")]
    first, second = got.orderBy("rank").collect()
    # rates 4/10 and 3/12, overall mean of both
    assert first["defect_rate"] == 0.4 and second["defect_rate"] == 0.25
    assert first["delta_loo"] == pytest.approx(0.25 - 0.325) and second["delta_loo"] == pytest.approx(0.4 - 0.325)
    assert first["total_defects"] == 4


def test_single_equipment_has_no_delta(history, inspection):
    h, i = equipment_facts([10])
    assert rows(equipment_ranking(history(h), inspection(i)), "delta_loo", "overall_avg") == [(0.0, 0.5)]


def test_no_equipment_qualifies(history, inspection):
    h, i = equipment_facts([3])
    assert equipment_ranking(history(h), inspection(i)).count() == 0


def test_ranking_filters_dates_and_dedups(history, inspection):
    h, i = equipment_facts([10, 10])
    moved = [(p, c, line, "2026-03-01T00:00:00", "M9") for p, c, line, _ in h[:10]]
    got = equipment_ranking(history(h + moved), inspection(i), "2026-01-01", "2026-01-31")
    assert rows(got, "product_type_code", "product_count") == [("M1", 10), ("M1", 10)]
    later = equipment_ranking(history(h + moved), inspection(i))
    assert rows(later, "equipment_line_id", "product_type_code") == [("A1CVD000", "M9"), ("A1CVD001", "M1")]


def test_within_process(spark):
    stats = spark.createDataFrame([("1", 1.0), ("1", 3.0), ("2", 5.0)], "process_code string, defect_rate double")
    got = equipment.within_process_delta(stats)
    assert rows(got, "process_code", "delta_process") == [("1", -1.0), ("1", 1.0), ("2", 0.0)]


@pytest.fixture
def facts(history, inspection):
    h, i = random_facts(7, False)
    return history(h).cache(), inspection(i).cache()


REQ = Request("2026-01-01", "2026-01-04", equipment_ids=["A1CVD002"])


def test_one_row_per_glass_and_labels_cover_all(facts):
    h, i = facts
    rows_ = glass.glass_level(h, i, REQ).collect()
    in_period = {r[0] for r in h.where("move_in_ymdhms < '2026-01-05'").select("product_id").distinct().collect()}
    assert sorted(r["product_id"] for r in rows_) == sorted(in_period)
    counts = dict(i.groupBy("product_id").count().collect())
    assert all(r["total_defects"] == counts.get(r["product_id"], 0) for r in rows_)
    lots = glass.lot_level(h, i, REQ)
    assert lots.agg(F.sum("glass_count")).first()[0] == len(rows_)
    assert lots.agg(F.sum("total_defects")).first()[0] == sum(r["total_defects"] for r in rows_)


def test_without_equipment_all_are_others(facts):
    for level in (glass.glass_level, glass.lot_level, glass.daily_level, glass.heatmap):
        groups = level(*facts, Request()).select("group_type").distinct()
        assert rows(groups) == [("Others",)]


def test_a_target_that_saw_nothing(facts):
    m = glass.metrics(glass.glass_level(*facts, Request(equipment_ids=["NONE"]))).first()
    assert m["target_glass_count"] == 0 and m["target_defect_rate"] == 0.0
    assert m["overall_defect_rate"] == m["others_defect_rate"] == m["superiority_indicator"] == m["delta_target"]


def test_metrics_of_nothing(spark):
    empty = spark.createDataFrame([], "group_type string, total_defects long")
    assert set(glass.metrics(empty).first()) == {0}


def test_processes_and_models_filter_everywhere(facts):
    h, i = facts
    some = Request(REQ.start, REQ.end, equipment_ids=REQ.equipment_ids, process_codes=["<2000"], model_codes=["M1"])
    steps_ = h.where("process_code < '2000' and product_type_code = 'M1'")
    at_line = {r[0] for r in steps_.where("equipment_line_id = 'A1CVD002'").select("product_id").collect()}
    passed = {r[0] for r in steps_.where("move_in_ymdhms < '2026-01-05'").select("product_id").collect()}
    less = glass.glass_level(h, i, some)
    assert {(r["product_id"], r["group_type"]) for r in less.collect()} == {(p, "Target" if p in at_line else "Others") for p in passed}
    assert 0 < len(passed) < glass.glass_level(h, i, REQ).count()
    found = i.where(F.col("product_id").isin(list(passed)) & (F.col("process_code") < "2000")).count()
    assert glass.heatmap(h, i, some).agg(F.sum("total_defects")).first()[0] == found
    assert found < glass.heatmap(h, i, REQ).agg(F.sum("total_defects")).first()[0]


def test_many_products_are_not_broadcast(facts, monkeypatch):
    want = rows(glass.glass_level(*facts, REQ))
    monkeypatch.setattr(steps, "FEW_KEYS", 0)
    assert rows(glass.glass_level(*facts, REQ)) == want


def test_heatmap_counts_a_defect_once_per_label(history, inspection):
    steps_ = [("P1", "1000", line, f"2026-01-0{d}T00:00:00") for line in ("A1CVD000", "A1CVD001") for d in (1, 2)]
    got = glass.heatmap(history(steps_), inspection([("P1", "1000", "P1A1", "X")]), Request(equipment_ids=["A1CVD000"]))
    assert rows(got) == [("Target", "A", "1", 1, 1, 1.0)]


def test_grid(spark, facts):
    h, i = facts
    req = Request(equipment_ids=["A1CVD002"], model_codes=["M1"])
    grid = spark.createDataFrame(
        [("M1", ["A", "Z"], ["1", "2"]), ("M0", [], [])], "model_code string, x_list array<string>, y_list array<string>"
    )
    got = glass.heatmap_grid(h, i, req, grid)
    assert got.count() == 8 and rows(got.where("x = 'Z'"), "total_defects", "defect_rate") == [(0, 0.0)] * 4
    observed = glass.heatmap(h, i, req).where("x = 'A' and y in ('1', '2')")
    assert rows(got.where("x = 'A' and total_glasses > 0"), *observed.columns) == rows(observed)
    empty = Request(equipment_ids=["A1CVD002"], model_codes=["M0"])
    assert glass.heatmap_grid(h, i, empty, grid).count() == 0
    # a model without a grid falls back to the observed cells
    other = Request(equipment_ids=["A1CVD002"], model_codes=["M7"])
    assert target_analysis(h, i, other, grid).heatmap.columns == observed.columns
    with pytest.raises(ValueError):
        glass.heatmap_grid(h, i, Request(), grid)


def h_of(h, equipment_id, process):
    """History in which the equipment is the target at one process only."""
    other = (F.col("equipment_line_id") == equipment_id) & (F.col("process_code") != process)
    return h.withColumn("equipment_line_id", F.when(other, "ELSEWHERE").otherwise(F.col("equipment_line_id")))


@pytest.mark.parametrize("defect", ["", "SPOT-DARK"])
def test_batch_equals_single_requests(facts, defect):
    pairs = [("A1CVD000", "1000"), ("A1CVD002", "3000"), ("A1CVD002", "1000"), ("NONE", "1000")]
    req = Request("2026-01-01", "2026-01-04", defect_name=defect)
    batch = batch_analysis(*facts, pairs, req)
    for equipment_id, process in pairs:
        mine = (F.col("equipment_line_id") == equipment_id) & (F.col("process_code") == process)
        # in the period the single request keeps the steps of the process only, the batch all steps
        single = target_analysis(h_of(facts[0], equipment_id, process), facts[1], Request(req.start, req.end, defect, [equipment_id]))
        for name in ("heatmap", "metrics"):
            want = getattr(single, name)
            assert rows(getattr(batch, name).where(mine), *want.columns) == rows(want), (name, equipment_id)
        columns = ("product_id", "lot_id", "work_date", "total_defects")
        own = batch.glass.where(mine)
        assert rows(own, *columns) == rows(single.glass.where("group_type = 'Target'"), *columns)
        rest = batch.baseline.join(own, "product_id", "left_anti")
        assert rows(rest, *columns) == rows(single.glass.where("group_type = 'Others'"), *columns)
        touched = single.lot.join(own.select("lot_id").distinct(), "lot_id", "left_semi")
        assert rows(batch.lot.where(mine), *touched.columns) == rows(touched)
        untouched = single.lot.join(own.select("lot_id").distinct(), "lot_id", "left_anti").drop("group_type")
        others = batch.lot_baseline.join(own.select("lot_id").distinct(), "lot_id", "left_anti")
        assert rows(others, *untouched.columns) == rows(untouched)
        days = single.glass.groupBy("work_date", "group_type").agg(F.sum("total_defects"), F.count("*"))
        got = batch.daily.where(mine).select("work_date", "group_type", "total_defects", "glass_count")
        assert rows(got) == rows(days)


def test_batch_thins_like_a_single_plot(spark, history, inspection):
    h = [(f"P{n:05d}", "1000", f"A1CVD{n % 3:03d}", "2026-01-01T00:00:00") for n in range(5000)]
    h += [(f"P{n:05d}", "2000", "A1CVD009", "2026-01-01T00:00:00") for n in range(0, 3000)]
    pairs = [("A1CVD001", "1000"), ("A1CVD009", "2000"), ("NONE", "1")]
    glass_ = batch_analysis(history(h), inspection([]), pairs, Request(), thin=True).glass
    got = {(r[0], r[2]) for r in glass_.select("equipment_line_id", "process_code", "product_id").collect()}
    for e, p in pairs:
        members = {r[0] for r in h if (r[2], r[1]) == (e, p)}
        others = sorted({r[0] for r in h} - members)[1::2]
        assert {product for name, product in got if name == e} == members | set(others)


def test_batch_needs_targets(spark, facts):
    none = spark.createDataFrame([(None, "1000")], "equipment_line_id string, process_code string")
    for targets in ([], none):
        with pytest.raises(ValueError):
            batch_analysis(*facts, targets, Request())


@pytest.mark.parametrize("thin", [False, True])
def test_targets_of_a_frame_are_those_of_a_list(spark, facts, thin):
    pairs = [("A1CVD000", "1000"), ("A1CVD002", "3000"), ("NONE", "1000"), ("A1CVD000", "1000")]
    frame = spark.createDataFrame([(p, "x", e) for e, p in [*pairs, (None, "1000")]], "process_code string, extra string, equipment_line_id string")
    listed, framed = (batch_analysis(*facts, t, Request(), thin=thin) for t in (pairs, frame))
    for name, part in listed.parts().items():
        assert rows(part) == rows(getattr(framed, name), *part.columns), name


def test_long_requests_stay_out_of_the_plan(spark, facts, tmp_path):
    h, i = facts

    def size(targets):
        result = batch_analysis(h, i, targets, Request())
        return len(result.daily._jdf.queryExecution().analyzed().toString())

    many = [(f"E{n}", "1000") for n in range(1000)]
    assert size(spark.createDataFrame(many, "equipment_line_id string, process_code string")) < 1.2 * size(many[:1])

    mart = build_glass_stats(i, h)
    mart.write.parquet(str(tmp_path / "mart"))
    mart = spark.read.parquet(str(tmp_path / "mart"))
    wanted = sorted({r[0] for r in mart.select("product_id").collect()})[::2]
    ids = [*wanted, *(f"gone{n}" for n in range(100_000))]
    frame = spark.createDataFrame([(p,) for p in ids], "product_id string")
    few = rows(hierarchy_filter(mart, HierarchyParams(product_ids=wanted)))
    for params in (HierarchyParams(product_ids=ids), HierarchyParams(products=frame), HierarchyParams(product_ids=ids, products=frame)):
        found = hierarchy_filter(mart, params)
        assert rows(found) == few and few
        assert len(found._jdf.queryExecution().analyzed().toString()) < 10_000


def test_documents_and_lines(spark, facts):
    pairs = [("A1CVD000", "1000"), ("A1CVD002", "3000")]
    result = batch_analysis(*facts, pairs, Request()).parts()
    documents = result_json(result, records=5)
    for name, part in result.items():
        chunks = documents.where(F.col("part") == name)
        assert chunks.agg(F.sum(F.json_array_length("payload"))).first()[0] == part.count()
    assert documents.where("part = 'glass'").select("chunk").distinct().count() > 1
    targets = spark.createDataFrame([*pairs, ("GONE", "1")], "equipment_line_id string, process_code string")
    lines = ndjson_rows(result_json(result), targets)
    assert result_json(result).select("chunk").distinct().count() == 1
    with pytest.raises(ValueError):
        result_json(result, records=0)
    assert rows(lines, "equipment_id", "error") == [
        ("A1CVD000", None), ("A1CVD002", None), ("GONE", "no result returned"),
    ]
