"""Lake, extraction, exports and the daily batch."""

import datetime as dt
import json

import pyarrow.parquet as pq
import pytest
from conftest import at, rows
from pyspark.sql import functions as F

from panelscope.plans import daily
from panelscope.session import delete, release, scratch_root, settle
from panelscope.sources import export, extract, lake, loads

DAYS = ["2026-01-01T05:00:00", "2026-01-02T06:00:00", "2026-02-01T00:00:00"]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def three_days(inspection):
    return inspection([(f"P{n}", "1000", f"P{n}A1", "SPOT", day) for n, day in enumerate(DAYS)])


def test_days_are_replaced_and_others_stay(spark, three_days, tmp_path):
    root = str(tmp_path / "inspection")
    lake.write_inspection(three_days, root)
    lake.write_inspection(three_days.where("product_id = 'P1'").withColumn("defect_name", F.lit("NEW")), root)
    lake.write_inspection(three_days.limit(0), root)
    got = lake.facility_scan(lake.read_lake(spark, root), "A1T")
    assert rows(got, "product_id", "year", "month", "day", "defect_name") == [
        ("P0", 2026, 1, 1, "SPOT"), ("P1", 2026, 1, 2, "NEW"), ("P2", 2026, 2, 1, "SPOT"),
    ]
    assert "PartitionFilters: [isnotnull(facility_code" in plan(got)
    assert lake.scan_glob(spark, root, "A1T").count() == 3
    with pytest.raises(ValueError):
        lake.facility_scan(got, "")
    with pytest.raises(ValueError):
        lake.scan_glob(spark, root, "")


def test_files_merge_by_column_name(spark, tmp_path):
    root = str(tmp_path / "lake")
    spark.sql("SELECT 1 AS a, 'x' AS b").write.parquet(f"{root}/facility_code=A1T")
    spark.sql("SELECT 'y' AS b, 2.5D AS c").write.parquet(f"{root}/facility_code=B2T")
    assert rows(lake.read_lake(spark, root), "a", "b", "c", "facility_code") == [
        (1, "x", None, "A1T"), (None, "y", 2.5, "B2T"),
    ]
    declared = lake.read_lake(spark, root, lake.read_lake(spark, root).schema)
    assert declared.count() == 2 and declared.where("c > 1").count() == 1


def test_history_buckets_and_lookup(spark, history, tmp_path):
    root = str(tmp_path / "history")
    h = history([(f"G1M{n % 2}{n:08d}", "1000", "A1CVD000", DAYS[n % 3]) for n in range(60)]).withColumn("model_code", F.substring("product_id", 3, 2))
    for _ in range(2):  # running a day again changes nothing
        lake.write_history(h, root, "2026-01-01", buckets=4)
    back = lake.read_lake(spark, root)
    assert back.count() == 60
    assert back.select("model_code", "bucket_id").distinct().count() == 8
    one = lake.product_lookup(back, "G1M100000007", buckets=4)
    assert one.count() == 1
    assert "bucket_id" in plan(one).split("PartitionFilters")[1].split("PushedFilters")[0]
    # more rows on another day are added
    lake.write_history(h.limit(5), root, "2026-01-02", buckets=4)
    assert lake.read_lake(spark, root).count() == 65
    assert lake.expire_days(spark, root, 3, "2026-01-05") == [f"file:{root}/load_day=2026-01-01"]
    assert lake.read_lake(spark, root).count() == 5


def test_codes_of_digits_stay_text(spark, history, tmp_path):
    root = str(tmp_path / "history")
    h = history([("G1070000001", "1000", "A1CVD000", DAYS[0])]).withColumns({"facility_code": F.lit("01"), "model_code": F.lit("07")})
    lake.write_history(h, root, "2026-01-01", buckets=7)
    for df in (lake.read_lake(spark, root), lake.read_history(spark, root), lake.scan_glob(spark, f"{root}/load_day=2026-01-01", "01")):
        row = df.first()
        assert (row["facility_code"], row["model_code"], len(row["bucket_id"])) == ("01", "07", 2)
    assert lake.facility_scan(lake.read_history(spark, root), "01").count() == 1
    assert [f.name for f in lake.read_history(spark, root).schema if f.dataType.simpleString() == "int"] == ["apd_seq_no"]


def bloom_bytes(spark, path) -> int:
    jvm, conf = spark._jvm.org.apache, spark._jsc.hadoopConfiguration()
    file = jvm.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.hadoop.fs.Path(str(path)), conf)
    reader = jvm.parquet.hadoop.ParquetFileReader.open(file)
    columns = reader.getFooter().getBlocks().get(0).getColumns()
    size = sum(c.getBloomFilterLength() for c in columns if c.getPath().toDotString() == "product_id")
    reader.close()
    return size


def test_history_files_are_sorted_and_have_a_bloom_filter(spark, history, tmp_path):
    root = tmp_path / "history"
    h = history([(f"G1M1{(n * 7919) % 997:08d}", "1000", "A1CVD000", DAYS[0]) for n in range(997)])
    # constant folders must not cost the order inside the files
    h = h.withColumns({"model_code": F.lit("M1"), "facility_code": F.lit("A1T")})
    lake.write_history(h, str(root), "2026-01-01", buckets=1)
    files = list(root.rglob("*.parquet"))
    assert files
    for f in files:
        products = pq.read_table(f, columns=["product_id"], partitioning=None)["product_id"].to_pylist()
        assert products == sorted(products)
        assert bloom_bytes(spark, f) > 0


def test_a_bucket_with_most_rows_is_split(spark, history, tmp_path):
    """All rows, even copies of one row, land in one folder but are written by several tasks."""
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "2000")
    try:
        one = history([("G1M100000001", "1000", "A1CVD000", DAYS[0])]).withColumn("model_code", F.lit("M1"))
        copies = spark.range(20000).repartition(8).crossJoin(F.broadcast(one)).drop("id")
        lake.write_history(copies, str(tmp_path / "h"), "2026-01-01")
        assert len(list((tmp_path / "h").rglob("*.parquet"))) > 1
        assert lake.read_lake(spark, str(tmp_path / "h")).count() == 20000
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_versions(spark, tmp_path):
    root = str(tmp_path / "t")
    assert lake.read_latest(spark, root) is None
    for n in (1, 2):
        assert lake.write_version(spark.range(n), root).endswith(f"v{n}")
    (tmp_path / "t" / "v3").mkdir()
    assert lake.read_latest(spark, root).count() == 2
    # a reader of the old version is not disturbed
    old = spark.read.parquet(f"{root}/v1")
    lake.write_version(spark.range(9), root)
    assert old.count() == 1 and lake.read_latest(spark, root).count() == 9
    lake.drop_versions(spark, root, keep=1)
    assert lake.read_latest(spark, root).count() == 9 and not (tmp_path / "t" / "v2").exists()
    with pytest.raises(ValueError):
        lake.drop_versions(spark, root, keep=0)


def test_append_by_name(spark, tmp_path):
    path = str(tmp_path / "t")
    lake.append(spark.sql("SELECT 1 AS a, 'x' AS b"), path)
    lake.append(spark.sql("SELECT 'y' AS b, 2 AS a"), path)
    assert rows(spark.read.parquet(path), "a", "b") == [(1, "x"), (2, "y")]


def test_extract_range(three_days):
    cols = ["facility_code", "product_id", "inspection_end_ymdhms"]
    ends = ("2026-01-01 05:00:00", "2026-02-01 00:00:00")

    def count(*args, **kwargs):
        return extract.extract_range(three_days, *args, **kwargs).count()

    assert count(cols, cols[2], *ends) == 3
    assert count(cols, cols[2], *ends, half_open=True) == 2
    assert count(cols, cols[2], *ends, facility="B2T") == 0
    assert count(cols[1:], cols[2], *ends, facility="B2T") == 3
    with pytest.raises(ValueError):
        count([], cols[2], *ends)


def test_time_slices_cover_the_range(spark):
    a, b = dt.datetime(2026, 1, 1), dt.datetime(2026, 1, 2)
    slices = extract.time_slices("t", a, b, 7)
    df = spark.range(0, 86401, 600).select((F.lit("2026-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs="id")).alias("t"))
    hits = sum((F.expr(s).cast("int") for s in slices), F.lit(0))
    assert rows(df.select(hits.alias("n")).distinct()) == [(1,)]
    assert extract.time_slices("t", a, b, 1, half_open=True) == [f"t >= '{a}' AND t < '{b}'"]
    with pytest.raises(ValueError):
        extract.time_slices("t", b, a, 2)


def test_incremental(history):
    h = history([(f"P{n}", "1", "L", t) for n, t in enumerate(["2026-01-01T00:00:00", "2026-01-01T00:00:01", "2026-01-05T00:00:00", "2026-03-01T00:00:00"])])
    now = at("2026-01-31T00:00:00")
    ts = "move_in_ymdhms"
    assert rows(extract.incremental(h, ts, at("2026-01-01T00:00:00"), now), "product_id") == [("P1",), ("P2",)]
    late = h.withColumn(ts, F.expr("move_in_ymdhms + INTERVAL 0.5 SECOND"))
    assert extract.incremental(late, ts, at("2026-01-01T00:00:00"), now).count() == 3
    assert extract.incremental(h, ts, None, now).count() == 3
    assert extract.incremental(h, ts, None, now, first_days=27).count() == 1
    other = h.withColumn("facility_code", F.lit("B2T"))
    both = h.unionByName(other)
    marks = extract.facility_marks(h.where(F.col(ts) < "2026-01-02"), ts)
    assert marks == {"A1T": at("2026-01-01T00:00:01")}
    got = extract.incremental_by_facility(both, ts, marks, now)
    assert rows(got, "facility_code", "product_id") == [("A1T", "P2"), ("B2T", "P0"), ("B2T", "P1"), ("B2T", "P2")]


def test_csv_exports(spark, tmp_path):
    glass = spark.createDataFrame([("P", "L", "2026-01-01", 3, "Target")], "product_id string, lot_id string, work_date string, total_defects long, group_type string")
    export.glass_csv(glass, str(tmp_path / "g"))
    assert rows(spark.read.csv(str(tmp_path / "g"), header=True)) == [("P", "L", "2026-01-01", "3", "Target")]
    ranking = spark.createDataFrame(
        [(1, "E", "P", "M", 0.123456789, -0.5, 4, 10)],
        "rank long, equipment_line_id string, process_code string, product_type_code string, defect_rate double, delta_loo double, total_defects long, product_count long",
    )
    export.ranking_csv(ranking, str(tmp_path / "r"))
    back = spark.read.csv(str(tmp_path / "r"), header=True)
    assert back.columns == list(export.RANKING_HEADINGS.values())
    assert tuple(back.first()) == ("1", "E", "P", "M", "12.3457%", "-50.0000%", "4", "10")


def test_grids(spark, tmp_path):
    text = {"MODEL_X": {"x_list": ["A", "B"], "y_list": ["1"]}, "NEW_MODEL": {"x_list": [], "y_list": []}}
    (tmp_path / "grid.json").write_text(json.dumps(text, indent=2))
    assert rows(export.read_grids(spark, str(tmp_path / "grid.json"))) == [("MODEL_X", ["A", "B"], ["1"]), ("NEW_MODEL", [], [])]


def test_daily_batch_twice_is_once(spark, history, inspection, tmp_path):
    h = history([("P1M1001", "1000", "A1CVD000", "2026-01-01T00:00:00")]).withColumn("model_code", F.lit("M1"))
    i = inspection([("P1M1001", "1000", f"P1M1001A{n}", "SPOT", DAYS[n % 2]) for n in range(4)])
    root = str(tmp_path / "mart")
    for _ in range(2):
        daily.refresh_mart(i, h, root, ["2026-01-01", "2026-01-02"], "A1T")
        daily.refresh_masters(i, h, str(tmp_path), "2026-01-01")
    assert spark.read.parquet(root).agg(F.sum("total_defects"), F.count("*")).first() == (4, 2)
    assert rows(lake.read_latest(spark, f"{tmp_path}/model_master"), "model_code") == [("M1",)]
    assert rows(lake.read_latest(spark, f"{tmp_path}/defect_master"), "defect_name") == [("SPOT",)]
    parts = spark.createDataFrame([("M1", "a")], "model_code string, part_no_name string")
    maps = spark.createDataFrame([("a", ["A1"])], "part_no_name string, ref_panels array<string>")
    for _ in range(2):
        daily.refresh_layouts(parts, maps, f"{tmp_path}/layouts")
    assert rows(lake.read_latest(spark, f"{tmp_path}/layouts"), "model_code", "ref_panels") == [("M1", ["A1"])]


def test_one_facility_leaves_the_other_alone(spark, history, inspection, tmp_path):
    """Facilities share days; a day without rows is cleared for its facility only."""
    root = str(tmp_path / "mart")
    h = history([("P1M1001", "1000", "A1CVD000", "2026-01-01T00:00:00")])
    i = inspection([("P1M1001", "1000", f"P1M1001A{n}", "SPOT", DAYS[n % 2]) for n in range(4)])
    both_h, both_i = (df.unionByName(df.withColumn("facility_code", F.lit("02"))) for df in (h, i))
    days = ["2026-01-01", "2026-01-02"]
    for facility in ("A1T", "02", "A1T"):
        daily.refresh_mart(both_i, both_h, root, days, facility)
    assert lake.read_mart(spark, root).count() == 4
    daily.refresh_mart(both_i.where("facility_code = '02'"), both_h, root, ["2026-01-02"], "A1T")
    assert rows(lake.read_mart(spark, root), "facility_code", "stat_date", "equipment_line_id") == [
        ("02", dt.date(2026, 1, 1), "A1CVD000"), ("02", dt.date(2026, 1, 2), "A1CVD000"), ("A1T", dt.date(2026, 1, 1), "A1CVD000"),
    ]
    assert len(lake.expire_days(spark, root, 1, "2026-01-03")) == 2
    assert lake.read_mart(spark, root).count() == 1
    with pytest.raises(ValueError):
        daily.refresh_mart(both_i, both_h, root, [], "A1T")


def test_day_folders_expire(spark, three_days, tmp_path):
    root = str(tmp_path / "lake")
    lake.write_inspection(three_days, root)
    assert len(lake.expire_days(spark, root, 30, "2026-02-01")) == 1
    assert rows(lake.read_inspection(spark, root), "day") == [(1,), (2,)]
    with pytest.raises(ValueError):
        lake.expire_days(spark, root, 0, "2026-02-01")


def test_accumulated_totals_replace_their_folders_only(spark, tmp_path):
    schema = "facility_code string, product_id string, defect_name string, work_time string, total_defects long, panel_map array<long>, panel_addrs array<string>"
    root = str(tmp_path / "totals")
    for n in range(3):
        daily.accumulate(spark.createDataFrame([("01", f"P{k}", "D", f"t{n}", 1, [1], ["A1"]) for k in range(n, n + 4)], schema), root, f"load {n}", buckets=5)
    got = rows(daily.read_totals(spark, root), "product_id", "work_time", "total_defects", "panel_map")
    assert got == [(f"P{k}", f"t{max(0, k - 3)}", n, [n]) for k, n in enumerate([1, 2, 3, 3, 2, 1])]


def test_a_load_is_added_once_to_each_folder(spark, tmp_path):
    schema = "facility_code string, product_id string, defect_name string, work_time string, total_defects long, panel_map array<long>, panel_addrs array<string>"
    root = str(tmp_path / "totals")
    load = spark.createDataFrame([("01", f"P{k}", "D", "t", 1, [1], ["A1"]) for k in range(12)], schema)
    part = daily.accumulate(load.where("product_id IN ('P0', 'P1')"), root, "monday", buckets=5)
    rest = daily.accumulate(load.where(~daily.hash_bucket("product_id", 5).isin(part)), root, "monday", buckets=5)
    assert part and rest and not set(part) & set(rest)
    assert daily.accumulate(load, root, "monday", buckets=5) == []
    once = rows(daily.read_totals(spark, root), "product_id", "total_defects", "panel_map")
    assert daily.accumulate(load, root, "tuesday", buckets=5) == sorted({*part, *rest})
    twice = rows(daily.read_totals(spark, root), "product_id", "total_defects", "panel_map")
    assert {n for _, n, _ in once} == {1} and {x[0]: x[1] for x in twice} == {f"P{k}": 1 + any(f"P{k}" == x[0] for x in once) for k in range(12)}
    assert daily.applied_loads(spark, root).count() == 2 * len({*part, *rest})
    assert daily.accumulate(load.limit(0), root, "nothing", buckets=5) == []


def test_intermediate_tables_go_to_the_shared_folder(spark):
    root = scratch_root(spark)
    assert root == spark.conf.get("spark.checkpoint.dir", root)
    df = settle(spark.range(5), "numbers")
    assert df.count() == 5 and all(root in f for f in df.inputFiles())
    path = df.inputFiles()[0]
    assert release(spark) > 0 and release(spark) == 0
    with pytest.raises(Exception):
        spark.read.parquet(path)


class Session:
    """Only what scratch_root asks of a session."""

    def __init__(self, master, folder=None):
        self.sparkContext, self.conf, self.master = self, self, master
        self.folder = folder

    def get(self, key, default):
        return self.folder or default

    def getCheckpointDir(self):
        return getattr(self, "chosen", None)

    def setCheckpointDir(self, folder):
        self.chosen = folder


def test_a_cluster_has_to_name_its_shared_folder():
    assert scratch_root(Session("yarn", "/shared/tmp/")) == "/shared/tmp"
    with pytest.raises(RuntimeError):
        scratch_root(Session("yarn"))
    chosen = Session("yarn")
    chosen.setCheckpointDir("/shared/other")
    assert scratch_root(chosen) == "/shared/other"
    local = Session("local[2]")
    assert scratch_root(local) == scratch_root(local)


def test_marks_of_loads_read_no_older_load(spark, history, tmp_path):
    root, ts = str(tmp_path / "loads"), "move_in_ymdhms"
    assert loads.marks(spark, root, ts).count() == 0
    for n in range(1, 4):
        rows_ = [(f"P{n}{k}", "1000", "A1CVD000", f"2026-01-0{n}T0{k}:00:00") for k in range(n)]
        loads.write_load(history(rows_), root, f"day-{n}", ts)
    marks = loads.marks(spark, root, ts)
    assert rows(marks) == [("A1T", 6, at("2026-01-03T02:00:00"))]
    assert all(loads.MARKS in f for f in marks.inputFiles())
    # an older load whose files are gone does not matter, one that was not recorded is read, one written again counts once
    source = history([("P9", "1000", "A1CVD000", "2026-01-03T02:00:00"), ("P9", "2000", "A1CVD000", "2026-01-04T00:00:00")])
    delete(spark, f"{root}/{loads.MARKS}/load=day-3")
    assert loads.record(spark, root, ts) == ["day-3"] and loads.record(spark, root, ts) == []
    loads.write_load(history([("P1", "1000", "A1CVD000", "2026-01-01T00:00:00")]), root, "day-1", ts)
    assert rows(loads.marks(spark, root, ts)) == [("A1T", 6, at("2026-01-03T02:00:00"))]
    fresh = loads.new_rows(source, root, ts, at("2026-02-01T00:00:00"))
    assert rows(fresh, "process_code") == [("2000",)]
    assert loads.read_loads(spark, root).count() == 6
    with pytest.raises(ValueError):
        loads.write_load(source, root, "a/b", ts)
