"""Streaming jobs give what the batch operators give."""

import pytest
from conftest import at, rows
from pyspark.sql import functions as F

from panelscope.operators.mart import build_glass_stats
from panelscope.session import delete
from panelscope.sources.lake import read_mart
from panelscope.streaming import jobs

EVENTS = "id long, ts timestamp_ntz, kind string, value double"


@pytest.fixture
def paths(tmp_path):
    return str(tmp_path / "table"), str(tmp_path / "checkpoint")


def write(spark, path, data, schema=EVENTS):
    spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(path)


def test_increments_are_read_once(spark, tmp_path, paths):
    source = str(tmp_path / "source")
    for n in range(3):
        write(spark, source, [(n, at("2026-01-01T00:00:00"), "a", 1.0)])
        stream = jobs.file_source(spark, source, spark.read.parquet(source).schema)
        jobs.increments(stream, *paths).awaitTermination()
        assert rows(spark.read.parquet(paths[0]), "id") == [(k,) for k in range(n + 1)]


def test_streamed_mart_equals_batch(spark, history, inspection, tmp_path, paths):
    h = history([("P1M1001", "1000", "A1CVD000", "2026-01-01T00:00:00")])
    i = inspection([("P1M1001", "1000", f"P1M1001{'AB'[n % 2]}{n % 3}", "SPOT", f"2026-01-0{n % 2 + 1}T0{n}:00:00") for n in range(9)])
    source = str(tmp_path / "source")
    for n in range(5):  # five files, whatever the number of cores
        i.where(F.floor(F.hour("inspection_end_ymdhms") / 2) == n).coalesce(1).write.mode("append").parquet(source)
    counts, mart = (str(tmp_path / n) for n in ("counts", "mart"))

    def run():
        jobs.mart_stream(jobs.file_source(spark, source, i.schema, max_files=2), h, counts, mart, paths[1]).awaitTermination()
        return rows(read_mart(spark, mart), *want.columns)

    want = build_glass_stats(i, h).drop("created_at")
    assert run() == rows(want)
    assert spark.read.parquet(counts).select("batch_id").distinct().count() == 3
    # a batch that is run again, and a later increment
    delete(spark, f"{paths[1]}/commits/2")
    assert run() == rows(want)
    more = inspection([("P1M1001", "1000", "P1M1001A0", "SPOT", "2026-01-02T23:00:00")])
    more.write.mode("append").parquet(source)
    want = build_glass_stats(i.unionByName(more), h).drop("created_at")
    assert run() == rows(want)


def test_merged_counts_survive_retries_and_stay_few(spark, history, inspection, tmp_path, paths):
    h = history([("P1M1001", "1000", "A1CVD000", "2026-01-01T00:00:00")])
    i = inspection([("P1M1001", "1000", f"P1M1001{'AB'[n % 2]}{n % 3}", "SPOT", f"2026-01-0{n % 2 + 1}T0{n}:00:00") for n in range(9)])
    source, counts, mart = (str(tmp_path / n) for n in ("source", "counts", "mart"))
    for n in range(9):
        i.where(F.hour("inspection_end_ymdhms") == n).coalesce(1).write.mode("append").parquet(source)

    def run():
        src = jobs.file_source(spark, source, i.schema, max_files=1)
        jobs.mart_stream(src, h, counts, mart, paths[1], merge_every=3).awaitTermination()
        return rows(read_mart(spark, mart), *want.columns)

    want = build_glass_stats(i, h).drop("created_at")
    assert run() == rows(want)
    left = spark.read.parquet(counts).select("batch_id").distinct()
    assert rows(left) == [(6,), (7,), (8,)] and jobs._merged(spark, counts) == [5]
    # the last batch again; then a merge that stops before it has removed anything
    delete(spark, f"{paths[1]}/commits/8")
    assert run() == rows(want)
    jobs.merged_counts(spark, counts, upto=7).write.partitionBy("stat_date").parquet(f"{counts}/{jobs.MERGED}/upto=7")
    assert rows(jobs.merged_counts(spark, counts).agg(F.sum("addr_count"))) == [(9,)]
    jobs.merge_counts(spark, counts, 7)
    assert rows(spark.read.parquet(counts).select("batch_id").distinct()) == [(8,)] and jobs._merged(spark, counts) == [7]
    assert rows(jobs.merged_counts(spark, counts, ["2026-01-01"]).agg(F.sum("addr_count"))) == [(5,)]


def test_retried_batch_replaces_its_rows(spark, tmp_path):
    write_batch = jobs._batches_to(str(tmp_path / "t"), lambda batch: batch)
    for _ in range(2):
        write_batch(spark.range(3), 0)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3


def days(n):
    return [(k, at(f"2026-01-{k % 10 + 1:02d}T{k % 24:02d}:00:00"), "ab"[k % 2], float(k)) for k in range(n)]


def test_trend_of_every_day_and_of_final_days(spark, tmp_path, paths):
    source = str(tmp_path / "source")
    data = sorted(days(60), key=lambda r: r[1])
    write(spark, source, data[:30])
    write(spark, source, data[30:])
    df = spark.read.parquet(source)
    stream = jobs.file_source(spark, source, df.schema, max_files=1)
    keys = ["kind"]
    jobs.trend_stream(stream, *paths, "ts", keys, "value").awaitTermination()
    batch = df.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("work_date"), "kind").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    assert rows(jobs.current_trend(spark, paths[0], keys)) == rows(batch)
    final = tuple(p + "2" for p in paths)
    jobs.trend_stream(stream, *final, "ts", keys, "value", mode="append").awaitTermination()
    newest = df.agg(F.max("ts")).first()[0]
    done = batch.where(F.col("work_date").cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY") <= F.lit(str(newest)).cast("timestamp_ntz") - F.expr("INTERVAL 2 DAYS"))
    assert 0 < done.count() < batch.count()
    assert rows(spark.read.parquet(final[0])) == rows(done)


@pytest.mark.parametrize("salts", [1, 16])
def test_copies_are_dropped(spark, tmp_path, paths, salts):
    source = str(tmp_path / "source")
    hot = [(7, at("2026-01-03T07:00:00"), "a", 7.0)] * 400
    for _ in range(2):
        write(spark, source, days(20) + hot)
    schema = spark.read.parquet(source).schema
    stream = jobs.file_source(spark, source, schema, max_files=1)
    rows_ = jobs.deduplicated(stream, "ts", ["id"], salts=salts)
    writer = rows_.writeStream.format("parquet").option("checkpointLocation", paths[1]).trigger(availableNow=True)
    writer.start(paths[0]).awaitTermination()
    got = spark.read.parquet(paths[0])
    assert got.columns == ["id", "ts", "kind", "value"]
    assert rows(got, "id") == [(k,) for k in sorted(range(20), key=lambda k: repr((k,)))]


def test_late_rows_go_beside_the_others(spark, tmp_path, paths):
    source = str(tmp_path / "source")
    parts = [
        [(1, at("2026-01-10T12:00:00"), "a", 1.0), (2, None, "a", 1.0)],
        # the 10th at noon minus two days closes the 7th but not the 8th
        [(3, at("2026-01-07T23:00:00"), "a", 1.0), (4, at("2026-01-08T01:00:00"), "b", 1.0), (5, at("2026-01-20T00:00:00"), "a", 1.0)],
        [(6, at("2026-01-17T23:59:59"), "b", 2.0), (7, at("2026-01-18T00:00:00"), "b", 1.0), (8, None, None, None)],
    ]

    def run():
        src = jobs.file_source(spark, source, schema)
        jobs.split_late_stream(src, *paths, "ts").awaitTermination()
        return rows(jobs.split_rows(spark, paths[0], schema), "id", "late")

    for part in parts:  # each run goes on after a restart
        write(spark, source, part)
        schema = spark.read.parquet(source).schema
        found = run()
    want = [(n, n in (3, 6)) for n in range(1, 9)]
    assert found == want
    for batch in (2, 1):
        delete(spark, f"{paths[1]}/commits/{batch}")
    assert run() == want  # batches that are run again split as before
    late = jobs.split_rows(spark, paths[0], schema, late=True)
    trend = jobs.with_late_rows(spark.createDataFrame([("2026-01-07", "a", 2, 5.0)], "work_date string, kind string, n long, total double"), late, "ts", ["kind"], "value")
    assert rows(trend) == [("2026-01-07", "a", 3, 6.0), ("2026-01-17", "b", 1, 2.0)]


def test_copies_are_dropped_after_a_restart_with_state_in_rocksdb(spark, tmp_path, paths):
    session, source = spark.newSession(), str(tmp_path / "source")
    jobs.rocksdb_state(session)
    for n in range(3):
        write(session, source, [(k, at("2026-01-01T00:00:00"), "a", 1.0) for k in range(n + 2)] * 2)
        src = jobs.file_source(session, source, session.read.parquet(source).schema)
        jobs.dedup_stream(src, *paths, "ts", ["id"]).awaitTermination()
        assert rows(session.read.parquet(paths[0]), "id") == [(k,) for k in range(n + 2)]
    changes = [f for f in (tmp_path / "checkpoint" / "state").rglob("*.changelog")]
    assert changes
