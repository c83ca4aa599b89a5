"""Streaming queries: each job runs until its input is used up, then its table is read."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelscope.catalog.marts import MART_COLUMNS
from panelscope.catalog.registry import listed, query
from panelscope.catalog.views import facts, table, with_mart
from panelscope.session import delete, scratch_path
from panelscope.sources.lake import read_mart
from panelscope.streaming import jobs


def _events(spark, sf):
    return jobs.file_source(spark, sf, table(spark, sf, "events").schema, "events.parquet")


def _paths(spark, name):
    root = scratch_path(spark, name)
    return f"{root}/table", f"{root}/checkpoint"


@query(
    "streamed_increments",
    "SELECT event_type, COUNT(*) AS n, ROUND(SUM(value), 2) AS total FROM events GROUP BY ALL",
)
def streamed_increments(spark, sf):
    path, checkpoint = _paths(spark, "increments")
    # the second run finds nothing new
    for _ in range(2):
        jobs.increments(_events(spark, sf), path, checkpoint).awaitTermination()
    rows = spark.read.parquet(path)
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("streamed_mart", with_mart(f"SELECT {MART_COLUMNS} FROM glass_stats"))
def streamed_mart(spark, sf):
    """Two increments, and the second one once more as after a lost checkpoint."""
    source, (counts, checkpoint), root = scratch_path(spark, "inspection"), _paths(spark, "mart"), scratch_path(spark, "mart")
    h, rows = facts(spark, sf)
    early = F.col("inspection_end_ymdhms") < "1998-01-01"
    for part in (early, ~early):
        rows.where(part).write.mode("append").parquet(source)
        stream = jobs.file_source(spark, source, rows.schema)
        jobs.mart_stream(stream, h, counts, root, checkpoint).awaitTermination()
    delete(spark, f"{checkpoint}/commits/1")
    jobs.mart_stream(jobs.file_source(spark, source, rows.schema), h, counts, root, checkpoint).awaitTermination()
    return listed(read_mart(spark, root).drop("created_at"), "panel_map", "panel_addrs")


DAILY = """SELECT strftime(ts, '%Y-%m-%d') AS work_date, event_type, COUNT(*) AS n, ROUND(SUM(value), 2) AS total
  FROM events GROUP BY ALL"""


@query("streamed_trend", DAILY)
def streamed_trend(spark, sf):
    path, checkpoint = _paths(spark, "trend")
    keys = ["event_type"]
    jobs.trend_stream(_events(spark, sf), path, checkpoint, "ts", keys, "value").awaitTermination()
    return jobs.current_trend(spark, path, keys).withColumn("total", F.round("total", 2))


@query(
    "streamed_final_days",
    f"""SELECT * FROM ({DAILY})
        WHERE CAST(work_date AS TIMESTAMP) + INTERVAL 1 DAY <= (SELECT MAX(ts) - INTERVAL 2 DAY FROM events)""",
)
def streamed_final_days(spark, sf):
    path, checkpoint = _paths(spark, "final")
    jobs.trend_stream(
        _events(spark, sf), path, checkpoint, "ts", ["event_type"], "value", mode="append"
    ).awaitTermination()
    return spark.read.parquet(path).withColumn("total", F.round("total", 2))


@query(
    "streamed_without_copies",
    "SELECT event_type, COUNT(*) AS n, COUNT(DISTINCT event_id) AS ids FROM events GROUP BY ALL",
)
def streamed_without_copies(spark, sf):
    source, (path, checkpoint) = scratch_path(spark, "events"), _paths(spark, "deduplicated")
    events = table(spark, sf, "events")
    for _ in range(2):
        events.write.mode("append").parquet(source)
    stream = jobs.file_source(spark, source, events.schema)
    jobs.dedup_stream(stream, path, checkpoint, "ts", ["event_id"]).awaitTermination()
    rows = spark.read.parquet(path)
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"))


# two increments, the later half of the time first; the rest is behind the watermark but for its last days
_EVENT_PARTS = """parts AS (SELECT *, ts >= (SELECT MIN(ts) + (MAX(ts) - MIN(ts)) / 2 FROM events) AS first FROM events),
  closed AS (SELECT MAX(ts) - INTERVAL 2 DAY AS mark FROM parts WHERE first)"""


def _late_first(spark, sf, name):
    """The table of rows on time and late ones, and the schema of its rows."""
    source, (path, checkpoint) = scratch_path(spark, "events"), _paths(spark, name)
    events = table(spark, sf, "events")
    middle = events.agg((F.min("ts") + (F.max("ts") - F.min("ts")) / 2)).scalar()
    for part in (F.col("ts") >= middle, F.col("ts") < middle):
        events.where(part).write.mode("append").parquet(source)
        jobs.split_late_stream(jobs.file_source(spark, source, events.schema), path, checkpoint, "ts").awaitTermination()
    # the last batch once more, as after a lost checkpoint
    delete(spark, f"{checkpoint}/commits/1")
    jobs.split_late_stream(jobs.file_source(spark, source, events.schema), path, checkpoint, "ts").awaitTermination()
    return path, events.schema


@query(
    "streamed_late_rows",
    f"""WITH {_EVENT_PARTS}
    SELECT event_type, NOT first AND date_trunc('day', ts) + INTERVAL 1 DAY <= mark AS late, COUNT(*) AS n, COUNT(DISTINCT event_id) AS ids
    FROM parts, closed GROUP BY ALL""",
)
def streamed_late_rows(spark, sf):
    rows = jobs.split_rows(spark, *_late_first(spark, sf, "late"))
    return rows.groupBy("event_type", "late").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"))


@query("streamed_trend_with_late_rows", f"SELECT * FROM ({DAILY}) WHERE CAST(work_date AS TIMESTAMP) + INTERVAL 1 DAY <= (SELECT MAX(ts) - INTERVAL 2 DAY FROM events)")
def streamed_trend_with_late_rows(spark, sf):
    """Closed days from the rows on time, and the late rows added to them."""
    split, schema = _late_first(spark, sf, "late-trend")
    path, checkpoint = _paths(spark, "closed")
    keys = ["event_type"]
    on_time = f"{split}/batch_id=*/late=false"
    jobs.trend_stream(jobs.file_source(spark, on_time, schema), path, checkpoint, "ts", keys, "value", mode="append").awaitTermination()
    trend = jobs.with_late_rows(spark.read.parquet(path), jobs.split_rows(spark, split, schema, late=True), "ts", keys, "value")
    return trend.withColumn("total", F.round("total", 2))
