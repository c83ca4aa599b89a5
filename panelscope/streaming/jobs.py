"""Structured Streaming jobs: incremental load, mart upkeep, trends and duplicate removal.

Every job reads what is new since its checkpoint and stops (``availableNow``) unless another trigger
is given, so it can be run on a timer or left running.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from panelscope.operators.mart import glass_defects, panel_counts, steps_of, with_steps
from panelscope.session import exists, settle
from panelscope.sources.lake import write_mart_days

# Folder of merged counts; Spark's readers skip names that begin with an underscore.
MERGED = "_merged"
AVAILABLE_NOW = {"availableNow": True}
# Least size of a task in upkeep.  Its time goes into files of days, so a batch under Spark's 1 MB a task is dealt over the cores as well.
SMALL_TASKS = ("spark.sql.adaptive.coalescePartitions.minPartitionSize", "4k")


def file_source(
    spark: SparkSession, root: str, schema: T.StructType, glob: str = "*.parquet", max_files: int = 0
) -> DataFrame:
    """Parquet files of a folder as a stream; each file is read once."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(root)


def event_time(df: DataFrame, ts: str) -> DataFrame:
    """Watermarks need a TIMESTAMP; times without zone are read in the session zone."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def _batches_to(path: str, make: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """foreachBatch body that writes ``make(batch)`` to a folder of its own.

    A batch that is retried after a failure overwrites what it wrote before.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        make(batch).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def increments(src: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append new source rows to a table, exactly once."""
    writer = src.writeStream.format("parquet").option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or AVAILABLE_NOW)).start(path)


def mart_stream(
    src: DataFrame, h: DataFrame, counts: str, mart: str, checkpoint: str, trigger: dict | None = None, merge_every: int = 0
) -> StreamingQuery:
    """Keep the day-keyed mart of cleaned inspection rows current.

    A batch is aggregated to counts per facility, day, product, defect and panel, which are written to a folder of
    the batch by day.  Then the mart rows of the days it touched are built from the counts of all
    batches for these days and replace what the mart has of them; of the history only the steps of their products are
    shuffled.  A batch that is retried overwrites its own counts and builds the same rows again.  With ``merge_every``, every so many
    batches the counts of all batches before are merged, see ``merge_counts``.
    """

    def upkeep(batch: DataFrame, batch_id: int) -> None:
        spark, own = batch.sparkSession, f"{counts}/batch_id={batch_id}"
        spark.conf.set(*SMALL_TASKS)  # the stream has a session of its own
        _by_day(panel_counts(batch)).write.mode("overwrite").partitionBy("stat_date").parquet(own)
        days = _days_of(spark, own)
        if days:
            touched = settle(merged_counts(spark, counts, days), "touched")
            steps = steps_of(h, touched)
            write_mart_days(with_steps(glass_defects(touched), steps).withColumn("created_at", F.current_timestamp()), mart)
        if merge_every and batch_id and batch_id % merge_every == 0:
            merge_counts(spark, counts, batch_id - 1)  # those before this one are committed

    writer = src.writeStream.option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or AVAILABLE_NOW)).foreachBatch(upkeep).start()


def _days_of(spark: SparkSession, path: str) -> list[str]:
    """Days that a table by day has folders of."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    names = [s.getPath().getName() for s in folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)]
    return sorted(d for n in names if (d := n.removeprefix("stat_date=")) != n and d[:1].isdigit())


def _by_day(counts: DataFrame) -> DataFrame:
    """Rows of a day together, so that a folder gets a file per share of its size instead of one from every task."""
    return counts.hint("rebalance", F.col("stat_date"))


_COUNTS = (
    "facility_code string, product_id string, defect_name string, model_code string, panel_addr string, addr_count long, "
    "inspection_time timestamp_ntz, batch_id long, stat_date date"
)


def _merged(spark: SparkSession, path: str) -> list[int]:
    """Complete merged states: the last batch in each, oldest first."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/{MERGED}")
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    found = [s.getPath() for s in fs.listStatus(folder)]
    done = [p.getName() for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(name.removeprefix("upto=")) for name in done)


def merge_counts(spark: SparkSession, path: str, upto: int) -> None:
    """Merge the counts of all batches up to a committed one into one state, by day.

    The state is written beside the batches and counts once it is complete; from then on readers skip the batches in it, so
    one that is retried after all is not counted twice.  Then batches and states that nobody reads are removed; a run that
    stops before that leaves them to the next.
    """
    if max(_merged(spark, path), default=-1) < upto:
        _by_day(merged_counts(spark, path, upto=upto)).write.mode("overwrite").partitionBy("stat_date").parquet(f"{path}/{MERGED}/upto={upto}")
    newest = max(_merged(spark, path))
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = [(s.getPath(), "batch_id=") for s in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/batch_id=*"))]
    old += [(s.getPath(), "upto=") for s in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/{MERGED}/upto=*"))]
    for folder, prefix in old:
        number = int(folder.getName().removeprefix(prefix))
        if number < newest or (number == newest and prefix == "batch_id="):
            fs.delete(folder, True)


def merged_counts(spark: SparkSession, path: str, days: Sequence = (), upto: int | None = None) -> DataFrame:
    """Panel counts of all batches added up, of some days or all; only the folders of these days are read.

    ``upto`` leaves later batches out.
    """
    keys = ["facility_code", "stat_date", "product_id", "defect_name", "model_code", "panel_addr"]
    base = max((n for n in _merged(spark, path) if upto is None or n <= upto), default=-1)
    rows = spark.read.schema(_COUNTS).option("basePath", path).parquet(path)
    rows = rows.where(F.col("batch_id") > base) if base >= 0 else rows
    rows = rows if upto is None else rows.where(F.col("batch_id") <= upto)
    if base >= 0:
        state = spark.read.schema(_COUNTS).parquet(f"{path}/{MERGED}/upto={base}")
        rows = rows.drop("batch_id").unionByName(state.drop("batch_id"))
    rows = rows.where(F.col("stat_date").isin([F.lit(str(d)).cast("date") for d in days])) if days else rows
    sums = (F.sum("addr_count").alias("addr_count"), F.max("inspection_time").alias("inspection_time"))
    return rows.groupBy(*keys).agg(*sums)


# Folder with the newest time seen up to each batch.
SEEN = "_seen"


def rocksdb_state(spark: SparkSession) -> None:
    """Keep the state of streaming queries that start from now on in RocksDB instead of executor memory.

    State may then be larger than memory; a batch checkpoints its changes only.  A query goes on with
    the store it was first started with.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def split_late_stream(
    src: DataFrame, path: str, checkpoint: str, ts: str, delay: str = "2 days", trigger: dict | None = None
) -> StreamingQuery:
    """Write rows in folders by batch and by whether they are late, so that none is lost.

    A row is late if its day ended ``delay`` or more before the newest time of all earlier batches: from then on a trend
    with this watermark has closed its day.  Rows without a time are on time.  A batch is written in one pass and the
    newest time is read from what it wrote; a batch that is retried compares with the batches before it only and
    overwrites what it wrote.
    """

    def split(batch: DataFrame, batch_id: int) -> None:
        spark, own = batch.sparkSession, f"{path}/batch_id={batch_id}"
        before = _seen(spark, path, batch_id)
        late = F.lit(False)
        if before is not None:
            day_end = F.date_trunc("day", F.col(ts)) + F.expr("interval 1 day")
            closed = F.lit(str(before)).cast("timestamp_ntz") - F.expr(f"interval {delay}")
            late = F.coalesce(day_end.cast("timestamp_ntz") <= closed, F.lit(False))
        batch.withColumn("late", late).write.mode("overwrite").partitionBy("late").parquet(own)
        newest = spark.read.schema(batch.schema).parquet(own).agg(F.max(F.col(ts).cast("timestamp_ntz")).alias("newest"))
        newest.write.mode("overwrite").parquet(f"{path}/{SEEN}/batch_id={batch_id}")

    writer = src.writeStream.option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or AVAILABLE_NOW)).foreachBatch(split).start()


def _seen(spark: SparkSession, path: str, batch_id: int):
    """Newest time of the batches before this one; None if there is none."""
    if not exists(spark, f"{path}/{SEEN}"):
        return None
    seen = spark.read.schema("newest timestamp_ntz, batch_id long").parquet(f"{path}/{SEEN}")
    return seen.where(F.col("batch_id") < batch_id).agg(F.max("newest")).first()[0]


def split_rows(spark: SparkSession, path: str, schema: T.StructType, late: bool | None = None) -> DataFrame:
    """What ``split_late_stream`` wrote: the rows on time, the late ones, or both with a column that says which."""
    folders = T.StructType([*schema.fields, T.StructField("late", T.BooleanType()), T.StructField("batch_id", T.LongType())])
    rows = spark.read.schema(folders).option("basePath", path).parquet(path).drop("batch_id")
    return rows if late is None else rows.where(F.col("late") == late).drop("late")


def with_late_rows(final: DataFrame, late: DataFrame, ts: str, keys: Sequence[str], value: str | None = None) -> DataFrame:
    """A trend of closed days with the late rows added to it."""
    columns = ["work_date", *keys]
    sums = [F.sum(value).alias("total")] if value else []
    more = late.groupBy(F.date_format(ts, "yyyy-MM-dd").alias("work_date"), *keys).agg(F.count("*").alias("n"), *sums)
    names = ["n", *(["total"] if value else [])]
    both = final.select(*columns, *names).unionByName(more.select(*columns, *names))
    return both.groupBy(*columns).agg(*[F.sum(c).alias(c) for c in names])


def daily_trend(
    src: DataFrame, ts: str, keys: Sequence[str], value: str | None = None, watermark: str = "2 days"
) -> DataFrame:
    """Rows (and sum of a value) per day and key; days older than the watermark are final."""
    sums = [F.sum(value).alias("total")] if value else []
    day = F.date_format(F.col("window.start"), "yyyy-MM-dd").alias("work_date")
    return (
        event_time(src, ts)
        .withWatermark(ts, watermark)
        .groupBy(F.window(ts, "1 day"), *keys)
        .agg(F.count("*").alias("n"), *sums)
        .select(day, *keys, "n", *[c for c in (["total"] if value else [])])
    )


def trend_stream(
    src: DataFrame,
    path: str,
    checkpoint: str,
    ts: str,
    keys: Sequence[str],
    value: str | None = None,
    watermark: str = "2 days",
    mode: str = "update",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Write the daily trend: ``append`` gives final days only, ``update`` every changed day."""
    writer = daily_trend(src, ts, keys, value, watermark).writeStream.outputMode(mode)
    writer = writer.option("checkpointLocation", checkpoint).trigger(**(trigger or AVAILABLE_NOW))
    if mode == "append":
        return writer.format("parquet").start(path)
    return writer.foreachBatch(_batches_to(path, lambda batch: batch)).start()


def current_trend(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Newest version of each day and key written in update mode."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in ("work_date", "batch_id", *keys)]
    newest = F.max_by(F.struct(*values), "batch_id").alias("_v")
    return rows.groupBy("work_date", *keys).agg(newest).select("work_date", *keys, "_v.*")


def deduplicated(
    src: DataFrame, ts: str, key: Sequence[str], watermark: str = "2 days", salts: int = 16
) -> DataFrame:
    """First copy of each key; later copies within the watermark are dropped.

    Copies are first dropped per key and salt, so that a key with very many copies is spread over
    several tasks and only one copy per salt meets in one task.
    """
    key = list(key)
    rows = event_time(src, ts).withWatermark(ts, watermark)
    if salts > 1:
        salted = rows.withColumn("_salt", F.floor(F.rand(0) * salts).cast("int"))
        rows = salted.dropDuplicatesWithinWatermark([*key, "_salt"]).drop("_salt")
    return rows.dropDuplicatesWithinWatermark(key)


def dedup_stream(
    src: DataFrame,
    path: str,
    checkpoint: str,
    ts: str,
    key: Sequence[str],
    watermark: str = "2 days",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Append rows to a table, dropping copies of a key that arrive within the watermark."""
    writer = deduplicated(src, ts, key, watermark).writeStream.format("parquet")
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or AVAILABLE_NOW)).start(path)
