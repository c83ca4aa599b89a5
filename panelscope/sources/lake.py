"""The Parquet lake: facility-partitioned inspection and history tables, and versioned marts."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelscope.functions.clean import hash_bucket
from panelscope.operators.updates import retention_start
from panelscope.schemas import GLASS_STATS, HISTORY, INSPECTION
from panelscope.session import delete

INSPECTION_PARTITIONS = ("facility_code", "year", "month", "day")
HISTORY_PARTITIONS = ("facility_code", "model_code", "bucket_id")
MART_PARTITIONS = ("facility_code", "stat_date")
# Folder names that are codes: they stay text, whatever they look like.
TEXT_FOLDERS = ("facility_code", "model_code", "bucket_id", "load_day")


def read_lake(spark: SparkSession, root: str, schema: T.StructType | None = None) -> DataFrame:
    """All Parquet files below ``root`` with their partition columns, merged by column name.

    Merging opens every file footer; with a declared schema nothing but the file list is read and
    columns a file lacks are NULL.  Codes in folder names are text, so a facility ``01`` stays ``01``.
    """
    return _read(spark, root, root, schema)


def _read(spark: SparkSession, root: str, path: str, schema: T.StructType | None, **options: str) -> DataFrame:
    if schema is None:
        schema = spark.read.options(basePath=root, mergeSchema="true", **options).parquet(path).schema
    fields = [T.StructField(f.name, T.StringType() if f.name in TEXT_FOLDERS else f.dataType) for f in schema]
    return spark.read.options(basePath=root, **options).schema(T.StructType(fields)).parquet(path)


def read_inspection(spark: SparkSession, root: str) -> DataFrame:
    """Inspection of the lake by its declared schema."""
    return read_lake(spark, root, INSPECTION)


def read_history(spark: SparkSession, root: str) -> DataFrame:
    """History of the lake by its declared schema."""
    return read_lake(spark, root, HISTORY)


def read_mart(spark: SparkSession, root: str) -> DataFrame:
    """Day-keyed mart by its declared schema."""
    return read_lake(spark, root, GLASS_STATS)


def facility_scan(df: DataFrame, facility: str) -> DataFrame:
    """Rows of one facility; on the lake this prunes to its folder."""
    if not facility:
        raise ValueError("facility is required")
    return df.where(F.col("facility_code") == facility)


def scan_glob(spark: SparkSession, root: str, facility: str, glob: str = "*.parquet") -> DataFrame:
    """Files of one facility whose name matches ``glob``, keeping the partition columns."""
    if not facility:
        raise ValueError("facility is required")
    return _read(spark, root, f"{root}/facility_code={facility}", None, pathGlobFilter=glob)


def _varying(name: str) -> Column:
    """The text column ``name`` in a form that the optimizer does not see as a constant.

    Sorting by a constant is optimized away, after which the writer would sort by folder again and
    lose the order inside the files.
    """
    nothing = F.substring("product_id", 1, 0)
    return F.when(F.col(name).isNotNull(), F.concat_ws("", F.col(name), nothing))


def _spread(df: DataFrame, folders: Sequence[str], order: Sequence[str], tasks: int | None) -> DataFrame:
    """Rows of a folder together and sorted, in a given number of tasks or as the size asks for.

    Rebalancing splits a facility, day, model or bucket that holds most of the rows over many tasks
    and packs small ones together.
    """
    together = df.repartition(tasks, *folders) if tasks else df.hint("rebalance", *[F.col(c) for c in folders])
    return together.sortWithinPartitions(*folders, *order)


def write_inspection(
    df: DataFrame, root: str, ts: str = "inspection_end_ymdhms", tasks: int | None = None
) -> None:
    """Write cleaned inspection rows by facility and day; days present in ``df`` are replaced.

    No rows replace nothing.
    """
    day = {"year": F.year(ts), "month": F.month(ts), "day": F.dayofmonth(ts)}
    df = df.withColumns({**day, "facility_code": _varying("facility_code")})
    rows = _spread(df, INSPECTION_PARTITIONS, ["product_id", ts], tasks)
    replace_partitions(rows, root, INSPECTION_PARTITIONS)


def with_bucket(df: DataFrame, buckets: int = 100) -> DataFrame:
    return df.withColumn("bucket_id", hash_bucket("product_id", buckets))


def write_history(df: DataFrame, root: str, load_day, buckets: int = 100, tasks: int | None = None) -> None:
    """Write the cleaned history rows of one load by facility, model and product hash, sorted by product.

    A load has a folder of its own and replaces what was there, so running a day again changes nothing.
    Sorting gives narrow row-group ranges and the bloom filter serves lookups of one product.
    """
    df = df.withColumn("model_code", F.coalesce("model_code", F.lit("UNKNOWN")))
    folders = {c: _varying(c) for c in ("facility_code", "model_code")}
    rows = with_bucket(df, buckets).withColumns(folders)
    (
        _spread(rows, HISTORY_PARTITIONS, ["product_id", "move_in_ymdhms"], tasks)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "static")
        .option("parquet.bloom.filter.enabled#product_id", "true")
        .option("parquet.bloom.filter.adaptive.enabled", "true")
        # Parquet leaves the filter out of a column that is all dictionary
        .option("parquet.enable.dictionary#product_id", "false")
        .partitionBy(*HISTORY_PARTITIONS)
        .parquet(f"{root}/load_day={str(load_day)[:10]}")
    )


def product_lookup(history: DataFrame, product_id: str, buckets: int = 100) -> DataFrame:
    """History rows of one product; the literal bucket prunes the scan to one folder per model."""
    key = int(hashlib.md5(product_id.encode()).hexdigest(), 16) % buckets
    bucket = F.col("bucket_id").cast("int") == key
    return history.where(bucket & (F.col("product_id") == product_id))


def append(df: DataFrame, path: str) -> None:
    """Append rows to a table, by column name."""
    df.write.mode("append").parquet(path)


def replace_partitions(df: DataFrame, root: str, partitions: Sequence[str]) -> None:
    """Write rows by folder; folders present in ``df`` are replaced, others stay."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*partitions).parquet(root)


def write_mart_days(df: DataFrame, root: str, tasks: int | None = None) -> None:
    """Write mart rows by facility and day; those present in ``df`` are replaced, so a rerun changes nothing."""
    df = df.withColumn("facility_code", _varying("facility_code"))
    rows = _spread(df, MART_PARTITIONS, ["product_id", "defect_name"], tasks)
    replace_partitions(rows, root, MART_PARTITIONS)


def clear_mart_days(spark: SparkSession, root: str, facility: str, days: Iterable) -> None:
    """Remove the mart rows of some days of a facility."""
    for day in days:
        delete(spark, f"{root}/facility_code={facility}/stat_date={str(day)[:10]}")


def expire_days(spark: SparkSession, root: str, days: int, as_of) -> list[str]:
    """Remove the day folders of a table that are older than so many days; returns what was removed.

    Knows the layouts of inspection (year, month, day), mart (stat_date) and history (load_day).
    """
    cutoff = retention_start(days, as_of).isoformat()
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = []
    for pattern in ("facility_code=*/year=*/month=*/day=*", "facility_code=*/stat_date=*", "load_day=*"):
        for status in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{root}/{pattern}")) or ():
            path = status.getPath()
            parts = dict(p.split("=", 1) for p in path.toString().split("/") if "=" in p)
            day = parts.get("stat_date") or parts.get("load_day")
            if "year" in parts:
                day = f"{int(parts['year']):04d}-{int(parts['month']):02d}-{int(parts['day']):02d}"
            if re.fullmatch(r"\d{4}-\d\d-\d\d", day) and day < cutoff:
                fs.delete(path, True)
                gone.append(path.toString())
    return sorted(gone)


def _versions(spark: SparkSession, root: str) -> list[int]:
    """Complete versions below ``root``, oldest first."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(root)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    names = [s.getPath() for s in fs.listStatus(folder)]
    done = [p for p in names if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(m[1]) for p in done if (m := re.fullmatch(r"v(\d+)", p.getName())))


def write_version(df: DataFrame, root: str) -> str:
    """Write a full new state next to the old ones; readers switch once it is complete.

    One writer at a time: two would choose the same number.
    """
    path = f"{root}/v{max(_versions(df.sparkSession, root), default=0) + 1}"
    df.write.mode("overwrite").parquet(path)
    return path


def drop_versions(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Remove all but the newest complete states."""
    if keep < 1:
        raise ValueError("at least one version has to stay")
    for version in _versions(spark, root)[:-keep]:
        delete(spark, f"{root}/v{version}")


def read_latest(spark: SparkSession, root: str) -> DataFrame | None:
    """Newest complete state, None if there is none."""
    versions = _versions(spark, root)
    return spark.read.parquet(f"{root}/v{versions[-1]}") if versions else None
