"""Tables that grow load by load, with row counts and high-water marks recorded beside each load.

A load is a folder of its own below the table.  What it adds to the marks is read from that folder when it is
complete and kept in a hidden folder, so asking for marks or counts never opens the files of older loads.
A load that was written by a run that stopped before recording is recorded by the next one that asks.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelscope.session import delete, exists
from panelscope.sources.extract import incremental_by_facility

#: Spark's readers skip names that begin with an underscore.
MARKS = "_marks"
MARK_COLUMNS = "load string, facility_code string, row_count long, high_water timestamp_ntz"


def write_load(df: DataFrame, root: str, load: str, ts: str) -> None:
    """Write the rows of a load and record them; a load that is written again replaces what it was."""
    if not re.fullmatch(r"[A-Za-z0-9.-]+", load):
        raise ValueError("a load is named by letters, digits, dots and dashes")
    spark = df.sparkSession
    delete(spark, f"{root}/{MARKS}/load={load}")  # from here on until recorded anew, the load has no marks
    df.write.mode("overwrite").parquet(f"{root}/load={load}")
    record(spark, root, ts)


def _loads(spark: SparkSession, root: str) -> list[str]:
    """Complete loads."""
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{root}/load=*/_SUCCESS")) or ()
    return sorted(s.getPath().getParent().getName().removeprefix("load=") for s in found)


def record(spark: SparkSession, root: str, ts: str) -> list[str]:
    """Record the complete loads that have no marks yet, and say which; others are not read."""
    missing = [n for n in _loads(spark, root) if not exists(spark, f"{root}/{MARKS}/load={n}/_SUCCESS")]
    for load in missing:
        rows = spark.read.parquet(f"{root}/load={load}")
        marks = rows.groupBy("facility_code").agg(F.count("*").alias("row_count"), F.max(ts).alias("high_water"))
        marks.coalesce(1).write.mode("overwrite").parquet(f"{root}/{MARKS}/load={load}")
    return missing


def read_loads(spark: SparkSession, root: str) -> DataFrame:
    """Rows of all loads."""
    return spark.read.option("basePath", root).parquet(f"{root}/load=*").drop("load")


def marks(spark: SparkSession, root: str, ts: str) -> DataFrame:
    """Row count and newest time per facility over all loads, from what was recorded."""
    record(spark, root, ts)
    if not _loads(spark, root):
        recorded = spark.createDataFrame([], MARK_COLUMNS)
    else:
        recorded = spark.read.schema(MARK_COLUMNS).option("basePath", f"{root}/{MARKS}").parquet(f"{root}/{MARKS}/load=*")
    return recorded.groupBy("facility_code").agg(F.sum("row_count").alias("row_count"), F.max("high_water").alias("high_water"))


def new_rows(
    source: DataFrame, root: str, ts: str, now: dt.datetime, first_days: int | None = None
) -> DataFrame:
    """Rows of the source that are later than what the loads below ``root`` have of their facility."""
    known = marks(source.sparkSession, root, ts).where("facility_code IS NOT NULL AND high_water IS NOT NULL").collect()
    return incremental_by_facility(source, ts, {r["facility_code"]: r["high_water"] for r in known}, now, first_days)
