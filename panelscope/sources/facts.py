"""History and inspection bucketed by product and process, the columns on which they meet.

Both tables are hashed into the same number of buckets when they are written.  Whatever is then grouped, numbered or
joined by these columns is read bucket by bucket, without an exchange, as often as it is asked for.  Panels that were
reported under several products, which cannot be counted inside a bucket, are found once at that time.
"""

from __future__ import annotations

import hashlib
import json
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelscope.operators.panels import shared_panels
from panelscope.session import exists

BUCKET_KEY = ("product_id", "process_code")
TABLES = ("history", "inspection")
#: Describes the tables and is written last, so facts without it are incomplete.
LAYOUT = "layout"


class Facts(NamedTuple):
    """Bucketed tables, and the panels of several products as (process, panel)."""

    history: DataFrame
    inspection: DataFrame
    shared: DataFrame


def _name(root: str, table: str) -> str:
    return f"facts_{hashlib.md5(root.encode()).hexdigest()}_{table}"


def _write(df: DataFrame, root: str, table: str, buckets: int) -> None:
    # rebalancing gives a bucket to one task, and to several if one key makes it large
    bucket = F.pmod(F.hash(*BUCKET_KEY), F.lit(buckets)).alias("_bucket")
    rows = df.withColumn("_bucket", bucket).hint("rebalance", F.col("_bucket")).drop("_bucket")
    spark = df.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {_name(root, table)}")
    writer = rows.write.format("parquet").mode("overwrite").option("path", f"{root}/{table}")
    writer.bucketBy(buckets, *BUCKET_KEY).sortBy(*BUCKET_KEY).saveAsTable(_name(root, table))


def write_facts(h: DataFrame, i: DataFrame, root: str, buckets: int = 200) -> Facts:
    """Write both tables to a new folder that every executor can reach.

    Choose ``buckets`` so that one of them fits a task: 200 buckets of 128 MB are 25 GB, 100 TB ask for some
    hundred thousand.  A later state is written to a folder of its own, as with ``lake.write_version``.
    """
    if buckets < 1:
        raise ValueError("need at least one bucket")
    spark = h.sparkSession
    if exists(spark, f"{root}/{LAYOUT}"):
        raise ValueError(f"{root} holds facts already")
    for table, df in zip(TABLES, (h, i), strict=True):
        _write(df, root, table, buckets)
    written = spark.read.schema(i.schema).parquet(f"{root}/inspection")
    shared_panels(written).write.mode("overwrite").parquet(f"{root}/shared")
    layout = [(buckets, h.schema.json(), i.schema.json())]
    spark.createDataFrame(layout, "buckets int, history string, inspection string").coalesce(1).write.mode("overwrite").parquet(f"{root}/{LAYOUT}")
    return read_facts(spark, root)


def read_facts(spark: SparkSession, root: str) -> Facts:
    """The tables of a folder, known to this session as bucketed whichever session wrote them."""
    layout = spark.read.parquet(f"{root}/{LAYOUT}").first()
    keys = ", ".join(BUCKET_KEY)
    for table in TABLES:
        fields = T.StructType.fromJson(json.loads(layout[table])).fields
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {_name(root, table)} ({columns}) USING parquet "
            f"CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {layout['buckets']} BUCKETS LOCATION '{root}/{table}'"
        )
    shared = spark.read.schema("process_code string, panel_id string").parquet(f"{root}/shared")
    return Facts(*(spark.table(_name(root, t)) for t in TABLES), shared)
