"""Display names and the report on a single glass."""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelscope.operators.steps import dedup_products


class GlassReport(NamedTuple):
    header: DataFrame
    history: DataFrame
    defects: DataFrame


def with_names(df: DataFrame, names: Mapping[str, str], key: str = "process_code", name: str = "process_name"):
    """Display name of each code, the code itself where none is given."""
    schema = T.StructType([T.StructField(key, T.StringType()), T.StructField(name, T.StringType())])
    table = df.sparkSession.createDataFrame(list(names.items()), schema)
    return df.join(table, key, "left").withColumn(name, F.coalesce(name, key))


def glass_headers(h: DataFrame, i: DataFrame) -> DataFrame:
    """Per product: lot and day of the latest step, number of steps and of defects."""
    steps = h.groupBy("product_id").agg(F.count("*").alias("n_steps"))
    found = i.groupBy("product_id").agg(F.count("*").alias("total_defects"))
    latest = dedup_products(h.select("product_id", "lot_id", "move_in_ymdhms"))
    return (
        latest.join(steps, "product_id")
        .join(found, "product_id", "left")
        .select(
            F.col("product_id").alias("glass_id"),
            "lot_id",
            F.date_format("move_in_ymdhms", "yyyy-MM-dd").alias("work_date"),
            F.coalesce("total_defects", F.lit(0)).cast("long").alias("total_defects"),
            "n_steps",
        )
    )


def glass_report(h: DataFrame, i: DataFrame, product_id: str) -> GlassReport:
    """One product: header, steps in time order, and its defects."""
    mine = F.col("product_id") == product_id
    h, i = h.where(mine), i.where(mine)
    steps = h.select("process_code", F.col("equipment_line_id").alias("equipment_id"), F.col("move_in_ymdhms").alias("time"))
    defects = i.select(F.col("defect_name").alias("name"), F.col("inspection_end_ymdhms").alias("time"))
    per_defect = defects.groupBy("name", "time").agg(F.count("*").alias("count"))
    return GlassReport(
        header=glass_headers(h, i),
        history=steps.orderBy("time", "process_code", "equipment_id"),
        defects=per_defect.select("name", "count", "time").orderBy("time", "name"),
    )
