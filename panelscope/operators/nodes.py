"""Aggregation of the defect mart along process > line > machine > path."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelscope.operators.mart import panel
from panelscope.operators.positions import numbered

# The levels, outermost first, and the column of each.
LEVELS = {
    "process": "process_code",
    "line": "equipment_line_id",
    "machine": "equipment_machine_id",
    "path": "equipment_path_id",
}
NODE = tuple(LEVELS.values())


def node_columns(level: str) -> list[Column]:
    """Node columns down to a level, the deeper ones NULL; an unknown level acts as process."""
    names = list(LEVELS)
    depth = names.index(level) if level in LEVELS else 0
    return [
        F.col(c) if n <= depth else F.lit(None).cast("string").alias(c) for n, c in enumerate(NODE)
    ]


def at_level(mart: DataFrame, level: str) -> DataFrame:
    """Mart rows whose node columns below the level are NULL."""
    rest = [c for c in mart.columns if c not in NODE]
    return mart.select(*node_columns(level), *rest)


def node_totals(mart: DataFrame, level: str = "path", by: Sequence[str] = ()) -> DataFrame:
    """Distinct products, defects and defects per product of each node."""
    return (
        at_level(mart, level)
        .groupBy(*NODE, *by)
        .agg(F.countDistinct("product_id").alias("total_products"), F.sum("total_defects").alias("total_defects"))
        .withColumn("dpu", F.try_divide(F.col("total_defects").cast("double"), F.col("total_products")))
    )


def product_bitmaps(mart: DataFrame) -> DataFrame:
    """Per path, and per range of product numbers: a bitmap of its products, and their defects.

    Products are numbered densely, range by range.  Bitmaps are exact and merge: those of several paths, days or
    loads combine by ``bitmap_or_agg``, without the products being read again.  A product without id has no bit.
    """
    products = numbered(mart.select("product_id").where("product_id IS NOT NULL").distinct(), [F.col("product_id")], "_number")
    rows = mart.join(products, "product_id", "left")
    return rows.groupBy(*NODE, F.bitmap_bucket_number("_number").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_number")).alias("bits"), F.sum("total_defects").alias("total_defects")
    )


def totals_of_all_levels(bitmaps: DataFrame) -> DataFrame:
    """``node_totals`` of all four levels at once, with the level's name, from ``product_bitmaps`` in one pass.

    Paths are merged into the nodes above them; products that several paths share are counted once by their bit.
    """
    sets = [[*NODE[: n + 1], "bucket"] for n in range(len(NODE))]
    merged = bitmaps.groupingSets(sets, *NODE, "bucket").agg(
        F.grouping_id().alias("_set"), F.bitmap_or_agg("bits").alias("bits"), F.sum("total_defects").alias("total_defects")
    )
    # a column that a set leaves out sets its bit; bucket, the last one, is in all sets
    names = F.create_map(*(F.lit(x) for n, level in enumerate(LEVELS) for x in (2 ** (len(NODE) - n) - 2, level)))
    totals = merged.groupBy("_set", *NODE).agg(F.sum(F.bitmap_count("bits")).alias("total_products"), F.sum("total_defects").alias("total_defects"))
    dpu = F.try_divide(F.col("total_defects").cast("double"), F.col("total_products"))
    return totals.select(F.element_at(names, F.col("_set").cast("int")).alias("level"), *NODE, "total_products", "total_defects", dpu.alias("dpu"))


def node_maps(mart: DataFrame, level: str = "path", by: Sequence[str] = ()) -> DataFrame:
    """Defects per panel address of each node, as parallel arrays sorted by address.

    Counted per address before the arrays are collected, so an array has one entry per address.
    """
    panels = at_level(mart, level).select(*NODE, *by, F.inline(F.arrays_zip("panel_addrs", "panel_map")))
    return (
        panels.groupBy(*NODE, *by, "panel_addrs")
        .agg(F.sum("panel_map").alias("panel_map"))
        .groupBy(*NODE, *by)
        .agg(F.sort_array(F.collect_list(panel("panel_addrs", "panel_map"))).alias("_panels"))
        .withColumns({"panel_addrs": F.col("_panels.addr"), "panel_map": F.col("_panels.n")})
        .drop("_panels")
    )


def daily_dpu(mart: DataFrame, level: str = "path", by: Sequence[str] = ()) -> DataFrame:
    """Defects per product of each node and work day."""
    day = F.date_format("work_time", "yyyy-MM-dd").alias("work_date")
    return (
        at_level(mart, level)
        .groupBy(*NODE, *by, day)
        .agg(F.sum("total_defects").alias("_defects"), F.countDistinct("product_id").alias("_products"))
        .withColumn("dpu", F.try_divide(F.col("_defects").cast("double"), F.col("_products")))
        .drop("_defects", "_products")
    )


def node_trend(mart: DataFrame, level: str = "path", by: Sequence[str] = ()) -> DataFrame:
    """Daily defects per product of each node as one list in date order."""
    return (
        daily_dpu(mart, level, by)
        .groupBy(*NODE, *by)
        .agg(F.array_sort(F.collect_list(F.struct("work_date", "dpu"))).alias("daily_dpu"))
    )


def node_summary(mart: DataFrame, level: str = "path", by: Sequence[str] = ()) -> DataFrame:
    """Totals and trend of each node from one pass over the mart.

    Rows are reduced to products per day first; each counts once for its day and once for the node.
    """
    keys, day = [*NODE, *by], F.date_format("work_time", "yyyy-MM-dd").alias("work_date")
    products = at_level(mart, level).groupBy(*keys, day, "product_id").agg(F.sum("total_defects").alias("_defects"))
    nothing = F.lit(None).cast("string")
    scopes = F.inline(
        F.array(
            F.struct(F.lit(True).alias("_daily"), F.col("work_date").alias("_day")),
            F.struct(F.lit(False).alias("_daily"), nothing.alias("_day")),
        )
    )
    once = products.select(*keys, "product_id", "_defects", scopes).groupBy(*keys, "_daily", "_day", "product_id")
    sums = once.agg(F.sum("_defects").alias("_defects")).groupBy(*keys, "_daily", "_day")
    rows = sums.agg(F.sum("_defects").alias("_defects"), F.count("product_id").alias("_products"))
    dpu = F.try_divide(F.col("_defects").cast("double"), F.col("_products"))

    def whole(value: Column) -> Column:
        return F.max(F.when(~F.col("_daily"), value))

    entry = F.when(F.col("_daily"), F.struct(F.col("_day").alias("work_date"), dpu.alias("dpu")))
    return rows.groupBy(*keys).agg(
        whole(F.col("_products")).alias("total_products"),
        whole(F.col("_defects")).alias("total_defects"),
        whole(dpu).alias("dpu"),
        F.array_sort(F.collect_list(entry)).alias("daily_dpu"),
    )


def _days(start, end) -> Column:
    first, last = (dt.date.fromisoformat(str(d)[:10]) for d in (start, end))
    return F.sequence(F.lit(first), F.lit(last))


def fill_days(nodes: DataFrame, start, end) -> DataFrame:
    """Trend lists with every day of start..end, 0 where a node has no rows; other days are left out."""
    names = F.transform(_days(start, end), lambda d: F.date_format(d, "yyyy-MM-dd"))
    zeros = F.map_from_arrays(names, F.array_repeat(F.lit(0.0), F.size(names)))
    known = F.map_from_entries(F.filter("daily_dpu", lambda d: d["work_date"].isNotNull()))
    merged = F.map_zip_with(
        zeros,
        F.coalesce(known, F.create_map().cast("map<string,double>")),
        lambda _, zero, dpu: F.struct(zero.alias("zero"), dpu.alias("dpu")),
    )
    wanted = F.filter(F.map_entries(merged), lambda e: e["value"]["zero"].isNotNull())
    filled = F.transform(
        wanted,
        lambda e: F.struct(
            e["key"].alias("work_date"), F.coalesce(e["value"]["dpu"], e["value"]["zero"]).alias("dpu")
        ),
    )
    return nodes.withColumn("daily_dpu", filled)


def fill_day_rows(trend: DataFrame, start, end, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The same for a trend in rows: one row per key and day, 0 in the value columns."""
    every = trend.select(*keys).distinct().withColumn("work_date", F.explode(_days(start, end)))
    every = every.withColumn("work_date", F.date_format("work_date", "yyyy-MM-dd"))
    marked = trend.select(*[F.col(c).alias(f"_{c}") for c in (*keys, "work_date")], *values)
    same = F.col("work_date") == F.col("_work_date")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    out = every.join(marked, same, "left").select(*keys, "work_date", *values)
    return out.fillna(0, subset=list(values))
