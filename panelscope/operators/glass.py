"""Target products against all others, at product, lot, day and panel level.

Target products went through the chosen equipment (at the chosen processes) at any time.  Rows are
the history inside the period; everything that is not a target product is "Others".
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelscope.functions.clean import safe_rate
from panelscope.functions.predicates import any_of, equals_nfc, process_filter, time_range
from panelscope.operators.panels import panels_per_product
from panelscope.operators.steps import dedup_products, dedup_steps, rows_of


@dataclass(frozen=True)
class Request:
    """What to compare.  Empty fields do not filter; without equipment every row is Others."""

    start: str | None = None
    end: str | None = None
    defect_name: str = ""
    equipment_ids: Sequence[str] = ()
    process_codes: Sequence[str] = ()
    model_codes: Sequence[str] = ()


# Row order of each result.
RESULT_ORDER = {
    "glass": ("work_date", "product_id"),
    "lot": ("lot_id", "group_type"),
    "daily": ("work_date", "group_type"),
    "heatmap": ("group_type", "x", "y"),
    "glass_stats": ("product_id", "defect_name"),
}


def in_order(df: DataFrame, result: str) -> DataFrame:
    """Result rows in their documented order, NULLs last."""
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in RESULT_ORDER[result]])


def rows_in_period(h: DataFrame, req: Request) -> DataFrame:
    """Steps of the period, models and processes that the request asks for."""
    wanted = time_range("move_in_ymdhms", req.start, req.end) & process_filter(req.process_codes)
    return h.where(wanted & any_of("product_type_code", req.model_codes))


def of_period(i: DataFrame, h: DataFrame, req: Request) -> DataFrame:
    """Inspection rows of the products in the period; all rows if the request has no period."""
    if not (req.start or req.end):
        return i
    return rows_of(i, rows_in_period(h, req), ["product_id"])


def target_products(h: DataFrame, req: Request) -> DataFrame:
    """Distinct products that went through the chosen equipment."""
    wanted = any_of("equipment_line_id", req.equipment_ids) & process_filter(req.process_codes)
    wanted &= any_of("product_type_code", req.model_codes)
    return h.where(wanted & F.lit(bool(req.equipment_ids))).select("product_id").distinct()


def label(df: DataFrame, targets: DataFrame, key: str = "product_id") -> DataFrame:
    """group_type: Target for rows whose key is in ``targets``, else Others."""
    marks = targets.select(key).distinct().withColumn("_target", F.lit(True))
    group = F.when(F.col("_target").isNotNull(), F.lit("Target")).otherwise(F.lit("Others"))
    return df.join(marks, key, "left").withColumn("group_type", group).drop("_target")


def products_with_defect(i: DataFrame, defect: str) -> DataFrame:
    return i.where(equals_nfc("defect_name", defect)).select("product_id").distinct()


def glass_rows(h: DataFrame, i: DataFrame, req: Request) -> DataFrame:
    """One row per product of the period with its latest lot and day and its number of defects.

    With a defect name only products that have the defect stay; all their defects count.
    """
    latest = dedup_products(rows_in_period(h, req).select("product_id", "lot_id", "move_in_ymdhms"))
    found = of_period(i, h, req).groupBy("product_id").agg(
        F.count("panel_id").alias("n_defects"),
        F.max(equals_nfc("defect_name", req.defect_name)).alias("_has"),
    )
    if req.defect_name:
        rows = latest.join(found.where("_has"), "product_id")
    else:
        rows = latest.join(found, "product_id", "left")
    return rows.select(
        "product_id",
        "lot_id",
        F.date_format("move_in_ymdhms", "yyyy-MM-dd").alias("work_date"),
        F.coalesce("n_defects", F.lit(0)).cast("long").alias("total_defects"),
    )


def glass_level(h: DataFrame, i: DataFrame, req: Request) -> DataFrame:
    """Defects per product, labelled."""
    return label(glass_rows(h, i, req), target_products(h, req))


def lots_of(glass: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return glass.groupBy(*keys, "lot_id", "group_type").agg(
        F.count("*").alias("glass_count"),
        F.sum("total_defects").alias("total_defects"),
        F.avg("total_defects").alias("avg_defects"),
        F.max("total_defects").alias("max_defects"),
    )


def lot_level(h: DataFrame, i: DataFrame, req: Request) -> DataFrame:
    """Products, defects, mean and maximum per lot and label."""
    return lots_of(glass_level(h, i, req))


def daily_level(h: DataFrame, i: DataFrame, req: Request) -> DataFrame:
    """Distinct defective panels and distinct products per day and label.

    A product counts on every day it had a step, a panel on the days its product was in a process
    the panel was found in.  Panels come counted per product and set of processes.
    """
    rows = rows_in_period(h, req)
    steps = dedup_steps(rows.select("product_id", "process_code", "equipment_line_id", "move_in_ymdhms"))
    day = F.date_format("move_in_ymdhms", "yyyy-MM-dd").alias("work_date")
    visits = steps.groupBy("product_id", day).agg(F.collect_set("process_code").alias("visited"))
    targets = target_products(h, req)
    panels = panels_per_product(of_period(i.where(equals_nfc("defect_name", req.defect_name)), h, req))

    met = F.arrays_overlap("visited", "processes")
    per_visit = (
        visits.join(panels.own, "product_id", "left")
        .groupBy("product_id", "work_date")
        .agg(F.coalesce(F.sum(F.when(met, F.col("n_panels"))), F.lit(0)).alias("n_panels"))
    )
    days = ["work_date", "group_type"]
    trend = label(per_visit, targets).groupBy(*days).agg(
        F.sum("n_panels").alias("total_defects"), F.count("product_id").alias("glass_count")
    )
    if panels.shared is not None:
        at_process = steps.select("product_id", "process_code", day).distinct()
        met = label(panels.shared.join(at_process, ["product_id", "process_code"]), targets)
        more = met.select(*days, "panel_id").distinct().groupBy(*days)
        more = more.agg(F.count("*").alias("total_defects"), F.lit(0).cast("long").alias("glass_count"))
        both = trend.unionByName(more).groupBy(*days)
        trend = both.agg(*[F.sum(c).alias(c) for c in ("total_defects", "glass_count")])
    return trend.withColumn("avg_defects", safe_rate("total_defects", "glass_count"))


def product_cells(h: DataFrame, i: DataFrame, req: Request) -> DataFrame:
    """Defects per product and panel position, for products that had the process in the period."""
    passed = rows_in_period(h, req).select("product_id", "process_code").distinct()
    placed = F.col("panel_x").isNotNull() & F.col("panel_y").isNotNull()
    return (
        of_period(i.where(equals_nfc("defect_name", req.defect_name) & placed), h, req)
        .groupBy("product_id", "process_code", "panel_x", "panel_y")
        .agg(F.count("panel_id").alias("n"))
        .join(passed, ["product_id", "process_code"], "left_semi")
        .groupBy("product_id", F.col("panel_x").alias("x"), F.col("panel_y").alias("y"))
        .agg(F.sum("n").alias("n"))
    )


def heatmap(h: DataFrame, i: DataFrame, req: Request) -> DataFrame:
    """Defects, products and rate per label and observed panel position."""
    cells = label(product_cells(h, i, req), target_products(h, req))
    return (
        cells.groupBy("group_type", "x", "y")
        .agg(F.sum("n").alias("total_defects"), F.count("product_id").alias("total_glasses"))
        .withColumn("defect_rate", safe_rate("total_defects", "total_glasses"))
    )


def has_grid(grid: DataFrame, model: str) -> bool:
    return not grid.where(F.col("model_code") == model).isEmpty()


def grid_cells(grid: DataFrame) -> DataFrame:
    """Every cell of a model's grid for both labels."""
    return (
        grid.select("model_code", F.explode("x_list").alias("x"), "y_list")
        .select("model_code", "x", F.explode("y_list").alias("y"))
        .select("*", F.explode(F.array(F.lit("Target"), F.lit("Others"))).alias("group_type"))
    )


def heatmap_grid(h: DataFrame, i: DataFrame, req: Request, grid: DataFrame) -> DataFrame:
    """Heatmap on the fixed grid of the one requested model: missing cells are 0, others left out."""
    if len(req.model_codes) != 1:
        raise ValueError("a fixed grid needs exactly one model")
    expected = grid_cells(grid.where(F.col("model_code") == req.model_codes[0])).drop("model_code")
    zero = {"total_defects": 0, "total_glasses": 0, "defect_rate": 0.0}
    return expected.join(heatmap(h, i, req), ["group_type", "x", "y"], "left").fillna(zero)


def metrics(glass: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rates of both labels and their differences; one row per key, 0 where a label has no rows."""
    count = F.col("glass_count") if "glass_count" in glass.columns else F.lit(1)
    target = F.col("group_type") == "Target"

    def total(which, value):
        return F.coalesce(F.sum(F.when(which, value)), F.lit(0)).cast("long")

    sums = glass.groupBy(*keys).agg(
        total(target, F.col("total_defects")).alias("target_defects"),
        total(~target, F.col("total_defects")).alias("others_defects"),
        total(target, count).alias("target_glass_count"),
        total(~target, count).alias("others_glass_count"),
    )
    both = F.col("target_defects") + F.col("others_defects")
    return (
        sums.withColumn("overall_defect_rate", safe_rate(both, F.expr("target_glass_count + others_glass_count")))
        .withColumn("target_defect_rate", safe_rate("target_defects", "target_glass_count"))
        .withColumn("others_defect_rate", safe_rate("others_defects", "others_glass_count"))
        .withColumn("delta_target", F.col("overall_defect_rate") - F.col("target_defect_rate"))
        .withColumn("superiority_indicator", F.col("others_defect_rate") - F.col("target_defect_rate"))
        .drop("target_defects", "others_defects")
    )
