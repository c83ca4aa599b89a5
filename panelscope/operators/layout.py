"""Model layouts: the full list of panels of a model, and panel maps completed with zeros."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelscope.functions.clean import safe_rate
from panelscope.operators.mart import panel


def model_layout(part_no: DataFrame, pnl_map: DataFrame) -> DataFrame:
    """One layout per model, from any of its parts that has one.

    Layouts within a model are meant to be equal; the smallest is taken so that a rerun agrees.
    """
    known = pnl_map.where(F.col("ref_panels").isNotNull()).select("part_no_name", "ref_panels").distinct()
    return (
        part_no.select("model_code", "part_no_name")
        .distinct()
        .join(known, "part_no_name")
        .groupBy("model_code")
        .agg(F.min("ref_panels").alias("ref_panels"))
        .withColumn("updated_at", F.current_timestamp())
    )


def slots(layout: DataFrame) -> DataFrame:
    """Per model its listed panels, a zero for each, and the slot number (from 0) of each address; none for an empty layout."""
    listed = F.array_distinct(F.filter("ref_panels", lambda a: a.isNotNull()))
    known = layout.where(F.size("ref_panels") > 0).select("model_code", listed.alias("_listed"))
    numbers = F.transform("_listed", lambda _, n: n)
    return known.withColumns({"_zeros": F.transform("_listed", lambda _: F.lit(0).cast("long")), "_slots": F.map_from_arrays("_listed", numbers)})


def on_layout(df: DataFrame, layout: DataFrame) -> DataFrame:
    """Panel arrays over every panel of the model's layout, 0 where nothing was found.

    Slots are numbered once per model; a row looks up its own few panels and writes their counts into the zeros.
    Rows without a layout keep the observed panels.  Defects on observed panels outside the layout are
    summed in ``outside_defects``: it and the panel map together are all defects of the row.
    """
    zero = F.lit(0).cast("long")
    has = F.col("_listed").isNotNull()
    known = F.filter(F.zip_with("panel_addrs", "panel_map", panel), lambda p: p["addr"].isNotNull())
    placed = F.transform(known, lambda p: F.struct(F.try_element_at("_slots", p["addr"]).alias("slot"), F.coalesce(p["n"].cast("long"), zero).alias("n")))
    full = df.join(slots(layout), "model_code", "left").withColumn("_placed", F.when(has, placed))
    inside = F.filter("_placed", lambda p: p["slot"].isNotNull())
    outside = F.filter("_placed", lambda p: p["slot"].isNull())

    def written(grid: Column, p: Column) -> Column:
        return F.concat(F.slice(grid, F.lit(1), p["slot"]), F.array(p["n"]), F.slice(grid, p["slot"] + 2, F.size(grid)))

    grid = F.coalesce(F.aggregate(inside, F.col("_zeros"), written), F.col("_zeros"))
    return full.select(
        *[c for c in df.columns if c not in ("panel_map", "panel_addrs")],
        F.when(has, grid).otherwise(F.col("panel_map").cast("array<bigint>")).alias("panel_map"),
        F.when(has, F.col("_listed")).otherwise(F.col("panel_addrs")).alias("panel_addrs"),
        F.coalesce(F.aggregate(outside, zero, lambda n, p: n + p["n"]), zero).alias("outside_defects"),
    )


def full_grid(defects: DataFrame, layout: DataFrame) -> DataFrame:
    """Panel map of each product and defect over the whole layout of its model, and what lies outside it."""
    out = on_layout(defects, layout)
    return out.withColumn("model_code", F.coalesce("model_code", F.lit("UNKNOWN")))


def panel_rates(nodes: DataFrame, layout: DataFrame) -> DataFrame:
    """Per node: every panel of the model by name, its defects, and defects per product of the node."""
    ref = layout.select("model_code", F.array_sort("ref_panels").alias("ref_panels"))
    full = on_layout(nodes, ref)
    rates = F.transform("panel_map", lambda n: safe_rate(n, F.col("total_products")))
    return full.withColumn("panel_rates", rates)


def known_models(df: DataFrame, master: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of models in the master, and the distinct unknown models that were left out."""
    models = master.select("model_code").distinct()
    kept = df.join(models, "model_code", "left_semi")
    unknown = df.select("model_code").distinct().join(models, "model_code", "left_anti")
    return kept, unknown


def known_requested(models: Sequence[str], master: DataFrame) -> tuple[list[str], list[str]]:
    """Requested models that exist, and the rest for the message to the user."""
    found = master.where(F.col("model_code").isin(list(models))).select("model_code").distinct()
    exists = {r[0] for r in found.collect()}
    return [m for m in models if m in exists], [m for m in models if m not in exists]
