"""Heatmap post-processing: flag sums, matrix form and colour intensity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelscope.functions.clean import safe_rate
from panelscope.session import settle

# Fixed value: cells per letter.
CELLS_PER_LETTER = 10


def sum_panel_flags(mart: DataFrame, keys: Sequence[str] = (), cells: int | None = None) -> DataFrame:
    """Element-wise sum of the flag maps as cells with rate, ten per letter; no rows give no cells.

    Every cell of the longest map is summed; ``cells`` asks for a grid of the first so many.  The mart is read
    once: of an opened map its first entry, which counts the row, and the set flags reach the sums, which are written,
    a row per cell.
    """
    keys = list(keys)
    opened = mart.select(*keys, F.size("panel_map").alias("_size"), F.posexplode_outer("panel_map").alias("pos", "flag"))
    opened = opened.where("flag <> 0 OR pos = 0 OR pos IS NULL").withColumn("pos", F.coalesce("pos", F.lit(-1)))
    summed = opened.groupBy(*keys, "pos").agg(F.sum(F.col("flag").cast("long")).alias("total_defects"), F.count("*").alias("_rows"), F.max("_size").alias("_size"))
    summed = settle(summed, "flag-sums")
    last = F.max("_size") if cells is None else F.lit(cells)
    sizes = summed.where("pos <= 0").groupBy(*keys).agg(F.sum("_rows").alias("total_glasses"), last.alias("_cells")).where("total_glasses > 0")
    sums = summed.select(*keys, "pos", "total_defects")
    every = sizes.where("_cells > 0").withColumn("pos", F.explode(F.sequence(F.lit(0), F.col("_cells") - 1)))
    return every.join(sums, [*keys, "pos"], "left").select(
        *keys,
        F.char(F.lit(65) + F.floor(F.col("pos") / CELLS_PER_LETTER)).alias("x"),
        (F.col("pos") % CELLS_PER_LETTER).cast("string").alias("y"),
        F.coalesce("total_defects", F.lit(0)).alias("total_defects"),
        "total_glasses",
        safe_rate("total_defects", "total_glasses").alias("defect_rate"),
    )


def heatmap_matrix(cells: DataFrame, xs: Sequence[str] = (), keys: Sequence[str] = ("group_type",)) -> DataFrame:
    """One row per y and one column per x, in sorted order, 0 where a cell is missing."""
    cells = cells if xs else settle(cells, "cells")  # read twice: for the columns and for their values
    columns = sorted(xs) if xs else None
    rows = cells.groupBy(*keys, "y").pivot("x", columns).agg(F.first("defect_rate"))
    return rows.fillna(0.0).orderBy(*keys, "y")


def intensity(cells: DataFrame) -> DataFrame:
    """Rate relative to the largest rate of all cells, 0 where all rates are 0."""
    cells = settle(cells, "cells")  # read twice
    top = cells.agg(F.max("defect_rate")).scalar()
    return cells.withColumn("intensity", safe_rate(F.col("defect_rate"), F.nullif(top, F.lit(0.0))))
