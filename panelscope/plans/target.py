"""Target against others: the full set of results of one request."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame

from panelscope.operators.glass import (
    Request,
    daily_level,
    glass_level,
    has_grid,
    heatmap,
    heatmap_grid,
    lots_of,
    metrics,
)
from panelscope.session import settle


class TargetResult(NamedTuple):
    glass: DataFrame
    lot: DataFrame
    daily: DataFrame
    heatmap: DataFrame
    metrics: DataFrame


def target_analysis(h: DataFrame, i: DataFrame, req: Request, grid: DataFrame | None = None) -> TargetResult:
    """Product, lot, day, panel and summary results; a request of one model that has a grid uses it."""
    glass = settle(glass_level(h, i, req), "glass")
    on_grid = grid is not None and len(req.model_codes) == 1 and has_grid(grid, req.model_codes[0])
    return TargetResult(
        glass=glass,
        lot=lots_of(glass),
        daily=daily_level(h, i, req),
        heatmap=heatmap_grid(h, i, req, grid) if on_grid else heatmap(h, i, req),
        metrics=metrics(glass),
    )
