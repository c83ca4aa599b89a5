"""Hierarchy analysis on the defect mart."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelscope.functions.predicates import any_of, date_between, equals_nfc, in_folders, process_filter
from panelscope.operators.nodes import NODE, node_maps, node_summary
from panelscope.operators.steps import rows_of


@dataclass(frozen=True)
class HierarchyParams:
    """Filters of a hierarchy analysis; empty fields do not filter.

    Products come as a list or, in any number, as a frame with their ids; rows of both must be in both.
    """

    start: str = ""
    end: str = ""
    product_ids: Sequence[str] = ()
    defect_name: str = ""
    facility_code: str = ""
    model_code: str = ""
    process_code: str = ""
    equipment_line_id: str = ""
    equipment_machine_id: str = ""
    equipment_path_id: str = ""
    analysis_level: str = ""
    date_type: str = "inspection"
    products: DataFrame | None = None


# Longer lists of products are joined as a table instead of being written into the plan.
LONG_LIST = 1_000


def level_of(params: HierarchyParams) -> str:
    """The level asked for, else that of the deepest equipment given, else path."""
    if params.analysis_level:
        return params.analysis_level
    for level in ("path", "machine", "line"):
        if getattr(params, f"equipment_{level}_id"):
            return level
    return "path"


def hierarchy_filter(mart: DataFrame, params: HierarchyParams) -> DataFrame:
    """Mart rows of the request; all given filters must hold."""
    wanted = equals_nfc("defect_name", params.defect_name)
    long_list = len(params.product_ids) > LONG_LIST
    wanted &= any_of("product_id", () if long_list else params.product_ids)
    wanted &= date_between(params.date_type, params.start, params.end)
    if params.date_type != "work" and params.start and params.end:
        wanted &= in_folders(mart, "inspection_time", [(params.start, params.end)])
    wanted &= any_of("facility_code", [params.facility_code] if params.facility_code else [])
    wanted &= any_of("model_code", [params.model_code] if params.model_code else [])
    wanted &= process_filter([params.process_code] if params.process_code else [])
    for column in NODE[1:]:
        value = getattr(params, column)
        wanted &= any_of(column, [value] if value else [])
    rows = mart.where(wanted)
    if long_list:
        listed = mart.sparkSession.createDataFrame([(str(p),) for p in params.product_ids], "product_id string")
        rows = rows_of(rows, listed, ["product_id"])
    if params.products is not None:
        rows = rows_of(rows, params.products, ["product_id"])
    return rows.select(*mart.columns)


def hierarchy_analysis(
    mart: DataFrame, params: HierarchyParams = HierarchyParams(), by: Sequence[str] = ()
) -> DataFrame:
    """Per node: products, defects, defects per product, panel arrays and the daily trend.

    ``by`` adds mart columns, such as model_code, to the node key.
    """
    rows, level = hierarchy_filter(mart, params), level_of(params)
    keys = [*NODE, *by]
    # one row per node and part; a NULL in the node key groups like any other value
    parts = [f(rows, level, by) for f in (node_summary, node_maps)]
    values = [c for part in parts for c in part.columns if c not in keys]
    every = parts[0].unionByName(parts[1], allowMissingColumns=True)
    return every.groupBy(*keys).agg(*[F.first(c, ignorenulls=True).alias(c) for c in values])
