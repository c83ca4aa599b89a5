"""Equipment ranking: which equipment makes more defects than its peers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelscope.functions.predicates import time_range
from panelscope.operators.equipment import equipment_stats, overall, with_delta
from panelscope.operators.positions import with_rank
from panelscope.operators.steps import dedup_steps
from panelscope.session import settle

RANK_ORDER = ("delta_loo", "equipment_line_id", "process_code", "product_type_code")


def ranking_rows(
    h: DataFrame, i: DataFrame, start=None, end=None, defect: str = "", min_n: int = 10, shared: DataFrame | None = None
) -> DataFrame:
    """Ranked equipment without the rank number.

    The statistics, one row per equipment, are written once: the overall row and the ranking both
    read them.  Bucketed facts (``sources.facts``) come with their ``shared`` panels.
    """
    columns = ("product_id", "process_code", "equipment_line_id", "product_type_code", "move_in_ymdhms")
    steps = dedup_steps(h.where(time_range("move_in_ymdhms", start, end)).select(*columns))
    stats = equipment_stats(steps, i, defect, latest=True, shared=shared).where(F.col("product_count") >= min_n)
    stats = settle(stats, "equipment")
    return with_delta(stats, overall(stats, min_n))


def equipment_ranking(
    h: DataFrame,
    i: DataFrame,
    start=None,
    end=None,
    defect: str = "",
    limit: int = 0,
    min_n: int = 10,
    shared: DataFrame | None = None,
) -> DataFrame:
    """Equipment by leave-one-out delta, worst first; limit 0 keeps all."""
    rows = ranking_rows(h, i, start, end, defect, min_n, shared)
    return with_rank(rows, [F.col(c).asc_nulls_last() for c in RANK_ORDER], limit)
