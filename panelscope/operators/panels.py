"""Distinct defective panels, reduced before they meet the process history.

History and inspection meet on product and process.  Joining panel rows there would emit every
(step, panel) pair of a product, so panels are counted first.  A panel normally belongs to one
product; panels reported under several products cannot be counted per product without counting
them twice, so those few stay as rows and are made distinct after the join.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelscope.session import settle


class Panels(NamedTuple):
    """Counted panels of one product; rows of the panels of several products, None if there are none."""

    own: DataFrame
    shared: DataFrame | None


def _count(i: DataFrame, by: Sequence[str], per: Sequence[str], extra: Sequence[Column] = ()) -> Panels:
    """Count the panels ``by`` identifies per product and ``per``.

    The counts, one row per product, are written once.  Panels of several products are counted under
    no product there, which tells whether the rows have to be read again for them.
    """
    columns = ["panel_id", "product_id", "process_code"]
    rows = i.select(*columns).dropna(subset=columns)
    owners = rows.groupBy(*by).agg(F.min("product_id").alias("_first"), F.max("product_id").alias("_last"), *extra)
    several = F.col("_first") != F.col("_last")
    owner = F.when(~several, F.col("_first")).alias("product_id")
    counts = settle(owners.groupBy(owner, *per).agg(F.count("*").alias("n_panels")), "panels")
    own = counts.where(F.col("product_id").isNotNull())
    if counts.where(F.col("product_id").isNull()).isEmpty():
        return Panels(own, None)
    return Panels(own, rows.join(owners.where(several).select(*by), list(by), "left_semi").distinct())


def panels_per_step(i: DataFrame) -> Panels:
    """own: number of panels per (product, process); shared: rows (panel, product, process)."""
    return _count(i, ["process_code", "panel_id"], ["process_code"])


def shared_panels(i: DataFrame) -> DataFrame:
    """Panels that were reported under several products, as (process, panel)."""
    rows = i.select("process_code", "panel_id", "product_id").dropna()
    owners = rows.groupBy("process_code", "panel_id").agg(F.min("product_id").alias("_first"), F.max("product_id").alias("_last"))
    return owners.where("_first != _last").select("process_code", "panel_id")


def panels_in_buckets(i: DataFrame, shared: DataFrame) -> Panels:
    """The same as ``panels_per_step`` where ``shared`` is known: counted inside the buckets of (product, process).

    ``shared`` may have been found over more rows than ``i`` has; its panels are made distinct after the join.
    """
    columns = ["panel_id", "product_id", "process_code"]
    rows, by = i.select(*columns).dropna(), ["process_code", "panel_id"]
    counted = ["product_id", "process_code"]
    if shared.isEmpty():
        return Panels(rows.distinct().groupBy(*counted).agg(F.count("*").alias("n_panels")), None)
    own = rows.join(shared, by, "left_anti").distinct()
    return Panels(own.groupBy(*counted).agg(F.count("*").alias("n_panels")), rows.join(shared, by, "left_semi").distinct())


def panels_per_product(i: DataFrame) -> Panels:
    """own: number of panels per product and set of processes they were found in; shared: as above."""
    return _count(i, ["panel_id"], ["processes"], [F.array_sort(F.collect_set("process_code")).alias("processes")])
