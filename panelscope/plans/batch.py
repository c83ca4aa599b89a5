"""Many targets against one shared baseline in one set of jobs.

Each target splits the same baseline into its own products and all others.  Repeating the baseline
per target would multiply it, so only the targets' own products are joined; what belongs to the
others is the baseline total minus the target part.  Totals per day and panel position are small and
repeated per target; lots grow with the data, so a target has rows of the lots it touched only and all
share one row per lot.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelscope.functions.clean import safe_rate
from panelscope.operators.glass import Request, glass_rows, metrics, product_cells
from panelscope.operators.positions import numbered, others_stride, stride
from panelscope.session import settle

Targets = Iterable[tuple[str, str]] | DataFrame
TARGET_KEY = ["equipment_line_id", "process_code"]


class BatchResult(NamedTuple):
    """Frames keyed by equipment_line_id and process_code, and two that all targets share."""

    glass: DataFrame
    lot: DataFrame
    daily: DataFrame
    heatmap: DataFrame
    metrics: DataFrame
    baseline: DataFrame
    lot_baseline: DataFrame

    def parts(self) -> dict[str, DataFrame]:
        """The frames keyed by target."""
        return {k: v for k, v in self._asdict().items() if k not in ("baseline", "lot_baseline")}


def target_pairs(targets: DataFrame) -> list[tuple[str, str]]:
    """All targets as a request argument; ``first_targets`` says how many there are."""
    return [tuple(r) for r in targets.select(*TARGET_KEY).collect()]


def target_frame(spark: SparkSession, targets: Targets) -> DataFrame:
    """Distinct targets as a frame: a list becomes a local table, a frame of any size is written once."""
    if isinstance(targets, DataFrame):
        return settle(targets.select(*[F.col(c).cast("string") for c in TARGET_KEY]).dropna().distinct(), "targets")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in TARGET_KEY])
    return spark.createDataFrame(list(dict.fromkeys((str(e), str(p)) for e, p in targets)), schema)


def membership(h: DataFrame, targets: Targets) -> DataFrame:
    """Distinct (equipment, process, product) of the target steps."""
    frame = target_frame(h.sparkSession, targets)
    return h.select(*TARGET_KEY, "product_id").join(frame, TARGET_KEY, "left_semi").distinct()


def _split(totals: DataFrame, mine: DataFrame, keys: list[str], counts: list[str], targets: DataFrame) -> DataFrame:
    """Target and Others rows per target: ``counts`` of ``mine``, and of ``totals`` minus ``mine``.

    The totals are a row per day or per cell of a grid; each target gets them as one list.
    """
    key = [*TARGET_KEY, *keys]
    target, others = F.lit("Target").alias("group_type"), F.lit("Others").alias("group_type")
    listed = totals.agg(F.collect_list(F.struct(*keys, *counts))).scalar()
    rows = (
        targets.withColumn("_totals", listed)
        .select(*TARGET_KEY, F.inline("_totals"))
        .select(*key, others, *counts)
        .unionByName(mine.select(*key, target, *counts))
        .unionByName(mine.select(*key, others, *[(-F.col(c)).alias(c) for c in counts]))
    )
    return rows.groupBy(*key, "group_type").agg(*[F.sum(c).alias(c) for c in counts])


_SUMS = ("glass_count", "total_defects", "max_defects")


def _sums():
    return (
        F.sum("n").cast("long").alias("glass_count"),
        F.sum(F.col("n") * F.col("total_defects")).alias("total_defects"),
        F.max("total_defects").alias("max_defects"),
    )


def _all_lots(baseline: DataFrame) -> DataFrame:
    """One row per lot over all products."""
    lots = baseline.groupBy("lot_id", "total_defects").agg(F.count("*").alias("n")).groupBy("lot_id").agg(*_sums())
    return lots.withColumn("avg_defects", safe_rate("total_defects", "glass_count"))


def _lots(baseline: DataFrame, members: DataFrame) -> DataFrame:
    """Target and Others rows of the lots that a target touched.

    In any other lot the others are all products of the lot, which the lot's baseline row has.  Others
    come from the lot's histogram of defect counts minus the target's, since a histogram can be
    subtracted and a maximum cannot.
    """
    n = F.count("*").alias("n")
    mine = members.groupBy(*TARGET_KEY, "lot_id", "total_defects").agg(n)
    touched = mine.select(*TARGET_KEY, F.col("lot_id").alias("_lot")).distinct()
    histogram = baseline.groupBy("lot_id", "total_defects").agg(n)
    seen = histogram.join(touched, F.col("lot_id").eqNullSafe(F.col("_lot"))).drop("_lot")
    key = [*TARGET_KEY, "lot_id"]
    left = seen.unionByName(mine.withColumn("n", -F.col("n"))).groupBy(*key, "total_defects")
    others = left.agg(F.sum("n").alias("n")).where("n > 0")
    groups = ((mine, "Target"), (others, "Others"))
    target, rest = (df.groupBy(*key).agg(*_sums()).select(*key, *_SUMS, F.lit(g).alias("group_type")) for df, g in groups)
    return target.unionByName(rest).withColumn("avg_defects", safe_rate("total_defects", "glass_count"))


def _days(baseline: DataFrame, members: DataFrame, targets: DataFrame) -> DataFrame:
    sums = [F.count("*").alias("glass_count"), F.sum("total_defects").alias("total_defects")]
    split = _split(
        baseline.groupBy("work_date").agg(*sums),
        members.groupBy(*TARGET_KEY, "work_date").agg(*sums),
        ["work_date"],
        ["glass_count", "total_defects"],
        targets,
    )
    return split.where("glass_count > 0").withColumn("avg_defects", safe_rate("total_defects", "glass_count"))


def _cells(cells: DataFrame, members: DataFrame, targets: DataFrame) -> DataFrame:
    sums = [F.sum("n").alias("total_defects"), F.count("product_id").alias("total_glasses")]
    split = _split(
        cells.groupBy("x", "y").agg(*sums),
        cells.join(members, "product_id").groupBy(*TARGET_KEY, "x", "y").agg(*sums),
        ["x", "y"],
        ["total_defects", "total_glasses"],
        targets,
    )
    return split.where("total_glasses > 0").withColumn(
        "defect_rate", safe_rate("total_defects", "total_glasses")
    )


def _points(baseline: DataFrame, members: DataFrame, targets: DataFrame) -> DataFrame:
    """Thinned product rows per target, equal to numbering each target's two groups by product.

    ``baseline`` is numbered once (_all) and ``members`` within their target (_own).  A member has
    _all - _own others in front of it, so the k-th, 2k-th, ... other of a target sits at its own
    number plus the count of members with fewer others in front: a short list of positions, looked
    up in the baseline.
    """
    rows = baseline.agg(F.count("*").alias("n")).scalar()
    kept = members.withColumn("group_type", F.lit("Target")).withColumn("_rows", rows)
    kept = kept.where(F.col("_own") % stride(F.col("group_type"), F.col("_rows")) == 0)

    ahead = members.withColumn("_k", others_stride(rows)).select(
        *TARGET_KEY, F.floor((F.col("_all") - F.col("_own")) / F.col("_k")).cast("long").alias("_slot")
    )
    adds = ahead.groupBy(*TARGET_KEY, "_slot").agg(F.count("*").alias("_members"))
    sizes = members.groupBy(*TARGET_KEY).agg(F.count("*").alias("_mine"))
    slots = (
        targets.join(sizes, TARGET_KEY, "left")
        .withColumn("_k", others_stride(rows))
        .withColumn("_last", F.floor((rows - F.coalesce("_mine", F.lit(0))) / F.col("_k")).cast("long"))
        .where("_last >= 1")
        .select(*TARGET_KEY, "_k", F.explode(F.sequence(F.lit(1).cast("long"), "_last")).alias("_slot"))
    )
    # slot j counts the members of all slots below j: asks sort before adds of the same slot
    events = slots.withColumn("_members", F.lit(0).cast("long")).withColumn("_adds", F.lit(0)).unionByName(
        adds.withColumn("_k", F.lit(None).cast("long")).withColumn("_adds", F.lit(1))
    )
    running = (
        Window.partitionBy(*TARGET_KEY)
        .orderBy("_slot", "_adds")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    wanted = (
        events.withColumn("_before", F.sum("_members").over(running))
        .where("_adds = 0")
        .select(*TARGET_KEY, (F.col("_slot") * F.col("_k") + F.col("_before")).alias("_all"))
    )
    others = baseline.join(wanted, "_all").withColumn("group_type", F.lit("Others"))
    columns = [*TARGET_KEY, "product_id", "lot_id", "work_date", "total_defects", "group_type"]
    return kept.select(*columns).unionByName(others.select(*columns))


def batch_analysis(
    h: DataFrame, i: DataFrame, targets: Targets, req: Request, thin: bool = False
) -> BatchResult:
    """Product, lot, day, panel and summary results for every (equipment, process) target.

    ``glass`` has the products of each target; its others are the rows of ``baseline`` that it does not
    have.  With ``thin`` it has the points of a plot instead: every k-th row of both groups.  ``targets`` is a list or,
    for any number of them, a frame.
    """
    targets = target_frame(h.sparkSession, targets)
    if targets.isEmpty():
        raise ValueError("at least one target is required")
    req = replace(req, equipment_ids=(), process_codes=())

    glass = glass_rows(h, i, req)
    if thin:
        baseline = numbered(glass, [F.col("product_id").asc_nulls_last()], "_all")
    else:
        baseline = settle(glass, "glass")
    passed = membership(h, targets)
    members = passed.join(baseline, "product_id")
    if thin:
        members = numbered(members, [F.col("_all").asc()], "_own", TARGET_KEY)
    else:
        members = settle(members, "target")
    cells = settle(product_cells(h, i, req), "cells")

    daily = _days(baseline, members, targets)
    rows = ["product_id", "lot_id", "work_date", "total_defects"]
    own = members.select(*TARGET_KEY, *rows, F.lit("Target").alias("group_type"))
    return BatchResult(
        glass=_points(baseline, members, targets) if thin else own,
        lot=_lots(baseline, members),
        daily=daily,
        heatmap=_cells(cells, passed, targets),
        metrics=metrics(daily, TARGET_KEY),
        baseline=baseline.select(*rows),
        lot_baseline=_all_lots(baseline),
    )
