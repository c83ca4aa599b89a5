"""Equipment statistics and the comparison of equipment with its peers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelscope.functions.clean import equip_group, safe_rate
from panelscope.functions.predicates import starts_with
from panelscope.operators.panels import panels_in_buckets, panels_per_step

EQUIPMENT_KEY = ("process_code", "equipment_group_id", "equipment_line_id", "product_type_code")


def equipment_stats(
    h: DataFrame, i: DataFrame, defect: str = "", latest: bool = False, shared: DataFrame | None = None
) -> DataFrame:
    """Distinct products and distinct defective panels per process, group, line and product type.

    A left join of history and inspection on product and process, with the defect prefix applied to
    the inspection side.  Both sides arrive reduced to one row per join key and equipment, so the
    join grows with products, never with defects times steps.  ``latest`` says that the history is
    already reduced to one step per product, process and line.  With the ``shared`` panels of
    bucketed facts nothing is exchanged before the join.
    """
    key, on = list(EQUIPMENT_KEY), ["product_id", "process_code"]
    steps = h.select("product_id", "process_code", "equipment_line_id", "product_type_code")
    steps = steps if latest else steps.distinct()
    steps = steps.withColumn("equipment_group_id", equip_group("equipment_line_id"))
    found = i.where(starts_with("defect_name", defect))
    panels = panels_per_step(found) if shared is None else panels_in_buckets(found, shared)
    stats = steps.join(panels.own, on, "left").groupBy(*key).agg(
        F.count("product_id").alias("product_count"),
        F.coalesce(F.sum("n_panels"), F.lit(0)).alias("total_defects"),
    )
    if panels.shared is not None:
        met = steps.join(panels.shared, on).select(*key, "panel_id").distinct()
        more = met.groupBy(*key).agg(F.lit(0).cast("long").alias("product_count"), F.count("*").alias("total_defects"))
        both = stats.unionByName(more).groupBy(*key)
        stats = both.agg(*[F.sum(c).alias(c) for c in ("product_count", "total_defects")])
    return stats.withColumn("defect_rate", safe_rate("total_defects", "product_count"))


def overall(stats: DataFrame, min_n: int = 10) -> DataFrame:
    """One row: unweighted mean, sum and number of the rates of equipment with enough products."""
    return stats.where(F.col("product_count") >= min_n).agg(
        F.avg("defect_rate").alias("overall_avg"),
        F.count("*").alias("n_equipment"),
        F.sum("defect_rate").alias("rate_total"),
    )


def with_delta(stats: DataFrame, overall: DataFrame) -> DataFrame:
    """Mean rate of all other equipment minus the overall mean; negative is worse than the peers."""
    one = overall.select(F.struct("overall_avg", "n_equipment", "rate_total")).scalar()
    others = (F.col("_all.rate_total") - F.col("defect_rate")) / (F.col("_all.n_equipment") - 1)
    return (
        stats.withColumn("_all", one)
        .withColumn("overall_avg", F.coalesce("_all.overall_avg", F.lit(0.0)))
        .withColumn(
            "delta_loo",
            F.when(F.col("_all.n_equipment") > 1, others - F.col("overall_avg")).otherwise(F.lit(0.0)),
        )
        .drop("_all")
    )


def within_process_delta(stats: DataFrame) -> DataFrame:
    """Rate minus the mean rate of all equipment of the same process."""
    means = stats.groupBy("process_code").agg(F.avg("defect_rate").alias("process_avg"))
    return stats.join(means, "process_code").withColumn(
        "delta_process", F.col("defect_rate") - F.col("process_avg")
    )
