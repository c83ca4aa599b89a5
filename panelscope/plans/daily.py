"""The daily batch: masters, layouts and the defect mart of some days, written to the lake."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelscope.operators.layout import full_grid, model_layout
from panelscope.functions.clean import hash_bucket
from panelscope.operators.mart import build_glass_stats, daily_masters, panel_counts
from panelscope.operators.updates import upsert_add, upsert_replace, upsert_touch
from panelscope.session import exists, settle
from panelscope.sources.lake import (
    clear_mart_days,
    facility_scan,
    read_lake,
    read_latest,
    replace_partitions,
    write_mart_days,
    write_version,
)


def refresh_mart(i: DataFrame, h: DataFrame, root: str, days: Iterable, facility: str) -> None:
    """Rebuild the mart rows of some days of a facility in one job; all else stays as it is.

    A day that has no rows any more is cleared.
    """
    days = [str(d)[:10] for d in days]
    if not days:
        raise ValueError("name the days to rebuild")
    i, h = facility_scan(i, facility), facility_scan(h, facility)
    write_mart_days(build_glass_stats(i, h, days), root)
    present = {str(r["stat_date"]) for r in panel_counts(i, days).select("stat_date").distinct().collect()}
    clear_mart_days(i.sparkSession, root, facility, set(days) - present)


def accumulate(new: DataFrame, root: str, load: str, buckets: int = 100) -> list[str]:
    """Add the mart rows of a load, unique per facility, product and defect, to totals kept in folders by product hash.

    Only the folders of the new products are read and replaced.  A folder also holds the ids of the loads that are in its
    totals, written with them in one swap: a load that comes again, or that stopped between two folders, is added only
    where it is missing.  Returns the folders it was added to.
    """
    spark, old, ledger = new.sparkSession, None, None
    new = new.withColumn("bucket_id", hash_bucket("product_id", buckets))
    if exists(spark, root):
        old = read_lake(spark, root)
        ledger = old.where("load_id IS NOT NULL").select("bucket_id", "load_id")
        done = sorted({r["bucket_id"] for r in ledger.where(F.col("load_id") == load).select("bucket_id").distinct().collect()})
        if {f"{n:0{max(2, len(str(buckets - 1)))}d}" for n in range(buckets)} <= set(done):
            return []  # nothing of the load is computed
        new = new.where(~F.col("bucket_id").isin(done)) if done else new
    new = settle(new, "new-totals")
    touched = {r["bucket_id"] for r in new.select("bucket_id").distinct().collect()}
    totals = new
    if old is not None:
        todo = F.col("bucket_id").isin(sorted(touched))
        totals = upsert_add(old.where(todo & F.col("load_id").isNull()).select(*new.columns), new)
        ledger = ledger.where(todo)
    if not touched:
        return []
    own = spark.createDataFrame([(b, load) for b in sorted(touched)], "bucket_id string, load_id string")
    ledger = own if ledger is None else ledger.unionByName(own)
    merged = settle(totals.unionByName(ledger, allowMissingColumns=True), "merged-totals")  # it replaces the folders it comes from
    replace_partitions(merged, root, ["bucket_id"])
    return sorted(touched)


def read_totals(spark: SparkSession, root: str) -> DataFrame:
    """The totals that ``accumulate`` keeps, without the ids of loads."""
    return read_lake(spark, root).where("load_id IS NULL").drop("load_id")


def applied_loads(spark: SparkSession, root: str) -> DataFrame:
    """The folders (bucket_id) that each load (load_id) is in."""
    return read_lake(spark, root).where("load_id IS NOT NULL").select("load_id", "bucket_id")


def refresh_master(new: DataFrame, root: str, key: str) -> str:
    """Add new values to a master table and renew the time of known ones."""
    old = read_latest(new.sparkSession, root)
    return write_version(new if old is None else upsert_touch(old, new, [key]), root)


def refresh_masters(i: DataFrame, h: DataFrame, root: str, day) -> None:
    """Model master from the history and defect master from the inspection of one day."""
    refresh_master(daily_masters(h, "model_code", day, "move_in_ymdhms"), f"{root}/model_master", "model_code")
    refresh_master(daily_masters(i, "defect_name", day), f"{root}/defect_master", "defect_name")


def refresh_layouts(part_no: DataFrame, pnl_map: DataFrame, root: str) -> str:
    """Replace the layouts of the models that have one."""
    new = model_layout(part_no, pnl_map)
    old = read_latest(new.sparkSession, root)
    return write_version(new if old is None else upsert_replace(old, new, ["model_code"]), root)


def full_grid_stats(i: DataFrame, h: DataFrame, layout: DataFrame, days: Iterable = ()) -> DataFrame:
    """Mart rows with the panel map over the whole layout of the model."""
    return full_grid(build_glass_stats(i, h, days), layout).withColumn("work_date", F.to_date("work_time"))
