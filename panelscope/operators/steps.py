"""Process history: latest rows, sequence numbers, lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelscope.functions.predicates import any_of, time_range, within
from panelscope.operators.positions import HOT_ROWS, numbered_in_groups
from panelscope.session import settle

STEP_KEY = ("product_id", "process_code", "equipment_line_id")


def _newest_first(df: DataFrame, keys: Sequence[str], ts: str):
    """Total order: time first, then every other column, so that equal times give one fixed winner."""
    ties = sorted(set(df.columns) - set(keys) - {ts})
    return [F.col(c).desc_nulls_last() for c in (ts, *ties)]


def latest_per(df: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Newest row per key.

    Spark keeps one row per key on the map side already (window group limit), so a hot key sends
    one row per task through the shuffle.  Select the needed columns first: all of them are part
    of the tie-break.
    """
    newest = Window.partitionBy(*keys).orderBy(*_newest_first(df, keys, ts))
    return df.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def dedup_steps(h: DataFrame, ts: str = "move_in_ymdhms") -> DataFrame:
    """Latest row per product, process and line."""
    return latest_per(h, STEP_KEY, ts)


def dedup_products(h: DataFrame, ts: str = "move_in_ymdhms") -> DataFrame:
    """Latest row per product."""
    return latest_per(h, ("product_id",), ts)


def seq_num(
    h: DataFrame, ts: str = "move_in_ymdhms", keys: Sequence[str] = STEP_KEY, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Every row, numbered within its key from the newest (1) on."""
    return numbered_in_groups(h, _newest_first(h, keys, ts), "seq_num", keys, hot_rows)


def product_history(
    h: DataFrame, product_id: str, process_code: str = "", equipment_id: str = ""
) -> DataFrame:
    """Steps of one product in time order."""
    if not product_id:
        raise ValueError("product_id is required")
    wanted = F.col("product_id") == product_id
    wanted &= any_of("process_code", [process_code] if process_code else [])
    wanted &= any_of("equipment_line_id", [equipment_id] if equipment_id else [])
    columns = (
        "product_id",
        "product_type_code",
        "lot_id",
        "equipment_line_id",
        "process_code",
        "move_in_ymdhms",
    )
    return h.where(wanted).select(*columns).orderBy("move_in_ymdhms", "process_code", "equipment_line_id")


def inspections(i: DataFrame, start=None, end=None, process_code: str = "", defect: str = "") -> DataFrame:
    """Raw inspection rows by time, process and defect; page the result with ``page``."""
    wanted = within(i, "inspection_end_ymdhms", start, end)
    wanted &= any_of("process_code", [process_code] if process_code else [])
    wanted &= any_of("defect_name", [defect] if defect else [])
    return i.where(wanted)


# Up to so many keys are broadcast to the scan that they reduce.
FEW_KEYS = 200_000


def rows_of(df: DataFrame, keys: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose columns are among ``keys``.

    The keys are written first, one short row each.  If they are few they are broadcast, so that rows of others leave the
    plan in the scan's stage and only what is asked for is shuffled.
    """
    return df.join(few_keys(keys, columns)[1], list(columns), "left_semi")


def few_keys(keys: DataFrame, columns: Sequence[str]) -> tuple[bool, DataFrame]:
    """Whether there are few distinct keys, and the keys: written, and to be broadcast if they are few."""
    keys = settle(keys.select(*columns).distinct(), "keys")
    few = keys.count() <= FEW_KEYS
    return few, F.broadcast(keys) if few else keys


def row_counts(**tables: DataFrame) -> DataFrame:
    """One row per table with its row count."""
    counts = [t.agg(F.lit(name).alias("table_name"), F.count("*").alias("row_count")) for name, t in tables.items()]
    out = counts[0]
    for one in counts[1:]:
        out = out.unionByName(one)
    return out


def high_water(df: DataFrame, ts: str = "move_in_ymdhms") -> DataFrame:
    """Newest time of a table."""
    return df.agg(F.max(ts).alias("high_water"))


def distinct_products(h: DataFrame) -> DataFrame:
    return h.select("product_id").distinct()
