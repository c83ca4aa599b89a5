"""Extraction of a time range from a relational source or any DataFrame."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelscope.functions.clean import HISTORY_MAPPING, INSPECTION_MAPPING, clean_inspection, drop_empty_key, map_source
from panelscope.functions.predicates import time_range

def extract_range(
    df: DataFrame, cols: Sequence[str], ts_col: str, start, end, facility: str | None = None, half_open: bool = False
) -> DataFrame:
    """Configured columns of the rows in start..end, both inclusive, or [start, end) if ``half_open``.

    The facility filter applies only if that column is among the configured ones.
    """
    if not cols:
        raise ValueError("no columns configured")
    wanted = time_range(ts_col, start, None if half_open else end)
    if half_open:
        wanted &= F.col(ts_col) < F.lit(str(end)).cast("timestamp_ntz")
    if facility and "facility_code" in cols:
        wanted &= F.col("facility_code") == facility
    return df.where(wanted).select(*cols)


def time_slices(ts_col: str, start: dt.datetime, end: dt.datetime, n: int, half_open: bool = False) -> list[str]:
    """SQL predicates that cut start..end into n slices without gap or overlap; the end belongs to it unless ``half_open``."""
    if n < 1 or end < start:
        raise ValueError("need at least one slice and start <= end")
    step = (end - start) / n
    edges = [start + k * step for k in range(n)]
    out = [f"{ts_col} >= '{a}' AND {ts_col} < '{b}'" for a, b in zip(edges, edges[1:])]
    return [*out, f"{ts_col} >= '{edges[-1]}' AND {ts_col} {'<' if half_open else '<='} '{end}'"]


def jdbc_range(
    spark: SparkSession,
    url: str,
    table: str,
    cols: Sequence[str],
    ts_col: str,
    start: dt.datetime,
    end: dt.datetime,
    slices: int = 16,
    properties: Mapping[str, str] | None = None,
    facility: str | None = None,
    half_open: bool = False,
) -> DataFrame:
    """Rows of a relational table in start..end, read by one connection per time slice.

    ``facility`` and ``half_open`` act as in ``extract_range``.
    """
    predicates = time_slices(ts_col, start, end, slices, half_open)
    if facility and "facility_code" in cols:
        name = facility.replace("'", "''")
        predicates = [f"{p} AND facility_code = '{name}'" for p in predicates]
    return spark.read.jdbc(url, table, predicates=predicates, properties=dict(properties or {})).select(*cols)


def conform_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The requested columns in that order, NULL where the input has none."""
    return df.select([F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in cols])


def ingest_history(source: DataFrame) -> DataFrame:
    """Source rows as history columns; rows without a product are dropped."""
    return drop_empty_key(map_source(source, HISTORY_MAPPING))


def ingest_inspection(source: DataFrame) -> DataFrame:
    """Source rows as inspection columns with the derived defect name; short terms stay as they are."""
    return clean_inspection(map_source(source, INSPECTION_MAPPING), strict=False, zero_numbers=True)


def _first_load(ts: str, now: dt.datetime, first_days: int | None) -> Column:
    if first_days is None:
        return F.lit(True)
    return F.col(ts) >= _time(now - dt.timedelta(days=first_days))


def _time(value: dt.datetime) -> Column:
    return F.lit(str(value)).cast("timestamp_ntz")


def incremental(df: DataFrame, ts: str, hwm, now: dt.datetime, first_days: int | None = None) -> DataFrame:
    """Rows later than the high-water mark, up to now; without a mark all, or those of the last ``first_days``."""
    later = F.col(ts) > _time(hwm) if hwm is not None else _first_load(ts, now, first_days)
    return df.where(time_range(ts, None, now) & later)


def facility_marks(df: DataFrame, ts: str) -> dict[str, dt.datetime]:
    """High-water mark of each facility, of which there are few: they are folders of the lake."""
    rows = df.groupBy("facility_code").agg(F.max(ts).alias("high_water"))
    return {r["facility_code"]: r["high_water"] for r in rows.collect()}


def incremental_by_facility(
    df: DataFrame, ts: str, marks: Mapping[str, dt.datetime], now: dt.datetime, first_days: int | None = None
) -> DataFrame:
    """The same for all facilities at once, as one filter; facilities without a mark are loaded from the start."""
    known = F.coalesce(F.col("facility_code").isin(list(marks)), F.lit(False))
    wanted = ~known & _first_load(ts, now, first_days)
    for facility, mark in marks.items():
        wanted |= (F.col("facility_code") == facility) & (F.col(ts) > _time(mark))
    return df.where(time_range(ts, None, now) & wanted)
