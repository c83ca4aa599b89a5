"""Combining an old table state with new rows.  Parquet has no MERGE: every function returns the new state."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelscope.operators.mart import panel, panel_counts_map


def _matched(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer join on unique keys: columns ``o`` and ``n`` hold the two rows, NULL where absent."""
    left, right = old.select(F.struct("*").alias("o")), new.select(F.struct("*").alias("n"))
    same = F.lit(True)
    for k in keys:
        same &= F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
    return left.join(right, same, "full")


def _in_order(addrs: Column, counts: Column) -> Column:
    """Whether two parallel arrays list panels by address, each once; not true of empty or missing ones."""
    return (F.size(addrs) == F.size(counts)) & (F.size(addrs) > 0) & (F.sort_array(F.array_distinct(addrs)) == addrs)


def _added_panels() -> Column:
    """Counts of the old and the new panel map added per address, as a struct of the two parallel arrays.

    Arrays in order stay as they are if the other row is absent, and are added entry by entry if both rows list the same
    panels, as on a layout; only what is left goes through maps.
    """
    zero = F.lit(0).cast("long")

    def arrays(addrs: Column, counts: Column) -> Column:
        return F.struct(addrs.cast("array<string>").alias("panel_addrs"), counts.cast("array<bigint>").alias("panel_map"))

    def ready(side):
        addrs = F.col(f"{side}.panel_addrs")
        return _in_order(addrs, F.col(f"{side}.panel_map")) & F.get(addrs, F.lit(0)).isNotNull()

    def own(side):
        return arrays(F.col(f"{side}.panel_addrs"), F.transform(f"{side}.panel_map", lambda n: F.coalesce(n.cast("long"), zero)))

    def counts(side):
        known = panel_counts_map(f"{side}.panel_addrs", f"{side}.panel_map").cast("map<string,bigint>")
        return F.coalesce(known, F.create_map().cast("map<string,bigint>"))

    def added(a: Column, b: Column) -> Column:
        return F.coalesce(a.cast("long"), zero) + F.coalesce(b.cast("long"), zero)

    same = (F.col("o.panel_addrs") == F.col("n.panel_addrs")) & (F.size("o.panel_map") == F.size("n.panel_map"))
    merged = F.sort_array(F.map_entries(F.map_zip_with(counts("o"), counts("n"), lambda _, a, b: added(a, b))))
    return (
        F.when(F.col("n").isNull() & ready("o"), own("o"))
        .when(F.col("o").isNull() & ready("n"), own("n"))
        .when(same & ready("o"), arrays(F.col("o.panel_addrs"), F.zip_with("o.panel_map", "n.panel_map", added)))
        .otherwise(F.get(F.transform(F.array(merged), lambda e: arrays(e["key"], e["value"])), F.lit(0)))
    )


def upsert_add(
    old: DataFrame,
    new: DataFrame,
    keys: Sequence[str] = ("facility_code", "product_id", "defect_name"),
    keep_old: Sequence[str] = ("work_time",),
) -> DataFrame:
    """Accumulate new mart rows: totals and panel counts add up, attributes come from the new row.

    Columns in ``keep_old`` keep the value a row was inserted with.  Both sides have unique keys, so
    the join is one to one.
    """
    panels = ("panel_map", "panel_addrs")
    rows = _matched(old, new, keys)
    if any(c in panels for c in old.columns):
        rows = rows.withColumn("_panels", _added_panels())

    def column(c: str) -> Column:
        if c == "total_defects":
            return F.coalesce(F.col(f"o.{c}"), F.lit(0)) + F.coalesce(F.col(f"n.{c}"), F.lit(0))
        if c in panels:
            return F.col(f"_panels.{c}")
        first, second = ("o", "n") if c in keep_old else ("n", "o")
        return F.when(F.col(first).isNotNull(), F.col(f"{first}.{c}")).otherwise(F.col(f"{second}.{c}"))

    return rows.select([column(c).alias(c) for c in old.columns])


def _panels_of_days(days: str, known: Column) -> Column:
    """Counts of all days of a key added per address, as a struct of the two parallel arrays; NULL without any.

    ``days`` lists the arrays of each day.  Those of one day stay as they are if they are in order.
    """

    def arrays(addrs: Column, counts: Column) -> Column:
        return F.struct(addrs.alias("panel_addrs"), counts.cast("array<bigint>").alias("panel_map"))

    def entries(d: Column) -> Column:
        return F.zip_with(d["panel_addrs"], d["panel_map"], panel)

    def total(a: Column, pairs: Column) -> Column:
        n = F.transform(F.filter(pairs, lambda p: p["addr"].eqNullSafe(a)), lambda p: p["n"].cast("long"))
        return F.aggregate(n, F.lit(None).cast("long"), lambda acc, x: F.coalesce(acc + x, acc, x))

    def added(pairs: Column) -> Column:
        addrs = F.sort_array(F.array_distinct(pairs["addr"]))
        return F.when(F.size(pairs) > 0, arrays(addrs, F.transform(addrs, lambda a: total(a, pairs))))

    first = F.get(days, F.lit(0))
    single = (F.size(days) == 1) & _in_order(first["panel_addrs"], first["panel_map"])
    listed = F.filter(days, lambda d: d["panel_addrs"].isNotNull() & d["panel_map"].isNotNull())
    pairs = F.flatten(F.transform(listed, entries))
    several = F.get(F.transform(F.array(pairs), added), F.lit(0))
    return F.when(known, F.when(single, arrays(first["panel_addrs"], first["panel_map"])).otherwise(several))


def total_of_days(daily: DataFrame) -> DataFrame:
    """Day-keyed mart rows added up per facility, product and defect, in one shuffle.

    The days of a key come together, as many as it has; a key of one day, the usual case, keeps its lists.  Keys with
    a NULL have no lists.
    """
    key = ["facility_code", "product_id", "defect_name"]
    attributes = [c for c in daily.columns if c not in (*key, "stat_date", "total_defects", "panel_map", "panel_addrs")]
    known = F.col(key[0]).isNotNull() & F.col(key[1]).isNotNull() & F.col(key[2]).isNotNull()
    rows = daily.groupBy(*key).agg(
        F.sum("total_defects").alias("total_defects"),
        F.max(F.struct("stat_date", *attributes)).alias("_last"),
        F.collect_list(F.struct("panel_addrs", "panel_map")).alias("_days"),
    )
    return rows.withColumn("_panels", _panels_of_days("_days", known)).select(
        *key, *[F.col(f"_last.{c}").alias(c) for c in attributes], "total_defects", "_panels.panel_map", "_panels.panel_addrs"
    )


def upsert_touch(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Master upsert: every key once, with its newest updated_at."""
    both = old.select(*keys, "updated_at").unionByName(new.select(*keys, "updated_at"))
    return both.groupBy(*keys).agg(F.max("updated_at").alias("updated_at"))


def upsert_replace(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows replace old rows of the same key."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def retain(df: DataFrame, ts: str, days: int, as_of) -> DataFrame:
    """Rows not older than so many days."""
    return df.where(F.col(ts) >= F.lit(retention_start(days, as_of).isoformat()).cast("timestamp_ntz"))


def retention_start(days: int, as_of) -> dt.date:
    """First day that stays."""
    if days <= 0:
        raise ValueError("retention needs a positive number of days")
    return dt.date.fromisoformat(str(as_of)[:10]) - dt.timedelta(days=days)


def evolve(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both; a column that one side lacks is NULL there."""
    return a.unionByName(b, allowMissingColumns=True)


def add_columns(df: DataFrame, **types: str) -> DataFrame:
    """Add columns that are not there yet, as NULL."""
    missing = {c: F.lit(None).cast(t) for c, t in types.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df
