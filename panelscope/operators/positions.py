"""Numbering, thinning, paging and top-k without pulling a large group into one task."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelscope.session import settle

# Groups of more rows are not sorted by one task.
HOT_ROWS = 1_000_000

# Thinning of target rows, (more rows than, keep every k-th).
TARGET_STRIDES = ((100_000, 10), (10_000, 2), (0, 1))
OTHERS_POINTS = 2000


def numbered(
    df: DataFrame, order: Sequence[Column], name: str, keys: Sequence[str] = (), copies: bool = False
) -> DataFrame:
    """``row_number() over (partition by keys order by order)`` for groups of any size.

    Rows are range-partitioned by (keys, order), so a group that holds a third of the table is still
    spread over many tasks.  Rows are numbered inside their range; only the first group of a range
    can have started in an earlier one, so the missing offset is one value per range.  ``order`` has
    to be a total order for repeatable numbers.  If rows may be ``copies`` of each other in all
    order columns, they first get a number that is stored with them, so that a large group of copies
    can be split as well.
    """
    columns = df.columns
    if copies:
        df = df.withColumn("_copy", F.monotonically_increasing_id())
        order = [*order, F.col("_copy")]
    group = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
    ranged = df.repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys], *order)
    ranged = settle(ranged.withColumn("_range", F.spark_partition_id()), "numbered")
    local = Window.partitionBy("_range", *keys).orderBy(*order)
    ranged = ranged.withColumn("_n", F.row_number().over(local)).withColumn("_group", group)

    edges = ranged.groupBy("_range").agg(
        F.min("_group").alias("_first"), F.max(F.struct("_group", "_n")).alias("_last")
    )
    # per range: first ask how much of its first group came before, then add its own last group
    ask = F.struct(F.col("_first").alias("_group"), F.lit(0).alias("_adds"), F.lit(0).alias("_rows"))
    add = F.struct(
        F.col("_last._group").alias("_group"), F.lit(1).alias("_adds"), F.col("_last._n").alias("_rows")
    )
    running = (
        Window.partitionBy("_group")
        .orderBy("_range", "_adds")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    offsets = (
        edges.select("_range", F.inline(F.array(ask, add)))
        .withColumn("_before", F.sum("_rows").over(running))
        .where("_adds = 0")
        .select("_range", F.col("_group").alias("_first"), "_before")
    )
    before = F.when(F.col("_group").eqNullSafe(F.col("_first")), F.col("_before")).otherwise(0)
    return ranged.join(offsets, "_range").select(*columns, (F.col("_n") + before).cast("long").alias(name))


def numbered_in_groups(
    df: DataFrame, order: Sequence[Column], name: str, keys: Sequence[str], hot_rows: int = HOT_ROWS
) -> DataFrame:
    """The same numbers with a plain window for the groups that one task can sort.

    Only groups of more than ``hot_rows`` rows are numbered range by range.  Their keys, one in ``hot_rows`` rows at most,
    are written and broadcast: a join by the key would bring each of these groups into one task.
    """
    plain = Window.partitionBy(*keys).orderBy(*order)
    hot = df.groupBy(*keys).agg(F.count("*").alias("_rows")).where(F.col("_rows") > hot_rows).drop("_rows")
    hot = settle(hot, "hot")
    if hot.isEmpty():
        return df.withColumn(name, F.row_number().over(plain).cast("long"))
    marks = F.broadcast(hot.select(*[F.col(k).alias(f"_{k}") for k in keys]))
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    small = df.join(marks, same, "left_anti").withColumn(name, F.row_number().over(plain).cast("long"))
    return small.unionByName(numbered(df.join(marks, same, "left_semi"), order, name, keys, copies=True))


def with_rank(df: DataFrame, order: Sequence[Column], limit: int = 0) -> DataFrame:
    """Rank 1..n in result order; a limit keeps the first rows only, 0 keeps all."""
    if limit < 0:
        raise ValueError("limit must not be negative")
    if not limit:
        return numbered(df, order, "rank")
    first = df.orderBy(*order).limit(limit)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def thin(df: DataFrame, label: str, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Every k-th row per label, in the given order, for plotting.

    k depends on the number of rows n: 1, 2 or 10 for Target rows, n / 2000 for the others.  With
    ``keys`` each key is one plot of its own.
    """
    keys = list(keys)
    rows = numbered(df, [F.col(c) for c in order], "_position", [*keys, label])
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_rows"))
    rows = rows.join(sizes, keys) if keys else rows.withColumn("_rows", sizes.scalar())
    return rows.where(F.col("_position") % stride(F.col(label), F.col("_rows")) == 0).select(*df.columns)


def stride(label: Column, rows: Column) -> Column:
    """Distance between kept rows for a label in a plot of so many rows."""
    target = F.coalesce(*[F.when(rows > more, F.lit(k)) for more, k in TARGET_STRIDES], F.lit(1))
    return F.when(label == "Target", target).otherwise(F.greatest(others_stride(rows), F.lit(1)))


def others_stride(rows: Column) -> Column:
    return F.greatest(F.floor(rows / OTHERS_POINTS).cast("long"), F.lit(1).cast("long"))


def page(df: DataFrame, order: Sequence[Column], limit: int = 100, offset: int = 0) -> DataFrame:
    """One page of rows in the given total order."""
    if limit < 0 or offset < 0:
        raise ValueError("limit and offset must not be negative")
    return df.orderBy(*order).offset(offset).limit(limit)


class PageToken(NamedTuple):
    """Where a page ended: the order columns of its last row, and how many rows with these values were given."""

    key: tuple
    given: int


def _literal(value, kind: T.DataType) -> Column:
    return F.lit(str(value) if isinstance(value, dt.date) else value).cast(kind)


def _from_key(df: DataFrame, order: Sequence[str], key: Sequence) -> Column:
    """Rows at or behind a key in ascending order, NULL last.

    The first column's part stands alone, so that it reaches the scan as a range.
    """
    first, *_ = order
    behind = F.lit(True)  # all later columns equal
    for name, value in reversed(list(zip(order, key, strict=True))):
        column = F.col(name)
        if value is None:
            behind = column.isNull() & behind
        else:
            at = _literal(value, df.schema[name].dataType)
            behind = (column > at) | column.isNull() | ((column == at) & behind)
    if key[0] is None:
        return F.col(first).isNull() & behind
    return ((F.col(first) >= _literal(key[0], df.schema[first].dataType)) | F.col(first).isNull()) & behind


def page_after(df: DataFrame, order: Sequence[str], limit: int = 100, token: PageToken | None = None) -> DataFrame:
    """The page behind a token, the first one without.

    Unlike an offset, which sorts all pages before again, the token is a filter on the order columns.  Rows that
    are equal in all of them have to be equal in every column, as only their number is remembered.
    """
    if limit < 1:
        raise ValueError("limit must be positive")
    rows = df if token is None else df.where(_from_key(df, order, token.key))
    rows = rows.orderBy(*[F.col(c).asc_nulls_last() for c in order])
    return (rows.offset(token.given) if token else rows).limit(limit)


def next_token(rows: Sequence[Row], order: Sequence[str], token: PageToken | None = None) -> PageToken | None:
    """The token behind the rows of a page that ``token`` led to; None behind an empty page."""
    if not rows:
        return None
    key = tuple(rows[-1][c] for c in order)
    given = sum(tuple(r[c] for c in order) == key for r in rows)
    return PageToken(key, given + (token.given if token and token.key == key else 0))


def pages(df: DataFrame, order: Sequence[str], limit: int = 100) -> Iterator[list[Row]]:
    """All pages one after the other, for a reader that shows or sends them; only one is held at a time."""
    token = None
    while rows := page_after(df, order, limit, token).collect():
        yield rows
        if len(rows) < limit:
            return
        token = next_token(rows, order, token)


def numbered_pages(df: DataFrame, order: Sequence[str], limit: int = 100, name: str = "page") -> DataFrame:
    """Every row with the number (from 0) of its page in ascending order, NULL last: all pages in one job.

    ``pages`` asks once per page, which suits a reader; for all pages of a large table that reads it as often as it has pages.
    """
    if limit < 1:
        raise ValueError("limit must be positive")
    rows = numbered(df, [F.col(c).asc_nulls_last() for c in order], "_number", copies=True)
    return rows.select(*df.columns, F.floor((F.col("_number") - 1) / limit).cast("long").alias(name))


def page_info(df: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """limit, offset, total_count and has_more of a paged result."""
    total = F.count("*")
    return df.agg(
        F.lit(limit).alias("limit"),
        F.lit(offset).alias("offset"),
        total.alias("total_count"),
        (F.lit(offset + limit) < total).alias("has_more"),
    )


def worst_best(df: DataFrame, n: int = 10, by: str = "delta_loo", ties: Sequence[str] = ()) -> DataFrame:
    """The n worst rows (smallest delta) and the n best ones."""
    tie = [F.col(c) for c in ties]
    worst = df.orderBy(F.col(by).asc_nulls_last(), *tie).limit(n).withColumn("side", F.lit("worst"))
    best = df.orderBy(F.col(by).desc_nulls_last(), *tie).limit(n).withColumn("side", F.lit("best"))
    return worst.unionByName(best)


def first_targets(ranking: DataFrame, n: int = 20) -> DataFrame:
    """The first n distinct equipment and process pairs in ranking order, as targets of a batch analysis."""
    pairs = ranking.groupBy("equipment_line_id", "process_code").agg(F.min("rank").alias("_rank"))
    return pairs.orderBy("_rank").limit(n).drop("_rank")
