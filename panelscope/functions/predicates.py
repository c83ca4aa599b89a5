"""Filters built from request arguments.  Every builder returns a Column; no argument means no filter."""

from __future__ import annotations

import datetime as dt
import re
import unicodedata
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_COMPARE = {
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    "<>": lambda c, v: c != v,
    "=": lambda c, v: c == v,
}
_INTEGER = r"[+-]?\d+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def everything() -> Column:
    return F.lit(True)


def process_filter(codes: Iterable[str], column: Column | str = "process_code") -> Column:
    """Process codes: one expression (``>n >=n <n <=n <>n``, ``a<x<b`` exclusive, ``a-b`` inclusive) or a list.

    The expressions compare numbers, so rows whose code is not a number drop out.
    """
    codes = [c for c in codes]
    if not codes:
        return everything()
    column = _col(column)
    number = F.round(column.try_cast("double")).try_cast("int")
    if len(codes) == 1:
        text = codes[0].strip()
        if m := re.fullmatch(rf"(<>|>=|<=|>|<)\s*({_INTEGER})", text):
            return _COMPARE[m[1]](number, F.lit(int(m[2])))
        if m := re.fullmatch(rf"({_INTEGER})\s*<[^<]*<\s*({_INTEGER})", text):
            return (number > int(m[1])) & (number < int(m[2]))
        if m := re.fullmatch(r"(\d+)\s*-\s*(\d+)", text):
            return number.between(int(m[1]), int(m[2]))
    return column.isin(codes)


def _moment(value: str | dt.datetime) -> Column:
    return F.lit(str(value)).cast("timestamp_ntz")


def time_range(column: Column | str, start=None, end=None) -> Column:
    """Inclusive at both ends; a plain end date means through the end of that day."""
    column, out = _col(column), everything()
    if start:
        out = out & (column >= _moment(start))
    if end:
        text = str(end).strip()
        if re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
            after = dt.date.fromisoformat(text) + dt.timedelta(days=1)
            out = out & (column < _moment(after.isoformat()))
        else:
            out = out & (column <= _moment(text))
    return out


def on_day(column: Column | str, day) -> Column:
    """Calendar day, written so that the scan receives it as a time range."""
    return time_range(column, str(day)[:10], str(day)[:10])


def on_days(column: Column | str, days: Iterable) -> Column:
    """Any of several calendar days; neighbouring days become one range."""
    runs = _runs(days)
    if not runs:
        return everything()
    out = time_range(column, *runs[0])
    for run in runs[1:]:
        out = out | time_range(column, *run)
    return out


def _runs(days: Iterable) -> list[list[dt.date]]:
    """First and last day of each run of neighbouring days."""
    runs: list[list[dt.date]] = []
    for day in sorted({dt.date.fromisoformat(str(d)[:10]) for d in days}):
        if runs and day - runs[-1][1] == dt.timedelta(days=1):
            runs[-1][1] = day
        else:
            runs.append([day, day])
    return runs


def _day_folder(df: DataFrame, column: str) -> Column | None:
    """The day of a row's folder as a number like 20260131, where folders are named after ``column``.

    Inspection has year, month and day of its inspection end as folders, marts the day of their inspection time.
    """
    if column == "inspection_end_ymdhms" and {"year", "month", "day"} <= set(df.columns):
        return F.col("year") * 10_000 + F.col("month") * 100 + F.col("day")
    if column == "inspection_time" and "stat_date" in df.columns:
        day = F.col("stat_date")
        return F.year(day) * 10_000 + F.month(day) * 100 + F.dayofmonth(day)
    return None


def _number(day) -> int:
    return int(str(day).strip()[:10].replace("-", ""))


def in_folders(df: DataFrame, column: str, ranges: Iterable[tuple]) -> Column:
    """What ranges of days of a time say about the folders of ``df``; no condition where folders say nothing.

    Only folder columns are compared, so folders outside of the ranges are neither listed nor opened.  Rows without a folder pass.
    """
    folder, ranges = _day_folder(df, column), list(ranges)
    if folder is None or not ranges:
        return everything()
    out = folder.isNull()
    for start, end in ranges:
        low = folder >= _number(start) if start else F.lit(True)
        out = out | (low & (folder <= _number(end)) if end else low)
    return out


def within(df: DataFrame, column: str, start=None, end=None) -> Column:
    """``time_range`` on a column of ``df``, and what it says about its day folders."""
    found = time_range(column, start, end)
    return found & in_folders(df, column, [(start, end)]) if start or end else found


def within_days(df: DataFrame, column: str, days: Iterable) -> Column:
    """``on_days`` on a column of ``df``, and what it says about its day folders."""
    days = list(days)
    return on_days(column, days) & in_folders(df, column, _runs(days))


def date_between(kind: str, start=None, end=None) -> Column:
    """Days start..end of the work time when kind is "work", else of the inspection time."""
    column = "work_time" if kind == "work" else "inspection_time"
    return time_range(column, start, end) if start and end else everything()


def any_of(column: Column | str, values: Iterable) -> Column:
    values = list(values)
    return _col(column).isin(values) if values else everything()


def tuple_in(df: DataFrame, pairs: Iterable[tuple], columns: tuple[str, ...] = ("equipment_line_id", "process_code")):
    """Rows whose column tuple is one of ``pairs``; an empty list keeps everything."""
    pairs = [tuple(str(v) for v in p) for p in pairs]
    if not pairs:
        return df
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return df.join(df.sparkSession.createDataFrame(pairs, schema), list(columns), "left_semi")


def starts_with(column: Column | str, prefix: str) -> Column:
    """Prefix test; the text is taken literally."""
    return _col(column).startswith(prefix) if prefix else everything()


def nfc(text: str) -> str:
    return unicodedata.normalize("NFC", text)


def equals_nfc(column: Column | str, text: str) -> Column:
    return _col(column) == nfc(text) if text else everything()


def conditions(rules: Mapping[str, str]) -> Column:
    """AND of rules such as ``{"a": "= 'x'", "b": ">= 5", "c": "begins_with '2026-01'"}``."""
    out = everything()
    for name, rule in rules.items():
        m = re.fullmatch(r"\s*(<>|>=|<=|>|<|=|begins_with\b)\s*(.*?)\s*", rule, re.DOTALL)
        operator, text = (m[1], m[2]) if m else ("=", rule.strip())
        if len(text) >= 2 and text[0] == text[-1] == "'":
            text = text[1:-1]
        column = F.col(name)
        if operator == "begins_with":
            out = out & column.cast("string").startswith(text)
        else:
            out = out & _COMPARE[operator](column, F.lit(text))
    return out


def contains_ci(column: Column | str, text: str) -> Column:
    return F.lower(_col(column)).contains(text.lower()) if text else everything()


def narrow(df: DataFrame, models: Iterable[str] = (), process: str = "", equipment: str = "") -> DataFrame:
    """Ranking rows of some models whose process and equipment contain a text, ignoring case."""
    return df.where(
        any_of("product_type_code", models)
        & contains_ci("process_code", process)
        & contains_ci("equipment_line_id", equipment)
    )


def in_group(column: Column | str, groups: Mapping[str, list[str]], name: str) -> Column:
    """Members of a named equipment group."""
    return _col(column).isin(groups[name])
