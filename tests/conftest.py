from __future__ import annotations

import datetime as dt
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

HISTORY = (
    "facility_code string, product_id string, product_type_code string, lot_id string, process_code string, "
    "equipment_line_id string, equipment_machine_id string, equipment_path_id string, move_in_ymdhms timestamp_ntz"
)
INSPECTION = (
    "facility_code string, product_id string, process_code string, panel_id string, defect_name string, "
    "inspection_end_ymdhms timestamp_ntz, panel_addr string, panel_x string, panel_y string"
)


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.maxMetadataStringLength", "10000")
        .config("spark.sql.codegen.cache.maxEntries", "2000")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def at(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


@pytest.fixture
def history(spark):
    """Maker of a history frame from (product, process, line, time[, type]) tuples."""

    def make(rows):
        full = []
        for product, process, line, time, *kind in rows:
            kind = kind[0] if kind else "M1"
            full.append(("A1T", product, kind, f"L{product[:2]}", process, line, f"{line}01", f"{line}0101", at(time)))
        return spark.createDataFrame(full, HISTORY)

    return make


@pytest.fixture
def inspection(spark):
    """Maker of an inspection frame from (product, process, panel, defect[, time]) tuples."""

    def make(rows):
        full = []
        for product, process, panel, defect, *time in rows:
            addr = panel[len(product) :] if panel and panel.startswith(product) else None
            x, y = (addr[:-1], addr[-1:]) if addr else (None, None)
            when = at(time[0]) if time else at("2026-01-05T00:00:00")
            full.append(("A1T", product, process, panel, defect, when, addr, x, y))
        return spark.createDataFrame(full, INSPECTION)

    return make


def rows(df, *columns):
    """Rows as a sorted list of tuples."""
    df = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in df.collect()), key=repr)
