"""Time the headline analyses.  Prints one JSON line.

BENCH_SF_DIR names the test tables, BENCH_CPUS the number of local cores, BENCH_RUNS how often each
query is timed after one warm-up run (the median counts).  BENCH_ONLY may name the queries to run.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelscope.catalog import views
from panelscope.operators.glass import Request, daily_level, glass_level, heatmap, lot_level
from panelscope.operators.mart import build_flag_mart, build_glass_stats
from panelscope.operators.layout import full_grid, model_layout
from panelscope.operators.positions import first_targets
from panelscope.plans.batch import batch_analysis, target_pairs
from panelscope.plans.hierarchy import HierarchyParams, hierarchy_analysis
from panelscope.plans.ranking import equipment_ranking
from panelscope.session import scratch_path
from panelscope.sources.facts import write_facts
from panelscope.sources.lake import write_version

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

PERIOD = ("1996-01-01", "1999-12-31")
TARGET = Request(*PERIOD, equipment_ids=("A1CVD000", "A1ETCH01"))


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        # a long-lived session keeps the generated code of more than the default 100 stages
        .config("spark.sql.codegen.cache.maxEntries", "2000")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def drain(*frames: DataFrame) -> None:
    """Compute every row of the frames without keeping them."""
    for df in frames:
        df.write.format("noop").mode("overwrite").save()


def timed(run: Callable[[], object]) -> float:
    started = time.perf_counter()
    run()
    return time.perf_counter() - started


def main() -> None:
    spark = session()
    lake = scratch_path(spark, "bench")

    def ingest() -> list[str]:
        facts = {"history": views.history, "inspection": views.inspection}
        return [
            write_version(rows(spark, SF_DIR).repartition(int(CPUS)), f"{lake}/{name}") for name, rows in facts.items()
        ]

    def build_mart() -> str:
        return write_version(build_glass_stats(i, h), f"{lake}/mart")

    times: dict[str, float] = {}
    h, i = (spark.read.parquet(path) for path in ingest())
    mart = spark.read.parquet(build_mart())
    layout = model_layout(views.part_no(spark, SF_DIR), views.pnl_map(spark, SF_DIR))
    facts = write_facts(h, i, f"{lake}/facts", buckets=int(CPUS) * 2)
    targets = target_pairs(first_targets(equipment_ranking(h, i)))
    week = Request("1997-06-01", "1997-06-07", equipment_ids=TARGET.equipment_ids)
    one_line = HierarchyParams(
        *PERIOD, model_code="M1", defect_name="SPOT-DARK", equipment_line_id="A1CVD000"
    )

    queries: dict[str, Callable[[], object]] = {
        "ingest_facts": ingest,
        "equipment_ranking_top100": lambda: drain(equipment_ranking(h, i, limit=100)),
        "equipment_ranking_all": lambda: drain(equipment_ranking(h, i)),
        "equipment_ranking_of_defect": lambda: drain(equipment_ranking(h, i, *PERIOD, defect="SPOT", limit=100)),
        "equipment_ranking_of_buckets": lambda: drain(equipment_ranking(facts.history, facts.inspection, shared=facts.shared)),
        "mart_build": build_mart,
        "flag_mart_build": lambda: drain(build_flag_mart(h, i)),
        "full_grid": lambda: drain(full_grid(mart, layout)),
        "hierarchy_by_path": lambda: drain(hierarchy_analysis(mart)),
        "hierarchy_by_line_filtered": lambda: drain(hierarchy_analysis(mart, one_line)),
        "glass_level": lambda: drain(glass_level(h, i, TARGET)),
        "lot_level": lambda: drain(lot_level(h, i, TARGET)),
        "daily_level": lambda: drain(daily_level(h, i, TARGET)),
        "heatmap": lambda: drain(heatmap(h, i, TARGET)),
        "glass_level_of_a_week": lambda: drain(glass_level(h, i, week)),
        "heatmap_of_a_week": lambda: drain(heatmap(h, i, week)),
        "batch_of_20_targets": lambda: drain(*batch_analysis(h, i, targets, Request(*PERIOD))),
    }
    only = os.environ.get("BENCH_ONLY", "").split()
    for name, run in queries.items():
        if only and name not in only:
            continue
        run()
        times[name] = statistics.median(timed(run) for _ in range(RUNS))
        print(f"{name} {times[name]:.2f}", file=sys.stderr, flush=True)

    line = {
        "metric": "analytics_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": {name: round(t, 3) for name, t in times.items()},
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
