"""Pre-aggregated defect marts: per product and defect with a panel map, and per product with flags."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelscope.functions.clean import model_code
from panelscope.functions.predicates import within_days
from panelscope.operators.steps import dedup_products, few_keys, latest_per
from panelscope.session import settle

# Cells of the flag map, columns per letter.
FLAG_CELLS = 260
CELLS_PER_LETTER = 10

DEFECT_KEY = ("facility_code", "stat_date", "product_id", "defect_name", "model_code")
PRODUCT = ("facility_code", "product_id")
STEP_ATTRIBUTES = (
    "lot_id",
    "process_code",
    "equipment_line_id",
    "equipment_machine_id",
    "equipment_path_id",
)


def panel_counts(i: DataFrame, days: Iterable = ()) -> DataFrame:
    """Defects per facility, day, product, defect, model and panel, with the last inspection time."""
    known = F.col("defect_name").isNotNull() & F.col("panel_addr").isNotNull()
    return (
        i.where(known & within_days(i, "inspection_end_ymdhms", days))
        .groupBy(
            "facility_code",
            F.to_date("inspection_end_ymdhms").alias("stat_date"),
            "product_id",
            "defect_name",
            model_code("product_id").alias("model_code"),
            "panel_addr",
        )
        .agg(F.count("*").alias("addr_count"), F.max("inspection_end_ymdhms").alias("inspection_time"))
    )


def panel(addr: Column | str, n: Column | str) -> Column:
    """Entry of a panel list."""
    addr, n = (F.col(c) if isinstance(c, str) else c for c in (addr, n))
    return F.struct(addr.alias("addr"), n.alias("n"))


def panel_arrays(panels: Column | str) -> dict[str, Column]:
    """The two parallel arrays of a list of panels, sorted by address."""
    panels = F.array_sort(panels)
    return {
        "panel_addrs": F.transform(panels, lambda p: p["addr"]),
        "panel_map": F.transform(panels, lambda p: p["n"]),
    }


def panel_counts_map(addrs: Column | str, counts: Column | str) -> Column:
    """Map from address to count of two parallel arrays with distinct addresses."""
    known = F.filter(F.zip_with(addrs, counts, panel), lambda p: p["addr"].isNotNull())
    return F.map_from_entries(known)


def glass_defects(counts: DataFrame) -> DataFrame:
    """Per product and defect: total and the parallel lists of panel address and count.

    The lists hold one entry per distinct panel of a glass; rows were counted before.  They are shuffled by product, so
    that what joins the result by product finds it in place.
    """
    return (
        counts.repartition(*PRODUCT)
        .groupBy(*DEFECT_KEY)
        .agg(
            F.max("inspection_time").alias("inspection_time"),
            F.sum("addr_count").alias("total_defects"),
            F.sort_array(F.collect_list(panel("panel_addr", "addr_count"))).alias("_panels"),
        )
        .withColumns({"panel_addrs": F.col("_panels.addr"), "panel_map": F.col("_panels.n")})
        .drop("_panels")
    )


def latest_steps(h: DataFrame) -> DataFrame:
    """Latest step per facility and product with the attributes a mart row carries."""
    columns = ("facility_code", "product_id", "move_in_ymdhms", *STEP_ATTRIBUTES)
    return latest_per(h.select(*columns), ("facility_code", "product_id"), "move_in_ymdhms")


def steps_of(h: DataFrame, counts: DataFrame) -> DataFrame:
    """Steps to attach to counts: those of the counted products, or all if these are many.

    Few products are broadcast, so that no step of others is shuffled.  Beside many a join would shuffle all steps, while
    ``latest_steps`` leaves one row per product of a task to shuffle; steps of others find no counts.
    """
    few, keys = few_keys(counts, PRODUCT)
    return h.join(keys, list(PRODUCT), "left_semi") if few else h


def with_steps(defects: DataFrame, h: DataFrame) -> DataFrame:
    """Attach lot, equipment and work time of the product's latest step, NULL without history."""
    steps = latest_steps(h).withColumnRenamed("move_in_ymdhms", "work_time")
    return defects.join(steps, ["facility_code", "product_id"], "left")


def build_glass_stats(i: DataFrame, h: DataFrame, days: Iterable = (), facility: str = "") -> DataFrame:
    """Mart rows of some days (all without days), keyed by facility, day, product and defect.

    The counts of days are written first, and of the history only the steps of their products are shuffled.
    """
    if facility:
        i, h = (df.where(F.col("facility_code") == facility) for df in (i, h))
    days = list(days)
    counts = panel_counts(i, days)
    if days:
        counts = settle(counts, "day-counts")
        h = steps_of(h, counts)
    rows = with_steps(glass_defects(counts), h)
    return rows.select(
        "facility_code",
        "stat_date",
        "product_id",
        "defect_name",
        "model_code",
        "lot_id",
        "work_time",
        "inspection_time",
        "process_code",
        "equipment_line_id",
        "equipment_machine_id",
        "equipment_path_id",
        "total_defects",
        "panel_map",
        "panel_addrs",
        F.current_timestamp().alias("created_at"),
    )


def panel_index(addr: Column | str = "panel_addr") -> Column:
    """Cell number of a panel address of one letter and one digit: A0 is 1, B0 is 11; else NULL."""
    addr = F.col(addr) if isinstance(addr, str) else addr
    letter = F.ascii(addr) - F.ascii(F.lit("A"))
    digit = F.substring(addr, 2, 1).try_cast("int")
    return F.when(addr.rlike("^[A-Z][0-9]$"), letter * CELLS_PER_LETTER + digit + 1)


def panel_indices(i: DataFrame) -> DataFrame:
    """Distinct cell numbers per product, sorted, and the number of rows with an unreadable address."""
    i = i.where(F.length("panel_addr") >= 2).withColumn("_cell", panel_index())
    return i.groupBy("product_id").agg(
        F.array_sort(F.collect_set("_cell")).alias("defect_indices"),
        F.count_if(F.col("_cell").isNull()).alias("unreadable"),
    )


def build_flag_mart(h: DataFrame, i: DataFrame) -> DataFrame:
    """Per product of the history: lot, day, number of defects and a 0/1 map of 260 cells.

    ``unreadable`` counts the rows whose address is no cell of the map.
    """
    long = F.length("panel_addr") >= 2
    readable = F.when(long, panel_index())
    count = F.col("defect_count") if "defect_count" in i.columns else F.lit(1)
    found = i.groupBy("product_id").agg(
        F.sum(count).alias("_defects"),
        F.collect_set(readable).alias("_cells"),
        F.count_if(long & panel_index().isNull()).alias("unreadable"),
    )
    steps = dedup_products(h.select("product_id", "lot_id", "move_in_ymdhms"))
    cells = F.coalesce("_cells", F.array().cast("array<int>"))
    none = F.array_repeat(F.lit(0), FLAG_CELLS)

    def marked(grid: Column, n: Column) -> Column:
        return F.concat(F.slice(grid, F.lit(1), n - 1), F.array(F.lit(1)), F.slice(grid, n + 1, F.lit(FLAG_CELLS)))

    flags = F.aggregate(cells, none, marked)  # a row writes its few cells only
    return steps.join(found, "product_id", "left").select(
        "product_id",
        "lot_id",
        F.to_date("move_in_ymdhms").alias("work_date"),
        F.coalesce("_defects", F.lit(0)).cast("long").alias("total_defects"),
        flags.alias("panel_map"),
        F.coalesce("unreadable", F.lit(0)).cast("long").alias("unreadable"),
        F.current_timestamp().alias("created_at"),
    )


def mart_stats(mart: DataFrame) -> DataFrame:
    """One row about the flag mart: rows, first and last day, mean and total defects, lots."""
    return mart.agg(
        F.count("*").alias("total_rows"),
        F.min("work_date").alias("min_date"),
        F.max("work_date").alias("max_date"),
        F.avg("total_defects").alias("avg_defects_per_glass"),
        F.coalesce(F.sum("total_defects"), F.lit(0)).alias("total_defects"),
        F.countDistinct("lot_id").alias("unique_lots"),
    )


def daily_masters(df: DataFrame, column: str, day=None, ts: str = "inspection_end_ymdhms") -> DataFrame:
    """Distinct known values of a column on one day, stamped with the time of the run."""
    days = [day] if day else []
    values = df.where(F.col(column).isNotNull() & within_days(df, ts, days)).select(column).distinct()
    return values.withColumn("updated_at", F.current_timestamp())


def unique_lots(mart: DataFrame, h: DataFrame) -> DataFrame:
    """Number of lots the mart's products have in the history."""
    products = mart.select("product_id").distinct()
    lots = h.select("product_id", "lot_id").distinct()
    return lots.join(products, "product_id", "left_semi").agg(F.countDistinct("lot_id").alias("unique_lots"))
