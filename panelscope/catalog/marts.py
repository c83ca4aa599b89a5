"""Queries on the defect marts, the equipment hierarchy and model layouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelscope.catalog.registry import listed, query, rounded
from panelscope.catalog.views import facts, history, inspection, mart, mart_of, part_no, pnl_map, with_facts, with_mart
from panelscope.operators import cells, layout, mart as marts, nodes
from panelscope.operators.glass import Request, heatmap, in_order
from panelscope.plans.daily import full_grid_stats
from panelscope.plans.hierarchy import HierarchyParams, hierarchy_analysis

MART_COLUMNS = (
    "facility_code, stat_date, product_id, defect_name, model_code, lot_id, work_time, inspection_time, process_code, equipment_line_id, "
    "equipment_machine_id, equipment_path_id, total_defects, array_to_string(panel_map, ',') AS panel_map, "
    "array_to_string(panel_addrs, ',') AS panel_addrs"
)


# ---- defect mart ---------------------------------------------------------------------------------


@query("panel_counts", with_mart("SELECT * FROM counts"))
def panel_counts(spark, sf):
    return marts.panel_counts(inspection(spark, sf))


@query(
    "glass_defects",
    with_mart(
        """SELECT facility_code, stat_date, product_id, defect_name, model_code, inspection_time, total_defects,
             array_to_string(panel_map, ',') AS panel_map, array_to_string(panel_addrs, ',') AS panel_addrs FROM defects"""
    ),
)
def glass_defects(spark, sf):
    rows = marts.glass_defects(marts.panel_counts(inspection(spark, sf)))
    return listed(rows, "panel_map", "panel_addrs")


@query("glass_stats", with_mart(f"SELECT {MART_COLUMNS} FROM glass_stats"))
def glass_stats(spark, sf):
    rows = marts.build_glass_stats(inspection(spark, sf), history(spark, sf)).drop("created_at")
    return listed(rows, "panel_map", "panel_addrs")


@query(
    "glass_stats_of_days",
    with_mart(
        f"""SELECT {MART_COLUMNS} FROM glass_stats
            WHERE facility_code = 'A1T' AND stat_date BETWEEN DATE '1997-06-01' AND DATE '1997-06-10'"""
    ),
)
def glass_stats_of_days(spark, sf):
    days = [f"1997-06-{d:02d}" for d in range(1, 11)]
    rows = marts.build_glass_stats(inspection(spark, sf), history(spark, sf), days, "A1T").drop("created_at")
    return listed(in_order(rows, "glass_stats"), "panel_map", "panel_addrs")


# ---- flag mart -----------------------------------------------------------------------------------

# a cell is found by its letter's place in the alphabet; each product of the history gets the whole grid, then marks
FLAGS = """
hit AS (SELECT DISTINCT product_id, 10 * strpos('ABCDEFGHIJKLMNOPQRSTUVWXYZ', panel_addr[1]) - 9 + panel_addr[2]::INT AS cell
  FROM {inspection} WHERE regexp_full_match(panel_addr, '[A-Z][0-9]')),
seen AS (SELECT product_id, COUNT(*) AS n, COUNT_IF(LENGTH(panel_addr) >= 2 AND NOT regexp_full_match(panel_addr, '[A-Z][0-9]')) AS unreadable
  FROM {inspection} GROUP BY product_id),
last AS (SELECT product_id, MAX((move_in_ymdhms, lot_id)) AS step FROM history GROUP BY product_id),
marks AS (SELECT last.product_id, list(IF(hit.cell IS NULL, 0, 1) ORDER BY g.cell) AS panel_map
  FROM last, (SELECT unnest(range(1, 261)) AS cell) g LEFT JOIN hit ON hit.product_id = last.product_id AND hit.cell = g.cell GROUP BY last.product_id),
flags AS (SELECT product_id, step[2] AS lot_id, step[1]::DATE AS work_date, COALESCE(n, 0) AS total_defects, panel_map, COALESCE(unreadable, 0) AS unreadable
  FROM last JOIN marks USING (product_id) LEFT JOIN seen USING (product_id))
"""


def flag_sql(body: str, inspection: str = "inspection", before: str = "") -> str:
    return with_facts(f"WITH {before}{FLAGS.replace('{inspection}', inspection)}\n{body}")


# addresses over all letters, and of two digits where the size has two
WIDE = """wide AS (SELECT * REPLACE (chr(CAST(65 + def_size % 26 AS INTEGER)) || CAST(IF(def_size % 7 = 0, def_size, def_size % 10) AS VARCHAR) AS panel_addr)
  FROM inspection),
"""


def _wide(spark, sf):
    size = F.col("def_size")
    number = F.when(size % 7 == 0, size).otherwise(size % 10)
    return inspection(spark, sf).withColumn("panel_addr", F.concat(F.char(size % 26 + 65), number.cast("string")))


def _flag_mart(spark, sf):
    return marts.build_flag_mart(history(spark, sf), inspection(spark, sf)).drop("created_at")


@query(
    "panel_indices",
    flag_sql(
        """SELECT product_id, COALESCE(string_agg(cell, ',' ORDER BY cell), '') AS defect_indices, ANY_VALUE(unreadable) AS unreadable
           FROM (SELECT product_id, unreadable FROM seen WHERE product_id IN (SELECT product_id FROM wide WHERE LENGTH(panel_addr) >= 2))
           LEFT JOIN hit USING (product_id) GROUP BY product_id""",
        "wide",
        WIDE,
    ),
)
def panel_indices(spark, sf):
    return listed(marts.panel_indices(_wide(spark, sf)), "defect_indices")


@query(
    "flag_mart",
    flag_sql("SELECT product_id, lot_id, work_date, total_defects, array_to_string(panel_map, ',') AS panel_map, unreadable FROM flags"),
)
def flag_mart(spark, sf):
    return listed(_flag_mart(spark, sf), "panel_map")


@query(
    "flag_mart_of_all_letters",
    flag_sql(
        "SELECT product_id, lot_id, work_date, total_defects, array_to_string(panel_map, ',') AS panel_map, unreadable FROM flags", "wide", WIDE
    ),
)
def flag_mart_of_all_letters(spark, sf):
    return listed(marts.build_flag_mart(history(spark, sf), _wide(spark, sf)).drop("created_at"), "panel_map")


@query(
    "flag_mart_stats",
    flag_sql(
        """SELECT COUNT(*) AS total_rows, MIN(work_date) AS min_date, MAX(work_date) AS max_date, ROUND(AVG(total_defects), 6) AS avg_defects_per_glass,
             CAST(SUM(total_defects) AS BIGINT) AS total_defects, COUNT(DISTINCT lot_id) AS unique_lots FROM flags"""
    ),
)
def flag_mart_stats(spark, sf):
    return rounded(marts.mart_stats(_flag_mart(spark, sf)), "avg_defects_per_glass")


@query(
    "lots_of_mart_products",
    with_mart("SELECT COUNT(DISTINCT h.lot_id) AS unique_lots FROM glass_stats g JOIN history h USING (product_id)"),
)
def lots_of_mart_products(spark, sf):
    rows = marts.glass_defects(marts.panel_counts(inspection(spark, sf)))
    return marts.unique_lots(rows, history(spark, sf))


@query(
    "panel_flag_sums",
    flag_sql(
        """SELECT chr(CAST(65 + pos // 10 AS INTEGER)) AS x, CAST(pos % 10 AS VARCHAR) AS y, CAST(SUM(flag) AS BIGINT) AS total_defects,
             COUNT(*) AS total_glasses, ROUND(AVG(flag), 6) AS defect_rate
           FROM (SELECT unnest(panel_map) AS flag, unnest(range(0, 260)) AS pos FROM flags) GROUP BY pos""",
        "wide",
        WIDE,
    ),
)
def panel_flag_sums(spark, sf):
    flags = marts.build_flag_mart(history(spark, sf), _wide(spark, sf))
    return rounded(cells.sum_panel_flags(flags), "defect_rate")


# ---- masters and layouts -------------------------------------------------------------------------


@query(
    "models_of_day",
    with_facts(
        "SELECT DISTINCT model_code FROM history WHERE CAST(move_in_ymdhms AS DATE) = DATE '1997-06-15' AND model_code IS NOT NULL"
    ),
)
def models_of_day(spark, sf):
    return marts.daily_masters(history(spark, sf), "model_code", "1997-06-15", "move_in_ymdhms").drop("updated_at")


@query(
    "defects_of_day",
    with_facts(
        """SELECT DISTINCT defect_name FROM inspection
           WHERE CAST(inspection_end_ymdhms AS DATE) = DATE '1997-06-15' AND defect_name IS NOT NULL"""
    ),
)
def defects_of_day(spark, sf):
    return marts.daily_masters(inspection(spark, sf), "defect_name", "1997-06-15").drop("updated_at")


LAYOUT = """
grid70 AS (SELECT LIST(chr(CAST(65 + x AS INTEGER)) || CAST(y AS VARCHAR) ORDER BY x, y) AS panels
  FROM (SELECT unnest(range(0, 10)) AS x), (SELECT unnest(range(0, 7)) AS y)),
part_no AS (SELECT 'M' || CAST(p_partkey % 7 AS VARCHAR) AS model_code, 'PN' || CAST(p_partkey AS VARCHAR) AS part_no_name FROM part),
pnl_map AS (SELECT 'PN' || CAST(p_partkey AS VARCHAR) AS part_no_name, CASE WHEN p_partkey % 5 < 2 THEN panels END AS ref_panels FROM part, grid70),
layout AS (SELECT model_code, panels AS ref_panels FROM grid70, (SELECT DISTINCT model_code FROM part_no
  WHERE part_no_name IN (SELECT part_no_name FROM pnl_map WHERE len(ref_panels) > 0)))
"""


def _layout(spark, sf):
    return layout.model_layout(part_no(spark, sf), pnl_map(spark, sf)).drop("updated_at")


@query("model_layouts", f"WITH {LAYOUT} SELECT model_code, array_to_string(ref_panels, ',') AS ref_panels FROM layout")
def model_layouts(spark, sf):
    return listed(_layout(spark, sf), "ref_panels")


@query(
    "full_grid",
    with_mart(
        f"""WITH {LAYOUT},
        cells AS (SELECT stat_date, product_id, defect_name, model_code, unnest(ref_panels) AS addr, unnest(range(0, 70)) AS pos
          FROM defects JOIN layout USING (model_code)),
        filled AS (SELECT c.stat_date, c.product_id, c.defect_name, LIST(COALESCE(k.addr_count, 0) ORDER BY pos) AS panel_map,
            LIST(c.addr ORDER BY pos) AS panel_addrs
          FROM cells c LEFT JOIN counts k ON k.stat_date = c.stat_date AND k.product_id = c.product_id AND k.defect_name = c.defect_name
            AND k.panel_addr = c.addr GROUP BY ALL)
        SELECT g.stat_date, g.product_id, g.defect_name, g.model_code, g.lot_id, CAST(g.work_time AS DATE) AS work_date, g.total_defects,
          array_to_string(COALESCE(f.panel_map, g.panel_map), ',') AS panel_map,
          array_to_string(COALESCE(f.panel_addrs, g.panel_addrs), ',') AS panel_addrs,
          IF(f.panel_map IS NULL, 0, g.total_defects - list_sum(f.panel_map)::BIGINT) AS outside_defects
        FROM glass_stats g LEFT JOIN filled f USING (stat_date, product_id, defect_name)"""
    ),
)
def full_grid(spark, sf):
    rows = full_grid_stats(inspection(spark, sf), history(spark, sf), _layout(spark, sf))
    columns = ("stat_date", "product_id", "defect_name", "model_code", "lot_id", "work_date", "total_defects")
    return listed(rows.select(*columns, "panel_map", "panel_addrs", "outside_defects"), "panel_map", "panel_addrs")


@query(
    "full_grid_outside",
    with_mart(
        f"""WITH {LAYOUT}
        SELECT product_id, defect_name, stat_date, total_defects, IF(l.model_code IS NULL, 0, n)::BIGINT AS outside_defects, TRUE AS whole
        FROM glass_stats g LEFT JOIN layout l USING (model_code)
        JOIN (SELECT product_id, defect_name, stat_date, COUNT_IF(panel_y IN ('1', '3')) AS n FROM
                (SELECT *, CAST(inspection_end_ymdhms AS DATE) AS stat_date FROM inspection) GROUP BY ALL) USING (product_id, defect_name, stat_date)"""
    ),
)
def full_grid_outside(spark, sf):
    """Addresses of two rows of panels lie outside every layout."""
    i = inspection(spark, sf)
    odd = F.when(F.col("panel_y").isin("1", "3"), F.concat(F.lit("Z"), "panel_addr")).otherwise(F.col("panel_addr"))
    rows = full_grid_stats(i.withColumn("panel_addr", odd), history(spark, sf), _layout(spark, sf))
    inside = F.aggregate("panel_map", F.lit(0).cast("long"), lambda n, x: n + x)
    whole = (inside + F.col("outside_defects") == F.col("total_defects")).alias("whole")
    return rows.select("product_id", "defect_name", "stat_date", "total_defects", "outside_defects", whole)


@query(
    "requested_models",
    """SELECT model, model IN (SELECT 'M' || CAST(p_partkey % 5 AS VARCHAR) FROM part) AS known FROM (SELECT unnest(['M1', 'M6', 'M4', 'X9']) AS model)""",
)
def requested_models(spark, sf):
    found, unknown = layout.known_requested(["M1", "M6", "M4", "X9"], _models(spark, sf))
    return spark.createDataFrame([*((m, True) for m in found), *((m, False) for m in unknown)], "model string, known boolean")


def _models(spark, sf):
    number = F.substring("part_no_name", F.lit(3), F.length("part_no_name")).cast("int") % 5
    return part_no(spark, sf).select(F.concat(F.lit("M"), number.cast("string")).alias("model_code"))


@query(
    "known_models",
    with_mart(
        """SELECT TRUE AS known, g.model_code, COUNT(*) AS n FROM glass_stats g WHERE model_code IN (SELECT 'M' || CAST(p_partkey % 5 AS VARCHAR) FROM part) GROUP BY ALL
           UNION ALL SELECT FALSE, g.model_code, COUNT(*) FROM (SELECT DISTINCT model_code FROM glass_stats) g
             WHERE model_code NOT IN (SELECT 'M' || CAST(p_partkey % 5 AS VARCHAR) FROM part) GROUP BY ALL"""
    ),
)
def known_models(spark, sf):
    kept, unknown = layout.known_models(mart(spark, sf), _models(spark, sf))
    parts = [
        df.groupBy(F.lit(known).alias("known"), "model_code").agg(F.count("*").alias("n"))
        for known, df in ((True, kept), (False, unknown))
    ]
    return parts[0].unionByName(parts[1])


# ---- hierarchy -----------------------------------------------------------------------------------


def node_sql(body: str, level: str, where: str = "TRUE", extra: str = "") -> str:
    """Node results at a level from rows of the mart; ``extra`` adds a mart column to the node."""
    columns = ["process_code", "equipment_line_id", "equipment_machine_id", "equipment_path_id"]
    depth = ["process", "line", "machine", "path"].index(level)
    node = ", ".join(c if n <= depth else f"CAST(NULL AS VARCHAR) AS {c}" for n, c in enumerate(columns))
    keys = ", ".join([*columns, *([extra] if extra else [])])
    same = " AND ".join(f"p.{c} IS NOT DISTINCT FROM q.{c}" for c in keys.split(", "))
    ctes = f"""
    rows_of AS (SELECT {node}{', ' + extra if extra else ''}, product_id, strftime(work_time, '%Y-%m-%d') AS work_date, total_defects, panel_map, panel_addrs
      FROM glass_stats WHERE {where}),
    visits AS (SELECT {keys}, work_date, list(DISTINCT product_id) AS products, SUM(total_defects)::BIGINT AS n FROM rows_of GROUP BY {keys}, work_date),
    trend AS (SELECT {keys}, work_date, n / len(products)::DOUBLE AS dpu FROM visits),
    totals AS (SELECT {keys}, len(list_distinct(flatten(list(products)))) AS total_products, SUM(n)::BIGINT AS total_defects,
      SUM(n) / len(list_distinct(flatten(list(products))))::DOUBLE AS dpu FROM visits GROUP BY {keys}),
    trends AS (SELECT {keys}, string_agg(work_date, ',' ORDER BY work_date) AS days, ROUND(SUM(dpu), 6) AS dpu_sum FROM trend GROUP BY {keys}),
    panels AS (SELECT {keys}, e[1] AS addr, SUM(e[2])::BIGINT AS cnt FROM (SELECT {keys}, unnest(list_zip(panel_addrs, panel_map)) AS e FROM rows_of) GROUP BY {keys}, addr),
    maps AS (SELECT {keys}, LIST(addr ORDER BY addr) AS panel_addrs, LIST(cnt ORDER BY addr) AS panel_map FROM panels GROUP BY {keys})
    """
    return with_mart(f"WITH {ctes}\n{body.replace('{keys}', keys).replace('{same}', same)}")


TOTALS = "SELECT {keys}, total_products, total_defects, ROUND(dpu, 6) AS dpu FROM totals"
ANALYSIS = """
SELECT p.*, array_to_string(q.panel_addrs, ',') AS panel_addrs, array_to_string(q.panel_map, ',') AS panel_map, d.days, d.dpu_sum
FROM (SELECT {keys}, total_products, total_defects, ROUND(dpu, 6) AS dpu FROM totals) p LEFT JOIN maps q ON {same}
LEFT JOIN (SELECT * FROM trends) d ON """


def analysis_sql(level: str, where: str = "TRUE") -> str:
    columns = ["process_code", "equipment_line_id", "equipment_machine_id", "equipment_path_id"]
    return node_sql(ANALYSIS + " AND ".join(f"p.{c} IS NOT DISTINCT FROM d.{c}" for c in columns), level, where)


def _flat(nodes_df):
    """Trend lists as text of days and the sum of their values."""
    days = F.array_join(F.transform("daily_dpu", lambda d: d["work_date"]), ",")
    total = F.aggregate("daily_dpu", F.lit(0.0), lambda acc, d: acc + d["dpu"])
    out = nodes_df.withColumns({"days": days, "dpu_sum": F.round(total, 6)}).drop("daily_dpu")
    return rounded(listed(out, "panel_addrs", "panel_map"), "dpu")


@query("node_totals_by_line", node_sql(TOTALS, "line"))
def node_totals_by_line(spark, sf):
    return rounded(nodes.node_totals(mart(spark, sf), "line"), "dpu")


@query(
    "node_maps_by_machine",
    node_sql(
        "SELECT {keys}, array_to_string(panel_addrs, ',') AS panel_addrs, array_to_string(panel_map, ',') AS panel_map FROM maps",
        "machine",
    ),
)
def node_maps_by_machine(spark, sf):
    return listed(nodes.node_maps(mart(spark, sf), "machine"), "panel_addrs", "panel_map")


@query("node_trend_by_process", node_sql("SELECT {keys}, work_date, ROUND(dpu, 6) AS dpu FROM trend", "process"))
def node_trend_by_process(spark, sf):
    trend = nodes.node_trend(mart(spark, sf), "process")
    return rounded(trend.select(*nodes.NODE, F.inline("daily_dpu")), "dpu")


def _totals_sql(level: str) -> str:
    depth = list(nodes.LEVELS).index(level) + 1
    keys = [c if n < depth else f"NULL AS {c}" for n, c in enumerate(nodes.NODE)]
    return f"""SELECT '{level}' AS level, {', '.join(keys)}, COUNT(DISTINCT product_id) AS total_products, SUM(total_defects)::BIGINT AS total_defects,
      ROUND(SUM(total_defects)::DOUBLE / NULLIF(COUNT(DISTINCT product_id), 0), 6) AS dpu
      FROM glass_stats GROUP BY {', '.join(nodes.NODE[:depth])}"""


@query("node_totals_of_all_levels", with_mart(" UNION ALL ".join(_totals_sql(level) for level in nodes.LEVELS)))
def node_totals_of_all_levels(spark, sf):
    return rounded(nodes.totals_of_all_levels(nodes.product_bitmaps(mart(spark, sf))), "dpu")


@query("hierarchy_by_path", analysis_sql("path"))
def hierarchy_by_path(spark, sf):
    return _flat(hierarchy_analysis(mart(spark, sf)))


@query(
    "hierarchy_by_line_of_model",
    analysis_sql(
        "line",
        """model_code = 'M1' AND defect_name = 'SPOT-DARK' AND equipment_line_id = 'A1CVD000'
           AND CAST(inspection_time AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'""",
    ),
)
def hierarchy_by_line_of_model(spark, sf):
    params = HierarchyParams(
        start="1996-01-01", end="1999-12-31", model_code="M1", defect_name="SPOT-DARK", equipment_line_id="A1CVD000"
    )
    return _flat(hierarchy_analysis(mart(spark, sf), params))


@query(
    "hierarchy_by_process_of_work_days",
    analysis_sql("process", "CAST(work_time AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1997-03-31'"),
)
def hierarchy_by_process_of_work_days(spark, sf):
    params = HierarchyParams(start="1997-01-01", end="1997-03-31", date_type="work", analysis_level="process")
    return _flat(hierarchy_analysis(mart(spark, sf), params))


@query(
    "hierarchy_of_products_and_days",
    analysis_sql(
        "machine",
        """product_id IN (SELECT DISTINCT product_id FROM history WHERE equipment_line_id = 'A1CVD004') AND facility_code = 'A1T'
           AND equipment_machine_id = 'A1CVD00404' AND CAST(inspection_time AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'""",
    ),
)
def hierarchy_of_products_and_days(spark, sf):
    """All filters hold together."""
    h = history(spark, sf)
    products = [r[0] for r in h.where("equipment_line_id = 'A1CVD004'").select("product_id").distinct().collect()]
    params = HierarchyParams(
        start="1996-01-01", end="1997-12-31", facility_code="A1T", product_ids=products, equipment_machine_id="A1CVD00404"
    )
    return _flat(hierarchy_analysis(mart(spark, sf), params))


@query(
    "hierarchy_of_product_frame",
    analysis_sql("line", "product_id IN (SELECT product_id FROM history WHERE equipment_line_id LIKE 'A1CVD%') AND facility_code = 'A1T'"),
)
def hierarchy_of_product_frame(spark, sf):
    """Products of any number as a frame."""
    h, i = facts(spark, sf)
    products = h.where(F.col("equipment_line_id").startswith("A1CVD"))
    return _flat(hierarchy_analysis(mart_of(h, i), HierarchyParams(facility_code="A1T", analysis_level="line", products=products)))


@query("hierarchy_of_path", analysis_sql("path", "equipment_path_id = 'A1CVD0040404'"))
def hierarchy_of_path(spark, sf):
    return _flat(hierarchy_analysis(mart(spark, sf), HierarchyParams(equipment_path_id="A1CVD0040404")))


@query(
    "panel_rates",
    node_sql(
        f"""WITH_LAYOUT
        SELECT {{keys}}, addr, n AS defects, ROUND(n / CAST(total_products AS DOUBLE), 6) AS rate FROM (
          SELECT t.process_code, t.equipment_line_id, t.equipment_machine_id, t.equipment_path_id, t.model_code, t.total_products, g.addr, COALESCE(p.cnt, 0) AS n
          FROM totals t JOIN (SELECT model_code, unnest(ref_panels) AS addr FROM layout) g ON g.model_code = t.model_code
          LEFT JOIN panels p ON p.process_code IS NOT DISTINCT FROM t.process_code AND p.equipment_line_id IS NOT DISTINCT FROM t.equipment_line_id
            AND p.model_code = t.model_code AND p.addr = g.addr)""",
        "line",
        extra="model_code",
    )
    .replace("WITH_LAYOUT", "")
    .replace("trends AS (", f"{LAYOUT.strip()},\n    trends AS (", 1),
)
def panel_rates(spark, sf):
    found = hierarchy_analysis(mart(spark, sf), HierarchyParams(analysis_level="line"), by=("model_code",))
    rates = layout.panel_rates(found, _layout(spark, sf))
    zipped = F.inline(F.arrays_zip("panel_addrs", "panel_map", "panel_rates"))
    rows = rates.select(*nodes.NODE, "model_code", zipped)
    return rounded(
        rows.withColumnsRenamed({"panel_addrs": "addr", "panel_map": "defects", "panel_rates": "rate"}), "rate"
    )


FILL = ("1997-01-01", "1997-01-31")


@query(
    "filled_trend_lists",
    node_sql(
        """SELECT t.process_code, t.equipment_line_id, t.equipment_machine_id, t.equipment_path_id, d.work_date, COALESCE(ROUND(r.dpu, 6), 0) AS dpu
           FROM totals t CROSS JOIN (SELECT strftime(unnest(generate_series(DATE '1997-01-01', DATE '1997-01-31', INTERVAL 1 DAY)), '%Y-%m-%d') AS work_date) d
           LEFT JOIN trend r ON r.process_code IS NOT DISTINCT FROM t.process_code AND r.equipment_line_id IS NOT DISTINCT FROM t.equipment_line_id
             AND r.work_date = d.work_date""",
        "line",
    ),
)
def filled_trend_lists(spark, sf):
    found = hierarchy_analysis(mart(spark, sf), HierarchyParams(analysis_level="line"))
    filled = nodes.fill_days(found, *FILL)
    return rounded(filled.select(*nodes.NODE, F.inline("daily_dpu")), "dpu")


@query(
    "filled_trend_rows",
    with_facts(
        """SELECT k.defect_name, d.work_date, COALESCE(r.n, 0) AS n FROM (SELECT DISTINCT defect_name FROM inspection) k
           CROSS JOIN (SELECT strftime(unnest(generate_series(DATE '1997-01-01', DATE '1997-01-31', INTERVAL 1 DAY)), '%Y-%m-%d') AS work_date) d
           LEFT JOIN (SELECT defect_name, strftime(inspection_end_ymdhms, '%Y-%m-%d') AS work_date, COUNT(*) AS n FROM inspection
             GROUP BY ALL) r ON r.defect_name = k.defect_name AND r.work_date = d.work_date"""
    ),
)
def filled_trend_rows(spark, sf):
    day = F.date_format("inspection_end_ymdhms", "yyyy-MM-dd").alias("work_date")
    trend = inspection(spark, sf).groupBy("defect_name", day).agg(F.count("*").alias("n"))
    return nodes.fill_day_rows(trend, *FILL, ["defect_name"], ["n"])


# ---- heatmap forms -------------------------------------------------------------------------------

CELL_RATES = """
rates AS (SELECT CASE WHEN t.product_id IS NOT NULL THEN 'Target' ELSE 'Others' END AS group_type, panel_x AS x, panel_y AS y,
    COUNT(*) / CAST(COUNT(DISTINCT i.product_id) AS DOUBLE) AS defect_rate
  FROM inspection i LEFT JOIN (SELECT DISTINCT product_id FROM history WHERE equipment_line_id = 'A1DEPO03') t USING (product_id) GROUP BY ALL)
"""


def _cells(spark, sf):
    return heatmap(history(spark, sf), inspection(spark, sf), Request(equipment_ids=("A1DEPO03",)))


@query(
    "heatmap_matrix",
    with_facts(
        f"""WITH {CELL_RATES} SELECT group_type, y, {', '.join(f"ROUND(COALESCE(MAX(CASE x WHEN '{x}' THEN defect_rate END), 0), 6) AS {x}" for x in 'ABCDEFGHIJ')}
            FROM rates GROUP BY group_type, y"""
    ),
)
def heatmap_matrix(spark, sf):
    matrix = cells.heatmap_matrix(_cells(spark, sf))
    return rounded(matrix, *[c for c in matrix.columns if c not in ("group_type", "y")])


@query(
    "heatmap_intensity",
    with_facts(
        f"""WITH {CELL_RATES} SELECT group_type, x, y, ROUND(defect_rate, 6) AS defect_rate,
              ROUND(defect_rate / (SELECT MAX(defect_rate) FROM rates), 6) AS intensity FROM rates"""
    ),
)
def heatmap_intensity(spark, sf):
    rows = cells.intensity(_cells(spark, sf)).select("group_type", "x", "y", "defect_rate", "intensity")
    return rounded(rows, "defect_rate", "intensity")
