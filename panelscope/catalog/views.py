"""The two facts and the dimensions, derived from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelscope.functions.clean import defect_name, once, panel_cols
from panelscope.operators.mart import build_glass_stats
from panelscope.session import settle

_BASE = """
SELECT CONCAT('G1M', CAST(o.o_custkey % 7 AS STRING), LPAD(CAST(l.l_orderkey AS STRING), 8, '0')) AS product_id,
  CONCAT('A1', CASE l.l_suppkey % 4 WHEN 0 THEN 'CVD0' WHEN 1 THEN 'ETCH' WHEN 2 THEN 'PHOT' ELSE 'DEPO' END,
         LPAD(CAST(l.l_suppkey % 20 AS STRING), 2, '0')) AS equipment_line_id,
  CAST(l.l_linenumber * 1000 AS STRING) AS process_code,
  CASE WHEN o.o_custkey % 2 = 0 THEN 'A1T' ELSE 'B2T' END AS facility_code,
  l.l_suppkey, l.l_partkey, l.l_returnflag, l.l_linestatus, l.l_quantity, l.l_shipdate
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey
"""

_HISTORY = """
SELECT facility_code, product_id, SUBSTR(product_id,3,2) AS model_code,
  SUBSTR(product_id,3,2) AS product_type_code,
  SUBSTR(product_id,1,LENGTH(product_id)-2) AS lot_id, process_code, equipment_line_id,
  CONCAT(equipment_line_id, LPAD(CAST(l_suppkey % 40 AS STRING),2,'0')) AS equipment_machine_id,
  CONCAT(equipment_line_id, LPAD(CAST(l_suppkey % 40 AS STRING),2,'0'),
         LPAD(CAST(l_suppkey % 80 AS STRING),2,'0')) AS equipment_path_id,
  l_shipdate AS move_in_ymdhms
FROM {base}
"""

_INSPECTION = """
SELECT facility_code, product_id, SUBSTR(product_id,3,2) AS model_code, process_code,
  CONCAT('TYPE1-', CASE l_returnflag WHEN 'R' THEN 'SPOT' ELSE 'LINE' END, '-SIZE-',
         CASE l_linestatus WHEN 'F' THEN 'DARK' ELSE 'BRIGHT' END) AS def_latest_summary_defect_term_name_s,
  CONCAT(product_id, CHR(CAST(65 + l_partkey % 10 AS INT)), CAST(l_partkey % 7 AS STRING)) AS panel_id,
  l_shipdate + CAST(l_quantity AS INT) * INTERVAL '1' HOUR AS inspection_end_ymdhms,
  CAST(l_quantity AS INT) AS def_size
FROM {base} WHERE l_returnflag <> 'N'
"""

# derived columns, for the SQL side only: the Spark side computes them with the cleaning operators
_CLEAN = """
SELECT *, CONCAT(split_part(def_latest_summary_defect_term_name_s, '-', 2), '-',
                 split_part(def_latest_summary_defect_term_name_s, '-', 4)) AS defect_name,
  SUBSTR(panel_id, LENGTH(product_id) + 1) AS panel_addr,
  SUBSTR(panel_id, LENGTH(product_id) + 1, LENGTH(panel_id) - LENGTH(product_id) - 1) AS panel_x,
  SUBSTR(panel_id, LENGTH(panel_id), 1) AS panel_y
FROM raw_inspection
"""


def with_facts(body: str) -> str:
    """SQL text with the facts in front: tables base, history, raw_inspection and inspection."""
    ctes = (
        ("base", _BASE.format(lineitem="lineitem", orders="orders")),
        ("history", _HISTORY.format(base="base")),
        ("raw_inspection", _INSPECTION.format(base="base")),
        ("inspection", _CLEAN),
    )
    prefix = ",\n".join(f"{name} AS ({text})" for name, text in ctes)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {prefix},\n{body[5:]}"
    return f"WITH {prefix}\n{body}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = spark.sql(_BASE, lineitem=table(spark, sf_dir, "lineitem"), orders=table(spark, sf_dir, "orders"))
    return once(base, "product_id", "product_id")


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_HISTORY, base=_base(spark, sf_dir))


def raw_inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_INSPECTION, base=_base(spark, sf_dir))


def inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaned(raw_inspection(spark, sf_dir))


def _cleaned(raw: DataFrame) -> DataFrame:
    return panel_cols(raw.withColumn("defect_name", defect_name("def_latest_summary_defect_term_name_s")))


def facts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """History and inspection for queries that read them several times: the join they come from is written once."""
    base = spark.sql(_BASE, lineitem=table(spark, sf_dir, "lineitem"), orders=table(spark, sf_dir, "orders"))
    base = settle(base, "base")
    return spark.sql(_HISTORY, base=base), _cleaned(spark.sql(_INSPECTION, base=base))


def part_no(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a model."""
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("M"), (F.col("p_partkey") % 7).cast("string")).alias("model_code"),
        F.concat(F.lit("PN"), F.col("p_partkey").cast("string")).alias("part_no_name"),
    )


def pnl_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel layout per part: 10 x 7 addresses on two of every five parts, none on the rest."""
    letters = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda n: F.char(n + 65))
    panels = F.flatten(
        F.transform(
            letters,
            lambda x: F.transform(F.sequence(F.lit(0), F.lit(6)), lambda y: F.concat(x, y.cast("string"))),
        )
    )
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("PN"), F.col("p_partkey").cast("string")).alias("part_no_name"),
        F.when(F.col("p_partkey") % 5 < 2, panels).alias("ref_panels"),
    )


# SQL only: the defect mart.  Each inspection row is ranked among those of its panel and glass, and the lists are
# read off the counted panels; the last step of a product is the greatest row of its history.
_MART = """
finds AS (
  SELECT facility_code, inspection_end_ymdhms::DATE AS stat_date, product_id, defect_name, product_id[3:4] AS model_code, panel_addr,
    inspection_end_ymdhms AS found_at FROM inspection WHERE defect_name || panel_addr IS NOT NULL),
counts AS (SELECT * EXCLUDE (found_at), COUNT(*) AS addr_count, MAX(found_at) AS inspection_time FROM finds GROUP BY ALL),
defects AS (
  SELECT * EXCLUDE (panels), list_transform(panels, lambda p: p.n) AS panel_map, list_transform(panels, lambda p: p.a) AS panel_addrs
  FROM (SELECT facility_code, stat_date, product_id, defect_name, model_code, MAX(inspection_time) AS inspection_time,
      SUM(addr_count)::BIGINT AS total_defects, list_sort(list({a: panel_addr, n: addr_count})) AS panels
    FROM counts GROUP BY ALL)),
latest_step AS (
  SELECT facility_code, product_id, s[1] AS work_time, s[2] AS equipment_line_id, s[3] AS equipment_machine_id, s[4] AS equipment_path_id, s[5] AS lot_id,
    s[6] AS process_code
  FROM (SELECT facility_code, product_id, MAX((move_in_ymdhms, equipment_line_id, equipment_machine_id, equipment_path_id, lot_id, process_code)) AS s
    FROM history GROUP BY facility_code, product_id)),
glass_stats AS (SELECT * FROM defects LEFT JOIN latest_step USING (facility_code, product_id))
"""


def with_mart(body: str) -> str:
    """SQL text with the facts and the defect mart (table glass_stats) in front."""
    body = body.strip()
    if body.upper().startswith("WITH "):
        return with_facts(f"WITH {_MART},\n{body[5:]}")
    return with_facts(f"WITH {_MART}\n{body}")


def mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defect mart of all days, written once as a job would."""
    return mart_of(*facts(spark, sf_dir))


def mart_of(h: DataFrame, i: DataFrame) -> DataFrame:
    """Defect mart of given facts, written once."""
    stats = build_glass_stats(i, h)
    return settle(stats.drop("created_at"), "glass_stats")
