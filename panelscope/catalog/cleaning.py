"""Queries on cleaning rules and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelscope.catalog.registry import query, rounded
from panelscope.catalog.views import history, inspection, mart, raw_inspection, table, with_facts, with_mart
from panelscope.functions import clean, predicates
from panelscope.operators.glass import label
from panelscope.operators.lookup import with_names
from panelscope.plans.hierarchy import HierarchyParams, hierarchy_filter
from panelscope.sources.extract import ingest_history, ingest_inspection

TERM = "def_latest_summary_defect_term_name_s"


@query(
    "defect_names",
    with_facts(
        "SELECT def_latest_summary_defect_term_name_s AS term, defect_name, COUNT(*) AS n FROM inspection GROUP BY ALL"
    ),
)
def defect_names(spark, sf):
    rows = raw_inspection(spark, sf).withColumn("defect_name", clean.defect_name(TERM))
    return rows.groupBy(F.col(TERM).alias("term"), "defect_name").agg(F.count("*").alias("n"))


@query(
    "defect_names_of_short_terms",
    """SELECT p_name AS term, split_part(t, '-', 2) || '-' || split_part(t, '-', 4) AS loose_name,
         trim(split_part(t, '-', 2)) || '-' || trim(split_part(t, '-', 4)) AS strict_name,
         short AS short_loose, CAST(NULL AS VARCHAR) AS short_strict, COUNT(*) AS n
       FROM (SELECT p_name, p_type || '- ' || p_name || ' -' || p_brand || '- x' AS t,
               p_type || '-' || p_name AS short FROM part) GROUP BY ALL""",
)
def defect_names_of_short_terms(spark, sf):
    part = table(spark, sf, "part")
    t = F.concat("p_type", F.lit("- "), "p_name", F.lit(" -"), "p_brand", F.lit("- x"))
    short = F.concat("p_type", F.lit("-"), "p_name")
    return part.groupBy(
        F.col("p_name").alias("term"),
        clean.defect_name(t, strict=False).alias("loose_name"),
        clean.defect_name(t).alias("strict_name"),
        clean.defect_name(short, strict=False).alias("short_loose"),
        clean.defect_name(short).alias("short_strict"),
    ).agg(F.count("*").alias("n"))


@query(
    "panel_addresses",
    with_facts("SELECT panel_addr, panel_x, panel_y, COUNT(*) AS n FROM inspection GROUP BY ALL"),
)
def panel_addresses(spark, sf):
    rows = clean.panel_cols(raw_inspection(spark, sf))
    return rows.groupBy("panel_addr", "panel_x", "panel_y").agg(F.count("*").alias("n"))


@query(
    "model_codes",
    with_facts(
        """SELECT SUBSTR(product_id, 3, 2) AS model_code,
             COALESCE(CASE WHEN facility_code = 'A1T' THEN model_code END, 'UNKNOWN') AS given, COUNT(*) AS n
           FROM history GROUP BY ALL"""
    ),
)
def model_codes(spark, sf):
    given = F.when(F.col("facility_code") == "A1T", F.col("model_code"))
    return (
        history(spark, sf)
        .groupBy(clean.model_code("product_id").alias("model_code"), clean.model_code("product_id", given).alias("given"))
        .agg(F.count("*").alias("n"))
    )


@query(
    "lot_ids",
    with_facts(
        "SELECT SUBSTR(product_id, 1, LENGTH(product_id) - 2) AS lot_id, COUNT(*) AS n FROM inspection GROUP BY ALL"
    ),
)
def lot_ids(spark, sf):
    return inspection(spark, sf).groupBy(clean.lot_id("product_id").alias("lot_id")).agg(F.count("*").alias("n"))


@query(
    "equipment_groups",
    with_facts(
        """SELECT SUBSTRING(equipment_line_id, 3, 4) AS equipment_group_id, equipment_line_id, COUNT(*) AS n
           FROM history GROUP BY ALL"""
    ),
)
def equipment_groups(spark, sf):
    group = clean.equip_group("equipment_line_id").alias("equipment_group_id")
    return history(spark, sf).groupBy(group, "equipment_line_id").agg(F.count("*").alias("n"))


@query(
    "parsed_times",
    """SELECT o_orderpriority, COUNT(t) AS readable, COUNT(*) - COUNT(t) AS unreadable, MIN(t) AS first_time
       FROM (SELECT o_orderpriority, TRY_CAST(CASE o_orderstatus WHEN 'F' THEN o_orderpriority
               ELSE CAST(o_orderdate AS VARCHAR) END AS TIMESTAMP) AS t FROM orders) GROUP BY ALL""",
)
def parsed_times(spark, sf):
    text = F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).otherwise(
        F.col("o_orderdate").cast("string")
    )
    rows = table(spark, sf, "orders").withColumn("t", clean.parse_ts(text))
    return rows.groupBy("o_orderpriority").agg(
        F.count("t").alias("readable"),
        F.count_if(F.col("t").isNull()).alias("unreadable"),
        F.min("t").alias("first_time"),
    )


@query(
    "parsed_numbers",
    """SELECT event_type, COUNT(v) AS readable, ROUND(SUM(v), 2) AS total, ROUND(SUM(COALESCE(v, 0)), 2) AS zero_total,
         CAST(SUM(CAST(FLOOR(COALESCE(v, 0)) AS BIGINT)) AS BIGINT) AS unsigned_total
       FROM (SELECT event_type, TRY_CAST(CASE WHEN value > 10 THEN props ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS v
             FROM events) GROUP BY ALL""",
)
def parsed_numbers(spark, sf):
    text = F.when(F.col("value") > 10, F.col("props")).otherwise(F.col("value").cast("string"))
    rows = table(spark, sf, "events").withColumn("text", text)
    return rows.groupBy("event_type").agg(
        F.count(clean.parse_num("text")).alias("readable"),
        F.round(F.sum(clean.parse_num("text")), 2).alias("total"),
        F.round(F.sum(clean.parse_num("text", null_as_zero=True)), 2).alias("zero_total"),
        F.sum(clean.unsigned("text")).alias("unsigned_total"),
    )


# the digest as a number modulo 100, folded over its four 32-bit limbs
BUCKET_SQL = """
  (SELECT LPAD(CAST((((((a * 4294967296 + b) % 100) * 4294967296 + c) % 100) * 4294967296 + d) % 100 AS VARCHAR), 2, '0')
   FROM (SELECT CAST('0x' || SUBSTR(m, 1, 8) AS BIGINT) % 100 AS a, CAST('0x' || SUBSTR(m, 9, 8) AS BIGINT) AS b,
           CAST('0x' || SUBSTR(m, 17, 8) AS BIGINT) AS c, CAST('0x' || SUBSTR(m, 25, 8) AS BIGINT) AS d
         FROM (SELECT md5(product_id) AS m)))
"""


@query(
    "hash_buckets",
    with_facts(f"SELECT product_id, {BUCKET_SQL} AS bucket_id, COUNT(*) AS n FROM history GROUP BY product_id"),
)
def hash_buckets(spark, sf):
    rows = history(spark, sf).groupBy("product_id").agg(F.count("*").alias("n"))
    return rows.withColumn("bucket_id", clean.hash_bucket("product_id"))


@query(
    "process_filters",
    with_facts(
        """SELECT equipment_line_id, COUNT_IF(p > 3000) AS above, COUNT_IF(p >= 3000) AS from_on,
             COUNT_IF(p < 3000) AS below, COUNT_IF(p <= 3000) AS up_to, COUNT_IF(p <> 3000) AS other,
             COUNT_IF(p > 2000 AND p < 5000) AS between_exclusive, COUNT_IF(p BETWEEN 2000 AND 5000) AS between_inclusive,
             COUNT_IF(process_code IN ('1000', '7000')) AS in_list, COUNT(*) AS everything
           FROM (SELECT *, TRY_CAST(process_code AS INTEGER) AS p FROM history) GROUP BY ALL"""
    ),
)
def process_filters(spark, sf):
    filters = {
        "above": ["> 3000"],
        "from_on": [">=3000"],
        "below": ["<3000"],
        "up_to": ["<= 3000"],
        "other": ["<> 3000"],
        "between_exclusive": ["2000 < x < 5000"],
        "between_inclusive": ["2000-5000"],
        "in_list": ["1000", "7000"],
        "everything": [],
    }
    counts = [F.count_if(predicates.process_filter(codes)).alias(name) for name, codes in filters.items()]
    return history(spark, sf).groupBy("equipment_line_id").agg(*counts)


@query(
    "time_ranges",
    with_facts(
        """SELECT process_code, COUNT(*) AS n, MIN(inspection_end_ymdhms) AS first_time, MAX(inspection_end_ymdhms) AS last_time
           FROM inspection WHERE inspection_end_ymdhms >= TIMESTAMP '1996-01-01' AND inspection_end_ymdhms < TIMESTAMP '1997-01-01'
           GROUP BY ALL"""
    ),
)
def time_ranges(spark, sf):
    ts = "inspection_end_ymdhms"
    rows = inspection(spark, sf).where(predicates.time_range(ts, "1996-01-01", "1996-12-31"))
    return rows.groupBy("process_code").agg(
        F.count("*").alias("n"), F.min(ts).alias("first_time"), F.max(ts).alias("last_time")
    )


@query(
    "calendar_day",
    with_facts(
        """SELECT product_id, process_code, panel_addr, COUNT(*) AS n FROM inspection
           WHERE strftime(inspection_end_ymdhms, '%Y-%m-%d') = '1997-06-15' GROUP BY ALL"""
    ),
)
def calendar_day(spark, sf):
    rows = inspection(spark, sf).where(predicates.on_day("inspection_end_ymdhms", "1997-06-15"))
    return rows.groupBy("product_id", "process_code", "panel_addr").agg(F.count("*").alias("n"))


@query(
    "mart_dates",
    with_mart(
        """SELECT defect_name, COUNT_IF(CAST(inspection_time AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1996-06-30') AS inspected,
             COUNT_IF(CAST(work_time AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1996-06-30') AS worked
           FROM glass_stats GROUP BY ALL"""
    ),
)
def mart_dates(spark, sf):
    period = ("1996-01-01", "1996-06-30")
    return mart(spark, sf).groupBy("defect_name").agg(
        F.count_if(predicates.date_between("inspection", *period)).alias("inspected"),
        F.count_if(predicates.date_between("work", *period)).alias("worked"),
    )


@query(
    "in_lists",
    with_facts(
        """SELECT equipment_line_id, process_code, model_code, COUNT(*) AS n FROM history
           WHERE equipment_line_id IN ('A1CVD000', 'A1ETCH01') AND process_code IN ('1000', '3000')
             AND model_code IN ('M1', 'M2') GROUP BY ALL"""
    ),
)
def in_lists(spark, sf):
    wanted = predicates.any_of("equipment_line_id", ["A1CVD000", "A1ETCH01"])
    wanted &= predicates.any_of("process_code", ["1000", "3000"]) & predicates.any_of("model_code", ["M1", "M2"])
    wanted &= predicates.any_of("facility_code", [])
    rows = history(spark, sf).where(wanted)
    return rows.groupBy("equipment_line_id", "process_code", "model_code").agg(F.count("*").alias("n"))


@query(
    "tuple_in_list",
    with_facts(
        """SELECT equipment_line_id, process_code, COUNT(*) AS n FROM history
           WHERE (equipment_line_id, process_code) IN (('A1CVD000', '1000'), ('A1ETCH01', '2000')) GROUP BY ALL"""
    ),
)
def tuple_in_list(spark, sf):
    rows = predicates.tuple_in(history(spark, sf), [("A1CVD000", "1000"), ("A1ETCH01", "2000")])
    return rows.groupBy("equipment_line_id", "process_code").agg(F.count("*").alias("n"))


@query(
    "defect_prefix",
    with_facts("SELECT defect_name, COUNT(*) AS n FROM inspection WHERE defect_name LIKE 'SPOT%' GROUP BY ALL"),
)
def defect_prefix(spark, sf):
    rows = inspection(spark, sf).where(predicates.starts_with("defect_name", "SPOT"))
    return rows.groupBy("defect_name").agg(F.count("*").alias("n"))


@query(
    "unicode_literal",
    """SELECT source, COUNT(*) AS n FROM documents WHERE contains(text, nfc_normalize('é')) GROUP BY ALL""",
)
def unicode_literal(spark, sf):
    # the literal arrives decomposed, as some file systems and keyboards produce it
    rows = table(spark, sf, "documents").where(F.col("text").contains(predicates.nfc("é")))
    return rows.groupBy("source").agg(F.count("*").alias("n"))


@query(
    "condition_rules",
    with_facts(
        """SELECT facility_code, process_code, COUNT(*) AS n FROM inspection
           WHERE facility_code = 'A1T' AND def_size >= 10 AND process_code > '1000'
             AND CAST(inspection_end_ymdhms AS VARCHAR) LIKE '1997-%' GROUP BY ALL"""
    ),
)
def condition_rules(spark, sf):
    rules = {
        "facility_code": "= 'A1T'",
        "def_size": ">= 10",
        "process_code": "> '1000'",
        "inspection_end_ymdhms": "begins_with '1997-'",
    }
    rows = inspection(spark, sf).where(predicates.conditions(rules))
    return rows.groupBy("facility_code", "process_code").agg(F.count("*").alias("n"))


@query(
    "empty_keys_dropped",
    with_facts(
        """SELECT facility_code, COUNT(*) AS n FROM (SELECT facility_code,
             CASE process_code WHEN '1000' THEN '' WHEN '2000' THEN NULL ELSE product_id END AS product_id FROM history)
           WHERE LENGTH(product_id) > 0 GROUP BY ALL"""
    ),
)
def empty_keys_dropped(spark, sf):
    key = F.when(F.col("process_code") == "1000", F.lit("")).when(F.col("process_code") != "2000", F.col("product_id"))
    rows = clean.drop_empty_key(history(spark, sf).withColumn("product_id", key))
    return rows.groupBy("facility_code").agg(F.count("*").alias("n"))


@query(
    "ingested_history",
    with_facts(
        """SELECT product_id, process_code, move_in_ymdhms, equipment_line_id, equipment_line_id AS equipment_id,
             equipment_machine_id, equipment_path_id, COUNT(*) AS n FROM history GROUP BY ALL"""
    ),
)
def ingested_history(spark, sf):
    source = history(spark, sf).select(
        F.col("product_id").alias("glass_id"),
        "process_code",
        F.col("move_in_ymdhms").alias("time_ymdhms"),
        "equipment_line_id",
        "equipment_machine_id",
        "equipment_path_id",
        "facility_code",
    )
    rows = ingest_history(source)
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))


@query(
    "ingested_inspection",
    with_facts(
        """SELECT facility_code, process_code, defect_name, COUNT(*) AS n, CAST(SUM(IF(def_size = 5, 0, def_size)) AS DOUBLE) AS size_total,
             MAX(inspection_end_ymdhms) AS last_time, SUM(GREATEST(def_size - 10, 0))::BIGINT AS code_total,
             SUM(def_size + 0.5) FILTER (def_size % 2 = 0)::DOUBLE AS point_total FROM inspection GROUP BY ALL"""
    ),
)
def ingested_inspection(spark, sf):
    size = F.col("def_size")
    text = {
        "def_size": F.when(size != 5, size.cast("string")),
        "inspection_end_ymdhms": F.col("inspection_end_ymdhms").cast("string"),
        # negative codes, codes with a fraction, and points that are no numbers
        "def_pnt_g": F.concat((size - 10).cast("string"), F.lit(".7")),
        "def_pnt_x": F.when(size % 2 == 0, (size + 0.5).cast("string")).otherwise("n/a"),
    }
    rows = ingest_inspection(raw_inspection(spark, sf).withColumns(text))
    return rows.groupBy("facility_code", "process_code", "defect_name").agg(
        F.count("*").alias("n"),
        F.sum("def_size").alias("size_total"),
        F.max("inspection_end_ymdhms").alias("last_time"),
        F.sum("def_pnt_g").alias("code_total"),
        F.nullif(F.sum("def_pnt_x"), F.lit(0.0)).alias("point_total"),
    )


@query(
    "defect_count_default",
    with_facts(
        """SELECT process_code, CAST(SUM(COALESCE(CASE WHEN def_size > 25 THEN def_size END, 1)) AS BIGINT) AS defects
           FROM inspection GROUP BY ALL"""
    ),
)
def defect_count_default(spark, sf):
    given = F.when(F.col("def_size") > 25, F.col("def_size"))
    rows = clean.defaults(inspection(spark, sf).withColumn("defect_count", given))
    return rows.groupBy("process_code").agg(F.sum("defect_count").alias("defects"))


@query(
    "group_labels",
    with_facts(
        """SELECT CASE WHEN t.product_id IS NOT NULL THEN 'Target' ELSE 'Others' END AS group_type, h.process_code, COUNT(*) AS n
           FROM history h LEFT JOIN (SELECT DISTINCT product_id FROM history WHERE equipment_line_id = 'A1PHOT02') t
             ON h.product_id = t.product_id GROUP BY ALL"""
    ),
)
def group_labels(spark, sf):
    h = history(spark, sf)
    rows = label(h, h.where(F.col("equipment_line_id") == "A1PHOT02"))
    return rows.groupBy("group_type", "process_code").agg(F.count("*").alias("n"))


@query(
    "safe_rates",
    with_facts(
        """SELECT h.product_id, h.n AS steps, COALESCE(i.n, 0) AS defects, ROUND(COALESCE(h.n / NULLIF(CAST(i.n AS DOUBLE), 0), 0), 6) AS steps_per_defect
           FROM (SELECT product_id, COUNT(*) AS n FROM history GROUP BY 1) h
           LEFT JOIN (SELECT product_id, COUNT(*) AS n FROM inspection GROUP BY 1) i USING (product_id)"""
    ),
)
def safe_rates(spark, sf):
    steps = history(spark, sf).groupBy("product_id").agg(F.count("*").alias("steps"))
    defects = inspection(spark, sf).groupBy("product_id").agg(F.count("*").alias("defects"))
    rows = steps.join(defects, "product_id", "left").fillna(0, ["defects"])
    return rounded(rows.withColumn("steps_per_defect", clean.safe_rate("steps", "defects")), "steps_per_defect")


@query(
    "process_names",
    with_facts(
        """SELECT process_code, CASE process_code WHEN '1000' THEN 'Photo Lithography' WHEN '2000' THEN 'Etching'
             ELSE process_code END AS process_name, COUNT(*) AS n,
             COUNT_IF(equipment_line_id IN ('A1CVD000', 'A1ETCH01')) AS critical FROM history GROUP BY ALL"""
    ),
)
def process_names(spark, sf):
    groups = {"critical": ["A1CVD000", "A1ETCH01"]}
    critical = F.count_if(predicates.in_group("equipment_line_id", groups, "critical")).alias("critical")
    rows = history(spark, sf).groupBy("process_code").agg(F.count("*").alias("n"), critical)
    return with_names(rows, {"1000": "Photo Lithography", "2000": "Etching"})


@query(
    "hierarchy_filters",
    with_mart(
        """SELECT 'line' AS filter, model_code, COUNT(*) AS n FROM glass_stats WHERE model_code = 'M1' AND defect_name = 'SPOT-DARK'
             AND equipment_line_id = 'A1CVD000' AND CAST(inspection_time AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1999-12-31' GROUP BY ALL
           UNION ALL SELECT 'process', model_code, COUNT(*) FROM glass_stats WHERE TRY_CAST(process_code AS INTEGER) >= 3000
             AND CAST(work_time AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1999-12-31' GROUP BY ALL"""
    ),
)
def hierarchy_filters(spark, sf):
    rows, period = mart(spark, sf), {"start": "1995-01-01", "end": "1999-12-31"}
    line = HierarchyParams(model_code="M1", defect_name="SPOT-DARK", equipment_line_id="A1CVD000", **period)
    process = HierarchyParams(process_code=">= 3000", date_type="work", **period)
    parts = [
        hierarchy_filter(rows, p).groupBy(F.lit(name).alias("filter"), "model_code").agg(F.count("*").alias("n"))
        for name, p in (("line", line), ("process", process))
    ]
    return parts[0].unionByName(parts[1])
