"""Cleaning rules for raw process history and inspection rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN_MODEL = "UNKNOWN"

# Source column -> columns of the fact it fills.
HISTORY_MAPPING = {
    "glass_id": ["product_id"],
    "product_id": ["product_id"],
    "factory_code": ["factory_code"],
    "process_code": ["process_code"],
    "time_ymdhms": ["move_in_ymdhms"],
    "equipment_hierarchy_type_code": ["equipment_hierarchy_type_code"],
    "equipment_line_id": ["equipment_line_id", "equipment_id"],
    "equipment_machine_id": ["equipment_machine_id"],
    "equipment_unit_id": ["equipment_unit_id"],
    "equipment_path_id": ["equipment_path_id"],
}
INSPECTION_MAPPING = {
    "product_id": ["product_id"],
    "facility_code": ["facility_code"],
    "process_code": ["process_code"],
    "inspection_end_ymdhms": ["inspection_end_ymdhms"],
    "def_pnt_x": ["def_pnt_x"],
    "def_pnt_y": ["def_pnt_y"],
    "def_pnt_g": ["def_pnt_g"],
    "def_pnt_d": ["def_pnt_d"],
    "def_size": ["def_size"],
    "def_latest_summary_defect_term_name_s": ["def_latest_summary_defect_term_name_s"],
}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def defect_name(term: Column | str, strict: bool = True) -> Column:
    """Second and fourth "-" part of a defect term, joined by "-".

    Strict trims the parts and gives NULL for a term of fewer than four parts; otherwise the parts
    stay as they are and a short term is returned unchanged.
    """
    term = _col(term)
    parts = F.split(term, "-")
    second, fourth = F.get(parts, F.lit(1)), F.get(parts, F.lit(3))
    if strict:
        second, fourth = (F.btrim(p, F.lit(" \t\n\r\f\v")) for p in (second, fourth))
    short = F.lit(None).cast("string") if strict else term
    return F.when(F.size(parts) >= 4, F.concat_ws("-", second, fourth)).otherwise(short)


def once(df: DataFrame, name: str, value: Column | str) -> DataFrame:
    """A column that is computed once per row, however often filters and keys use it.

    A projected expression is copied to every place that names it, a generated one is not.
    """
    rest = [c for c in df.columns if c != name]
    out = df.select(*[F.col(f"`{c}`") for c in rest], F.explode(F.array(_col(value))).alias(name))
    return out.select(*[F.col(f"`{c}`") for c in df.columns]) if name in df.columns else out


def panel_cols(df: DataFrame) -> DataFrame:
    """panel_addr is panel_id without its product_id prefix; its last character is panel_y."""
    addr = F.when(
        F.startswith("panel_id", "product_id"),
        F.substring("panel_id", F.length("product_id") + 1, F.length("panel_id")),
    )
    return once(df, "panel_addr", addr).withColumns(
        {
            "panel_x": F.substring("panel_addr", F.lit(1), F.length("panel_addr") - 1),
            "panel_y": F.right("panel_addr", F.lit(1)),
        }
    )


def model_code(product: Column | str, given: Column | str | None = None) -> Column:
    """Characters 3-4 of the product id; a given model column is kept and its gaps are UNKNOWN."""
    if given is not None:
        return F.coalesce(_col(given), F.lit(UNKNOWN_MODEL))
    return F.substring(_col(product), 3, 2)


def lot_id(product: Column | str) -> Column:
    """Product id without its last two characters."""
    product = _col(product)
    return F.substring(product, F.lit(1), F.length(product) - 2)


def equip_group(line: Column | str) -> Column:
    """Equipment group: characters 3-6 of the line id."""
    return F.substring(_col(line), 3, 4)


def parse_ts(text: Column | str) -> Column:
    """Timestamp without zone; unreadable text is NULL."""
    return _col(text).try_cast("timestamp_ntz")


def parse_num(text: Column | str, null_as_zero: bool = False) -> Column:
    """Double; unreadable text is NULL, or 0 on request."""
    text = _col(text).cast("string")
    # a cast alone would read the Java literals "1d" and "1f" as numbers
    number = F.when(~text.rlike(r"[0-9.][dDfF]\s*$"), text.try_cast("double"))
    return F.coalesce(number, F.lit(0.0)) if null_as_zero else number


def unsigned(text: Column | str) -> Column:
    """Whole non-negative part of a number; unreadable text is 0."""
    return F.greatest(parse_num(text, null_as_zero=True).try_cast("long"), F.lit(0).cast("long"))


def hash_bucket(key: Column | str, n: int = 100) -> Column:
    """md5(key) as a 128-bit number modulo n, zero-padded; NULL goes to bucket 0."""
    if not 0 < n <= 1_000_000:
        raise ValueError("bucket count must be between 1 and 1,000,000")
    digest = F.md5(_col(key))
    limbs = [F.conv(F.substring(digest, start, 8), 16, 10).cast("long") for start in (1, 9, 17, 25)]
    # (high * 2^32 + low) % n stays far below 2^63 because the running value is < n
    bucket = reduce(lambda high, low: (high * F.lit(2**32) + low) % n, limbs, F.lit(0).cast("long"))
    width = max(2, len(str(n - 1)))
    return F.coalesce(F.lpad(bucket.cast("string"), width, "0"), F.lit("0" * width))


def drop_empty_key(df: DataFrame, key: str = "product_id") -> DataFrame:
    return df.where(F.length(key) > 0)


def map_source(df: DataFrame, mapping: dict[str, list[str]]) -> DataFrame:
    """Rename source columns to fact columns; of two sources for one column the later one wins."""
    chosen = {target: source for source in df.columns for target in mapping.get(source, [])}
    if not chosen:
        raise ValueError("the source has none of the mapped columns")
    return df.select([F.col(source).alias(target) for target, source in chosen.items()])


def defaults(df: DataFrame) -> DataFrame:
    """One defect per inspection row unless the row says otherwise."""
    count = F.coalesce(F.col("defect_count"), F.lit(1)) if "defect_count" in df.columns else F.lit(1)
    return df.withColumn("defect_count", count)


def clean_inspection(df: DataFrame, strict: bool = True, zero_numbers: bool = False) -> DataFrame:
    """All inspection rules: times, numbers, defect name, panel position, empty keys dropped.

    With ``zero_numbers`` unreadable and missing numbers are 0 and the two defect codes whole and not negative.
    """
    term = "def_latest_summary_defect_term_name_s"
    rules: dict[str, Column] = {}
    if "inspection_end_ymdhms" in df.columns:
        rules["inspection_end_ymdhms"] = parse_ts("inspection_end_ymdhms")
    for name in ("def_pnt_x", "def_pnt_y", "def_size"):
        if name in df.columns:
            rules[name] = parse_num(name, null_as_zero=zero_numbers)
    for name in ("def_pnt_g", "def_pnt_d"):
        if name in df.columns:
            rules[name] = unsigned(name) if zero_numbers else parse_num(name)
    if term in df.columns:
        rules["defect_name"] = defect_name(term, strict)
    df = drop_empty_key(df).withColumns(rules) if rules else drop_empty_key(df)
    return panel_cols(df) if "panel_id" in df.columns else df


def clean_history(df: DataFrame) -> DataFrame:
    """All history rules: times, model, lot, empty keys dropped."""
    rules = {
        "model_code": model_code("product_id", "model_code" if "model_code" in df.columns else None),
    }
    if "move_in_ymdhms" in df.columns:
        rules["move_in_ymdhms"] = parse_ts("move_in_ymdhms")
    if "lot_id" not in df.columns:
        rules["lot_id"] = lot_id("product_id")
    return drop_empty_key(df).withColumns(rules)


def safe_rate(a: Column | str, b: Column | str) -> Column:
    """a / b as double, 0 where b is 0 or either is NULL."""
    return F.coalesce(F.try_divide(_col(a).cast("double"), _col(b).cast("double")), F.lit(0.0))
