"""Result exports: CSV, JSON documents per target, NDJSON, and the heatmap grid configuration."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelscope.operators.positions import numbered

# Column headings of the ranking export.
RANKING_HEADINGS = {
    "rank": "순위",
    "equipment_line_id": "설비 ID",
    "process_code": "공정",
    "product_type_code": "모델",
    "defect_rate": "불량률",
    "delta_loo": "차이",
    "total_defects": "총 불량 수",
    "product_count": "제품 수",
}

_GRID_SCHEMA = "map<string, struct<x_list: array<string>, y_list: array<string>>>"


def glass_csv_rows(glass: DataFrame) -> DataFrame:
    return glass.select(
        F.col("product_id").alias("GlassID"),
        F.col("lot_id").alias("LotID"),
        F.col("work_date").alias("WorkDate"),
        F.col("total_defects").alias("TotalDefects"),
        F.col("group_type").alias("Group"),
    )


def glass_csv(glass: DataFrame, path: str) -> None:
    """Labelled product rows as CSV with header."""
    glass_csv_rows(glass).write.mode("overwrite").csv(path, header=True)


def percent(rate: Column) -> Column:
    return F.format_string("%.4f%%", rate * 100)


def ranking_csv_rows(ranking: DataFrame) -> DataFrame:
    """Ranking columns for a spreadsheet, rate and delta as percentages."""
    percentages = {"defect_rate": percent(F.col("defect_rate")), "delta_loo": percent(F.col("delta_loo"))}
    return ranking.select([percentages.get(c, F.col(c)).alias(name) for c, name in RANKING_HEADINGS.items()])


def ranking_csv(ranking: DataFrame, path: str) -> None:
    """Ranking as CSV with header, in rank order."""
    ranking_csv_rows(ranking.orderBy("rank")).write.mode("overwrite").csv(path, header=True)


def result_json(
    parts: Mapping[str, DataFrame], keys: Sequence[str] = ("equipment_line_id", "process_code"), records: int | None = None
) -> DataFrame:
    """Result document per target: for each part a JSON array of its records, sorted.

    With ``records`` a part comes in ordered chunks of so many records, for parts that one task should
    not hold; without it every part is one chunk.
    """
    if records is not None and records < 1:
        raise ValueError("a chunk needs at least one record")
    keys, out = list(keys), None
    for name, df in parts.items():
        values = [c for c in df.columns if c not in keys]
        chunk = F.lit(0)
        if records is not None:
            df = numbered(df, [F.col(c) for c in values], "_record", keys, copies=True)
            chunk = F.floor((F.col("_record") - 1) / records).cast("int")
        part = (
            df.groupBy(*keys, chunk.alias("chunk"))
            .agg(F.to_json(F.array_sort(F.collect_list(F.struct(*values)))).alias("payload"))
            .select(*keys, F.lit(name).alias("part"), "chunk", "payload")
        )
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no parts")
    return out


def ndjson_rows(documents: DataFrame, targets: DataFrame, keys: Sequence[str] = ("equipment_line_id", "process_code")) -> DataFrame:
    """One line per target, or per target and chunk of chunked documents: ``equipment_id``, ``result`` or ``error``."""
    keys = list(keys)
    result = F.map_from_entries(F.collect_list(F.struct("part", "payload")))
    lines = documents.groupBy(*keys, "chunk").agg(result.alias("result"))
    found = targets.select(*keys).distinct().join(lines, keys, "left")
    return found.select(
        F.col("equipment_line_id").alias("equipment_id"),
        *[k for k in keys if k != "equipment_line_id"],
        F.coalesce("chunk", F.lit(0)).alias("chunk"),
        "result",
        F.when(F.col("result").isNull(), F.lit("no result returned")).alias("error"),
    )


def ndjson(documents: DataFrame, targets: DataFrame, path: str) -> None:
    """One JSON object per line."""
    ndjson_rows(documents, targets).write.mode("overwrite").json(path)


def grids(text: DataFrame, column: str = "value") -> DataFrame:
    """Grid per model from a JSON object ``{model: {"x_list": [...], "y_list": [...]}}``."""
    parsed = text.select(F.explode(F.from_json(column, _GRID_SCHEMA)).alias("model_code", "grid"))
    return parsed.select("model_code", "grid.x_list", "grid.y_list")


def read_grids(spark: SparkSession, path: str) -> DataFrame:
    """Grids of a JSON configuration file."""
    return grids(spark.read.text(path, wholetext=True))
