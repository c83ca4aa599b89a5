"""Removal of repeated lines or paragraphs: the earliest ranked occurrence stays, later ones go.

Units are normalised (letters lowered, white space collapsed) and hashed to 128 bits.  Digests are grouped
over the corpus; of each, the occurrence with the smallest (doc_id, unit number) stays.  Removed units are
listed with their original offsets.

Defined results.  Only doc_id and text are read.  Every unit that is not empty once normalised counts, however
short; ``min_words`` spares units of fewer words (cut at white space).  Null ids rank last.  Rows with one doc_id rank together: a
unit that is the earliest in several of them stays in each.  A null text has no units and stays null.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelscope.llm.common import by_bytes, conform, heavy_join, read, settle
from panelscope.llm.registry import query

#: Rank of rows without an id.
LAST = (1 << 63) - 1

_SPACE = re.compile("[\\x20\\x09-\\x0D]+")
_BREAKS = {"line": re.compile("\n"), "paragraph": re.compile("\n[\\x20\\x09\\x0B-\\x0D]*(?:\n[\\x20\\x09\\x0B-\\x0D]*)+")}


def spans(text: str, kind: str) -> list[tuple[int, int]]:
    """Start and end of each unit."""
    found, at = [], 0
    for m in _BREAKS[kind].finditer(text):
        found.append((at, m.start()))
        at = m.end()
    return [*found, (at, len(text))]


def normalised(unit: str) -> str:
    return _SPACE.sub(" ", unit.lower()).strip(" ")


def units(docs: DataFrame, kind: str = "line", min_words: int = 1) -> DataFrame:
    """A row per unit that may be removed: rank, text_hash, unit, start, stop and digest."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            rank, of, unit, start, stop, high, low = ([] for _ in range(7))
            for r, h, text in zip(*(batch.column(c).to_pylist() for c in ("rank", "text_hash", "text")), strict=True):
                for n, (a, b) in enumerate(spans(text, kind) if text else ()):
                    key = normalised(text[a:b])
                    if key and key.count(" ") + 1 >= min_words:
                        digest = hashlib.md5(key.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()
                        for column, value in zip((rank, of, unit, start, stop, high, low), (r, h, n, a, b, int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)), strict=True):
                            column.append(value)
            arrays = [pa.array(x, pa.int64()) for x in (rank, of, unit, start, stop, high, low)]
            yield pa.RecordBatch.from_arrays(arrays, ["rank", "text_hash", "unit", "start", "stop", "high", "low"])

    schema = "rank long, text_hash long, unit long, start long, stop long, high long, low long"
    return ranked(docs).select("rank", "text_hash", "text").mapInArrow(cut, schema)


def ranked(docs: DataFrame) -> DataFrame:
    return conform(docs, "doc_id", "text").withColumns({"rank": F.coalesce("doc_id", F.lit(LAST)), "text_hash": F.xxhash64("text")})


def repeated(found: DataFrame) -> DataFrame:
    """The units to remove, with the rank of the document that keeps the text; ``found`` is a written table."""
    first = F.min(F.struct("rank", "unit")).alias("first")
    groups = found.groupBy("high", "low").agg(first, F.count("*").alias("n")).where("n > 1")
    groups = settle(groups.select("high", "low", "n", F.col("first.rank").alias("first_rank"), F.col("first.unit").alias("first_unit")), "line-groups")
    joined = heavy_join(found, groups, ["high", "low"], "n", found.count())
    return joined.where("rank > first_rank OR unit > first_unit").select("rank", "text_hash", "unit", "start", "stop", "first_rank")


def dedup(docs: DataFrame, kind: str = "line", min_words: int = 1) -> DataFrame:
    """Every document with its kept text and the removed units: unit, start, stop, first_doc_id."""
    gone = repeated(settle(units(docs, kind, min_words), "line-units"))
    known = F.when(F.col("first_rank") != LAST, F.col("first_rank")).alias("first_doc_id")
    lists = gone.dropDuplicates(["rank", "text_hash", "unit"]).groupBy("rank", "text_hash").agg(F.sort_array(F.collect_list(F.struct("unit", "start", "stop", known))).alias("removed"))
    joined = ranked(docs).join(lists, ["rank", "text_hash"], "left")
    empty = F.array().cast("array<struct<unit:long,start:long,stop:long,first_doc_id:long>>")
    joined = joined.select("doc_id", "text", F.coalesce("removed", empty).alias("removed"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            kept, count = [], []
            for text, gone in zip(batch.column("text").to_pylist(), batch.column("removed").to_pylist(), strict=True):
                places = spans(text, kind) if text else []
                out = {r["unit"] for r in gone}
                glue = "\n" if kind == "line" else "\n\n"
                kept.append(text if not out else glue.join(text[a:b] for n, (a, b) in enumerate(places) if n not in out))
                count.append(len(places))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kept, pa.string()), pa.array(count, pa.int64())], [*batch.schema.names, "kept_text", "n_units"])

    schema = "doc_id long, text string, removed array<struct<unit:long,start:long,stop:long,first_doc_id:long>>, kept_text string, n_units long"
    return joined.mapInArrow(keep, schema)


SQL = """
WITH l AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS unit_text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS unit
  FROM documents WHERE text <> ''
), u AS (
  SELECT *, sum(length(unit_text) + 1) OVER (PARTITION BY doc_id ORDER BY unit) - length(unit_text) - 1 AS start,
    trim(regexp_replace(lower(unit_text), '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' ') AS norm FROM l
), f AS (
  SELECT *, CASE WHEN norm <> '' THEN min(struct_pack(d := doc_id, u := unit)) OVER (PARTITION BY norm) END AS first FROM u
), g AS (
  SELECT *, first IS NOT NULL AND (first.d < doc_id OR first.u < unit) AS gone FROM f
), d AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, coalesce(sum(length(unit_text)) FILTER (gone), 0)::BIGINT AS chars_removed,
    coalesce(string_agg(start || '-' || start + length(unit_text) || ':' || first.d, ' ' ORDER BY unit) FILTER (gone), '') AS removed,
    coalesce(string_agg(unit_text, chr(10) ORDER BY unit) FILTER (NOT gone), '') AS kept_text
  FROM g GROUP BY doc_id
)
SELECT t.doc_id, coalesce(n_removed, 0) AS n_removed, coalesce(chars_removed, 0) AS chars_removed,
  coalesce(removed, '') AS removed, coalesce(kept_text, t.text) AS kept_text
FROM documents t LEFT JOIN d USING (doc_id)
"""


@query("op9_line_dedup", SQL)
def _op9(spark, sf_dir):
    out = dedup(read(spark, sf_dir, "documents"))
    size = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["stop"] - r["start"])
    places = F.transform("removed", lambda r: F.concat(r["start"].cast("string"), F.lit("-"), r["stop"].cast("string"), F.lit(":"), r["first_doc_id"].cast("string")))
    return out.select("doc_id", F.size("removed").cast("long").alias("n_removed"), size.alias("chars_removed"), F.concat_ws(" ", places).alias("removed"), "kept_text")
