"""Sharding by extendible hashing: a directory of hash prefixes whose oversized buckets alone split further.

Every row has a 60-bit hash.  A bucket is a prefix of it; a bucket over the byte limit is split on its
next bit, the others stay as they are, so leaves have different depths.  Bucket sizes are sums, and the
sums of all depths come from one aggregate at a sufficient depth; only rows of buckets that are still too
large there are aggregated again, deeper.

Defined results.  Only the columns of documents are read; others are dropped.  A null text has 0 bytes.
A row longer than the limit gets a shard of its own.  Equal rows (also with null ids) are told apart by a copy number,
so any number of them is dealt over as many shards as they need.  An empty table has no shards.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelscope.llm.common import DOCUMENT, HASH_BITS, conform, settle, unit_hash
from panelscope.llm.registry import query

LIMIT_BYTES = 1 << 20
#: Depth beyond the mean need at which sizes are first summed, and the step of later rounds.
MARGIN_BITS, STEP_BITS = 3, 8
#: Copies of one row are numbered in blocks, so that no task builds one long array.
COPY_BLOCK = 1000


def row_key() -> Column:
    """Digest of all columns of a document; equal for equal rows only."""
    parts = [F.md5("text") if c == "text" else F.col(c).cast("string") for c in DOCUMENT]
    return F.md5(F.concat_ws("|", *(F.coalesce(F.hex(p.cast("binary")), F.lit("-")) for p in parts)))


def _prefix(h: str | Column, depth: int | Column) -> Column:
    """The first ``depth`` bits of a hash."""
    h = F.col(h) if isinstance(h, str) else h
    if isinstance(depth, int):
        return F.shiftright(h, HASH_BITS - depth)
    return F.call_function("shiftright", h, (F.lit(HASH_BITS) - depth).cast("int"))


def numbered_copies(docs: DataFrame) -> DataFrame:
    """A row per row of the table: key, copy number, size and hash."""
    kept = docs.select(row_key().alias("key"), "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    grouped = kept.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("n_bytes").alias("n_bytes"), F.count("*").alias("copies"))
    blocks = grouped.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / COPY_BLOCK))))
    last = F.least(F.col("copies") - 1, F.col("block") * COPY_BLOCK + COPY_BLOCK - 1)
    rows = blocks.withColumn("copy", F.explode(F.sequence(F.col("block") * COPY_BLOCK, last)))
    return rows.select("key", "copy", "doc_id", "n_bytes", unit_hash(F.concat_ws(":", "key", F.col("copy").cast("string"))).alias("h"))


def _level(cells: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """Of each prefix of ``high`` bits, the shallowest bucket from ``low`` bits on that fits; nulls if none does."""
    deep = cells.groupBy(_prefix("h", high).alias("p")).agg(F.sum("n_bytes").alias("size"), F.count("*").alias("n_rows"))
    deep = settle(deep, "shard-sizes")
    depths = F.explode(F.sequence(F.lit(low), F.lit(high)))
    spread = deep.select("p", "size", "n_rows", depths.alias("depth"))
    spread = spread.withColumn("bucket", F.call_function("shiftright", F.col("p"), (F.lit(high) - F.col("depth")).cast("int")))
    sums = spread.groupBy("depth", "bucket").agg(F.sum("size").alias("shard_bytes"), F.sum("n_rows").alias("shard_rows"))
    fits = sums.where((F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1) | (F.col("depth") == HASH_BITS))
    found = spread.select("p", "depth", "bucket").join(fits, ["depth", "bucket"])
    shallowest = found.groupBy("p").agg(F.min(F.struct("depth", "shard_bytes", "shard_rows")).alias("leaf"))
    return deep.select("p").join(shallowest, "p", "left")


def assign(cells: DataFrame, limit: int = LIMIT_BYTES) -> DataFrame:
    """Add ``depth``, ``shard``, ``shard_bytes`` and ``shard_rows`` to a written table with ``h`` and ``n_bytes``."""
    total = cells.agg(F.sum("n_bytes").alias("b")).first()["b"] or 0
    low, high = 0, min(HASH_BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + MARGIN_BITS)
    rest, levels = cells.select("h", "n_bytes"), []
    while True:
        leaves = settle(_level(rest, low, high, limit), "shard-leaves")
        levels.append((high, leaves))
        over = leaves.where(F.col("leaf").isNull()).select("p")
        if high == HASH_BITS or over.isEmpty():
            break
        rest = rest.withColumn("p", _prefix("h", high)).join(over, "p", "left_semi").drop("p")
        low, high = high + 1, min(HASH_BITS, high + STEP_BITS)
    out, leaf = cells, F.lit(None)
    for n, (high, leaves) in enumerate(levels):
        known = leaves.where(F.col("leaf").isNotNull()).select(F.col("p").alias(f"p{n}"), F.col("leaf").alias(f"leaf{n}"))
        out = out.withColumn(f"p{n}", _prefix("h", high)).join(known, f"p{n}", "left")
    leaf = F.coalesce(*(F.col(f"leaf{n}") for n in range(len(levels))))
    bits = F.lpad(F.bin("h"), HASH_BITS, "0")
    return out.select(
        *cells.columns,
        leaf["depth"].alias("depth"),
        F.concat(F.lit("b"), bits.substr(F.lit(1), leaf["depth"].cast("int"))).alias("shard"),
        leaf["shard_bytes"].alias("shard_bytes"),
        leaf["shard_rows"].alias("shard_rows"),
    )


def shard(docs: DataFrame, limit: int = LIMIT_BYTES) -> DataFrame:
    """The documents with their shard; texts are moved once, to be joined with the keys."""
    docs = conform(docs)
    assigned = assign(settle(numbered_copies(docs), "shard-cells"), limit).drop("doc_id", "h", "n_bytes")
    return docs.withColumn("key", row_key()).dropDuplicates(["key"]).join(assigned, "key").drop("key", "copy")


def directory(assigned: DataFrame) -> DataFrame:
    """The leaves: a row per shard."""
    return assigned.groupBy("shard", "depth", "shard_bytes", "shard_rows").agg(F.count("*").alias("n")).drop("n")


def write_shards(sharded: DataFrame, path: str) -> None:
    """A folder per shard, each written by one task."""
    sharded.repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(path)


SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0) AS n_bytes,
    md5(concat_ws('|', coalesce(hex(encode(doc_id::VARCHAR)), '-'), coalesce(hex(encode(md5(text))), '-'),
      coalesce(hex(encode(lang)), '-'), coalesce(hex(encode(source)), '-'), coalesce(hex(encode(n_chars::VARCHAR)), '-'))) AS key
  FROM documents
), c AS (
  SELECT doc_id, n_bytes,
    ('0x' || substr(md5(key || ':' || (row_number() OVER (PARTITION BY key) - 1)), 1, 15))::BIGINT AS h
  FROM d
), s AS (
  SELECT c.*, k AS depth, h >> (60 - k) AS bucket FROM c, (SELECT unnest(range(0, 61))::INT AS k)
), b AS (
  SELECT depth, bucket, sum(n_bytes) AS shard_bytes, count(*) AS shard_rows FROM s GROUP BY ALL
), f AS (
  SELECT s.doc_id, s.n_bytes, s.h, b.* FROM s JOIN b USING (depth, bucket)
  WHERE b.shard_bytes <= {LIMIT_BYTES} OR b.shard_rows = 1
)
SELECT doc_id, n_bytes, depth, 'b' || left(lpad(bin(h), 60, '0'), depth::INT) AS shard,
  shard_bytes::BIGINT AS shard_bytes, shard_rows
FROM f QUALIFY row_number() OVER (PARTITION BY h, doc_id ORDER BY depth) = 1
"""


@query("op1_extendible_sharding", SQL)
def _op1(spark, sf_dir):
    from panelscope.llm.common import read

    cells = settle(numbered_copies(conform(read(spark, sf_dir, "documents"))), "shard-cells")
    return assign(cells).drop("key", "copy", "h")
