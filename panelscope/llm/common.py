"""Helpers shared by the corpus operators: reading, safe joins, slicing of Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelscope.session import settle

__all__ = ["DOCUMENT", "DOCUMENT_SCHEMA", "below", "by_bytes", "compact", "conform", "hash_rank", "heavy_join", "least_hashes", "letters_lowered", "read", "settle", "unit_hash"]

DOCUMENT_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")

#: A key is heavy from this share of all rows on; so at most as many keys are heavy, and they may be broadcast.
HEAVY_SHARE = 10_000

HASH_BITS = 60


#: Rows of texts that Spark sends to Python at once, unless the session says otherwise.
ARROW_ROWS, _BATCH = "1000", "spark.sql.execution.arrow.maxRecordsPerBatch"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of texts; from now on the session sends them to Python in small batches, if it has no setting of its own."""
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, ARROW_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def compact(df: DataFrame, rows: int, per: int = 100_000, least: int = 1) -> DataFrame:
    """In no more partitions than so many rows need; large frames stay as they are."""
    return df.coalesce(max(least, rows // per + 1))


def conform(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns of a document table; what else it carries is left out, whatever its name."""
    return docs.select(*(F.col(f"`{c}`") for c in (columns or DOCUMENT)))


def letters_lowered(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def unit_hash(text: Column) -> Column:
    """The first 60 bits of the MD5 digest of a text, as a long that other engines can compute too."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def heavy_join(big: DataFrame, small: DataFrame, keys: list[str], weight: str, total: int, how: str = "inner") -> DataFrame:
    """Join ``big`` with ``small``, which has one row per key and the key's number of rows of ``big`` in ``weight``.

    Keys that hold at least one in ``HEAVY_SHARE`` of the ``total`` rows number at most ``HEAVY_SHARE``.
    They are broadcast, so a key on a third of all rows meets its match without a shuffle; the others
    are shuffled, in groups of a bounded share.  Both frames are read twice: pass written tables.
    """
    least = max(2, total // HEAVY_SHARE)
    heavy, light = small.where(F.col(weight) >= least), small.where(F.col(weight) < least)
    known = F.broadcast(heavy.select(*keys))
    first = big.join(F.broadcast(heavy), keys, "inner")
    rest = big.join(known, keys, "left_anti").join(light, keys, how)
    return first.unionByName(rest)


def hash_rank(hashed: Column) -> Column:
    """A 64-bit hash as a whole number of 62 bits, by which samples are ordered."""
    return F.pmod(hashed, F.lit(1 << 62))


@dataclass
class Taken:
    """Distinct hashes of a group, how many of the least are wanted, and a bound below which so many lie."""

    distinct: int
    wanted: int
    bound: int


def least_hashes(rows: DataFrame, group: str, hashed: str, wanted: Callable[[int], int]) -> dict[object, Taken]:
    """For each group a bound below which its least ``wanted(number of groups)`` hashes lie, or all that it has.

    Distinct hashes are counted by group and bit length, so no group meets in one task, and a bound passes about
    twice the wanted ones.  ``hashed`` is of ``hash_rank``.
    """
    length = F.length(F.bin(hashed)).alias("bits")
    found: dict[object, dict[int, int]] = {}
    for r in rows.select(group, hashed).distinct().groupBy(group, length).count().collect():
        found.setdefault(r[group], {})[r["bits"]] = r["count"]
    most, out = wanted(len(found)) if found else 0, {}
    for key, counts in found.items():
        upto = 0
        for bits in sorted(counts):
            upto += counts[bits]
            if upto >= most:
                break
        out[key] = Taken(sum(counts.values()), most, 1 << bits)
    return out


def below(spark: SparkSession, taken: dict[str, Taken]) -> DataFrame:
    """The bounds as a table: of, bound."""
    return spark.createDataFrame([(key, t.bound) for key, t in taken.items()], "of string, bound long")


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices with about ``limit`` bytes of ``column`` each; a longer value comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
        start, held = 0, 0
        for n, size in enumerate(sizes):
            if n > start and held + size > limit:
                yield batch.slice(start, n - start)
                start, held = n, 0
            held += size
        yield batch.slice(start)
