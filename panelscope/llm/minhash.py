"""Near-duplicate groups by one-permutation MinHash, banded buckets and star-shaped candidate edges.

A document is the set of its distinct word 4-grams.  One hash deals its shingles to ``BINS`` bins, and the least of
each bin is its value.  Empty bins are filled by optimal densification: every bin has its own random order of all bins and
borrows from the first that is not empty, so each bin of two documents agrees with the probability of their similarity.  Bands of ``ROWS``
bins are bucket keys; documents with similarity of 0.8 miss all ``BINS / ROWS`` shared buckets with a probability of 5e-8.

Buckets do not emit their pairs.  Each has a centre, and its members are joined to the centre: a star, of as many edges as members.
Of the centres of its buckets a document is checked against the one it shares most buckets with, on full sets.  Linked documents
become one component, and buckets that lie in one component are done.  The others go through a second round with
other centres.  What then is still mixed is finished completely: small buckets by the pairs between their components, large ones
by the rarest shingles of their members, of which similar sets share one at least; again only between components.

Defined results.  Only doc_id and text are read.  Null texts and texts without words have empty sets and link with nothing, not
even each other.  A component's id is its smallest id, null if it has none; rows with null ids are grouped like others and are
kept only in a component without any id.  Equal rows are in one component and are kept or not together.  A text of any length is
read whole.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelscope.llm.common import by_bytes, conform, read, settle
from panelscope.llm.hashing import mix
from panelscope.llm.registry import query
from panelscope.llm.sets import SLICE, Rule, between, fingerprint, grouped, linked_classes, matching, mixed, rarely_apart, raw, shingles, with_component

RULE = Rule(words=4, percent=80)
#: Bins of a signature, a power of two, and bins of a band.
BINS, ROWS = 128, 4
#: Rounds in which every document meets one centre.
ROUNDS = 2
#: Buckets that a document shares at least with the centre it meets in a round; links share 13 of 32 as a rule.
SHARED = 4
#: Buckets of so many members left are finished by pairs between components, larger ones by rare shingles.
SMALL = 16

_MULTIPLIERS = mix(np.arange(1, ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _orders() -> np.ndarray:
    """For each bin all bins in an order of its own, that of a hash; where it borrows first."""
    pair = np.arange(BINS, dtype=np.uint64)[:, None] * np.uint64(BINS) + np.arange(BINS, dtype=np.uint64)
    return np.argsort(mix(pair + np.uint64(0x5851F42D4C957F2D)), axis=1, kind="stable")


ORDERS = _orders()


def signature(own: np.ndarray) -> np.ndarray:
    """The values of all bins of a sorted set that is not empty.

    Bins are the leading bits, so the least hash of a bin is its first in the sorted set.
    """
    shift = np.uint64(64 - BINS.bit_length() + 1)
    firsts = np.searchsorted(own, np.arange(BINS, dtype=np.uint64) << shift)
    ends = np.append(firsts[1:], len(own))
    full = firsts < ends
    values = own[np.minimum(firsts, len(own) - 1)]
    if not full.all():
        empty = np.flatnonzero(~full)
        donors = ORDERS[empty, full[ORDERS[empty]].argmax(1)]
        values[empty] = values[donors]
    return values


def bands(values: np.ndarray) -> np.ndarray:
    """A key per band of a signature."""
    rows = values.reshape(-1, ROWS)
    return mix((rows * _MULTIPLIERS).sum(1, dtype=np.uint64) + np.arange(len(rows), dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, class, n_shingles and band keys of every row; no keys for empty sets."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", SLICE):
            own = shingles(raw(batch), RULE.words)
            keys = [bands(signature(s)) if len(s) else np.empty(0, np.int64) for s in own]
            offsets = np.concatenate(([0], np.cumsum([len(k) for k in keys])))
            arrays = [
                batch.column("doc_id"),
                batch.column("text_hash"),
                pa.array([fingerprint(s) for s in own], pa.int64()),
                pa.array([len(s) for s in own], pa.int64()),
                pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(keys), pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "text_hash", "class", "n_shingles", "keys"])

    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return hashed.mapInArrow(sign, "doc_id long, text_hash long, class long, n_shingles long, keys array<long>")


def buckets(rows: DataFrame) -> DataFrame:
    """key, class and size of the members of buckets that several classes share."""
    classes = rows.where("n_shingles > 0").groupBy("class").agg(F.first("n_shingles").alias("size"), F.first("keys").alias("keys"))
    entries = classes.select("class", "size", F.explode("keys").alias("key"))
    shared = entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    return entries.join(shared, "key")


def rare_lists(texts: DataFrame) -> DataFrame:
    """token, class and size: every class with its rarest shingles, of which it shares one with any similar class.

    Shingles are ordered by their number of classes here, by hash where it is equal.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", SLICE):
            names = batch.column("class").to_pylist()
            for name, own in zip(names, shingles(raw(batch), RULE.words), strict=True):
                arrays = [pa.array(own.view(np.int64)), pa.array(np.full(len(own), name)), pa.array(np.full(len(own), len(own)))]
                yield pa.RecordBatch.from_arrays(arrays, ["token", "class", "size"])

    entries = settle(texts.mapInArrow(listed, "token long, class long, size long"), "left-shingles")
    counts = entries.groupBy("token").agg(F.count("*").alias("n"))
    counted = entries.join(counts, "token")
    rank = (F.row_number().over(Window.partitionBy("class").orderBy("n", "token")) - 1).cast("long")
    return counted.withColumn("rank", rank).where((F.col("rank") <= F.col("size") - RULE.own_least()) & (F.col("n") > 1))


def rest(lists: DataFrame, texts: DataFrame, found: DataFrame | None) -> DataFrame:
    """All candidate pairs of mixed buckets."""
    sizes = lists.groupBy("key").agg(F.count("*").alias("n"))
    counted = lists.join(sizes, "key")
    pairs = between(counted.where(F.col("n") <= SMALL).drop("n"), "key", RULE.near_in_size()).select("a", "b")
    large = settle(counted.where(F.col("n") > SMALL).select("class").distinct(), "left-classes")
    if large.isEmpty():
        return pairs
    rare = rare_lists(texts.join(large, "class", "left_semi")).select("token", "class", "size", "rank")
    rare = settle(mixed(with_component(rare, found), "token"), "rare-lists")
    return pairs.union(rarely_apart(rare, RULE)).distinct()


def join(docs: DataFrame) -> DataFrame:
    """doc_id, class, part, n_shingles, component_id and kept of every row."""
    docs = conform(docs, "doc_id", "text")
    rows = settle(signed(docs), "signatures")
    lists = settle(buckets(rows), "buckets")
    found = linked_classes(docs, rows, lists, "key", RULE, matching(RULE), ROUNDS, ("size",), RULE.near_in_size(), SHARED, rest)
    whole = grouped(rows.drop("keys", "text_hash"), found)
    return whole.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)
  )
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS x FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), l AS MATERIALIZED (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * x >= 80 * (na.n + nb.n - x)
), e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
), c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""


@query("op11_minhash_near_dedup", SQL)
def _op11(spark, sf_dir):
    return join(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")
