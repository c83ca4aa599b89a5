"""Audit of how filters interact, from one word per document.

Five filters leave 32 subsets.  A document becomes a word of 32 bits, bit s set if it survives all filters of subset s.
Counting each bit over all words (a positional popcount) gives the survivors of every subset at once.  The counts are
taken by carry-save adders: three words of one weight become one word of sums and one of carries with
twice the weight, so 32 counters advance together.  Every task counts its words per part and label (all, good, toxic);
the counts of tasks add up.  What any order of the filters keeps and removes at any step, and the share of each
filter over all orders (its Shapley value), follow from the 32 survivor counts alone.

Failure conditions, of whole texts (null: empty; words: runs without ASCII white space, case kept):
A under 200 words; B fewer than half of the words distinct; C more than 2 % of the code points in A-Z; D one of #$%&*|;
E equal to the text of a document with a smaller id, wherever that is.

Defined results.  Only doc_id, text and source, and doc_id, quality and toxic of the labels are read.  A null source
is the part "".  Null and empty texts are equal.  No id is smaller than a null id, and a null id is smaller than none: such rows
pass E and have no label.  Rows with equal ids and texts pass or fail E together.  Labels that come repeatedly count as
good or toxic if one of them does.  An empty table has no parts and no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelscope.llm.common import conform, heavy_join, read, settle
from panelscope.llm.registry import query

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
ALL = SUBSETS - 1
SPACES = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_UPPER_PERCENT = 200, 50, 2
LABELS = ("every", "good", "toxic")
#: Parts whose counts a task holds at once; beyond it they are passed on.
HELD_PARTS = 4096


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest of the text, and ``fails``: a bit per filter from A on, without E."""
    d = conform(docs, "doc_id", "text", "source").select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("inner", F.btrim("text", F.lit(SPACES)))
    d = d.withColumn("w", F.split("inner", "[ \\x09-\\x0D]+"))
    d = d.withColumn("n", F.when(F.col("inner") == "", 0).otherwise(F.size("w")))
    d = d.withColumn("different", F.when(F.col("inner") == "", 0).otherwise(F.size(F.array_distinct("w"))))
    upper = F.length("text") - F.length(F.translate("text", UPPER, ""))
    found = (
        F.col("n") < LEAST_WORDS,
        100 * F.col("different") < LEAST_DISTINCT_PERCENT * F.col("n"),
        100 * upper > MOST_UPPER_PERCENT * F.length("text"),
        F.col("text").rlike("[#$%&*|]"),
    )
    fails = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(found)), F.lit(0))
    return d.select("doc_id", "part", F.unhex(F.md5("text")).alias("digest"), fails.cast("int").alias("fails"))


def with_copies(found: DataFrame) -> DataFrame:
    """The rows of ``failures``, a written table, with the bit of E: the earliest id of each repeated text is joined."""
    repeated = found.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    joined = heavy_join(found, settle(repeated, "repeated-texts"), ["digest"], "n", found.count(), "left")
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return joined.select("doc_id", "part", (F.col("fails") + F.when(copy, 1 << 4).otherwise(0)).alias("fails"))


def words(judged: DataFrame, labels: DataFrame) -> DataFrame:
    """part, good, toxic, the word of surviving subsets, and how many documents have it.

    Rows of one id are counted before labels are joined, so an id (or none) on many rows is no hot key.
    """
    counted = judged.groupBy("doc_id", "part", "fails").agg(F.count("*").alias("n"))
    known = conform(labels, "doc_id", "quality", "toxic").groupBy("doc_id").agg(*(F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(a) for c, a in (("quality", "good"), ("toxic", "toxic"))))
    survives = F.array(*(F.lit(sum(1 << s for s in range(SUBSETS) if not s & f)) for f in range(SUBSETS)))
    word = F.element_at(survives, F.col("fails") + 1).cast("long")
    named = (F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic"))
    return counted.join(known, "doc_id", "left").select("part", *named, word.alias("word"), "n")


def positional_counts(own: np.ndarray, times: np.ndarray) -> np.ndarray:
    """How often each of 32 bits is set over the words, each counted ``times``.

    A word enters the adders at every weight that its multiplicity has.
    """
    total, weight, carries = np.zeros(SUBSETS, np.int64), 0, own[:0]
    while len(carries) or (times >> weight).any():
        level = np.concatenate((carries, own[(times >> weight) & 1 == 1]))
        carried = []
        while len(level) > 2:
            third = len(level) // 3
            a, b, c = (level[k * third : (k + 1) * third] for k in range(3))
            half = a ^ b
            carried.append((a & b) | (half & c))
            level = np.concatenate((half ^ c, level[3 * third :]))
        for word in level.tolist():
            total += ((word >> np.arange(SUBSETS)) & 1) << weight
        carries = np.concatenate(carried) if carried else own[:0]
        weight += 1
    return total


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}

    def counts() -> pa.RecordBatch:
        parts = [p for p in held for _ in range(SUBSETS)]
        values = np.concatenate([held[p] for p in held], axis=1) if held else np.zeros((len(LABELS), 0), np.int64)
        arrays = [pa.array(parts, pa.string()), pa.array(list(range(SUBSETS)) * len(held), pa.int32()), *(pa.array(v) for v in values)]
        return pa.RecordBatch.from_arrays(arrays, ["part", "subset", *LABELS])

    for batch in batches:
        names = batch.column("part").dictionary_encode()
        label = 2 * batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64) + batch.column("good").to_numpy(zero_copy_only=False)
        group = 4 * names.indices.to_numpy(zero_copy_only=False).astype(np.int64) + label
        own, times = batch.column("word").to_numpy().astype(np.uint32), batch.column("n").to_numpy()
        order = np.argsort(group, kind="stable")
        starts = np.flatnonzero(np.diff(group[order], prepend=-1))
        known = names.dictionary.to_pylist()
        for rows in np.split(order, starts[1:]) if len(order) else ():
            part, kind = known[group[rows[0]] // 4], group[rows[0]] % 4
            added = positional_counts(own[rows], times[rows])
            held.setdefault(part, np.zeros((len(LABELS), SUBSETS), np.int64))[[0, *([1] if kind & 1 else []), *([2] if kind & 2 else [])]] += added
        if len(held) >= HELD_PARTS:
            yield counts()
            held = {}
    yield counts()


def survivors(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, subset (bit k: the k-th filter) and the documents that survive all its filters: every, good, toxic."""
    judged = with_copies(settle(failures(docs), "filter-failures"))
    counts = words(judged, labels).mapInArrow(_count, "part string, subset int, " + ", ".join(f"{x} long" for x in LABELS))
    return counts.groupBy("part", "subset").agg(*(F.sum(x).alias(x) for x in LABELS))


def report(counts: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, from the survivors of all subsets."""
    entry = F.struct("subset", *LABELS)
    parts = counts.groupBy("part").agg(F.sort_array(F.collect_list(entry)).alias("s"))  # 32 entries each

    def alive(mask: Column | int, label: str = "every") -> Column:
        return F.element_at("s", (mask if isinstance(mask, Column) else F.lit(mask)) + 1)[label]

    def shapley(k: int) -> Column:
        own, rest = 1 << k, [s for s in range(SUBSETS) if not s >> k & 1]
        ways = {s: factorial(s.bit_count()) * factorial(len(FILTERS) - 1 - s.bit_count()) for s in rest}
        return sum((ways[s] * (alive(s) - alive(s | own)) for s in rest), F.lit(0).cast("long"))

    shares = parts.withColumn("shares", F.array(*(shapley(k) for k in range(len(FILTERS)))))
    orders = F.array(*(F.lit("".join(p)) for p in permutations(FILTERS)))
    listed = shares.withColumn("filter_order", F.explode(orders))
    bits = [F.element_at(F.create_map(*(x for k, f in enumerate(FILTERS) for x in (F.lit(f), F.lit(1 << k)))), F.substring("filter_order", n + 1, 1)) for n in range(len(FILTERS))]
    steps = [F.struct(F.lit(n + 1).alias("step"), sum(bits[:n], F.lit(0)).alias("before"), bits[n].alias("own")) for n in range(len(FILTERS))]
    listed = listed.withColumn("at", F.explode(F.array(*steps))).select("part", "filter_order", "s", "shares", "at.*")
    after, own = F.col("before") + F.col("own"), F.col("own")

    def gone(label: str) -> Column:
        return alive(F.col("before"), label) - alive(after, label)

    return listed.select(
        "part",
        "filter_order",
        "step",
        alive(after).alias("kept"),
        gone("every").alias("removed"),
        (alive(0) - alive(own) - gone("every")).alias("redundant"),
        (alive(ALL - own) - alive(ALL)).alias("unique_fails"),
        gone("good").alias("good_lost"),
        gone("toxic").alias("toxic_lost"),
        F.element_at("shares", F.length(F.bin(own))).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The report over a table of documents and its labels."""
    return report(settle(survivors(docs, labels), "subset-survivors"))


SQL = f"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), b AS (
  SELECT doc_id, part, (len(w) < {LEAST_WORDS})::INT + 2 * (100 * len(list_distinct(w)) < {LEAST_DISTINCT_PERCENT} * len(w))::INT
    + 4 * (100 * (length(text) - length(translate(text, '{UPPER}', ''))) > {MOST_UPPER_PERCENT} * length(text))::INT
    + 8 * regexp_matches(text, '[#$%&*|]')::INT
    + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS fails FROM t
), k AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false)::INT AS good, coalesce(bool_or(toxic = 1), false)::INT AS toxic FROM labels GROUP BY doc_id
), g AS MATERIALIZED (
  SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM b LEFT JOIN k USING (doc_id) GROUP BY ALL
), l AS (SELECT unnest(string_split('A B C D E', ' ')) AS x),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), p AS (
  SELECT filter_order, step, (1 << (ord(filter_order[step]) - 65)) AS own,
    list_sum(list_transform(string_split(filter_order[1:step], ''), lambda x: 1 << (ord(x) - 65)))::INT AS upto
  FROM o, (SELECT unnest(range(1, 6))::INT AS step)
), r AS (
  SELECT part, filter_order, step, own,
    coalesce(sum(n) FILTER (fails & upto = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (fails & upto = own), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (fails & own > 0 AND fails & (upto - own) > 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (fails = own), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (fails & upto = own), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (fails & upto = own), 0)::BIGINT AS toxic_lost
  FROM g, p GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r
"""


@query("op13_filter_interaction_audit", SQL)
def _op13(spark, sf_dir):
    return audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
