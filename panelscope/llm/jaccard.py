"""Similarity join of documents on word 5-grams by T-occurrence search, with components of the links.

Documents with equal shingle sets are one class.  Two classes whose sets have Jaccard similarity of at least
3/4 share at least T = ceil(3 (a + b) / 7) shingles.  DivideSkip leaves the longest inverted lists out of the
merge: of the T lists at least T - L occurrences must fall into the others.  Taken to its end, L = T - 1, one
occurrence in the short lists suffices.  That is how candidates are found over the corpus: each class
enters only its rarest shingles (a quarter of them), whose lists are grouped by shingle.  Frequent shingles are known from a
sketch of counts, which only decides the order.

Lists do not emit their pairs.  In rounds every class meets one centre of its lists, which lies in another component, and
linked classes become one component.  Lists within one component are done; the others are then
searched completely, between components.  The first shingle that two sets have in common, in the order of all, must come early
enough in both to leave T within reach, and of their rarest shingles similar sets share several.

Candidates are searched in blocks: a task holds a query and up to ``BLOCK`` candidates, merges the short
lists of the query's shingles with a heap, skipping ahead as MergeSkip does, probes the long ones by binary search
and keeps candidates that reach T.

Defined results.  Only doc_id and text are read.  Null texts and texts without words have empty sets and
link with nothing, not even each other.  Rows with null ids are grouped like others; a component's id is its smallest
id, null if it has none.  Equal rows are in one component.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelscope.llm.common import DOCUMENT, by_bytes, compact, conform, read, settle
from panelscope.llm.recurring import recurring
from panelscope.llm.registry import query
from panelscope.llm.sets import SLICE, TASKS, Rule, fingerprint, grouped, linked_classes, rarely_apart, raw, shingles

RULE = Rule(words=5, percent=75)
#: Cells of the sketch of shingle counts, as a power of two.
CELL_BITS = 22
#: Parts of the sketch that are added up side by side, as a power of two.
CHUNK_BITS = 6
#: Candidates of one query that are searched at once.
BLOCK = 256
#: Weight of a probe against a merge step, of DivideSkip.
PROBE_WEIGHT = 0.01
#: Rounds in which every class meets one centre, before all that is left.
ROUNDS = 2
#: Short lists that a class shares at least with the centre it meets in a round.
SHARED = 3


def sized(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep``, class (fingerprint) and set size of every row."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", SLICE):
            own = shingles(raw(batch), RULE.words)
            arrays = [*(batch.column(c) for c in keep), pa.array([fingerprint(s) for s in own], pa.int64()), pa.array([len(s) for s in own], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, "class", "n_shingles"])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.mapInArrow(name, f"{kept}, class long, n_shingles long")


def levels(docs: DataFrame, rows: DataFrame) -> np.ndarray:
    """A level per cell of shingle hashes: 0 for the usual count, more for each doubling of what exceeds it.

    Tasks count cells and chunks of cells are added up side by side; only the levels, a byte per cell, reach the driver.
    """
    size = 1 << CELL_BITS
    width = size >> CHUNK_BITS
    usual = float(rows.agg(F.sum("n_shingles")).first()[0] or 0) / size

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, waiting = np.zeros(size, np.uint32), [], 0
        for batch in by_bytes(batches, "text", SLICE):
            for own in shingles(raw(batch), RULE.words):
                held.append((own >> np.uint64(64 - CELL_BITS)).astype(np.int64))
                waiting += len(held[-1])
            if waiting > size // 4:
                counts += np.bincount(np.concatenate(held), minlength=size).astype(np.uint32)
                held, waiting = [], 0
        if held:
            counts += np.bincount(np.concatenate(held), minlength=size).astype(np.uint32)
        codec = zstandard.ZstdCompressor(level=1)
        parts = [codec.compress(counts[at : at + width].tobytes()) for at in range(0, size, width)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int64()), pa.array(parts, pa.binary())], ["chunk", "counts"])

    def added(group: pa.Table) -> pa.Table:
        codec, total = zstandard.ZstdDecompressor(), np.zeros(width, np.uint64)
        for part in group.column("counts"):
            total += np.frombuffer(codec.decompress(part.as_py(), max_output_size=4 * width), np.uint32)
        above = total - usual
        level = np.where(above >= 8 + 4 * np.sqrt(usual), np.log2(np.maximum(above, 8) / 4), 0).astype(np.uint8)
        return pa.table({"chunk": group.column("chunk").slice(0, 1), "level": pa.array([level.tobytes()], pa.binary())})

    parts = docs.select("text").mapInArrow(tally, "chunk long, counts binary").groupBy("chunk").applyInArrow(added, "chunk long, level binary")
    found = np.zeros(size, np.uint8)
    for r in parts.collect():  # the size of the levels in all
        found[r["chunk"] * width : (r["chunk"] + 1) * width] = np.frombuffer(r["level"], np.uint8)
    return found


def rarest(own: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The set's short lists: its shingles from the rarest on, all but the T - 1 last for the smallest partner."""
    order = np.argsort(level[(own >> np.uint64(64 - CELL_BITS)).astype(np.int64)], kind="stable")
    return own[order[: len(own) - RULE.least(len(own)) + 1]] if len(own) else own


def postings(docs: DataFrame, level, shared) -> DataFrame:
    """Entries of the short lists: token, class, set size and rank of the token in the set."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", SLICE):
            parts = []
            for own in shingles(raw(batch), RULE.words):
                short = rarest(own, level.value)
                rank = np.flatnonzero(shared.value.has(short))
                parts.append((short[rank].view(np.int64), np.full(len(rank), fingerprint(own)), np.full(len(rank), len(own)), rank))
            arrays = [pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*parts, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["token", "class", "size", "rank"])

    rows = docs.select("text").mapInArrow(emit, "token long, class long, size long, rank long")
    return rows.groupBy("token", "class").agg(F.first("size").alias("size"), F.first("rank").alias("rank"))


def occurrences(lists: list[list[int]], least: int) -> dict[int, int]:
    """Ids in at least ``least`` of the sorted lists, with their number: a heap merge that skips (MergeSkip)."""
    heap = [(own[0], n) for n, own in enumerate(lists) if own]
    heapq.heapify(heap)
    at, found = [0] * len(lists), {}
    while len(heap) >= least:
        top, held = heap[0][0], []
        while heap and heap[0][0] == top:
            held.append(heapq.heappop(heap)[1])
        if len(held) >= least:
            found[top] = len(held)
            goal = top + 1
        else:  # nothing below the new top can be in enough lists
            while heap and len(held) < least - 1:
                held.append(heapq.heappop(heap)[1])
            if not heap:
                break
            goal = max(top + 1, heap[0][0])
        for n in held:
            at[n] = bisect_left(lists[n], goal, at[n])
            if at[n] < len(lists[n]):
                heapq.heappush(heap, (lists[n][at[n]], n))
    return found


def search(own: np.ndarray, members: list[np.ndarray]) -> list[int]:
    """The members that share enough with the query, by DivideSkip over an index of the members."""
    sizes = [len(m) for m in members]
    goals = [RULE.needed(len(own), n) if 4 * n >= 3 * len(own) and 4 * len(own) >= 3 * n else 0 for n in sizes]
    fitting = [n for n, goal in enumerate(goals) if goal]
    if not fitting:
        return []
    tokens = np.concatenate([members[n] for n in fitting])
    ids = np.repeat(fitting, [sizes[n] for n in fitting])
    spots = np.minimum(np.searchsorted(own, tokens), len(own) - 1)
    good = own[spots] == tokens
    order = np.argsort(spots[good], kind="stable")  # ids stay ascending in each list
    lengths = np.bincount(spots[good], minlength=len(own))
    lists = sorted((x.tolist() for x in np.split(ids[good][order], np.cumsum(lengths)[:-1])), key=len)
    least, longest = min(goals[n] for n in fitting), max(1, len(lists[-1]))
    skipped = min(least - 1, int(least / (PROBE_WEIGHT * np.log2(longest) + 1)))
    short, long = lists[: len(lists) - skipped], lists[len(lists) - skipped :]
    found = []
    for member, count in occurrences(short, least - skipped).items():
        for n, other in enumerate(long):
            if count >= goals[member] or count + len(long) - n < goals[member]:
                break
            spot = bisect_left(other, member)
            count += spot < len(other) and other[spot] == member
        if count >= goals[member]:
            found.append(member)
    return found


def linked(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows with class and set size, and the component of each class that has links."""
    context = docs.sparkSession.sparkContext
    docs = conform(docs, "doc_id", "text")
    rows = settle(sized(docs.withColumn("text_hash", F.xxhash64("text")), ("doc_id", "text_hash")), "shingle-sets")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    level = context.broadcast(levels(docs, rows))

    def short_lists(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for part in by_bytes(iter([batch]), "text", SLICE):
            for own in shingles(raw(part), RULE.words):
                yield rarest(own, level.value)

    shared = context.broadcast(recurring(docs.select("text"), short_lists, total))
    entries = settle(compact(postings(docs, level, shared), total, 4 << 20, TASKS), "postings")
    for sent in (level, shared):
        sent.destroy()
    counts = entries.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").select("token")
    lists = settle(compact(entries.join(counts, "token"), entries.count(), least=TASKS), "short-lists")
    def rest(left: DataFrame, texts: DataFrame, found: DataFrame | None) -> DataFrame:
        return rarely_apart(left, RULE)

    return rows, linked_classes(docs, rows, lists, "token", RULE, search, ROUNDS, ("size", "rank"), RULE.near_in_size() & RULE.first_possible(), SHARED, rest, BLOCK)


def join(docs: DataFrame) -> DataFrame:
    """doc_id, class, part, n_shingles and component_id of every row."""
    rows, found = linked(docs)
    return grouped(rows, found)


def first_of_components(docs: DataFrame) -> DataFrame:
    """The document with the smallest id of every component, once, and every document without words."""
    docs = conform(docs)
    joined = settle(join(docs), "components")
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "class")
    firsts = joined.where("n_shingles > 0").groupBy("part").agg(F.min(rank).alias("first"))
    firsts = firsts.select(F.col("first.doc_id").alias("first_id"), F.col("first.class").alias("first_class"))
    named = sized(docs, DOCUMENT)
    same = named["doc_id"].eqNullSafe(F.col("first_id")) & (named["class"] == F.col("first_class"))
    kept = named.where("n_shingles > 0").join(firsts, same, "left_semi").dropDuplicates(["doc_id", "class"])
    return kept.unionByName(named.where("n_shingles = 0")).select(*DOCUMENT)


SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)
  )
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS x FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), l AS MATERIALIZED (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * x >= 75 * (na.n + nb.n - x)
), e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
), c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM c LEFT JOIN n USING (doc_id)
"""


@query("op6_ngram_jaccard_join", SQL)
def _op6(spark, sf_dir):
    return join(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
