"""Benchmark decontamination by greedy string tiling.

Texts become lower-case words of letters and digits.  Runs of ``SEED`` words that a document shares with a
benchmark item are found by hash in one pass over the documents; the items are the query side and
travel in blocks of bounded size.  For each document and item with a shared seed, running Karp-Rabin
finds the longest common runs of words that no tile covers yet, and marks them longest first, until none
of ``SEED`` words is left.  The share of the item's words that tiles cover decides, so passages whose
parts were moved about are caught too.

Defined results.  Only doc_id and text of documents and item_id and text of the benchmark are read.  Null
and empty texts share nothing.  Items of fewer than ``SEED`` words match nothing.  Each row is judged for itself, so
equal rows are reported alike; equal items are each reported.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelscope.llm.common import by_bytes, conform, read, settle
from panelscope.llm.hashing import BYTE_VALUES, grams, hashed_spans, runs
from panelscope.llm.registry import query

SEED = 5
COVERAGE = 0.5
#: Longest window that the search starts with.
FIRST_WINDOW = 20
#: Text of the benchmark items that are searched for in one pass.
BLOCK_BYTES = 8 << 20

MATCHES = "item_id long, coverage double, tiles array<struct<item_start: int, doc_start: int, length: int>>"
_OTHER = re.compile(r"[\W_]+")
_MASK = (1 << 22) - 1


def words(text: str | None) -> np.ndarray:
    """Hashes of the words of letters and digits, lower-cased."""
    data = np.frombuffer(_OTHER.sub(" ", (text or "").lower()).encode("utf-8", "surrogatepass"), np.uint8)
    return hashed_spans(data, BYTE_VALUES, *runs(data != 32))


def _matches(item: list[int], text: list[int], covered: bytearray, taken: bytearray, size: int) -> list[tuple[int, int, int]]:
    """Maximal unmarked common runs of at least ``size`` words: (length, item start, text start)."""
    places: dict[int, list[int]] = defaultdict(list)
    for at, key in _windows(text, taken, size):
        places[key].append(at)
    found = []
    for p, key in _windows(item, covered, size):
        for t in places.get(key, ()):
            if p and t and not covered[p - 1] and not taken[t - 1] and item[p - 1] == text[t - 1]:
                continue  # found from further left
            k = 0
            while p + k < len(item) and t + k < len(text) and not covered[p + k] and not taken[t + k] and item[p + k] == text[t + k]:
                k += 1
            if k >= size:
                found.append((k, p, t))
    return found


def _windows(tokens: list[int], marked: bytearray, size: int) -> Iterator[tuple[int, int]]:
    """Karp-Rabin hashes of the windows without a marked word."""
    prime, base = (1 << 61) - 1, 1_000_003
    drop = pow(base, size - 1, prime)
    key, held = 0, 0
    for n, token in enumerate(tokens):
        if marked[n]:
            key = held = 0
            continue
        if held == size:
            key, held = (key - tokens[n - size] * drop) % prime, held - 1
        key, held = (key * base + token) % prime, held + 1
        if held == size:
            yield n - size + 1, key


def _free(covered: bytearray, taken: bytearray, p: int, t: int, k: int) -> list[tuple[int, int]]:
    """(offset, length) of the stretches of a match without a marked word."""
    if 1 not in covered[p : p + k] and 1 not in taken[t : t + k]:
        return [(0, k)]
    marked = bytes(map(or_, covered[p : p + k], taken[t : t + k]))
    return [(m.start(), m.end() - m.start()) for m in re.finditer(b"\0+", marked)]


def tile(item: list[int], text: list[int], taken: bytearray, least: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy tiles (item start, text start, length), always the longest match that is left.

    Equally long ones go by item start, then text start.  What earlier tiles leave of a match waits for its turn
    by its new length.  Words of ``text`` marked in ``taken`` are left out.
    """
    covered, tiles, size = bytearray(len(item)), [], max(least, min(FIRST_WINDOW, len(item)))
    while True:
        queue = [(-k, p, t) for k, p, t in _matches(item, text, covered, taken, size)]
        heapify(queue)
        while queue:
            k, p, t = heappop(queue)
            rest = _free(covered, taken, p, t, -k)
            if rest == [(0, -k)]:
                covered[p : p - k] = taken[t : t - k] = b"\1" * -k
                tiles.append((p, t, -k))
                continue
            for at, left in rest:
                if left >= size:  # shorter ones are found again with the next window
                    heappush(queue, (-left, p + at, t + at))
        if size == least:
            return sorted(tiles)
        size = max(least, size // 2)


@dataclass
class Block:
    """Items of one pass, ready for the search."""

    ids: list[int | None]
    items: list[list[int]]
    seeds: np.ndarray  # sorted
    owners: np.ndarray  # item of each seed
    bits: np.ndarray  # seeds by their low bits

    @staticmethod
    def of(rows: list) -> Block:
        hashes = [words(r["text"]) for r in rows]
        keys = [grams(h, SEED) for h in hashes]
        seeds = np.concatenate([*keys, np.empty(0, np.uint64)])
        owners = np.repeat(np.arange(len(rows)), [len(k) for k in keys])
        order = np.argsort(seeds, kind="stable")
        bits = np.zeros(_MASK + 1, bool)
        bits[(seeds & np.uint64(_MASK)).astype(np.int64)] = True
        return Block([r["item_id"] for r in rows], [h.tolist() for h in hashes], seeds[order], owners[order], bits)

    def matches(self, text: str | None, coverage: float) -> list[dict]:
        """The items whose tiles in the text cover enough."""
        own = words(text)
        keys = grams(own, SEED)
        spots = np.flatnonzero(self.bits[(keys & np.uint64(_MASK)).astype(np.int64)])
        if not len(spots):
            return []
        low, high = np.searchsorted(self.seeds, keys[spots]), np.searchsorted(self.seeds, keys[spots], side="right")
        near: dict[int, list[int]] = defaultdict(list)
        for at, a, b in zip(spots[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist(), strict=True):
            for owner in set(self.owners[a:b].tolist()):
                near[owner].append(at)
        found = []
        for owner, seen in sorted(near.items()):
            # only words in shared seeds can be in a tile; gaps are one marked word
            inside = np.zeros(len(own), bool)
            inside[(np.array(seen)[:, None] + np.arange(SEED)).ravel()] = True
            starts, stops = runs(inside)
            part, taken, origin = [], bytearray(), []
            for a, b in zip(starts.tolist(), stops.tolist(), strict=True):
                part += [*own[a:b].tolist(), 0]
                taken += bytes(b - a) + b"\1"
                origin += [*range(a, b), -1]
            item = self.items[owner]
            tiles = tile(item, part, taken)
            share = sum(k for _, _, k in tiles) / len(item)
            if share >= coverage:
                found.append({"item_id": self.ids[owner], "coverage": share, "tiles": [{"item_start": p, "doc_start": origin[t], "length": k} for p, t, k in tiles]})
        return found


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """The benchmark in parts of about ``block_bytes`` of text."""
    items = conform(benchmark, "item_id", "text").where("text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = 1 + total // block_bytes
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(count))
    for n in range(count):
        yield Block.of(items.where(part == n).orderBy("item_id", "text").collect())


def _searched(docs: DataFrame, block: Block, coverage: float, keep_clean: bool) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(block)
    names = docs.columns

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("item_start", pa.int32()), ("doc_start", pa.int32()), ("length", pa.int32())]))
        for batch in by_bytes(batches, "text"):
            ids, items, shares, tiles = [], [], [], []
            for n, text in enumerate(batch.column("text").to_pylist()):
                for m in sent.value.matches(text, coverage):
                    ids.append(batch.column("doc_id")[n].as_py())
                    items.append(m["item_id"])
                    shares.append(m["coverage"])
                    tiles.append(m["tiles"])
            if ids:
                arrays = [pa.array(ids, pa.int64()), pa.array(items, pa.int64()), pa.array(shares, pa.float64()), pa.array(tiles, kind)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "item_id", "coverage", "tiles"])

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            kept = [not sent.value.matches(text, coverage) for text in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(kept, pa.bool_()))

    if keep_clean:
        return docs.select(*names).mapInArrow(clean, docs.schema)
    return docs.select("doc_id", "text").mapInArrow(report, f"doc_id long, {MATCHES}")


def matches(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row per document and item that it contains: doc_id, item_id, coverage, tiles."""
    docs = conform(docs, "doc_id", "text")
    parts = [settle(_searched(docs, b, coverage, False), "leaks") for b in blocks(benchmark, block_bytes)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that contain no item; rows pass through in place."""
    out = conform(docs)
    for n, block in enumerate(blocks(benchmark, block_bytes)):
        out = _searched(settle(out, "clean") if n else out, block, coverage, True)
    return out


@query("op5_string_tiling")
def _op5(spark, sf_dir):
    found = matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    longest = F.array_max(F.transform("tiles", lambda t: t["length"]))
    return found.select("doc_id", "item_id", F.round("coverage", 6).alias("coverage"), F.size("tiles").alias("n_tiles"), longest.alias("longest_tile"))
