"""Which hashes occur in more than one row, as a filter of bounded size that errs on the safe side.

Tasks sort the hashes of their rows, cut them by leading bits into buckets and pack them; a bucket is sorted
once more over the corpus, and what occurs twice is entered in the bucket's slice of a Bloom filter.  Four bytes
a hash are shuffled.  A hash that many rows share is sent twice by a task at most.  The filter never misses a recurring hash;
who uses it passes rows on to an exact step, so its size (bounded by ``MOST_BITS``) changes costs, not results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelscope.llm.hashing import mix

#: Text bytes per bucket, and bounds for the number of buckets, as powers of two.
BUCKET_BYTES, LEAST_BUCKETS, MOST_BUCKETS = 1 << 20, 6, 20
#: Filter bits as powers of two; within the bounds a bit for eight bytes of text.
LEAST_BITS, MOST_BITS, BYTES_PER_BIT = 20, 29, 8
PROBES = 4
#: Hashes that a task sorts at once.
CHUNK = 1 << 19

Hashes = Callable[[pa.RecordBatch], Iterator[np.ndarray]]


def power_of_two(x: float, low: int, high: int) -> int:
    return min(high, max(low, int(max(1, x) - 1).bit_length()))


@dataclass
class Filter:
    """Bits by bucket; ``has`` is true for all recurring hashes and few others."""

    bucket_bits: int
    slice_bits: int
    data: np.ndarray

    def has(self, hashes: np.ndarray) -> np.ndarray:
        base = (hashes >> np.uint64(64 - self.bucket_bits)) << np.uint64(self.slice_bits)
        found = np.ones(len(hashes), bool)
        for at in positions(low_part(hashes, self.bucket_bits), self.slice_bits):
            at = base + at
            found &= (self.data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found


def low_part(hashes: np.ndarray, bucket_bits: int) -> np.ndarray:
    """The 32 bits after the bucket's."""
    return ((hashes >> np.uint64(32 - bucket_bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def positions(values: np.ndarray, slice_bits: int) -> Iterator[np.ndarray]:
    key = mix(values.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    for _ in range(PROBES):
        yield key & np.uint64((1 << slice_bits) - 1)
        key = mix(key)


def packed(hashes: list[np.ndarray], bucket_bits: int) -> pa.RecordBatch:
    """A row per bucket with its sorted values; those that come twice or more come twice."""
    values, counts = np.unique(np.concatenate(hashes), return_counts=True)
    values = np.repeat(values, np.minimum(counts, 2))
    buckets = (values >> np.uint64(64 - bucket_bits)).astype(np.int64)
    data = low_part(values, bucket_bits)
    first = np.flatnonzero(np.concatenate(([True], buckets[1:] != buckets[:-1]))) if len(buckets) else np.empty(0, np.int64)
    parts = np.split(data, first[1:]) if len(first) else []
    return pa.RecordBatch.from_arrays([pa.array(buckets[first], pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], ["bucket", "data"])


def recurring(rows: DataFrame, hashes: Hashes, total_bytes: int) -> Filter:
    """The filter of the hashes that ``hashes`` yields, an array per row, for more than one row."""
    bucket_bits = power_of_two(total_bytes / BUCKET_BYTES, LEAST_BUCKETS, MOST_BUCKETS)
    slice_bits = power_of_two(total_bytes / BYTES_PER_BIT, LEAST_BITS, MOST_BITS) - bucket_bits
    slice_bits = max(6, slice_bits)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for own in hashes(batch):
                held.append(own)
                size += len(own)
                if size >= CHUNK:
                    yield packed(held, bucket_bits)
                    held, size = [], 0
        if size:
            yield packed(held, bucket_bits)

    def twice(group: pa.Table) -> pa.Table:
        values = np.sort(np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in group.column("data")]))
        found = np.unique(values[1:][values[1:] == values[:-1]])
        bits = np.zeros(1 << slice_bits, bool)
        for at in positions(found, slice_bits):
            bits[at.astype(np.int64)] = True
        data = np.packbits(bits, bitorder="little").tobytes() if len(found) else None
        return pa.table({"bucket": group.column("bucket").slice(0, 1), "bits": pa.array([data], pa.binary())})

    scattered = rows.mapInArrow(scatter, "bucket long, data binary")
    slices = scattered.groupBy("bucket").applyInArrow(twice, "bucket long, bits binary").where(F.col("bits").isNotNull())
    data = np.zeros(1 << (bucket_bits + slice_bits - 3), np.uint8)
    width = 1 << (slice_bits - 3)
    for r in slices.toLocalIterator():  # the filter's size in all
        data[r["bucket"] * width : (r["bucket"] + 1) * width] = np.frombuffer(r["bits"], np.uint8)
    return Filter(bucket_bits, slice_bits, data)
