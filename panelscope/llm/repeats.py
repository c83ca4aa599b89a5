"""Removal of byte strings that a document with a smaller id contains too, by prefix-free parsing.

Trigger positions are the minimal rolling hashes of every window of ``LENGTH`` bytes, so each window holds one, and
equal windows hold the same.  The triggers cut a text into phrases: a phrase is the run of windows with one
trigger, with all their bytes.  The parse of a document is its list of phrases; the dictionary has each phrase once, with the
smallest document that contains it.  All windows of a phrase that came in a smaller document are repeated,
without a look at them.  That settles copies of any length by one row per phrase.

Left are dictionary phrases around the same trigger that differ in their bytes, at the ends of passages and at edits.
Their suffixes are sorted by their first ``LENGTH`` bytes, by prefix doubling, and those that share them by document: this is
the corpus order of the windows of a trigger.  A window never leaves its phrase, so the parse adds to the order only which documents
have the phrase.  Neighbours with ``LENGTH`` common bytes are copies, and of those the smallest document is the first.

No group holds more than the distinct phrases or windows of a bounded share of the hashes: phrases are dealt by phrase, triggers are
summed up per task, and the windows of a trigger with ``HOT`` phrases or more are dealt one by one and reduced per task first.

Triggers that occur in one document only are left out by a filter that never misses a recurring one.

Defined results.  Only doc_id and text are read.  Null ids rank after all others, and rows with one id (or
none) never repeat each other.  Null texts are empty.  Equal rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelscope.llm.common import by_bytes, conform, read, settle
from panelscope.llm.hashing import BYTE_VALUES, hashed_spans, mix, prefix, rolling, span
from panelscope.llm.recurring import BUCKET_BYTES, LEAST_BUCKETS, MOST_BUCKETS, Filter, positions, power_of_two, low_part, recurring
from panelscope.llm.registry import query

LENGTH = 50
#: Bytes of a rolling hash; a window has ``LENGTH - TRIGGER + 1`` of them.
TRIGGER = 20
#: Rank of rows without an id.
LAST = (1 << 63) - 1
#: Window starts parsed at once, and phrases that a task combines at once.
SEGMENT, CHUNK = 1 << 16, 1 << 17
#: Bytes of text that a task parses at once.
SLICE = 1 << 18
#: Bytes of phrases that a task gathers before it sends them to be compared.
CONTEXT_BYTES = 8 << 20
#: From so many phrases on, the windows of a trigger are dealt one by one; and bytes of such phrases that a task reduces at once.
HOT, HOT_BYTES = 1 << 14, 2 << 20
#: Result kinds of the dictionary step: repeated runs, and filter slices of first phrases, of triggers with several, and of hot ones.
REPEATED, FIRST, SEVERAL, CROWDED = 0, 1, 2, 3
#: Hot triggers are few: their filter is smaller by so many powers of two.
FEWER_BITS = 6
#: Groups for results that need no further step, at least.
SPREAD = 256

_PLACE = np.uint64((1 << 20) - 1)
_PHRASE = (("trigger", "<u8"), ("phrase", "<u8"), ("rank", "<i8"), ("text", "<i8"), ("start", "<u4"), ("count", "<u4"))
_RUN = (("rank", "<i8"), ("text", "<i8"), ("start", "<u4"), ("count", "<u4"))
_RUN_NAMES = ["rank", "text_hash", "start", "windows"]
_RUN_ROWS = "rank long, text_hash long, start long, windows long"
_TRIGGER = (("trigger", "<u8"), ("phrases", "<i8"), ("low", "<u8"), ("high", "<u8"), ("least", "<i8"), ("most", "<i8"))
_WINDOW = (("window", "<u8"), ("rank", "<i8"), ("text", "<i8"), ("start", "<u4"))


def pack(kind, columns) -> bytes:
    return b"".join(np.ascontiguousarray(c, dtype=t).tobytes() for (_, t), c in zip(kind, columns, strict=True))


def unpack(kind, data: bytes) -> list[np.ndarray]:
    n, at, out = len(data) // sum(np.dtype(t).itemsize for _, t in kind), 0, []
    for _, t in kind:
        out.append(np.frombuffer(data, t, n, at))
        at += n * np.dtype(t).itemsize
    return out


class Parse:
    """Phrases of the documents of one slice, in order: document, first window, number of windows, trigger and phrase hash."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        self.stops = np.cumsum(sizes)
        self.begins = self.stops - sizes
        parts = [self._segment(low) for low in range(0, max(0, len(self.data) - LENGTH + 1), SEGMENT)]
        names = ("doc", "start", "count", "trigger", "phrase")
        merged = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.empty(0, np.int64)] * 3 + [np.empty(0, np.uint64)] * 2
        for name, values in zip(names, merged, strict=True):
            setattr(self, name, values)
        self.within = self.start - self.begins[self.doc] if len(self.doc) else self.start

    def _segment(self, low: int):
        symbols = self.data[low : low + SEGMENT + LENGTH - 1]
        sums = prefix(BYTE_VALUES[symbols])
        hashes = rolling(sums, TRIGGER)
        best = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
        reach, width = 1, LENGTH - TRIGGER + 1
        while reach < width:  # minima of ever longer windows; ties go to the left
            step = min(reach, width - reach)
            best = np.minimum(best[: len(best) - step], best[step:])
            reach += step
        places = best & _PLACE
        n, one, last = len(places), *np.searchsorted(self.stops, (low, low + len(places)), side="right")
        edges = np.concatenate((self.begins[one : last + 1], self.stops[one : last + 1] - LENGTH + 1)) - low
        heads = np.flatnonzero(places[1:] != places[:-1]) + 1
        begin = np.unique(np.concatenate(([0], heads, edges[(edges > 0) & (edges < n)])))
        counts = np.diff(np.append(begin, n))
        doc = np.searchsorted(self.stops, begin + low, side="right")
        good = begin + low + LENGTH <= self.stops[doc]
        begin, counts, doc = begin[good], counts[good], doc[good]
        trigger = mix(hashes[places[begin].astype(np.int64)])
        return doc, begin + low, counts, trigger, span(sums, begin, begin + counts + LENGTH - 1)


def ranked(docs: DataFrame) -> DataFrame:
    """rank, text_hash and the bytes of every row."""
    data = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return conform(docs, "doc_id", "text").select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("rank"), F.xxhash64("text").alias("text_hash"), data.alias("data"))


def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Parse, np.ndarray, np.ndarray]]:
    """Parses of slices, with rank and text hash of each phrase."""
    for batch in by_bytes(batches, "data", SLICE):
        own = Parse(batch.column("data").to_pylist())
        if len(own.doc):
            ranks, names = (np.array(batch.column(c).to_pylist(), np.int64)[own.doc] for c in ("rank", "text_hash"))
            yield own, ranks, names


def _triggers(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The triggers of a batch, each once per document."""
    for own, _, _ in parsed(iter([batch])):
        order = np.lexsort((own.doc, own.trigger))
        values, docs = own.trigger[order], own.doc[order]
        yield values[np.concatenate(([True], (values[1:] != values[:-1]) | (docs[1:] != docs[:-1])))]


def pair_hash(hashes: np.ndarray, ranks: np.ndarray, names: np.ndarray, bucket_bits: int) -> np.ndarray:
    """A hash of phrase and document that stays in the phrase's bucket."""
    both = mix(hashes ^ mix(mix(ranks.view(np.uint64)) ^ names.view(np.uint64)))
    top = np.uint64(64 - bucket_bits)
    return (hashes >> top << top) | (both >> np.uint64(bucket_bits))


def bucket_of(hashes: np.ndarray, bucket_bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bucket_bits)).astype(np.int64)


def heads_of(values: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin."""
    return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.empty(0, np.int64)


def dealt(to: np.ndarray, kind, columns: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
    """A packed row per bucket."""
    if not len(to):
        return
    order = np.argsort(to, kind="stable")
    to, columns = to[order], [x[order] for x in columns]
    cuts = heads_of(to)
    for low, high in zip(cuts, [*cuts[1:], len(to)], strict=True):
        yield int(to[low]), pack(kind, [x[low:high] for x in columns])


def apart(ranks: np.ndarray, names: np.ndarray, bucket_bits: int) -> np.ndarray:
    """Negative buckets for finished runs, so that copies of one text come apart."""
    spread = np.uint64(max(SPREAD, 1 << bucket_bits))
    return -1 - (mix(ranks.astype(np.uint64) ^ mix(names.astype(np.uint64))) % spread).astype(np.int64)


def after_first(hashes: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Which rows have a hash that a smaller document has too."""
    order = np.lexsort((ranks, hashes))
    h, r = hashes[order], ranks[order]
    head = heads_of(h)
    later = np.zeros(len(order), bool)
    later[order] = r > np.repeat(r[head], np.diff(np.append(head, len(h))))
    return later


def combined(phrases: list[np.ndarray], bucket_bits: int) -> pa.RecordBatch:
    """Of each phrase of a chunk the smallest documents go on to the dictionary, in the phrase's bucket; the others are repeated.

    Runs have negative buckets, and sums over triggers those above the phrases'.
    """
    trigger, phrase, rank, text, start, count = phrases
    order = np.lexsort((start, text, rank))
    trigger, phrase, rank, text, start, count = (x[order] for x in (trigger, phrase, rank, text, start, count))
    later, rows = after_first(phrase, rank), []
    if later.any():  # neighbours of one document are one run
        a, b, s, c = rank[later], text[later], start[later], count[later]
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (s[1:] != s[:-1] + c[:-1])))
        at = np.flatnonzero(new)
        rows += dealt(apart(a[at], b[at], bucket_bits), _RUN, [a[at], b[at], s[at], np.add.reduceat(c, at)])
    order = np.flatnonzero(~later)
    order = order[np.argsort(phrase[order], kind="stable")]
    keep = [x[order] for x in (trigger, phrase, rank, text, start, count)]
    new = np.concatenate(([True], (keep[1][1:] != keep[1][:-1]) | (keep[3][1:] != keep[3][:-1]) | (keep[4][1:] != keep[4][:-1])))
    keep = [x[new] for x in keep]  # equal rows once
    rows += dealt(bucket_of(keep[1], bucket_bits), _PHRASE, keep)
    order = np.argsort(keep[0], kind="stable")
    t, p, r = (x[order] for x in keep[:3])
    head = heads_of(t)
    sums = [t[head], np.diff(np.append(head, len(t))), *(f.reduceat(x, head) for x in (p, r) for f in (np.minimum, np.maximum))]
    rows += dealt(bucket_of(t[head], bucket_bits) + (1 << bucket_bits), _TRIGGER, sums)
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.binary())], ["bucket", "data"])


def filter_slice(hashes: np.ndarray, bucket_bits: int, slice_bits: int) -> bytes:
    bits = np.zeros(1 << slice_bits, bool)
    for at in positions(low_part(hashes, bucket_bits), slice_bits):
        bits[at.astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def filter_bits(kind: int, slice_bits: int) -> int:
    return max(6, slice_bits - FEWER_BITS) if kind == CROWDED else slice_bits


def dictionary(docs: DataFrame, shared, bucket_bits: int, slice_bits: int) -> DataFrame:
    """Repeated phrases as packed runs, and filter slices that tell which phrases must be compared by their windows."""

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for own, ranks, names in parsed(batches):
            known = shared.value.has(own.trigger)
            held.append([x[known] for x in (own.trigger, own.phrase, ranks, names, own.within, own.count)])
            size += int(known.sum())
            if size >= CHUNK:
                yield combined([np.concatenate(x) for x in zip(*held, strict=True)], bucket_bits)
                held, size = [], 0
        if size:
            yield combined([np.concatenate(x) for x in zip(*held, strict=True)], bucket_bits)

    def first_phrases(blobs: list[bytes]) -> Iterator[tuple[int, bytes]]:
        _, phrase, rank, text, start, count = (np.concatenate(x) for x in zip(*(unpack(_PHRASE, b) for b in blobs), strict=True))
        later = after_first(phrase, rank)
        if later.any():
            yield REPEATED, pack(_RUN, [x[later] for x in (rank, text, start, count)])
        yield FIRST, filter_slice(pair_hash(phrase[~later], rank[~later], text[~later], bucket_bits), bucket_bits, slice_bits)

    def sums_of_triggers(blobs: list[bytes]) -> Iterator[tuple[int, bytes]]:
        sums = [np.concatenate(x) for x in zip(*(unpack(_TRIGGER, b) for b in blobs), strict=True)]
        order = np.argsort(sums[0], kind="stable")
        trigger, phrases, low, high, least, most = (x[order] for x in sums)
        head = heads_of(trigger)
        # several phrases, in several documents
        several = (np.minimum.reduceat(low, head) < np.maximum.reduceat(high, head)) & (np.minimum.reduceat(least, head) < np.maximum.reduceat(most, head))
        crowded = several & (np.add.reduceat(phrases, head) >= HOT)
        for kind, which in ((SEVERAL, several), (CROWDED, crowded)):
            if which.any():
                yield kind, filter_slice(trigger[head][which], bucket_bits, filter_bits(kind, slice_bits))

    def settle_bucket(group: pa.Table) -> pa.Table:
        bucket, blobs = group.column("bucket")[0].as_py(), group.column("data").to_pylist()
        if bucket < 0:
            out = [(REPEATED, b) for b in blobs]
        elif bucket < 1 << bucket_bits:
            out = list(first_phrases(blobs))
        else:
            bucket -= 1 << bucket_bits
            out = list(sums_of_triggers(blobs))
        kinds, data = [x[0] for x in out], [x[1] for x in out]
        return pa.table({"kind": pa.array(kinds, pa.int32()), "bucket": pa.array([bucket] * len(out), pa.int64()), "data": pa.array(data, pa.binary())})

    rows = docs.select("rank", "text_hash", "data").mapInArrow(scatter, "bucket long, data binary")
    return rows.groupBy("bucket").applyInArrow(settle_bucket, "kind int, bucket long, data binary")


def filters(found: DataFrame, bucket_bits: int, slice_bits: int) -> dict[int, Filter]:
    """The filters of the dictionary step from their slices."""
    out = {}
    for kind in (FIRST, SEVERAL, CROWDED):
        bits = filter_bits(kind, slice_bits)
        out[kind] = Filter(bucket_bits, bits, np.zeros(1 << (bucket_bits + bits - 3), np.uint8))
    for r in found.where(F.col("kind") != REPEATED).toLocalIterator():  # the filters' size in all
        width = 1 << (out[r["kind"]].slice_bits - 3)
        out[r["kind"]].data[r["bucket"] * width : (r["bucket"] + 1) * width] = np.frombuffer(r["data"], np.uint8)
    return out


def suffix_ranks(symbols: np.ndarray) -> np.ndarray:
    """Ranks of all suffixes by their first ``LENGTH`` bytes, equal for equal ones, by prefix doubling; those that are shorter have none that counts."""
    n, reach = len(symbols), 8
    padded = np.concatenate((symbols, np.zeros(reach, np.uint8)))
    key = np.zeros(n, np.uint64)
    for k in range(reach):
        key = key << np.uint64(8) | padded[k : k + n]
    rank = np.unique(key, return_inverse=True)[1].astype(np.uint64)
    while reach < LENGTH:
        step = min(reach, LENGTH - reach)
        after = np.concatenate((rank[step:], np.zeros(min(n, step), np.uint64)))
        rank = np.unique(rank << np.uint64(32) | after, return_inverse=True)[1].astype(np.uint64)
        reach += step
    return rank


def windows_of(count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows of phrases that lie one after the other: phrase, place in it, place among all bytes."""
    count = count.astype(np.int64)
    begin = np.cumsum(count + LENGTH - 1) - (count + LENGTH - 1)
    of = np.repeat(np.arange(len(count)), count)
    offset = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    return of, offset, begin[of] + offset


def runs_of(later: np.ndarray, of: np.ndarray, offset: np.ndarray, rank: np.ndarray, text: np.ndarray, start: np.ndarray) -> list[np.ndarray]:
    """Repeated windows as runs."""
    at = np.flatnonzero(later)
    heads = np.flatnonzero(np.concatenate(([True], (np.diff(at) != 1) | (of[at][1:] != of[at][:-1])))[: len(at)])
    first = at[heads]
    lengths = np.diff(np.concatenate((heads, [len(at)])))
    return [rank[of[first]], text[of[first]], start[of[first]].astype(np.int64) + offset[first], lengths]


def compared(docs: DataFrame, sent, bucket_bits: int) -> DataFrame:
    """Runs of repeated windows among dictionary phrases that share a trigger but not all bytes.

    Phrases meet in the bucket of their trigger; windows of hot triggers have buckets above, finished runs negative ones.
    """

    def together(held: list[tuple]) -> tuple[list[np.ndarray], np.ndarray]:
        return [np.concatenate(x) for x in list(zip(*held, strict=True))[:5]], np.frombuffer(b"".join(x[5] for x in held), np.uint8)

    def batch_of(rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["bucket", "heads", "data"])

    def gathered(held: list[tuple]) -> pa.RecordBatch:
        """A row per bucket with the contexts of several slices."""
        (trigger, rank, text, start, count), symbols = together(held)
        begin = np.cumsum(count + LENGTH - 1) - (count + LENGTH - 1)
        to = bucket_of(trigger, bucket_bits)
        order = np.argsort(to, kind="stable")
        cuts, rows = heads_of(to[order]), []
        for low, high in zip(cuts, [*cuts[1:], len(to)], strict=True):
            own = order[low:high]
            places = zip(begin[own].tolist(), count[own].tolist(), strict=True)
            data = b"".join(symbols[s : s + c + LENGTH - 1].tobytes() for s, c in places)
            rows.append((int(to[own[0]]), pack(_RUN, [x[own] for x in (rank, text, start, count)]), data))
        return batch_of(rows)

    def reduced(held: list[tuple]) -> pa.RecordBatch:
        """Windows of hot triggers: those that a smaller document of the task has are repeated, the others go on by hash."""
        (_, rank, text, start, count), symbols = together(held)
        of, offset, places = windows_of(count)
        keys = hashed_spans(symbols, BYTE_VALUES, places, places + LENGTH)
        later, rows = after_first(keys, rank[of]), []
        runs = runs_of(later, of, offset, rank, text, start)
        rows += dealt(apart(runs[0], runs[1], bucket_bits), _RUN, runs)
        left = np.flatnonzero(~later)
        to = bucket_of(keys[left], bucket_bits) + (1 << bucket_bits)
        rows += dealt(to, _WINDOW, [keys[left], rank[of[left]], text[of[left]], start[of[left]] + offset[left]])
        return batch_of([(b, d, b"") for b, d in rows])

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sent.value
        held, sizes = {False: [], True: []}, {False: 0, True: 0}
        finish, limits = {False: gathered, True: reduced}, {False: CONTEXT_BYTES, True: HOT_BYTES}
        for own, ranks, names in parsed(batches):
            at = np.flatnonzero(found[SEVERAL].has(own.trigger))
            at = at[found[FIRST].has(pair_hash(own.phrase[at], ranks[at], names[at], bucket_bits))]
            crowded = found[CROWDED].has(own.trigger[at])
            for hot, some in ((False, at[~crowded]), (True, at[crowded])):
                if not len(some):
                    continue
                places = zip(own.start[some].tolist(), own.count[some].tolist(), strict=True)
                data = b"".join(own.data[s : s + c + LENGTH - 1].tobytes() for s, c in places)
                held[hot].append((own.trigger[some], ranks[some], names[some], own.within[some], own.count[some], data))
                sizes[hot] += len(data)
                if sizes[hot] >= limits[hot]:
                    yield finish[hot](held[hot])
                    held[hot], sizes[hot] = [], 0
        for hot in (False, True):
            if held[hot]:
                yield finish[hot](held[hot])

    def sort_windows(group: pa.Table) -> pa.Table:
        bucket, heads = group.column("bucket")[0].as_py(), group.column("heads").to_pylist()
        single = bucket >= 1 << bucket_bits
        columns = [np.concatenate(x) for x in zip(*(unpack(_WINDOW if single else _RUN, b) for b in heads), strict=True)]
        if bucket < 0:
            runs = columns
        elif single:
            later = after_first(columns[0], columns[1])
            runs = [*(x[later] for x in columns[1:]), np.ones(int(later.sum()), np.int64)]
        else:
            rank, text, start, count = columns
            of, offset, places = windows_of(count)
            order = suffix_ranks(np.frombuffer(b"".join(group.column("data").to_pylist()), np.uint8))[places]
            runs = runs_of(after_first(order, rank[of]), of, offset, rank, text, start)
        return pa.table([pa.array(x.astype(np.int64)) for x in runs], _RUN_NAMES)

    rows = docs.select("rank", "text_hash", "data").mapInArrow(scatter, "bucket long, heads binary, data binary")
    return rows.groupBy("bucket").applyInArrow(sort_windows, _RUN_ROWS)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob in batch.column("data").to_pylist():
            rank, text, start, count = unpack(_RUN, blob)
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (rank, text, start, count)], _RUN_NAMES)


def repeated(docs: DataFrame) -> DataFrame:
    """Runs of repeated windows: rank, text_hash, start, windows; ``docs`` comes from ``ranked``."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    shared = recurring(docs.select("rank", "text_hash", "data"), _triggers, total)
    sent = spark.sparkContext.broadcast(shared)
    bucket_bits = power_of_two(total / BUCKET_BYTES, LEAST_BUCKETS, MOST_BUCKETS)
    slice_bits = shared.slice_bits
    found = settle(dictionary(docs, sent, bucket_bits, slice_bits), "phrases")
    wanted = spark.sparkContext.broadcast(filters(found, bucket_bits, slice_bits))
    packed = found.where(F.col("kind") == REPEATED).select("data")
    return packed.mapInArrow(_runs, _RUN_ROWS).unionByName(compared(docs, wanted, bucket_bits))


def covered(runs: list[dict], size: int) -> list[tuple[int, int]]:
    """Maximal removed byte ranges."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted((r["start"], min(size, r["start"] + r["windows"] + LENGTH - 1)) for r in runs):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], stop))
        else:
            out.append((start, stop))
    return out


def strip(docs: DataFrame) -> DataFrame:
    """Every document with the removed byte ranges and the bytes that stay."""
    docs = ranked(docs)
    runs = repeated(docs).groupBy("rank", "text_hash").agg(F.collect_set(F.struct("start", "windows")).alias("runs"))
    joined = docs.join(runs, ["rank", "text_hash"], "left").select("doc_id", "data", "runs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for batch in by_bytes(batches, "data", SLICE):
            spans, kept = [], []
            for data, found in zip(batch.column("data").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                places = covered(found or [], len(data))
                edges = [0, *(x for p in places for x in p), len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                spans.append([{"start": a, "stop": b} for a, b in places])
            sizes = pa.compute.binary_length(batch.column("data")).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes, pa.array(spans, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "removed", "kept"])

    return joined.mapInArrow(cut, "doc_id long, n_bytes long, removed array<struct<start:long,stop:long>>, kept binary")


SQL = f"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS MATERIALIZED (
  SELECT doc_id, i, md5(h[2 * i + 1:2 * i + {2 * LENGTH}]) AS s
  FROM (SELECT doc_id, h, unnest(range(0, greatest(len(h) // 2 - {LENGTH - 1}, 0))) AS i FROM d)
), f AS (
  SELECT s, min(doc_id) AS first FROM w GROUP BY s
), r AS (
  SELECT w.doc_id, i, lag(i) OVER (PARTITION BY w.doc_id ORDER BY i) AS before FROM w JOIN f USING (s) WHERE first < w.doc_id
), g AS (
  SELECT *, sum(CASE WHEN i <= before + {LENGTH} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM r
), o AS (
  SELECT doc_id, min(i) AS start, max(i) + {LENGTH} AS stop FROM g GROUP BY doc_id, island
), k AS (
  SELECT doc_id, count(*) AS n_spans, sum(stop - start)::BIGINT AS n_removed, list(start ORDER BY start) AS starts, list(stop ORDER BY start) AS stops FROM o GROUP BY doc_id
)
SELECT d.doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN k.doc_id IS NULL THEN h ELSE array_to_string(list_transform(range(0, n_spans + 1),
    lambda x: h[2 * coalesce(stops[x], 0) + 1:2 * coalesce(starts[x + 1], len(h) // 2)]), '') END)) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""


@query("op7_prefix_free_parsing", SQL)
def _op7(spark, sf_dir):
    out = strip(read(spark, sf_dir, "documents"))
    size = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["stop"] - r["start"])
    return out.select("doc_id", "n_bytes", size.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
