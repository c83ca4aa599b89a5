"""Documents as sets of word shingles: names, candidates from lists, exact checks of pairs, and components.

Documents with equal sets are one class, named by a 64-bit fingerprint.  Classes meet in lists (of a shingle, or of a
signature's band).  ``one_each`` gives every class one partner, the head of most of its lists: star-shaped pairs, as many as
there are classes at most.  ``verified`` reads the texts of candidate pairs and checks them on full sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelscope.llm.common import by_bytes, compact, heavy_join, settle
from panelscope.llm.hashing import grams, mix, words_of_all

#: Candidates of one query that are checked at once.
BLOCK = 256
#: Partitions that small steps with much work to a row keep at least.
TASKS = 12
#: Bytes of text that a task hashes at once.
SLICE = 1 << 18
#: Up to so many classes (16 bytes each) are broadcast to find their texts.
BROADCAST_CLASSES = 500_000


@dataclass(frozen=True)
class Rule:
    """Shingles of so many words; sets are linked from ``percent`` of intersection to union on."""

    words: int
    percent: int

    def needed(self, a, b):
        """Shingles that sets of these sizes must share: 100 x >= percent (a + b - x)."""
        return (self.percent * (a + b) + 99 + self.percent) // (100 + self.percent)

    def least(self, n: int) -> int:
        """Shingles that a set of this size must share with any partner."""
        return (self.percent * n + 99) // 100

    def goal(self) -> Column:
        """``needed`` of the columns size and size_b."""
        return F.expr(f"({self.percent} * (size + size_b) + {99 + self.percent}) div {100 + self.percent}")

    def own_least(self) -> Column:
        """``least`` of the column size."""
        return F.expr(f"({self.percent} * size + 99) div 100")

    def rare_shared(self) -> Column:
        """Shingles that similar sets of sizes size and size_b share at least among the rarest ones of both, ``least`` of them left out."""
        return F.greatest(F.lit(1), self.goal() - F.expr(f"({self.percent} * greatest(size, size_b) + 99) div 100") + 1)

    def first_possible(self) -> Column:
        """Whether sets whose first common shingle has these ranks (rank, rank_b) in one order of all can share enough."""
        return F.least(F.col("size") - F.col("rank"), F.col("size_b") - F.col("rank_b")) >= self.goal()

    def near_in_size(self) -> Column:
        return (100 * F.col("size") >= self.percent * F.col("size_b")) & (100 * F.col("size_b") >= self.percent * F.col("size"))


def shingles(texts: list[bytes | None], width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each UTF-8 text; a text with fewer words is one shingle."""
    words, bounds = words_of_all([t or b"" for t in texts])
    whole, out = grams(words, width), []
    for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if 0 < high - low < width:
            own = grams(words[low:high], high - low)
        else:
            own = np.sort(whole[low : max(low, high - width + 1)])
        out.append(own[np.concatenate(([True], own[1:] != own[:-1]))] if len(own) else own)
    return out


def fingerprint(own: np.ndarray) -> int:
    """A 64-bit name of a set, as a signed number."""
    total = np.uint64(len(own)) + np.add.reduce(mix(own ^ np.uint64(0xC3A5C85C97CB3127)), dtype=np.uint64)
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])


def raw(batch: pa.RecordBatch) -> list[bytes | None]:
    """Texts as bytes, whatever they hold."""
    return batch.column("text").cast(pa.binary()).to_pylist()


def texts_of(docs: DataFrame, rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """One text of each wanted class; ``rows`` has class and text_hash, ``wanted`` is a written table of classes."""
    named = rows.join(wanted, "class").groupBy("class").agg(F.min("text_hash").alias("text_hash"))
    named = settle(compact(named, wanted.count()), "class-names")
    n = named.count()
    if n <= BROADCAST_CLASSES:
        named = F.broadcast(named)
    texts = docs.select(F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    return compact(texts.join(named, "text_hash").groupBy("class").agg(F.first("text").alias("text")), n, 2_000, TASKS)


Find = Callable[[np.ndarray, list[np.ndarray]], list[int]]


def matching(rule: Rule) -> Find:
    """Which members share enough with a query: all by one lookup of their shingles in it."""

    def find(own: np.ndarray, members: list[np.ndarray]) -> list[int]:
        sizes = np.array([len(m) for m in members])
        tokens = np.concatenate(members)
        if not len(own):
            return []
        spots = np.minimum(np.searchsorted(own, tokens), len(own) - 1)
        shared = np.bincount(np.repeat(np.arange(len(members)), sizes)[own[spots] == tokens], minlength=len(members))
        return np.flatnonzero((shared >= rule.needed(len(own), sizes)) & (sizes > 0)).tolist()

    return find


def verified(pairs: DataFrame, texts: DataFrame, rule: Rule, find: Find, block: int | None = None) -> DataFrame:
    """Of the candidate pairs (a, b), a written table, those that are similar enough."""
    block = block or BLOCK
    n_pairs = pairs.count()
    counts = settle(compact(pairs.groupBy("a").agg(F.count("*").alias("n")), n_pairs), "query-sizes")
    blocks = F.ceil(F.col("n") / block)
    dealt = pairs.join(counts, "a").select("a", "b", F.pmod(F.xxhash64("b"), blocks).alias("block"))
    asked = counts.select("a", F.lit(None).cast("long").alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"))
    rows = asked.join(texts.withColumnRenamed("class", "a"), "a").unionByName(dealt.join(texts.withColumnRenamed("class", "b"), "b"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, names, members, size, key = None, [], [], 0, None

        def done() -> pa.RecordBatch:
            good = [names[n] for n in find(own, members)] if members else []
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(good) if key else [], pa.int64()), pa.array(good, pa.int64())], ["a", "b"])

        for batch in by_bytes(batches, "text", SLICE):
            found = zip(*(batch.column(c).to_pylist() for c in ("a", "b", "block")), shingles(raw(batch), rule.words), strict=True)
            for a, b, part, own_set in found:
                if (a, part) != key or len(members) >= 2 * block or size > 1 << 22:
                    yield done()
                    names, members, size, key = [], [], 0, (a, part)
                if b is None:  # the query comes first
                    own = own_set
                else:
                    names.append(b)
                    members.append(own_set)
                    size += len(own_set)
        yield done()

    # as many partitions as there is work: coalesced ones would hold the Arrow buffers of all their parts until the task ends
    dealt_out = rows.select("a", "b", "block", "text").repartition(max(TASKS, n_pairs // 2_000 + 1), "a", "block")
    return dealt_out.sortWithinPartitions("a", "block", F.col("b").asc_nulls_first()).mapInArrow(check, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node that links reach, for all nodes of the links (a, b)."""
    size = 2 * edges.count()
    both = settle(compact(edges.select("a", "b").union(edges.select("b", "a")).distinct(), size), "edges")
    labels = settle(compact(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), size), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("beyond"))
        best = F.least("next", "beyond")
        moved = lower.join(jump, "next", "left").select("node", best.alias("label"), (best < F.col("label")).alias("changed"))
        moved = settle(compact(moved, size), "labels")
        labels = moved.drop("changed")
        if moved.where("changed").isEmpty():
            return labels


def with_component(lists: DataFrame, found: DataFrame | None) -> DataFrame:
    """Entries with ``part``, the component of their class by now."""
    if found is None:
        return lists.withColumn("part", F.col("class"))
    return lists.join(found.withColumnRenamed("node", "class"), "class", "left").withColumn("part", F.coalesce("label", "class")).drop("label")


def mixed(lists: DataFrame, key: str) -> DataFrame:
    """The entries of lists whose classes are in more than one component."""
    keys = lists.groupBy(key).agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high")
    return lists.join(keys.select(key), key, "left_semi")


def stars(lists: DataFrame, key: str, columns: tuple[str, ...], possible: Column, least: int, turn: int, checked: DataFrame | None) -> DataFrame:
    """Pairs (a, b): each class b with that centre a of another component which it shares most lists with.

    The centre of a list is its member with most company in all of its lists: of edited copies one that is near to
    the original, and so to most others.  Later turns weigh company by chance, which brings other centres up.
    ``columns`` are those that ``possible`` reads, of the centre with ``_b``.  Pairs in ``checked`` are left out, as are those
    that share fewer than ``least`` lists: they are seldom links, and what rounds leave is searched completely.
    """
    sizes = lists.groupBy(key).agg(F.count("*").alias("n"))
    company = lists.join(sizes, key).groupBy("class").agg(F.sum("n").cast("double").alias("company"))
    chance = F.lit(1.0) if turn == 0 else (F.pmod(F.xxhash64("class", F.lit(turn)), F.lit(1000)) + 1) / 1000.0
    counted = lists.join(company, "class").withColumn("k", -F.col("company") * chance)
    heads = counted.groupBy(key).agg(F.min(F.struct("k", "class", "part", *columns)).alias("head"))
    heads = heads.select(key, *(F.col(f"head.{c}").alias(f"{c}_b") for c in ("class", "part", *columns)))
    met = lists.join(heads, key).where((F.col("part") != F.col("part_b")) & possible)
    edges = met.groupBy(F.col("class").alias("b"), F.col("class_b").alias("a")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    if checked is not None:
        edges = edges.join(checked, ["a", "b"], "left_anti")
    return edges.groupBy("b").agg(F.max(F.struct("n", "a")).alias("best")).select("best.a", "b")


def between(lists: DataFrame, key: str, possible: Column) -> DataFrame:
    """All pairs (a, b, size, size_b) of classes of different components that meet in a list, where ``possible`` holds.

    Every pair has one class outside of the component that has most of the list; only those are joined with the list.
    Sizes need not be in the order of the classes.
    """
    per = lists.groupBy(key, "part").agg(F.count("*").alias("n"))
    main = per.groupBy(key).agg(F.max(F.struct("n", "part")).alias("most")).select(key, F.col("most.part").alias("main"))
    flagged = lists.join(main, key).withColumn("outside", F.col("part") != F.col("main")).drop("main")
    other = flagged.select(key, *(F.col(c).alias(f"{c}_b") for c in flagged.columns if c != key))
    once = (F.col("class") < F.col("class_b")) | ~F.col("outside_b")
    met = flagged.where("outside").drop("outside").join(other, key).where(once & (F.col("part") != F.col("part_b")) & possible)
    ends = (("class", "a", "b"), ("size", "size", "size_b"))
    return met.select(*(f(c, f"{c}_b").alias(name) for c, *names in ends for f, name in zip((F.least, F.greatest), names, strict=True))).distinct()


def rarely_apart(lists: DataFrame, rule: Rule) -> DataFrame:
    """All pairs (a, b) between components that can be similar by their rarest shingles (token, class, size, rank, part).

    The first shingle in common, by one order of all, makes a pair; then the common ones are counted.  Shingles that are not
    in ``lists`` are common to no two components.
    """
    pairs = settle(between(lists, "token", rule.near_in_size() & rule.first_possible()), "met-classes")
    own = lists.groupBy("class").agg(F.collect_list("token").alias("tokens"))
    for side in ("a", "b"):
        pairs = pairs.join(own.select(F.col("class").alias(side), F.col("tokens").alias(f"tokens_{side}")), side)
    return pairs.where(F.size(F.array_intersect("tokens_a", "tokens_b")) >= rule.rare_shared()).select("a", "b")


def linked_classes(
    docs: DataFrame,
    rows: DataFrame,
    lists: DataFrame,
    key: str,
    rule: Rule,
    find: Find,
    rounds: int,
    columns: tuple[str, ...],
    possible: Column,
    least: int,
    rest: Callable[[DataFrame, DataFrame, DataFrame | None], DataFrame],
    block: int | None = None,
) -> DataFrame | None:
    """The components of the links between classes that meet in ``lists``, a written table; None without links.

    Rounds of stars come first; what is mixed after them goes to ``rest`` (lists, texts, components), whose pairs are all that
    remain.
    """
    size = lists.count()
    found = known = checked = texts = None
    for turn in range(rounds + 1 if size else 0):
        left = settle(compact(mixed(with_component(lists, found), key), size, least=TASKS), "mixed-lists")
        if left.isEmpty():
            break
        if texts is None:
            texts = settle(texts_of(docs, rows, settle(compact(left.select("class").distinct(), size), "wanted-classes")), "class-texts")
        pairs = stars(left, key, columns, possible, least, turn, checked) if turn < rounds else rest(left, texts, found)
        pairs = settle(compact(pairs, size, least=TASKS), "candidates")
        checked = pairs if checked is None else checked.unionByName(pairs)
        new = settle(verified(pairs, texts, rule, find, block), "links")
        if not new.isEmpty():
            known = new if known is None else known.unionByName(new)
            found = components(known)
    return found


def grouped(rows: DataFrame, found: DataFrame | None) -> DataFrame:
    """doc_id, class, part, n_shingles and component_id of all rows (doc_id, class, n_shingles; a written table).

    A component's id is its smallest doc_id, null if it has none; rows with an empty set are components of their own.
    """
    parts, total = rows.select("doc_id", "class", "n_shingles").withColumn("part", F.col("class")), rows.count()
    if found is not None:
        weighed = rows.groupBy("class").agg(F.count("*").alias("n")).join(found.withColumnRenamed("node", "class"), "class")
        parts = heavy_join(rows, settle(compact(weighed, total), "class-labels"), ["class"], "n", total, "left")
        parts = parts.select("doc_id", "class", "n_shingles", F.coalesce("label", "class").alias("part"))
    parts = settle(compact(parts, total, least=TASKS), "parts")
    groups = parts.where("n_shingles > 0").groupBy("part").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    out = heavy_join(parts, settle(compact(groups, total), "components"), ["part"], "n", total, "left")
    whole = F.when((F.col("n_shingles") > 0) & F.col("n").isNotNull(), F.col("first")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "class", "part", "n_shingles", whole.alias("component_id"))
