"""MinHash groups, centroid clusters and the filter audit against plain versions; their rough cases."""

from __future__ import annotations

import hashlib
import random
import re
import sys
from collections import Counter, defaultdict
from itertools import permutations
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))
from llm_data import CLASHING, corpus, frame, rough
from test_llm_pairs import WORD, near_copies, plain_components

from panelscope.llm import centroids, filter_audit, minhash, sets
from panelscope.llm.catalog import QUERIES

LABELS = "doc_id long, quality int, toxic int"
VECTORS = "vec_id long, embedding array<float>, label int"


def in_order(rows):
    return sorted(rows, key=repr)


# ---- MinHash groups ----


def joined(df):
    return [tuple(r) for r in minhash.join(df).select("doc_id", "n_shingles", "component_id").collect()]


@pytest.mark.parametrize("rows", [corpus(3), near_copies(6), rough(), []], ids=["corpus", "near", "rough", "empty"])
def test_groups_hold_all_links(spark, rows):
    assert in_order(joined(frame(spark, rows, extra=True))) == in_order(plain_components(rows, 4, 80))


@pytest.mark.parametrize("rounds, small", [(0, 16), (1, 2), (0, 0)])
def test_groups_are_whole_whatever_the_rounds(spark, monkeypatch, rounds, small):
    monkeypatch.setattr(minhash, "ROUNDS", rounds)
    monkeypatch.setattr(minhash, "SMALL", small)
    monkeypatch.setattr("panelscope.llm.sets.BLOCK", 7)
    rows = near_copies(9)
    assert in_order(joined(frame(spark, rows))) == in_order(plain_components(rows, 4, 80))


def test_kept_is_the_first_of_each_group(spark):
    for r in minhash.join(frame(spark, rough(4))).collect():
        assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_stars_give_each_class_one_pair_at_most(spark):
    rows = minhash.signed(frame(spark, near_copies(7)).select("doc_id", "text"))
    lists = sets.with_component(minhash.buckets(rows), None).cache()
    pairs = sets.stars(lists, "key", ("size",), F.lit(True), 1, 0, None).collect()
    assert 0 < len(pairs) <= lists.select("class").distinct().count() and max(Counter(r["b"] for r in pairs).values()) == 1
    again = sets.stars(lists, "key", ("size",), F.lit(True), 1, 0, spark.createDataFrame(pairs)).collect()
    assert not {tuple(r) for r in again} & {tuple(r) for r in pairs}


def test_signatures_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(4)
    for size in (6, 40, 3000):
        agree = []
        for _ in range(60):
            both = rng.integers(0, 1 << 64, size, dtype=np.uint64)
            other = np.unique(np.concatenate([both[: size // 2], rng.integers(0, 1 << 64, size // 2, dtype=np.uint64)]))
            both = np.unique(both)
            similar = len(np.intersect1d(both, other)) / len(np.union1d(both, other))
            agree.append((minhash.signature(both) == minhash.signature(other)).mean() - similar)
        assert abs(np.mean(agree)) < 0.06


def test_bins_without_shingles_borrow_from_others():
    own = np.sort(np.array([5, 1 << 60, 3 << 61], np.uint64))
    values = minhash.signature(own)
    assert set(values.tolist()) == set(own.tolist()) and Counter(values.tolist()).most_common()[-1][1] > 10
    assert len(minhash.bands(values)) == minhash.BINS // minhash.ROWS


# ---- centroid clusters ----


def plain_integers(rows):
    out = []
    for vec, x, *_ in rows:
        if x is not None and len(x) == 64 and all(v is not None and np.isfinite(v) for v in x):
            out.append((vec, tuple(max(-(1 << 27), min(1 << 27, int(np.floor(1024 * float(np.float32(v)))))) for v in x)))
    return out


def plain_nearest(x, cents):
    return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), n) for n, c in enumerate(cents))


def plain_clusters(rows):
    kept = plain_integers(rows)
    key = [(vec is None, hashlib.sha256(f"3:{vec}".encode()).hexdigest() if vec is not None else "", x) for vec, x in kept]
    cents = [kept[n][1] for n in sorted(range(len(kept)), key=lambda n: key[n])[:8]]
    for _ in range(10):
        groups = defaultdict(list)
        for _, x in kept:
            groups[plain_nearest(x, cents)[1]].append(x)
        cents = [tuple(sum(v) // len(groups[n]) for v in zip(*groups[n], strict=True)) if n in groups else c for n, c in enumerate(cents)]
    placed = [(vec, *plain_nearest(x, cents)) for vec, x in kept]
    inertia = Counter()
    for _, d, n in placed:
        inertia[n] += d
    return [(vec, n, d, inertia[n], sum(inertia.values())) for vec, d, n in placed], cents


def vectors(seed=1, n=60):
    rng = random.Random(seed)
    middles = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(5)]
    return [(k * 7, [m + rng.gauss(0, 0.3) for m in rng.choice(middles)], k % 3) for k in range(n)]


def odd_vectors():
    rows = vectors(2, 30)
    long = rows[0][1]
    odd = [None, [], long[:-1], [*long, 0.0], [None, *long[1:]], [float("nan"), *long[1:]], [float("inf"), *long[1:]], [3e38, *long[1:]], [-2e5, *long[1:]]]
    return [*rows, *rows[:4], *rows[:4], (rows[5][0], rows[6][1], 0), (None, rows[7][1], 0), (None, rows[7][1], 0), *((900 + k, x, None) for k, x in enumerate(odd))]


@pytest.mark.parametrize("rows", [vectors(), odd_vectors(), vectors(3, 5), [(k, [0.25] * 64, 0) for k in range(20)]], ids=["plain", "odd", "few", "equal"])
def test_clusters_equal_the_plain_version(spark, rows):
    df = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit("x") for c in ("e", "cluster", "distance", "hashed")})
    placed, cents = centroids.cluster(df)
    want, plain = plain_clusters(rows)
    assert in_order(tuple(r) for r in placed.collect()) == in_order(want)
    assert [tuple(int(v) for v in c) for c in cents] == list(plain)


def test_no_vectors_no_clusters(spark, tmp_path):
    spark.createDataFrame([(1, [1.0], 0)], VECTORS).write.parquet(str(tmp_path / "embeddings.parquet"))
    out = QUERIES["op12_centroid_clustering"](spark, str(tmp_path))
    assert out.count() == 0 and {"centroid_sha256", "inertia"} <= set(out.columns)


@pytest.mark.parametrize("scale, number", [(2, 9), (1000, 40), (1 << 27, 3)])
def test_search_finds_the_nearest_and_the_first_of_equals(scale, number):
    rng = np.random.default_rng(scale)
    cents = rng.integers(-scale, scale + 1, (number, 8)) + rng.integers(-scale, scale + 1, (number, 1)) // 2
    cents = np.concatenate([cents, cents[: number // 3]])  # equal centroids: the smaller number wins
    x = np.concatenate([rng.integers(-scale, scale + 1, (300, 8)), cents])
    apart = ((x[:, None].astype(object) - cents[None].astype(object)) ** 2).sum(2)
    found, distance, formed = centroids.Search(cents).nearest(x)
    assert distance.tolist() == apart.min(1).tolist() and found.tolist() == [list(row).index(min(row)) for row in apart]
    assert formed <= apart.size


def test_bounds_spare_most_distances():
    rng = np.random.default_rng(8)
    cents = rng.integers(-50, 50, (64, 16)) + rng.integers(-3000, 3000, (64, 1))
    x = cents[rng.integers(0, 64, 2000)] + rng.integers(-20, 20, (2000, 16))
    assert centroids.Search(cents).nearest(x)[2] < 0.1 * x.shape[0] * len(cents)


# ---- filter audit ----


def plain_audit(rows, labels):
    good, toxic = ({d for d, *v in labels if d is not None and v[k] == 1} for k in (0, 1))
    first = defaultdict(list)
    for d, text, *_ in rows:
        if d is not None:
            first[text or ""].append(d)
    docs = []
    for d, text, _, source, _ in rows:
        text = text or ""
        w = WORD.findall(text)
        fails = "".join(
            f
            for f, bad in (
                ("A", len(w) < 200),
                ("B", 100 * len(set(w)) < 50 * len(w)),
                ("C", 100 * len(re.findall("[A-Z]", text)) > 2 * len(text)),
                ("D", re.search("[#$%&*|]", text) is not None),
                ("E", d is not None and min(first[text]) < d),
            )
            if bad
        )
        docs.append((source or "", fails, d in good, d in toxic))
    out = []
    for part in sorted({x[0] for x in docs}):
        own, removed_by = [x for x in docs if x[0] == part], Counter()
        lines = []
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                removed_by[f] += len(gone)
                failing = [x for x in own if f in x[1]]
                lines.append(["".join(order), step, len(left), len(gone), len(failing) - len(gone), sum(x[1] == f for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone)])
        out += [(part, *line, removed_by[line[0][line[1] - 1]]) for line in lines]
    return out


def audit_rows():
    words = " ".join(f"w{k}" for k in range(220))
    special = [words, words.title(), words + " #", "a " * 300, words, "A" + "b" * 49, "AA" + "b" * 98, "x" * 10 + "A" * 3]
    return [(7000 + k, t, None, ("s1", "", None)[k % 3], None) for k, t in enumerate(special)]


def some_labels(rows):
    ids = [r[0] for r in rows][::2]
    return [(d, n % 2, int(n % 3 == 0)) for n, d in enumerate(ids)] + [(ids[0], 1, 1), (None, 1, 1), (123456, 1, 1), (ids[1], None, None)]


@pytest.mark.parametrize("rows", [corpus(5) + audit_rows(), rough(6) + audit_rows() * 2], ids=["corpus", "rough"])
def test_audit_equals_the_plain_version(spark, rows):
    labels = some_labels(rows)
    named = spark.createDataFrame(labels, LABELS).withColumns({c: F.lit("x") for c in ("part", "fails", "good", "n")})
    out = filter_audit.audit(frame(spark, rows, extra=True), named)
    columns = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    got = [tuple(r[c] for c in columns) for r in out.collect()]
    assert in_order(got) == in_order(plain_audit(rows, labels))
    assert dict(out.dtypes)["step"] == "int" and all(dict(out.dtypes)[c] == "bigint" for c in columns[3:])


def test_audit_of_nothing(spark):
    none = spark.createDataFrame([], LABELS)
    assert filter_audit.audit(frame(spark, []), none).count() == 0
    assert filter_audit.audit(frame(spark, [(1, None, None, None, None)]), none).count() == 600


def test_words_are_counted_by_bit():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 3, 50, 1000):
        own = rng.integers(0, 1 << 32, n).astype(np.uint32)
        times = np.where(rng.random(n) < 0.8, 1, rng.integers(1, 1 << 40, n))
        want = [sum(int(t) for w, t in zip(own, times, strict=True) if int(w) >> b & 1) for b in range(32)]
        assert filter_audit.positional_counts(own, times).tolist() == want


def test_parts_beyond_what_a_task_holds(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "HELD_PARTS", 2)
    rows = [(n, f"text {n}", None, f"s{n % 40}", None) for n in range(200)]
    out = filter_audit.survivors(frame(spark, rows), spark.createDataFrame([], LABELS))
    assert {(r["part"], r["every"]) for r in out.where("subset = 0").collect()} == {(f"s{n}", 5) for n in range(40)}


def test_clashing_names_reach_no_result(spark):
    out = minhash.join(frame(spark, corpus(2), extra=True))
    assert not (set(CLASHING) - {"class", "part", "kept"}) & set(out.columns)
