"""The Jaccard join and the removal of repeated strings against plain versions; their rough cases."""

from __future__ import annotations

import hashlib
import random
import re
import sys
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
from llm_data import CLASHING, corpus, edited, frame, rough, sentence

from panelscope.llm import jaccard, repeats
from panelscope.llm.hashing import grams, hashed_spans, plain_words, words_of_all
from panelscope.llm.recurring import recurring

WORD = re.compile("[^\\x20\\x09-\\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_sets(rows, width=5):
    out = []
    for row in rows:
        w = WORD.findall((row[1] or "").translate(LOWER))
        out.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    return out


def plain_components(rows, width=5, percent=75):
    """Number of shingles and smallest id of each row's component."""
    sets = plain_sets(rows, width)
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x = len(sets[a] & sets[b])
            if x and 100 * x >= percent * len(sets[a] | sets[b]):
                up[top(a)] = top(b)
    first = {}
    for n, row in enumerate(rows):
        if row[0] is not None:
            first[top(n)] = min(first.get(top(n), row[0]), row[0])
    return [(row[0], len(sets[n]), first.get(top(n)) if sets[n] else row[0]) for n, row in enumerate(rows)]


def near_copies(seed=5):
    """Groups of near copies around the threshold, of sizes from two to many, with chains and a shared passage."""
    rng, rows = random.Random(seed), []
    passage = sentence(rng, "en", 60)
    for group in range(12):
        base = sentence(rng, "de", rng.randint(30, 120))
        for k in range(2 if group < 10 else 45):
            rows.append(edited(rng, base, rng.randint(0, 5)))
    chain = sentence(rng, "fr", 100)
    for _ in range(8):
        chain = edited(rng, chain, 2)
        rows.append(chain)
    rows += [passage + " " + sentence(rng, "fr", rng.randint(3, 30)) for _ in range(30)]
    rng.shuffle(rows)
    return [(n * 2, t, "en", "s", None) for n, t in enumerate(rows)]


def joined(df):
    return [tuple(r) for r in jaccard.join(df).select("doc_id", "n_shingles", "component_id").collect()]


def by_text(found):
    return sorted(found, key=repr)


@pytest.mark.parametrize("rows", [corpus(3), near_copies(), rough()], ids=["corpus", "near", "rough"])
def test_join_finds_all_links(spark, rows):
    assert by_text(joined(frame(spark, rows, extra=True))) == by_text(plain_components(rows))


@pytest.mark.parametrize("rounds", [0, 1])
def test_join_is_whole_whatever_the_rounds(spark, monkeypatch, rounds):
    monkeypatch.setattr(jaccard, "ROUNDS", rounds)
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    rows = near_copies(8)
    assert by_text(joined(frame(spark, rows))) == by_text(plain_components(rows))


def test_occurrences_counts_like_a_dictionary():
    rng = random.Random(1)
    for _ in range(200):
        lists = [sorted(rng.sample(range(30), rng.randint(0, 12))) for _ in range(rng.randint(1, 9))]
        count = defaultdict(int)
        for own in lists:
            for x in own:
                count[x] += 1
        least = rng.randint(1, 5)
        assert jaccard.occurrences(lists, least) == {x: n for x, n in count.items() if n >= least}


def test_search_keeps_exactly_the_similar():
    rng = np.random.default_rng(2)
    base = np.unique(rng.integers(0, 1 << 60, 200).astype(np.uint64))
    members = []
    for k in range(120):
        kept = base[rng.random(len(base)) > k / 300]
        members.append(np.unique(np.concatenate([kept, rng.integers(0, 1 << 60, k // 4).astype(np.uint64)])))
    want = [n for n, m in enumerate(members) if 100 * len(np.intersect1d(base, m)) >= 75 * len(np.union1d(base, m))]
    assert 0 < len(want) < len(members) and sorted(jaccard.search(base, members)) == want


def test_one_document_of_each_group_stays(spark):
    rows = rough()
    got = jaccard.first_of_components(frame(spark, rows, extra=True))
    assert not set(CLASHING) & set(got.columns)
    found = [tuple(r) for r in got.collect()]
    sets, parts = plain_sets(rows), plain_components(rows)
    assert sum(1 for r in found if not WORD.findall(r[1] or "")) == sum(1 for s in sets if not s)
    names = defaultdict(list)
    for n, row in enumerate(rows):
        names[row[1]].append(n)
    kept = [r for r in found if WORD.findall(r[1] or "")]
    assert len(kept) == len({p for p, s in zip(parts_of(rows), sets, strict=True) if s})
    assert all(any(parts[n][2] == r[0] for n in names[r[1]]) for r in kept)


def parts_of(rows):
    """A name of each row's component that null ids have too."""
    numbered = [(n, *row[1:]) for n, row in enumerate(rows)]
    return [p[2] for p in plain_components(numbered)]


def plain_repeats(rows):
    first, n = {}, repeats.LENGTH
    data = [(r[1] or "").encode() for r in rows]
    ranks = [repeats.LAST if r[0] is None else r[0] for r in rows]
    for text, rank in zip(data, ranks, strict=True):
        for i in range(len(text) - n + 1):
            first[text[i : i + n]] = min(first.get(text[i : i + n], rank), rank)
    out = []
    for row, text, rank in zip(rows, data, ranks, strict=True):
        gone = bytearray(len(text))
        for i in range(len(text) - n + 1):
            if first[text[i : i + n]] < rank:
                gone[i : i + n] = b"\1" * n
        kept = bytes(c for c, g in zip(text, gone, strict=True) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((row[0], len(text), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def stripped(df):
    out = []
    for r in repeats.strip(df).collect():
        out.append((r["doc_id"], r["n_bytes"], sum(s["stop"] - s["start"] for s in r["removed"]), len(r["removed"]), hashlib.sha256(bytes(r["kept"])).hexdigest()))
    return out


def shared_passages(seed=4):
    rng = random.Random(seed)
    parts = [sentence(rng, "en", rng.randint(8, 40)) for _ in range(6)]
    rows = []
    for n in range(50):
        a, b = rng.randint(0, 60), rng.randint(0, 60)
        middle = rng.choice(parts)
        rows.append((rng.randrange(10**6), sentence(rng, "fr", rng.randint(0, 20)) + middle[a : len(middle) - b] + sentence(rng, "de", rng.randint(0, 20)) + rng.choice(parts), "en", "s", None))
    return [*rows, (-5, "ab" * 300, "x", "y", 0), (-4, "ab" * 250 + "c", "x", "y", 0), (-3, "z" * 500, "x", "y", 0), (-2, "z" * 77, "x", "y", 0)]


@pytest.mark.parametrize("rows", [corpus(6), shared_passages(), rough(9), []], ids=["corpus", "passages", "rough", "empty"])
def test_repeated_strings_go(spark, rows):
    assert by_text(stripped(frame(spark, rows, extra=True))) == by_text(plain_repeats(rows))


def test_small_segments_and_chunks_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SEGMENT", 300)
    monkeypatch.setattr(repeats, "CHUNK", 40)
    rows = shared_passages(7)
    parse = repeats.Parse([r[1].encode() for r in rows])
    assert parse.count.sum() == sum(max(0, len(r[1].encode()) - repeats.LENGTH + 1) for r in rows)
    assert by_text(stripped(frame(spark, rows))) == by_text(plain_repeats(rows))


@pytest.mark.parametrize("rows", [shared_passages(11), rough(12)], ids=["passages", "rough"])
def test_windows_of_hot_triggers_equal_the_plain_version(spark, monkeypatch, rows):
    monkeypatch.setattr(repeats, "HOT", 1)
    monkeypatch.setattr(repeats, "HOT_BYTES", 500)
    assert by_text(stripped(frame(spark, rows, extra=True))) == by_text(plain_repeats(rows))


def test_some_triggers_hot_and_others_not(spark, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", 12)
    rng = random.Random(2)
    rows = shared_passages(13) + [(10**7 + n, sentence(rng, "en", 5) + "the one passage that very many of these documents have in common" + sentence(rng, "fr", 5), "en", "s", None) for n in range(60)]
    assert by_text(stripped(frame(spark, rows))) == by_text(plain_repeats(rows))


def test_suffixes_are_in_corpus_order():
    rng = random.Random(9)
    phrases = [bytes(rng.choice(b"ab\0\xff") for _ in range(rng.randint(50, 90))) for _ in range(40)]
    phrases += [p[: rng.randint(50, len(p))] for p in phrases]
    ranks = np.array([rng.randint(0, 9) for _ in phrases], np.int64)
    of, offset, places = repeats.windows_of(np.array([len(p) - repeats.LENGTH + 1 for p in phrases]))
    order = repeats.suffix_ranks(np.frombuffer(b"".join(phrases), np.uint8))[places]
    windows = [phrases[p][o : o + repeats.LENGTH] for p, o in zip(of.tolist(), offset.tolist(), strict=True)]
    by_rank = np.lexsort((ranks[of], order)).tolist()
    assert [(windows[n], ranks[of[n]]) for n in by_rank] == sorted(zip(windows, ranks[of].tolist(), strict=True))
    assert len(set(order.tolist())) == len(set(windows)) < len(windows)
    least = {}
    for w, r in zip(windows, ranks[of].tolist(), strict=True):
        least[w] = min(r, least.get(w, r))
    assert repeats.after_first(order, ranks[of]).tolist() == [r > least[w] for w, r in zip(windows, ranks[of].tolist(), strict=True)]


def test_phrases_of_one_trigger_are_dealt_apart_and_summed_up():
    n, rng = 2_000, np.random.default_rng(4)
    phrase = rng.integers(1, 1 << 63, n).astype(np.uint64) * np.uint64(2)
    phrases = [np.full(n, 7 << 40, np.uint64), phrase, np.arange(n), rng.integers(0, 99, n), np.zeros(n, np.int64), np.ones(n, np.int64)]
    rows = dict(zip(*repeats.combined(phrases, 6).to_pydict().values(), strict=True))
    sizes = [len(repeats.unpack(repeats._PHRASE, d)[0]) for b, d in rows.items() if 0 <= b < 64]
    sums = [repeats.unpack(repeats._TRIGGER, d) for b, d in rows.items() if b >= 64]
    assert sum(sizes) == n and max(sizes) < 80
    assert [[x.tolist() for x in s] for s in sums] == [[[7 << 40], [n], [int(phrase.min())], [int(phrase.max())], [0], [n - 1]]]


def test_runs_of_copies_of_one_text_are_dealt_apart():
    n = 2_000
    one = np.ones(n, np.uint64)
    phrases = [one, one, np.arange(n, dtype=np.int64), np.full(n, 77, np.int64), np.zeros(n, np.uint32), np.ones(n, np.uint32)]
    batch = repeats.combined(phrases, 4)
    held = [repeats.unpack(repeats._RUN, d)[0] for b, d in zip(batch.column("bucket").to_pylist(), batch.column("data").to_pylist(), strict=True) if b < 0]
    assert sorted(np.concatenate(held).tolist()) == list(range(1, n))
    assert max(map(len, held)) < 40


def test_word_hashes_are_by_content(monkeypatch):
    a = plain_words("The quick BROWN\tfox é".encode())
    b = plain_words("  xx the quick brown fox é ".encode())
    assert a.tolist() == b[1:].tolist() and len(set(b.tolist())) == 6
    text = ("word " * 50 + "other ").encode() * 40
    whole = plain_words(text)
    monkeypatch.setattr("panelscope.llm.hashing.SEGMENT", 64)
    assert plain_words(text).tolist() == whole.tolist()
    words, bounds = words_of_all([b"", b"a b", b" c ", b"", text])
    assert bounds.tolist() == [0, 0, 2, 3, 3, 3 + len(whole)] and words[3:].tolist() == whole.tolist()
    assert len(grams(whole, 5)) == len(whole) - 4 and not len(grams(whole[:3], 5))
    assert not len(hashed_spans(np.empty(0, np.uint8), np.zeros(256, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)))


def test_filter_has_all_recurring_and_few_others(spark):
    rng = np.random.default_rng(3)
    own = [np.unique(rng.integers(0, 1 << 63, 500).astype(np.uint64)) for _ in range(40)]
    twice = np.unique(np.concatenate([x[:20] for x in own]))
    rows = [(n, np.concatenate([x, own[(n + 1) % 40][:20]]).view(np.int64).tolist()) for n, x in enumerate(own)]

    def hashes(batch):
        for x in batch.column("x").to_pylist():
            yield np.array(x, np.int64).view(np.uint64)

    found = recurring(spark.createDataFrame(rows, "n long, x array<long>"), hashes, 1 << 20)
    assert found.has(twice).all()
    alone = np.concatenate([x[20:] for x in own])
    assert found.has(alone).mean() < 0.05
