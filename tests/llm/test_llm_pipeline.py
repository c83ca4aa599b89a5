"""The pipeline against plain versions of its stages, and on rough tables."""

from __future__ import annotations

import random
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))
from llm_data import frame, rough, sentence
from test_llm_pairs import parts_of, plain_sets
from test_llm_rest import leaks

import corpus_pipeline
from panelscope.llm import langid, mixing
from panelscope.llm.common import DOCUMENT, read, settle

COLUMNS = list(DOCUMENT)
SF_DIR = "/root/testdata/sf0.001"


def staged(spark, docs, sf_dir):
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(settle(stage(spark, out[-1], sf_dir), name))
    return out


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def test_stages_equal_plain_versions(spark):
    start, spoken, single, clean, mixed, sharded = staged(spark, read(spark, SF_DIR, "documents"), SF_DIR)
    judged = langid.predict(start, langid.fit(start), *COLUMNS).where("lang_pred <> 'und'")
    assert rows_of(spoken) == rows_of(judged)
    rows = rows_of(spoken)
    first = {}
    for row, part in sorted(zip(rows, parts_of(rows), strict=True), key=lambda x: x[0][0]):
        first.setdefault(part, row)
    assert rows_of(single) == sorted(first.values(), key=repr)
    items = [x.split() for x in plain_texts(spark)]
    grams = {tuple(i[k : k + 8]) for i in items for k in range(len(i) - 7)}
    leaking = {r[0] for r in rows_of(single) if any(tuple(w[k : k + 8]) in grams for w in [words(r[1])] for k in range(len(w) - 7))}
    assert {r[0] for r in rows_of(single)} - {r[0] for r in rows_of(clean)} == leaking
    rates = {r["source"]: r["rate"] for r in mixing.rates(clean).collect()}
    assert rows_of(mixed) == rows_of(mixing.mix(clean)) and set(rows_of(mixed)) <= set(rows_of(clean)) and all(r > 0 for r in rates.values())
    assert rows_of(sharded) == rows_of(mixed)
    assert sharded.groupBy("shard").agg(F.sum(F.octet_length("text")).alias("b")).where(f"b > {1 << 20}").isEmpty()


def words(text):
    import re

    return re.sub(r"[\W_]+", " ", text.lower()).split()


def plain_texts(spark):
    return [" ".join(words(r["text"])) for r in read(spark, SF_DIR, "benchmark").collect()]


def test_short_texts_and_many_languages_are_not_rejected(spark):
    rng = random.Random(3)
    rows = [(n, sentence(rng, "en", 6), f"l{n % 14}", "s", None) for n in range(14 * 12)]
    rows += [(1000, "A.", "l0", "s", None), (1001, "A.\nAll rights reserved.", "l0", "s", None), (1002, "zq", "l3", "s", None)]
    none = [(2000, "123 ...", "l0", "s", None), (2001, "", "l0", "s", None), (2002, None, "l0", "s", None)]
    assert rows_of(corpus_pipeline.language(spark, frame(spark, rows + none), "")) == sorted(rows, key=repr)


def test_run_equals_its_stages(spark):
    last = staged(spark, read(spark, SF_DIR, "documents"), SF_DIR)[-1]
    assert rows_of(corpus_pipeline.run(spark, SF_DIR)) == rows_of(last)


def test_rough_table_goes_through(spark, tmp_path):
    bench, more = leaks(spark)
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = rough() + more
    steps = staged(spark, frame(spark, rows, extra=True), str(tmp_path))
    assert all(s.columns == COLUMNS for s in steps[1:-1])
    known = Counter(rows)
    for s in steps[1:4]:
        assert not Counter(map(tuple, s.collect())) - known
    spoken = rows_of(steps[1])
    assert all(r[1] and any(c.isalpha() for c in r[1]) for r in spoken)
    parts = {p for p, s in zip(parts_of(spoken), plain_sets(spoken), strict=True) if s}
    assert steps[2].count() == len(parts)


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)]])
def test_nothing_goes_through(spark, tmp_path, rows):
    leaks(spark)[0].write.parquet(str(tmp_path / "benchmark.parquet"))
    assert staged(spark, frame(spark, rows), str(tmp_path))[-1].count() == 0
