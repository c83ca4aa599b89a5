"""Every corpus query with an SQL text against it: on the smallest tables, and on a corpus of odd cases."""

from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))

import check_queries
from llm_data import corpus, frame

from panelscope.llm.catalog import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"
LABELS = "doc_id long, quality int, toxic int"
VECTORS = "vec_id long, embedding array<float>, label int"


def same(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "embeddings"):
        file = Path(f"{folder}/{t}.parquet")
        if file.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{file}{'/*.parquet' if file.is_dir() else ''}'")
    df = QUERIES[name](spark, str(folder))
    result = con.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    got, want = check_queries.rows_of(df.columns, df.collect()), check_queries.rows_of(columns, result.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    same(spark, SF_DIR, name)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    frame(spark, corpus()).write.parquet(str(folder / "documents.parquet"))
    html = "<p>" + "long page " * 30 + "</p>"
    pages = [(1, "http://a/", html), (2, "http://b/\r\nx%0A", html), (3, None, None), (4, "c", ""), (5, "http://a/", "short"), (6, "http://e", "short"), (7, None, html + "é" * 5000)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(folder / "pages.parquet"))
    labels = [(r[0], k % 2, int(k % 3 == 0)) for k, r in enumerate(corpus()) if k % 4] + [(1000, None, 1), (1000, 1, None)]
    spark.createDataFrame(labels, LABELS).write.parquet(str(folder / "labels.parquet"))
    vectors = [(k, [((k * 31 + n * 17) % 97 - 48) / (7 + k % 5) for n in range(64)], None) for k in range(40)]
    vectors += [(100, None, 1), (101, [], 1), (102, [1.0] * 63, 1), (103, [None] + [1.0] * 63, 1), (104, [float("nan")] * 64, 1), (105, [-0.5] * 64, 1)]
    spark.createDataFrame(vectors, VECTORS).write.parquet(str(folder / "embeddings.parquet"))
    return folder


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_odd_cases_equal_sql(spark, odd, name):
    same(spark, odd, name)


@pytest.mark.parametrize("name", sorted(n for n in ORACLES if not n.startswith("op2")))
def test_empty_table(spark, tmp_path, name):
    frame(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], VECTORS).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert QUERIES[name](spark, str(tmp_path)).count() == 0


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
