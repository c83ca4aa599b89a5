"""Numbering, thinning and paging against plain windows."""

import random
import re

import pytest
from conftest import at, rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelscope.operators import positions
from panelscope.operators.positions import numbered, page, page_info, thin, with_rank, worst_best
from panelscope.plans.batch import target_pairs


@pytest.fixture(scope="module")
def skewed(spark):
    """One key with a third of the rows, many small keys, NULL keys."""
    draw = random.Random(1)
    keys = ["hot"] * 2000 + [f"k{draw.randrange(900)}" for _ in range(3900)] + [None] * 100
    draw.shuffle(keys)
    return spark.createDataFrame([(k, n) for n, k in enumerate(keys)], "k string, n int").repartition(8)


@pytest.fixture(autouse=True)
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("keys", [["k"], []])
def test_numbered_equals_row_number(skewed, keys):
    order = [F.col("n").desc()]
    got = numbered(skewed, order, "pos", keys)
    want = skewed.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    assert rows(got) == rows(want)


def test_a_hot_group_is_spread(spark, skewed):
    ranges = numbered(skewed, [F.col("n").asc()], "pos", ["k"]).inputFiles()
    assert len(ranges) == 8


def test_copies_get_different_numbers(spark):
    df = spark.createDataFrame([("a", 1)] * 500 + [("b", 2)], "k string, n int")
    got = numbered(df, [F.col("n").asc()], "pos", ["k"], copies=True)
    assert sorted(r["pos"] for r in got.where("k = 'a'").collect()) == list(range(1, 501))
    assert got.columns == ["k", "n", "pos"]


def test_ranks(spark, skewed):
    order = [F.col("n").asc()]
    assert [r["rank"] for r in with_rank(skewed, order, 5).orderBy("n").collect()] == [1, 2, 3, 4, 5]
    assert sorted((r["n"], r["rank"]) for r in with_rank(skewed, order).collect()) == [(n, n + 1) for n in range(6000)]
    assert with_rank(skewed, order, 150).count() == 150
    with pytest.raises(ValueError):
        with_rank(skewed, order, -10)


@pytest.mark.parametrize("hot_rows", [100, 10_000])
def test_only_hot_groups_are_numbered_by_ranges(skewed, hot_rows):
    got = positions.numbered_in_groups(skewed, [F.col("n").desc()], "pos", ["k"], hot_rows)
    want = skewed.withColumn("pos", F.row_number().over(Window.partitionBy("k").orderBy(F.col("n").desc())))
    assert rows(got, "k", "n", "pos") == rows(want)


def test_targets_are_distinct_and_in_order(spark):
    ranking = spark.createDataFrame([(n + 1, f"E{n // 2}", "1") for n in range(60)], "rank long, equipment_line_id string, process_code string")
    assert [r[0] for r in positions.first_targets(ranking, 20).collect()] == [f"E{n}" for n in range(20)]
    assert len(target_pairs(positions.first_targets(ranking, 25))) == 25


@pytest.mark.parametrize("total, target_step, others_step", [(1500, 1, 1), (4500, 1, 2), (12000, 2, 6)])
def test_thinning(spark, total, target_step, others_step):
    df = spark.range(total).select(
        F.format_string("p%06d", "id").alias("p"), F.when(F.col("id") % 3 == 0, "Target").otherwise("Others").alias("g")
    )
    kept = sorted((r["g"], r["p"]) for r in thin(df, "g", ["p"]).collect())
    names = {g: [f"p{n:06d}" for n in range(total) if (n % 3 == 0) == (g == "Target")] for g in ("Target", "Others")}
    want = [(g, p) for g, step in (("Others", others_step), ("Target", target_step)) for p in names[g][step - 1 :: step]]
    assert kept == want


def test_thinning_of_several_plots(spark):
    df = spark.range(6000).select((F.col("id") % 2).alias("plot"), F.lit("Others").alias("g"), F.col("id").alias("p"))
    got = thin(df, "g", ["p"], ["plot"])
    assert sorted(r[0] for r in got.groupBy("plot").count().select("count").collect()) == [3000, 3000]


def test_pages(spark, skewed):
    order = [F.col("n").asc()]
    assert [r["n"] for r in page(skewed, order, 3, 10).collect()] == [10, 11, 12]
    assert page(skewed, order, 10, 5995).count() == 5
    assert tuple(page_info(skewed, 100, 5900).first()) == (100, 5900, 6000, False)
    assert page_info(skewed, 100, 5899).first()["has_more"]
    with pytest.raises(ValueError):
        page(skewed, order, -1)


def test_worst_and_best(spark):
    df = spark.createDataFrame([(float(n), n) for n in range(8)], "delta_loo double, n int")
    got = worst_best(df, 2)
    assert rows(got.where("side = 'worst'"), "n") == [(0,), (1,)]
    assert rows(got.where("side = 'best'"), "n") == [(6,), (7,)]


def test_pages_by_key_equal_the_whole_order(spark, tmp_path):
    rng = random.Random(3)
    data = [(rng.choice([None, 1, 2, 2, 3]), rng.choice([None, "a", "b"]), rng.choice([None, at("2026-01-01T00:00:00"), at("2026-01-02T12:00:00.5")])) for _ in range(120)]
    schema = "a int, b string, c timestamp_ntz"
    spark.createDataFrame(data, schema).write.parquet(str(tmp_path / "rows"))
    df, order = spark.read.parquet(str(tmp_path / "rows")), ("a", "b", "c")
    want = [tuple(r) for r in df.orderBy(*[F.col(c).asc_nulls_last() for c in order]).collect()]
    for limit in (7, 40, 120, 500):
        found = list(positions.pages(df, order, limit))
        assert [tuple(r) for page in found for r in page] == want
        assert all(len(page) == limit for page in found[:-1])
    second = positions.page_after(df, order, 7, positions.PageToken((2, "a", None), 1))
    pushed = re.findall(r"PushedFilters: \[([^\]]*)\]", second._jdf.queryExecution().executedPlan().toString())
    assert "GreaterThanOrEqual(a,2)" in pushed[0], pushed
    with pytest.raises(ValueError):
        positions.page_after(df, order, 0)
    assert positions.next_token([], order) is None
