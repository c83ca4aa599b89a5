"""Centroid clustering in whole numbers, with equal-average equal-variance search for the nearest centroid.

Vectors become integers floor(1024 x).  A vector x and a centroid c of k components with sums S and deviations V (the length
of what is left once the mean is taken off) are at least (Sx - Sc)^2 / k + (Vx - Vc)^2 apart, squared.  Centroids are
sorted by mean.  A vector starts at the centroid whose mean is nearest and scans outward on both sides; a side ends
where the mean alone excludes it, and single centroids are rejected by mean and deviation together.  What is left is compared by
exact integer distances; the bounds, being floating point, are lowered by more than their rounding error, and
equal bounds are not rejected, so ties go to the smaller number as if all had been compared.

A round is one job: every task adds up its vectors by cluster, and the sums (clusters x components numbers) are added over
tasks.  Only they reach the driver.

Defined results.  Only vec_id and embedding are read.  Vectors of another length, with a null or a number that is not finite are
left out, as are null vectors.  Centroids start as the vectors whose ids hash least; equal hashes (repeated ids) go by components, null
ids come last.  With fewer vectors than centroids there are fewer centroids.  Equal rows get equal results.  Components beyond
2**17 count as 2**17, so that a distance stays within a long; sums of distances beyond a long count as the largest long.  An empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelscope.llm.common import conform, read, settle
from panelscope.llm.registry import query

COMPONENTS, CENTROIDS, ROUNDS = 64, 8, 10
SCALE, SEED = 1024, 3
#: Largest integer component: 64 squares of twice as much fit into a long.
LARGEST = 1 << 27
LONGEST = (1 << 63) - 1
#: Vectors that are compared at once.
BLOCK = 4096
#: Share by which lower bounds are lowered against rounding.
SLACK = 1e-9


def integers(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id and integer components of the vectors that are kept."""

    def floored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            lengths = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
            whole = np.flatnonzero(lengths == components)
            flat = lists.take(pa.array(whole)).flatten().cast(pa.float64())
            values = flat.to_numpy(zero_copy_only=False).reshape(-1, components)  # nulls become NaN
            finite = np.isfinite(values).all(1)
            values = np.clip(np.floor(np.clip(values[finite], -LARGEST, LARGEST) * SCALE), -LARGEST, LARGEST).astype(np.int32)
            ids = batch.column("vec_id").take(pa.array(whole[finite]))
            yield pa.RecordBatch.from_arrays([ids, listed(values)], ["vec_id", "e"])

    return conform(vectors, "vec_id", "embedding").mapInArrow(floored, "vec_id long, e array<int>")


def listed(values: np.ndarray) -> pa.Array:
    """The rows of a matrix as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(values.ravel(), pa.int32()))


def matrix(batch: pa.RecordBatch, components: int) -> np.ndarray:
    """The vectors of a batch of ``integers``."""
    return batch.column("e").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, components)


class Search:
    """Nearest centroids by equal-average equal-variance search."""

    def __init__(self, centroids: np.ndarray):
        sums = centroids.sum(1)
        self.number = np.argsort(sums, kind="stable")  # place in the order of means: number of the centroid
        self.centroids, self.sums = centroids[self.number], sums[self.number].astype(np.float64)
        self.deviation = deviations(self.centroids)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number of the nearest centroid and squared distance of each vector, and how many distances were formed."""
        n, k, last = len(x), x.shape[1], len(self.sums) - 1
        sums, own = x.sum(1).astype(np.float64), deviations(x)
        right = np.clip(np.searchsorted(self.sums, sums), 0, last)
        left = np.maximum(right - 1, 0)
        start = np.where(np.abs(self.sums[left] - sums) < np.abs(self.sums[right] - sums), left, right)
        place, best, formed = start.copy(), self._distances(x, start), n
        for side in (-1, 1):
            rows, at = np.arange(n), start + side
            while True:
                inside = (at >= 0) & (at <= last)
                rows, at = rows[inside], at[inside]
                mean = (self.sums[at] - sums[rows]) ** 2 / k
                near = mean * (1 - SLACK) - 1 <= best[rows]  # means only go farther on this side
                rows, at, mean = rows[near], at[near], mean[near]
                if not len(rows):
                    break
                spread = (self.deviation[at] - own[rows]) ** 2
                slack = SLACK * (mean + self.deviation[at] ** 2 + own[rows] ** 2) + 1
                tried = mean + spread - slack <= best[rows]
                close, spot = rows[tried], at[tried]
                distance = self._distances(x[close], spot)
                formed += len(close)
                better = (distance < best[close]) | ((distance == best[close]) & (self.number[spot] < self.number[place[close]]))
                place[close[better]], best[close[better]] = spot[better], distance[better]
                at = at + side
        return self.number[place], best, formed

    def _distances(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        apart = x - self.centroids[at]
        return np.einsum("ij,ij->i", apart, apart)


def deviations(x: np.ndarray) -> np.ndarray:
    """Length of each vector without its mean."""
    centred = x - x.mean(1, keepdims=True)
    return np.sqrt(np.einsum("ij,ij->i", centred, centred))


def first_centroids(vectors: DataFrame, number: int = CENTROIDS, seed: int = SEED, components: int = COMPONENTS) -> np.ndarray:
    """The vectors whose ids hash least."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(hashed.alias("hashed"), "e").orderBy(F.col("hashed").asc_nulls_last(), "e").limit(number).collect()
    return np.array([r["e"] for r in rows], np.int64).reshape(len(rows), components)


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floors of the means of their vectors, empty ones as they are."""
    components = centroids.shape[1]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centroids)
        counts, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            whole = matrix(batch, components)
            for low in range(0, len(whole), BLOCK):
                x = whole[low : low + BLOCK]
                number = search.nearest(x)[0]
                counts += np.bincount(number, minlength=len(counts))
                for c in np.unique(number):
                    sums[c] += x[number == c].sum(0)
        used = np.flatnonzero(counts)
        at = [pa.array(np.repeat(used, components + 1)), pa.array(np.tile(np.arange(components + 1), len(used)))]
        values = np.column_stack((sums[used], counts[used])).ravel()
        yield pa.RecordBatch.from_arrays([*at, pa.array(values, pa.int64())], ["cluster", "component", "value"])

    parts = vectors.select("e").mapInArrow(add, "cluster long, component long, value long")
    total = np.zeros((len(centroids), components + 1), object)
    # sums of many vectors may exceed a long
    for r in parts.groupBy("cluster", "component").agg(F.sum(F.col("value").cast("decimal(28,0)")).alias("value")).collect():
        total[r["cluster"], r["component"]] = int(r["value"])
    out = centroids.copy()
    for c, row in enumerate(total):
        if row[-1]:
            out[c] = [s // row[-1] for s in row[:-1]]
    return out


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and squared distance of every vector."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centroids)
        for batch in batches:
            whole = matrix(batch, centroids.shape[1])
            for low in range(0, len(whole), BLOCK):
                number, distance, _ = search.nearest(whole[low : low + BLOCK])
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").slice(low, BLOCK), pa.array(number.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(assign, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, number: int = CENTROIDS, rounds: int = ROUNDS, components: int = COMPONENTS, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster, distance, cluster_inertia and inertia of every kept vector, and the final centroids."""
    spark = vectors.sparkSession
    kept = settle(integers(vectors, components), "integer-vectors")
    centroids = first_centroids(kept, number, seed, components)
    if not len(centroids):
        empty = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long"
        return spark.createDataFrame([], empty), np.zeros((0, components), np.int64)
    for _ in range(rounds):
        centroids = moved(kept, centroids)
    placed = settle(assigned(kept, centroids), "assigned-vectors")
    sums = {r["cluster"]: int(r["d"]) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(28,0)")).alias("d")).collect()}
    whole = min(LONGEST, sum(sums.values()))
    inertia = spark.createDataFrame([(c, min(LONGEST, d), whole) for c, d in sums.items()], "cluster int, cluster_inertia long, inertia long")
    return placed.join(F.broadcast(inertia), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia"), centroids


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in centroid).encode()).hexdigest()


def _assigned_sql(n: int) -> str:
    apart = "list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    return f"a{n} AS MATERIALIZED (SELECT v.r, v.vec_id, v.e, min(struct_pack(d := {apart}, c := c.c)) AS best FROM v, c{n} c GROUP BY ALL)"


def _moved_sql(n: int) -> str:
    """Floors of means; the remainder is made positive first, since integer division cuts towards zero."""
    return f"""c{n + 1} AS MATERIALIZED (
  SELECT c.c, coalesce(m.e, c.e) AS e FROM c{n} c LEFT JOIN (
    SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS e FROM (
      SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT best.c AS c, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM a{n}) GROUP BY ALL
    ) GROUP BY c
  ) m USING (c)
)"""


_CHAIN = ",\n".join(f"{_assigned_sql(n)},\n{_moved_sql(n)}" for n in range(ROUNDS))
SQL = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS e
  FROM embeddings WHERE len(embedding) = {COMPONENTS} AND len(list_filter(embedding, lambda x: isfinite(x))) = {COMPONENTS}
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h NULLS LAST, e) - 1 AS c, e FROM (SELECT sha256('{SEED}:' || vec_id) AS h, e FROM v ORDER BY h NULLS LAST, e LIMIT {CENTROIDS})
),
{_CHAIN},
{_assigned_sql(ROUNDS)},
d AS (SELECT c, sha256(array_to_string(e, ',')) AS centroid_sha256 FROM c{ROUNDS})
SELECT vec_id, best.c::INT AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.c))::BIGINT AS cluster_inertia,
  (sum(best.d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{ROUNDS} JOIN d ON d.c = best.c
"""


@query("op12_centroid_clustering", SQL)
def _op12(spark, sf_dir):
    placed, centroids = cluster(read(spark, sf_dir, "embeddings"))
    names = spark.createDataFrame([(c, digest(x)) for c, x in enumerate(centroids)], "cluster int, centroid_sha256 string")
    return placed.join(F.broadcast(names), "cluster")
