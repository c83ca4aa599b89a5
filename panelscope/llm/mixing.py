"""Mixing sources to target weights by Poisson replication.

Each source has a target share of the mixture and a present share; their ratio is the mean repetition of
its documents.  A document's number of copies is the inverse of the Poisson distribution with that mean at
a point in (0, 1) that is hashed from seed, id and text.  Copies are exploded and dealt over all partitions by a
second hash, in whose order they lie.  All of it is built-in expressions.

Defined results.  Only the columns of documents are read.  Null is a source like any other.  The mass of a
document is its characters plus one, so empty and null texts take part.  Equal rows get equal counts, each
for itself.  An empty table gives an empty mixture.  Sources missing from given weights weigh nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from panelscope.llm.common import DOCUMENT, conform, read, settle
from panelscope.llm.registry import query

SEED = 20
#: Without given weights, a source weighs its mass to this power: below 1, small sources are raised.
TEMPERATURE = 0.5
#: Mixture size as a multiple of the corpus.
EPOCHS = 1.0
#: The distribution is tabulated to where its tail is below the resolution of a double.
TAIL_SDS, TAIL_EXTRA = 12, 20
#: Up to so many tabulated values the table is broadcast (8 bytes each); beyond it is joined by salted keys.
BROADCAST_VALUES = 500_000
SALTS = 64


def point(key: Column) -> Column:
    """A number in (0, 1) of 52 hashed bits."""
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def document_key(seed: int) -> Column:
    return F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce(F.md5("text"), F.lit("-")))


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, epochs: float = EPOCHS) -> DataFrame:
    """Mean repetition of each source: target mass over present mass."""
    mass = docs.groupBy("source").agg(F.sum(F.coalesce(F.length("text"), F.lit(0)) + 1).cast("double").alias("mass"), F.count("*").alias("n"))
    if weights is None:
        weighed = mass.withColumn("weight", F.pow("mass", F.lit(TEMPERATURE)))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "name string, weight double")
        weighed = mass.join(given, mass["source"].eqNullSafe(given["name"]), "left").drop("name").fillna(0.0, ["weight"])
    weighed = settle(weighed, "mix-mass")
    totals = weighed.agg(F.sum("mass").alias("mass"), F.sum("weight").alias("weight")).first()
    rate = F.lit(float(epochs)) * F.lit(totals["mass"] or 0.0) * F.col("weight") / F.lit(totals["weight"] or 1.0) / F.col("mass")
    return weighed.select("source", "n", rate.alias("rate"))


def tabulated(means: DataFrame) -> DataFrame:
    """The Poisson distribution function of each source as an array; terms are formed from logarithms."""
    last = F.ceil(F.col("rate") + TAIL_SDS * F.sqrt("rate") + TAIL_EXTRA)
    steps = means.where("rate > 0").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    upto = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    logs = steps.withColumn("log_factorial", F.sum(F.log(F.greatest("k", F.lit(1)).cast("double"))).over(upto))
    terms = logs.withColumn("term", F.exp(F.col("k") * F.log("rate") - F.col("rate") - F.col("log_factorial")))
    sums = terms.withColumn("cdf", F.sum("term").over(upto))
    return sums.groupBy("source").agg(F.max("rate").alias("rate"), F.sort_array(F.collect_list("cdf")).alias("cdf"))


def with_counts(docs: DataFrame, table: DataFrame, seed: int) -> DataFrame:
    """Documents with their rate and number of copies; ``table`` is a written table."""
    values = table.agg(F.sum(F.size("cdf")).alias("v")).first()["v"] or 0
    table = table.withColumnRenamed("source", "of")
    if values <= BROADCAST_VALUES:
        joined = docs.join(F.broadcast(table), docs["source"].eqNullSafe(table["of"]))
    else:
        salted = docs.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text"), F.lit(SALTS)))
        spread = table.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = salted.join(spread, salted["source"].eqNullSafe(spread["of"]) & (salted["salt"] == spread["part"])).drop("salt", "part")
    u = joined.withColumn("u", point(document_key(seed)))
    return u.withColumn("n_copies", F.size(F.filter("cdf", lambda c: c <= F.col("u")))).drop("of", "cdf", "u")


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, epochs: float = EPOCHS, seed: int = SEED) -> DataFrame:
    """The mixture: copies of documents in a random order over all partitions."""
    docs = conform(docs)
    table = settle(tabulated(rates(docs, weights, epochs)), "mix-table")
    counted = with_counts(docs, table, seed)
    copies = counted.withColumn("copy", F.explode(F.when(F.col("n_copies") > 0, F.sequence(F.lit(1), F.col("n_copies")))))
    key = F.concat_ws("|", document_key(seed), F.lit("copy"), F.col("copy").cast("string"))
    keyed = copies.withColumn("shuffle_key", F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long"))
    return keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


SQL = f"""
WITH m AS (
  SELECT source, sum(coalesce(length(text), 0) + 1)::DOUBLE AS mass FROM documents GROUP BY source
), r AS (
  SELECT source, {EPOCHS} * sum(mass) OVER () * pow(mass, {TEMPERATURE}) / sum(pow(mass, {TEMPERATURE})) OVER () / mass AS rate FROM m
), k AS (
  SELECT source, rate, unnest(range(0, ceil(rate + {TAIL_SDS} * sqrt(rate) + {TAIL_EXTRA})::BIGINT + 1)) AS k FROM r
), l AS (
  SELECT *, sum(ln(greatest(k, 1))) OVER (PARTITION BY source ORDER BY k) AS lf FROM k
), c AS (
  SELECT source, rate, k, sum(exp(k * ln(rate) - rate - lf)) OVER (PARTITION BY source ORDER BY k) AS cdf FROM l
), t AS (
  SELECT source, max(rate) AS rate, list(cdf ORDER BY k) AS cdf FROM c GROUP BY source
), d AS (
  SELECT *, concat_ws('|', '{SEED}', coalesce(doc_id::VARCHAR, '-'), coalesce(md5(text), '-')) AS key FROM documents
), n AS (
  SELECT d.*, rate, len(list_filter(cdf, lambda x: x <= (('0x' || substr(md5(key), 1, 13))::BIGINT + 0.5) / (1::BIGINT << 52))) AS n_copies
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), e AS (
  SELECT *, unnest(range(1, n_copies + 1)) AS copy FROM n
)
SELECT doc_id, text, lang, source, n_chars, round(rate, 9) AS rate, n_copies, copy,
  ('0x' || substr(md5(key || '|copy|' || copy), 1, 15))::BIGINT AS shuffle_key
FROM e
"""


@query("op3_poisson_mixture", SQL)
def _op3(spark, sf_dir):
    mixed = mix(read(spark, sf_dir, "documents"))
    return mixed.select(*DOCUMENT, F.round("rate", 9).alias("rate"), "n_copies", "copy", "shuffle_key")
