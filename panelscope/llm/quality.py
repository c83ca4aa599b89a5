"""Quality rules whose thresholds come from mergeable quantile sketches per language and source.

The sketch of a metric is a histogram over logarithmic buckets (sixteen to each power of two, so values
are known within 7 percent).  Sketches merge by adding counts: per task, per language and source, and
further to the whole language and the whole corpus where a group has too few documents of its own.
A threshold is a fence above the third quartile (for word length also below the first) by
a multiple of the distance between the quartiles plus a margin, so a group without outliers loses nothing.

All of it is built-in expressions; repeated word windows are found inside each row by sorting.

Defined results.  Only doc_id, text, lang and source are read.  A null text has no words and fails the
base rules.  Null language or source is a group like any other.  Equal rows get equal verdicts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelscope.llm.common import conform, read, settle
from panelscope.llm.registry import query

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Groups with fewer passing documents use the sketch of their language, and that of the corpus below it.
LEAST_DOCUMENTS = 50
#: Distance of a fence from its quartile, in distances between the quartiles.
REACH = 3
#: Margins of the metrics in their units: parts per million, and thousandths of a character for word length.
MARGINS = {"symbols": 20_000, "dup_lines": 300_000, "repeats": 300_000, "word_length": 1_000}
#: Lines added to a text's own, so that one repeated line of a short text weighs little.
FREE_LINES = 2
#: Up to so many groups the thresholds are broadcast; beyond it they are joined by salted keys.
BROADCAST_GROUPS = 100_000
SALTS = 64


def words(text: Column) -> Column:
    return F.filter(F.split(text, "[ \\x09-\\x0D]+"), lambda w: w != "")


def _later(array: str, by: int) -> Column:
    """An array without its first ``by`` elements."""
    return F.slice(array, by + 1, F.greatest(F.size(array) - by, F.lit(0)))


def base(docs: DataFrame) -> DataFrame:
    """Counts of words, symbols, repeated lines and repeated words, and the base verdict."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, SPACES, "") != "")
    d = conform(docs, "doc_id", "text", "lang", "source").select(
        "doc_id",
        "lang",
        "source",
        words(text).alias("w"),
        lines.alias("lines"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    d = d.withColumn("n_words", F.size("w").cast("long")).withColumn("n_lines", F.size("lines").cast("long"))
    d = d.withColumn("n_dup_lines", F.col("n_lines") - F.size(F.array_distinct("lines")))
    # each 3-word window as (hash, position), sorted: equal windows are neighbours
    pairs = F.zip_with("w", _later("w", 1), lambda a, b: F.xxhash64(a, b))
    d = d.withColumn("pairs", pairs).withColumn("ends", _later("w", 2))
    d = d.withColumn("triples", F.zip_with("pairs", "ends", lambda a, b: F.xxhash64(a, b)))
    d = d.withColumn("triples", F.when(F.col("n_words") >= 4, F.slice("triples", 1, F.greatest(F.size("triples") - 2, F.lit(0)))))
    d = d.withColumn("repeats", F.size(F.array_distinct("triples")) < F.size("triples"))
    d = d.withColumn("sorted", F.when(F.col("repeats"), F.sort_array(F.transform("triples", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = F.zip_with("sorted", _later("sorted", 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    d = d.withColumn("same", F.flatten(F.filter(same, lambda x: x.isNotNull())))
    covered = F.array_distinct(F.flatten(F.transform("same", lambda i: F.array(i, i + 1, i + 2))))
    d = d.withColumn("n_repeat_words", F.coalesce(F.when(F.col("repeats"), F.size(covered)), F.lit(0)).cast("long"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    kept = ("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    return d.select(*kept, failed.alias("base_failed"))


def metrics() -> dict[str, Column]:
    """What thresholds are set for, as whole numbers."""

    def per(part: str, whole: str, unit: int) -> Column:
        return F.expr(f"{unit} * {part} div {whole}")

    return {
        "symbols": per("n_symbols", "greatest(word_chars, 1)", 1_000_000),
        "dup_lines": per("n_dup_lines", f"(n_lines + {FREE_LINES})", 1_000_000),
        "repeats": per("n_repeat_words", "greatest(n_words, 1)", 1_000_000),
        "word_length": per("word_chars", "greatest(n_words, 1)", 1_000),
    }


def bucket(value: Column) -> Column:
    """Values below 16 are their own buckets; from there on each power of two has 16."""
    e = F.length(F.bin(value)) - 1
    return F.when(value < 16, value).otherwise(16 * (e - 3) + F.call_function("shiftright", value, (e - 4).cast("int")) - 16).cast("long")


def bucket_top(number: Column) -> Column:
    """The largest value of a bucket."""
    e = F.expr("cast(bucket div 16 + 3 as int)")
    high = F.call_function("shiftleft", F.pmod(number, F.lit(16)) + 17, e - 4) - 1
    return F.when(number < 16, number).otherwise(high).cast("long")


def sketches(measured: DataFrame) -> DataFrame:
    """A row per language, source, metric and bucket, counted over documents that pass the base rules."""
    named = F.explode(F.map_from_arrays(F.array(*(F.lit(m) for m in MARGINS)), F.array(*(metrics()[m] for m in MARGINS))))
    values = measured.where(~F.col("base_failed")).select("lang", "source", named.alias("metric", "value"))
    return values.groupBy("lang", "source", "metric", bucket(F.col("value")).alias("bucket")).agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, *by: str) -> DataFrame:
    return sketch.groupBy(*by, "metric", "bucket").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, *by: str) -> DataFrame:
    """Quartiles of each group's sketches, and the fences around them."""
    keys = [*by, "metric"]
    upto = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    ranked = sketch.withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(whole)).withColumn("top", bucket_top(F.col("bucket")))
    at = [F.min(F.when(4 * F.col("upto") >= q * F.col("total"), F.col("top"))).alias(f"q{q}") for q in (1, 3)]
    quartiles = ranked.groupBy(*keys).agg(*at, F.max("total").alias("docs"))
    margin = F.element_at(F.create_map(*(F.lit(x) for pair in MARGINS.items() for x in pair)), F.col("metric"))
    spread = REACH * (F.col("q3") - F.col("q1")) + margin
    high, low = F.col("q3") + spread, F.when(F.col("metric") == "word_length", F.col("q1") - spread)
    fenced = quartiles.groupBy(*by) if by else quartiles.groupBy()
    sides = [F.max(F.when(F.col("metric") == m, high)).alias(f"max_{m}") for m in MARGINS]
    return fenced.agg(F.max("docs").alias("docs"), *sides, F.max(low).alias("min_word_length"))


LIMITS = (*(f"max_{m}" for m in MARGINS), "min_word_length")


def thresholds(measured: DataFrame) -> DataFrame:
    """The limits of every language and source, from the smallest group with documents enough."""
    own = settle(sketches(measured), "quality-sketch")
    by_lang, overall = fences(merged(own, "lang"), "lang"), fences(merged(own)).first()
    limits = overall.asDict() if overall else {}
    groups = measured.groupBy("lang", "source").agg(F.count("*").alias("members"))

    def beside(left: DataFrame, right: DataFrame, keys: tuple[str, ...], tag: str) -> DataFrame:
        right = right.select(*(F.col(c).alias(f"{tag}_{c}") for c in right.columns))
        on = None
        for k in keys:
            same = left[k].eqNullSafe(right[f"{tag}_{k}"])
            on = same if on is None else on & same
        return left.join(right, on, "left")

    wide = beside(groups, fences(own, "lang", "source"), ("lang", "source"), "own")
    wide = beside(wide, by_lang, ("lang",), "lang")
    pick = [
        F.when(F.col("own_docs") >= LEAST_DOCUMENTS, F.col(f"own_{c}"))
        .when(F.col("lang_docs") >= LEAST_DOCUMENTS, F.col(f"lang_{c}"))
        .otherwise(F.lit(limits.get(c)).cast("long"))
        .alias(c)
        for c in LIMITS
    ]
    return wide.select("lang", "source", *pick)


def judge(docs: DataFrame) -> DataFrame:
    """Every document with its counts, limits and verdict."""
    measured = settle(base(docs), "quality-counts")
    limits = settle(thresholds(measured), "quality-limits").withColumnsRenamed({"lang": "for_lang", "source": "for_source"})
    same = F.col("lang").eqNullSafe(F.col("for_lang")) & F.col("source").eqNullSafe(F.col("for_source"))
    if limits.count() <= BROADCAST_GROUPS:
        joined = measured.join(F.broadcast(limits), same)
    else:
        salted = measured.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_words"), F.lit(SALTS)))
        spread = limits.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = salted.join(spread, same & (F.col("salt") == F.col("part"))).drop("salt", "part")
    outside = F.col("base_failed")
    for name, value in metrics().items():
        outside = outside | F.coalesce(value > F.col(f"max_{name}"), F.lit(False))
    outside = outside | F.coalesce(metrics()["word_length"] < F.col("min_word_length"), F.lit(False))
    return joined.withColumn("kept", ~outside).drop("for_lang", "for_source")


_METRIC_SQL = {
    "symbols": "1000000 * n_symbols // greatest(word_chars, 1)",
    "dup_lines": f"1000000 * n_dup_lines // (n_lines + {FREE_LINES})",
    "repeats": "1000000 * n_repeat_words // greatest(n_words, 1)",
    "word_length": "1000 * word_chars // greatest(n_words, 1)",
}


def _fence_sql(by: str) -> str:
    group = f"GROUP BY {by}" if by else ""
    over = f"PARTITION BY {by + ', ' if by else ''}metric"
    tops = ", ".join(f"max(q3 + {REACH} * (q3 - q1) + {v}) FILTER (metric = '{m}') AS max_{m}" for m, v in MARGINS.items())
    return f"""
  SELECT {by + ', ' if by else ''}max(docs) AS docs, {tops},
    max(q1 - {REACH} * (q3 - q1) - {MARGINS['word_length']}) FILTER (metric = 'word_length') AS min_word_length
  FROM (
    SELECT {by + ', ' if by else ''}metric, max(total) AS docs, min(top) FILTER (4 * upto >= total) AS q1, min(top) FILTER (4 * upto >= 3 * total) AS q3
    FROM (
      SELECT *, sum(n) OVER ({over} ORDER BY top) AS upto, sum(n) OVER ({over}) AS total
      FROM (SELECT {by + ', ' if by else ''}metric, top, count(*) AS n FROM v GROUP BY ALL)
    ) GROUP BY {by + ', ' if by else ''}metric
  ) {group}"""


SQL = f"""
WITH t AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents
), g AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t)
), r AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1
  ) GROUP BY doc_id
), b AS (
  SELECT t.doc_id, lang, source, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(text) - length(translate(text, '{SYMBOLS}', '')) AS n_symbols,
    len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
  FROM t LEFT JOIN r USING (doc_id)
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    {', '.join(f'{s} AS {m}' for m, s in _METRIC_SQL.items())} FROM b
), v AS (
  SELECT lang, source, metric, CASE WHEN x < 16 THEN x ELSE ((x >> e) + 1 << e) - 1 END AS top
  FROM (SELECT lang, source, metric, value AS x, greatest(floor(log2(greatest(value, 1)))::INT - 4, 0) AS e
    FROM (UNPIVOT (SELECT lang, source, {', '.join(_METRIC_SQL)} FROM f WHERE NOT base_failed) ON {', '.join(_METRIC_SQL)} INTO NAME metric VALUE value))
), o AS ({_fence_sql('lang, source')}
), l AS ({_fence_sql('lang')}
), a AS ({_fence_sql('')}
), j AS (
  SELECT f.*, {', '.join(f'CASE WHEN o.docs >= {LEAST_DOCUMENTS} THEN o.{c} WHEN l.docs >= {LEAST_DOCUMENTS} THEN l.{c} ELSE a.{c} END AS {c}' for c in LIMITS)}
  FROM f LEFT JOIN o ON f.lang IS NOT DISTINCT FROM o.lang AND f.source IS NOT DISTINCT FROM o.source
  LEFT JOIN l ON f.lang IS NOT DISTINCT FROM l.lang, a
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR {' OR '.join(f'coalesce({m} > max_{m}, false)' for m in MARGINS)} OR coalesce(word_length < min_word_length, false)) AS kept,
  {', '.join(LIMITS)}
FROM j
"""


@query("op8_adaptive_quality", SQL)
def _op8(spark, sf_dir):
    judged = judge(read(spark, sf_dir, "documents"))
    counts = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged.select(*counts, *LIMITS)
