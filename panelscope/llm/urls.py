"""URL filter: host and path rules, and gradient-boosted trees where no rule fits.

Rules name a host and a path prefix; a rule fits its host and all subdomains, and the longest rule wins.
The URLs that a rule decides are the labelled ones.  Boosted trees learn from lexical features of a bounded,
hash-picked sample of them and judge the rest.  Where not all fit, each label has its own half of the sample, so a rare
one is never left out, and weights restore how many rows each label has.

Features: lengths of url, host and path, depth, share of digits, entropy of the characters, number of
parameters, hyphens and labels, and for the last two labels of the host the smoothed share of
blocked URLs and how many labelled URLs there are (suffix statistics).

Defined results.  Only page_id and url are read.  A null url or one without ``://`` has empty host and path
and the features of an empty text; the trees judge it.  Without labelled URLs, or with labels of one kind, the verdict is that kind, or allow.
Equal urls get equal verdicts.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from panelscope.llm.common import conform, hash_rank, heavy_join, least_hashes, letters_lowered, read, settle
from panelscope.llm.registry import query

RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Labelled URLs that the trees learn from, at most; picked by hash.
MAX_TRAINING = 20_000
TREES, DEPTH, SEED = 10, 4, 7
#: Weight of the overall share in the statistics of a suffix.
SMOOTHING = 20.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.substring_index(F.coalesce(url, F.lit("")), "://", 1)
    has = F.coalesce(url.contains("://"), F.lit(False))
    rest = url.substr(F.length(rest) + 4, F.length(url))
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(url)), r"(?s)\A([^?#]*)", 1)
    return F.when(has, letters_lowered(host)).otherwise(""), F.when(has, path).otherwise("")


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls if none does."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


@pandas_udf(DoubleType())
def entropy(texts: pd.Series) -> pd.Series:
    """Bits per character of each text."""

    def of(text: str) -> float:
        n = len(text)
        return sum(-c / n * math.log2(c / n) for _, c in sorted(Counter(text).items())) if n else 0.0

    return texts.map(of)


def suffix(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def parsed(pages: DataFrame, rules=RULES) -> DataFrame:
    pages = conform(pages, "page_id", "url")
    host, path = host_and_path(F.col("url"))
    split = pages.withColumns({"host": host, "path": path})
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return split.withColumns({"rule": name, "label": verdict, "suffix": suffix(F.col("host"))})


def _count(text: str, pattern: str) -> Column:
    """Characters of a class in a column."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def features(rows: DataFrame) -> DataFrame:
    """Adds ``features``; needs url, host, path and the suffix statistics."""
    rows = rows.withColumn("u", F.coalesce("url", F.lit("")))
    asked = F.col("u").contains("?")
    columns = [
        F.length("u"),
        F.length("host"),
        F.length("path"),
        _count("path", "/"),
        _count("u", "[0-9]") / F.greatest(F.length("u"), F.lit(1)),
        entropy("u"),
        F.when(asked, 1 + _count("u", "&")).otherwise(0),
        _count("u", "-"),
        _count("host", "\\."),
        F.col("u").contains("#").cast("int"),
        F.col("u").startswith("https").cast("int"),
        F.coalesce("suffix_share", "overall_share"),
        F.log1p(F.coalesce("suffix_seen", F.lit(0))),
    ]
    return rows.withColumn("features", array_to_vector(F.array(*(c.cast("double") for c in columns)))).drop("u")


def sampled(labelled: DataFrame, stats: DataFrame, rows: dict[str, float]) -> DataFrame:
    """Up to half of ``MAX_TRAINING`` URLs of each label, each once, weighted so that a label's weights sum to its ``rows``."""
    picked = labelled.withColumn("pick", hash_rank(F.xxhash64("url")))
    least = least_hashes(picked, "label", "pick", lambda _: max(1, MAX_TRAINING // 2))
    parts = []
    for label, taken in least.items():
        few = picked.where((F.col("label") == label) & (F.col("pick") < taken.bound))
        few = few.groupBy("url", "host", "path", "suffix", "label", "pick").agg(F.count("*").cast("double").alias("copies"))
        parts.append(settle(few.orderBy("pick").limit(taken.wanted), "url-label"))
    shares = {p.first()["label"]: p.agg(F.sum("copies")).first()[0] for p in parts}
    both = reduce(DataFrame.unionByName, parts)
    weight = reduce(lambda w, x: w.when(F.col("label") == x, F.col("copies") * (rows[x] / shares[x])), shares, F)
    return both.withColumn("weight", weight).join(stats, "suffix", "left")


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """Every page's url with host, path, rule and verdict."""
    rows = parsed(pages, rules)
    blocked = (F.col("label") == "block").cast("double")
    labelled = rows.where("label IS NOT NULL")
    totals = labelled.agg(F.count("*").alias("n"), F.sum(blocked).alias("bad")).first()
    n, bad = totals["n"], totals["bad"] or 0.0
    if bad in (0.0, float(n)):
        only = "block" if n and bad else "allow"
        return rows.select("page_id", "host", "path", "rule", F.coalesce("label", F.lit(only)).alias("verdict"), F.lit(bad / n if n else 0.0).alias("block_score"))
    overall = bad / n
    seen = rows.groupBy("suffix").agg(F.count("*").alias("n_rows"), F.count("label").alias("suffix_seen"), F.sum(blocked).alias("suffix_bad"))
    share = (F.coalesce("suffix_bad", F.lit(0.0)) + SMOOTHING * overall) / (F.col("suffix_seen") + SMOOTHING)
    stats = settle(seen.select("suffix", "n_rows", "suffix_seen", share.alias("suffix_share")), "url-suffixes")
    total = stats.agg(F.sum("n_rows")).first()[0]
    joined = heavy_join(rows, stats, ["suffix"], "n_rows", total, "left").withColumn("overall_share", F.lit(overall))
    ready = features(joined)
    # every second one is learned as if its suffix were new, since suffixes without rules are what is judged
    known = F.pmod(F.xxhash64("url", F.lit(SEED)), F.lit(2)) == 0
    half = {c: F.when(known, F.col(c)) for c in ("suffix_share", "suffix_seen")}
    chosen = joined.where("label IS NOT NULL").withColumn("weight", F.lit(1.0)) if n <= MAX_TRAINING else sampled(labelled, stats, {"block": bad, "allow": n - bad})
    sample = features(chosen.withColumns({"overall_share": F.lit(overall), **half})).select("url", blocked.alias("label"), "weight", "features")
    sample = settle(sample.orderBy(F.xxhash64("url")), "url-sample")
    model = GBTClassifier(weightCol="weight", maxIter=TREES, maxDepth=DEPTH, seed=SEED, stepSize=0.3, checkpointInterval=-1).fit(sample.coalesce(1))
    scored = model.transform(ready)
    odds = vector_to_array("probability")[1]
    verdict = F.coalesce("label", F.when(odds > 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), odds.alias("block_score"))


@query("op4_url_boosted_trees")
def _op4(spark, sf_dir):
    return judge(read(spark, sf_dir, "pages"))
