"""Small corpora for the tests: clean ones that SQL can judge, and rough ones with every odd case."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; a table may carry columns of these names.
CLASHING = ("shard", "depth", "h", "key", "copy", "rank", "part", "class", "size", "label", "score", "lang_pred", "n", "token", "data", "kept", "rate", "u", "w")

LANGUAGES = {
    "en": "the house and of water with that this from they have were said each which their time will about".split(),
    "de": "der die und das nicht mit sich auch über schön für wäre straße größe können ich wir haben einen".split(),
    "fr": "le la les des être où même très français élève à ça leur nous vous sont avec pour dans quelle".split(),
}


def sentence(rng: random.Random, lang: str, n: int) -> str:
    """Invented words out of the syllables of a language."""
    words = LANGUAGES[lang]
    return " ".join(rng.choice(words)[: rng.randint(1, 5)] + rng.choice(words)[-rng.randint(1, 4) :] for _ in range(n))


def edited(rng: random.Random, text: str, times: int) -> str:
    words = text.split(" ")
    for _ in range(times):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


def corpus(seed: int = 1, n: int = 60) -> list[tuple]:
    """Documents with ids of their own: near and exact copies, shared passages and lines, null and empty texts."""
    rng, out = random.Random(seed), []
    passage = sentence(rng, "en", 40)
    for k in range(n):
        lang = rng.choice(list(LANGUAGES))
        text = "\n".join(sentence(rng, lang, rng.randint(4, 60)) for _ in range(rng.randint(1, 4)))
        kind = k % 6
        if kind == 1 and out and out[-1][1]:
            text = edited(rng, out[-1][1], rng.randint(1, 4))
        elif kind == 2:
            text = text + "\n" + passage + "\n" + sentence(rng, lang, 8)
        elif kind == 3 and out and out[-1][1]:
            text = out[-1][1]
        out.append((k * 3 + 1, text, lang, f"s{min(k % 7, 3)}", len(text)))
    odd = ["", None, " \t\n ", "one", "a b c d", "a b c d", "ABC def\r\nABC DEF", "\n\n\n", "é" * 60, "x" * 49, "y" * 400]
    out += [(1000 + k, t, "en" if k % 2 else None, None if k % 3 == 0 else "s9", None) for k, t in enumerate(odd)]
    long = " ".join(sentence(rng, "de", 50) for _ in range(120))
    return [*out, (5000, long, "de", "s1", len(long)), (4000, long[100:], "de", "s1", None)]


def rough(seed: int = 2) -> list[tuple]:
    """The same with null ids, ids that several texts share, and rows that are equal in all columns."""
    rows = corpus(seed, 24)
    return rows + rows[:6] * 2 + [(None, *r[1:]) for r in rows[3:9]] * 2 + [(rows[0][0], *r[1:]) for r in rows[10:14]] + [(None, None, None, None, None)] * 3


def frame(spark, rows, extra: bool = False):
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        from pyspark.sql import functions as F

        df = df.select(*(F.lit(f"extra {c}").alias(c) for c in CLASHING), "*")
    return df
