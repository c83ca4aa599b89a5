"""Language identification by string kernels.

The kernel of two texts counts the letter n-grams of one to three characters that both contain (the
blended spectrum, by presence), over the root of what each contains.  N-grams are hashed to ``BINS``.
Nyström landmarks from the labelled sample give the kernel a finite map; one ridge regression per
language is fitted in it.  The product of landmarks, map and weights is formed once, so a batch of texts is
scored by one matrix product of its presence rows with a (bins x languages) matrix.

Training reads a bounded sample: of each language the texts with the smallest hashes, each text once, up to
``PER_LANGUAGE`` and to an equal part of ``MAX_SAMPLE``, but one at least, so that no language is left out.  Only
packed presence bits of the sample reach the driver.  Prediction reads whole texts and nothing but texts.

Defined results.  A text that is null or has no letter is ``und`` with score 0; so is every text if nothing
could be learned.  Rows with a null id are not learned from and count as not held out.  Ties go to the language that sorts
first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelscope.llm.common import below, by_bytes, conform, hash_rank, least_hashes, read
from panelscope.llm.registry import query

BINS = 1 << 14
PER_LANGUAGE, MAX_SAMPLE = 400, 6_000
LANDMARKS = 256
RIDGE = 1e-2
#: Scores are the softmax of the regressions' outputs times this.
SHARPNESS = 3.0
UNKNOWN = "und"
#: Texts whose presence rows are held at once.
BLOCK_ROWS = 256

_LETTERS: np.ndarray | None = None
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint64)


def held_out() -> Column:
    """Whether a document is kept from training, by its id."""
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def letters() -> np.ndarray:
    """Which code points are letters."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTERS


def codes(text: str | None) -> np.ndarray:
    """Lower-case letters as code points, each run of other characters as one 0, with 0 at both ends; empty without letters."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kept = np.where(letters()[points], points, 0)
    if not kept.any():
        return kept[:0]
    kept = np.concatenate(([0], kept, [0]))
    return kept[(kept != 0) | np.concatenate(([True], kept[1:] != kept[:-1]))]


def presence(texts: list[str | None]) -> np.ndarray:
    """A row of ``BINS`` bits per text: the n-grams it contains."""
    marks = np.zeros((len(texts), BINS), bool)
    shift = np.uint64(64 - 14)
    for row, text in enumerate(texts):
        c = codes(text).astype(np.uint64)
        gram = np.zeros(len(c), np.uint64)
        for n in range(3):
            if len(c) <= n:
                break
            gram = (gram[: len(c) - n] if n else gram) * np.uint64(0x100000001B3) + (c[n:] + np.uint64(1)) * _MIX[n]
            marks[row, ((gram + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15) >> shift).astype(np.int64)] = True
    return marks


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # bins x languages

    def scores(self, marks: np.ndarray) -> np.ndarray:
        """Regression outputs of a batch."""
        rows = marks.astype(np.float32)
        return (rows @ self.weights) / np.sqrt(np.maximum(rows.sum(1, keepdims=True), 1))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        marks = presence(texts)
        known = marks.any(1)
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        raw = SHARPNESS * self.scores(marks).astype(np.float64)
        odds = np.exp(raw - raw.max(1, keepdims=True))
        odds /= odds.sum(1, keepdims=True)
        best = odds.argmax(1)
        return (
            [self.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)],
            [float(min(1.0, o[b])) if k else 0.0 for o, b, k in zip(odds, best, known, strict=True)],
        )


def dense(bits: list[bytes]) -> np.ndarray:
    """Packed presence rows as a matrix of 0 and 1."""
    packed = np.frombuffer(b"".join(bits), np.uint8).reshape(len(bits), BINS // 8)
    return np.unpackbits(packed, axis=1).astype(np.float32)


def fit_bits(bits: list[bytes], labels: list[str]) -> Model:
    """Nyström map and ridge regressions from packed presence rows and their languages.

    Rows are unpacked in blocks, whose shares of the regressions' matrices (landmarks x landmarks) are added up; so the
    landmarks and one block are all that is held unpacked.
    """
    names = sorted(set(labels))
    if not names:
        return Model([], np.zeros((BINS, 0), np.float32))
    of = np.array([names.index(x) for x in labels])
    turn = np.zeros(len(of), int)  # landmarks take the languages in turn
    for k in range(len(names)):
        turn[of == k] = np.arange((of == k).sum())
    marks = dense([bits[n] for n in np.lexsort((of, turn))[:LANDMARKS]])
    length = np.sqrt(np.maximum(marks.sum(1), 1)).astype(np.float64)

    def kernel(rows: np.ndarray) -> np.ndarray:
        common = (rows @ marks.T).astype(np.float64)  # whole numbers, exact
        return common / np.sqrt(np.maximum(rows.sum(1, dtype=np.float64), 1))[:, None] / length

    values, vectors = np.linalg.eigh(kernel(marks))
    good = values > 1e-9 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    share = np.bincount(of)
    weight = (1.0 / share)[of] * len(of) / len(names)  # languages count alike, however many texts they have
    gram, cross = RIDGE * len(of) * np.eye(root.shape[1]) / 100, np.zeros((root.shape[1], len(names)))
    for low in range(0, len(of), BLOCK_ROWS):
        part = slice(low, low + BLOCK_ROWS)
        mapped = kernel(dense(bits[part])) @ root
        weighed = mapped * weight[part, None]
        gram += weighed.T @ mapped
        cross += weighed.T @ np.where(of[part, None] == np.arange(len(names)), 1.0, -1.0)
    solved = (root @ np.linalg.solve(gram, cross)) / length[:, None]
    return Model(names, marks.T @ solved.astype(np.float32))


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = set()  # a task sends copies of a text once
    for batch in by_bytes(batches, "text"):
        keys = list(zip(batch.column("lang").to_pylist(), batch.column("pick").to_pylist(), strict=True))
        new = [n for n, key in enumerate(keys) if key not in seen and not seen.add(key)]
        batch = batch.take(pa.array(new, pa.int64()))
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(at, BLOCK_ROWS)
            packed = [np.packbits(x).tobytes() for x in presence(part.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("pick"), pa.array(packed, pa.binary())], ["lang", "pick", "bits"])


def fit(docs: DataFrame) -> Model:
    """Learn from text and language of the documents outside the held-out quarter."""
    labelled = conform(docs, "doc_id", "text", "lang").where("text IS NOT NULL AND lang IS NOT NULL").where(~held_out())
    labelled = labelled.select("text", "lang", hash_rank(F.xxhash64("text")).alias("pick"))
    known = least_hashes(labelled, "lang", "pick", lambda n: max(1, min(PER_LANGUAGE, MAX_SAMPLE // n)))
    if not known:
        return fit_bits([], [])
    chosen = labelled.join(F.broadcast(below(docs.sparkSession, known)), F.col("lang") == F.col("of")).where("pick < bound")
    rows = chosen.select("text", "lang", "pick").mapInArrow(_bits, "lang string, pick long, bits binary").dropDuplicates(["lang", "pick"]).collect()
    taken: dict[str, int] = {}
    sample = []
    for r in sorted(rows, key=lambda r: (r["pick"], r["lang"])):
        taken[r["lang"]] = taken.get(r["lang"], 0) + 1
        if taken[r["lang"]] <= known[r["lang"]].wanted:
            sample.append(r)
    return fit_bits([r["bits"] for r in sample], [r["lang"] for r in sample])


def predict(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """The columns of ``keep`` with lang_pred and score; texts are scored in batches."""
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, model.weights))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*sent.value)
        for batch in by_bytes(batches, "text"):
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                langs, scores = own.predict(part.column("text").to_pylist())
                columns = [part.column(c) for c in keep]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*keep, "lang_pred", "score"])

    taken = docs.select(*dict.fromkeys((*keep, "text")))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return taken.mapInArrow(score, f"{schema}, lang_pred string, score double")


@query("op10_string_kernel_langid")
def _op10(spark, sf_dir):
    docs = conform(read(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    judged = predict(docs.select("doc_id", "text"), fit(docs), "doc_id")
    return judged.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
