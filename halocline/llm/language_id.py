"""Language ID by nearest centroid.

A text is a vector of byte 2- and 3-grams of its lower-cased letters, hashed,
weighted by (1 + log count) times inverse document frequency and normalised. Each
language has several centroids (spherical k-means); the prediction is the
language of the centroid with the largest cosine, and the score that cosine. A
text further from every centroid than the calibrated distance is rejected.

The model is fitted on a bounded sample: about ``per_language`` documents of each
language, picked by a hash of the id. Prediction reads whole texts.

Null texts and texts without a letter are ``und`` with score 0. Rows without a
language, id or text are not learned from. Repeated rows are predicted one by
one. Other columns pass through ``identify``, which adds lang_pred and score and
replaces columns of these names. A table with nothing to learn from gives ``und``
for all rows; an empty table gives an empty result. Of centroids that are as near the
first counts: that of the language first in the alphabet. Long texts are one vector
each, read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

UNDETERMINED = "und"
SLOTS = 1 << 13
SIZE = 2 * SLOTS
#: Bytes that aren't letters become a space; bytes over 127 are parts of letters.
_LETTERS = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))
_ROWS = 256


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    centroids: np.ndarray
    owner: np.ndarray
    weights: np.ndarray
    least_cosine: float


def counts(text: str | None) -> np.ndarray:
    """Counts of hashed 2-grams, then 3-grams."""
    raw = b" " + b" ".join((text or "").lower().encode("utf-8", "replace").translate(_LETTERS).split()) + b" "
    b = np.frombuffer(raw, dtype=np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(SIZE, dtype=np.float32)
    two = (b[:-1] * np.uint32(0x9E3779B1)) ^ (b[1:] * np.uint32(0x85EBCA77))
    three = (two[:-1] + b[2:]) * np.uint32(0xC2B2AE3D)
    two = ((two * np.uint32(0x27D4EB2F)) >> np.uint32(19)).astype(np.int64)
    return np.concatenate((np.bincount(two, minlength=SLOTS), np.bincount((three >> np.uint32(19)).astype(np.int64), minlength=SLOTS))).astype(np.float32)


def _weighted(rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
    v = np.log1p(rows) * weights
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def _weighted_in_place(rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """As ``_weighted``; a block of rows at a time, so that nothing else of the size of ``rows`` is held."""
    for i in range(0, len(rows), 32):
        rows[i : i + 32] = _weighted(rows[i : i + 32], weights)
    return rows


def _clusters(v: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Spherical k-means from spread-out seeds."""
    at = [int(rng.integers(len(v)))]
    while len(at) < min(k, len(v)):
        at.append(int(np.argmin((v @ v[at].T).max(axis=1))))
    c = v[at]
    for _ in range(12):
        near = (v @ c.T).argmax(axis=1)
        c = np.stack([v[near == j].sum(axis=0) if (near == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def fit(docs: DataFrame, usable: Column | None = None, per_language: int = 400, clusters: int = 4, seed: int = 7) -> LanguageModel:
    """Fits on documents for which ``usable`` holds; ``per_language`` bounds the expected number of each language's documents."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    known = known.where(usable) if usable is not None else known
    totals = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not totals:
        return LanguageModel([], np.zeros((0, SIZE), np.float32), np.zeros(0, int), np.ones(SIZE, np.float32), 0.0)
    share = F.create_map(*[F.lit(x) for lang, n in totals.items() for x in (lang, min(1.0, per_language / n))])
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 20)) / (1 << 20)
    rows = known.where(draw < share[F.col("lang")]).select("lang", "text").where(F.rlike("text", F.lit(r"\p{L}"))).toLocalIterator()
    # Slots and counts of each vector by language: dense vectors of one language at a time are held.
    vectors: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    seen, n = np.zeros(SIZE, dtype=np.int64), 0
    for r in rows:
        x = counts(r["text"])
        at = np.flatnonzero(x)
        seen[at] += 1
        n += 1
        vectors.setdefault(r["lang"], []).append((at.astype(np.uint16), x[at]))
    weights = (np.log((1 + n) / (1 + seen)) + 1).astype(np.float32)
    names, rng = sorted(vectors), np.random.default_rng(seed)
    parts, own = [], []
    for name in names:
        v = np.zeros((len(vectors[name]), SIZE), dtype=np.float32)
        for row, (at, c) in zip(v, vectors.pop(name)):
            row[at] = c
        v = _weighted_in_place(v, weights)
        parts.append(_clusters(v, clusters, rng))
        own.append((v @ parts[-1].T).max(axis=1).min())
        del v
    centroids = np.concatenate(parts) if parts else np.zeros((0, SIZE), np.float32)
    owner, own = np.repeat(np.arange(len(names)), [len(p) for p in parts]), np.array(own)
    # Half the cosine of the furthest document that was learned from.
    return LanguageModel(names, centroids.astype(np.float32), owner, weights, float(own.min() / 2) if len(own) else 0.0)


def predict(texts: list[str | None], model: LanguageModel) -> tuple[list[str], np.ndarray]:
    best, score = np.zeros(len(texts), dtype=int), np.zeros(len(texts))
    if not model.languages:
        return [UNDETERMINED] * len(texts), score
    for i in range(0, len(texts), _ROWS):
        cosines = _weighted(np.stack([counts(t) for t in texts[i : i + _ROWS]]), model.weights) @ model.centroids.T
        best[i : i + _ROWS], score[i : i + _ROWS] = model.owner[cosines.argmax(axis=1)], cosines.max(axis=1)
    return [model.languages[k] for k in best.tolist()], np.clip(score, 0.0, 1.0)


def identify(docs: DataFrame, model: LanguageModel, reject: bool = True) -> DataFrame:
    """``docs`` with lang_pred and score; with ``reject`` false only texts without letters are ``und``."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            lang, score = predict(texts.tolist(), shared.value)
            yield pd.DataFrame({"lang": lang, "score": score})

    lettered = F.coalesce(F.rlike("text", F.lit(r"\p{L}")), F.lit(False))
    out = docs.withColumn("_lang", run("text"))
    known = lettered & (F.col("_lang.score") >= model.least_cosine) if reject else lettered
    out = out.withColumn("lang_pred", F.when(known, F.col("_lang.lang")).otherwise(UNDETERMINED)).withColumn("score", F.when(lettered, F.col("_lang.score")).otherwise(0.0))
    return out.drop("_lang")
