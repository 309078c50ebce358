"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, mix

BITS = 22
SAMPLE_ROWS = 16384  # labelled rows that the model is fitted on, at most
EPOCHS = 5
ALPHA, BETA, L2 = 3.0, 1.0, 0.01
L1_ROOT = 0.05  # the L1 term is this times the root of the number of rows, as noise grows
THRESHOLD = 0.7

# ASCII letters to lower case, other ASCII but digits to a blank
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def features(text: bytes | None) -> np.ndarray:
    """Distinct hashed unigrams, bigrams and skip-grams (one or two words left out)."""
    words = text.translate(_FOLD).split() if text else []
    if not words:
        return np.zeros(0, np.int32)
    h = mix(np.fromiter(map(zlib.crc32, words), np.uint64, len(words)) + np.uint64(1))
    grams = [h]
    for gap in (1, 2, 3):
        grams.append(mix(h[:-gap] * np.uint64(2 * gap + 1) + (h[gap:] >> np.uint64(gap))))
    return np.unique((np.concatenate(grams) >> np.uint64(64 - BITS)).astype(np.int32))


def fit(rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights as (indices, values, bias); most coordinates are zero by the L1 term."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    l1 = L1_ROOT * np.sqrt(len(rows))
    rate = min(max(float(labels.mean()) if len(labels) else 0.0, 1e-3), 1 - 1e-3)
    bias, bias_n = float(np.log(rate / (1 - rate))), 1.0

    def weights(at):
        zi = z[at]
        return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(epochs):
        for at, y in zip(rows, labels, strict=True):
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -30, 30)))
            g = p - y
            grown = np.sqrt(n[at] + g * g)
            z[at] += g - (grown - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
            bias_n += g * g
            bias -= 0.05 / np.sqrt(bias_n) * g
    some = np.flatnonzero(np.abs(z) > l1)
    return some.astype(np.int32), weights(some), bias


def _gather(batches):
    for batch in batches:
        grams = [features(x).tobytes() for x in as_bytes(batch.column(1))]
        yield pa.RecordBatch.from_arrays([pa.array([0] * len(grams), pa.int32()), batch.column(0), pa.array(grams, pa.binary()), batch.column(2)], names=["model", "doc_id", "grams", "label"])


def _train(table: pa.Table) -> pa.Table:
    table = table.sort_by([("doc_id", "ascending"), ("label", "ascending"), ("grams", "ascending")])
    order = np.argsort(mix(np.arange(table.num_rows, dtype=np.uint64)), kind="stable")
    grams = table.column("grams").to_pylist()
    labels = table.column("label").to_numpy()[order].astype(float)
    at, values, bias = fit([np.frombuffer(grams[i], np.int32) for i in order], labels)
    return pa.table({"at": pa.array([at.tobytes()], pa.binary()), "weights": pa.array([values.tobytes()], pa.binary()), "bias": pa.array([bias], pa.float64())})


def train_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """Fit on labelled documents: `labels` (doc_id, label), at most `sample_rows` of them.

    The sample is by hash of the doc_id; its size bounds the broadcast ids, the one
    training task and the weights.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").distinct()
    # repeated ids with both labels are left out, as nobody knows which holds
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most").drop("most")
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    found = rows.select("doc_id", "text", "label").mapInArrow(_gather, "model int, doc_id long, grams binary, label int")
    model = found.groupBy("model").applyInArrow(_train, "at binary, weights binary, bias double").first()
    if model is None:
        return np.zeros(0, np.int32), np.zeros(0), 0.0
    return np.frombuffer(model["at"], np.int32), np.frombuffer(model["weights"], np.float64), model["bias"]


def toxicity_scores(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted for every document, from a model fitted on `labels`.

    Only the text enters a score. Null, empty and wordless texts get the bias alone;
    without usable labels every score is 0.5. Null doc_ids are scored and never trained
    on; every repeated row is scored; texts are read whole; an empty table gives an empty
    result; extra columns are ignored.
    """
    spark = docs.sparkSession
    at, values, bias = train_toxicity(docs, labels, sample_rows)
    model = spark.sparkContext.broadcast((at, values.astype(np.float32)))  # the weights that aren't zero

    def run(batches):
        weights = np.zeros(1 << BITS, np.float32)
        weights[model.value[0]] = model.value[1]
        for batch in batches:
            scores = []
            for text in as_bytes(batch.column(1)):
                x = bias + float(weights[features(text)].sum(dtype=np.float64))
                scores.append(1 / (1 + np.exp(-min(max(x, -30.0), 30.0))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def held_out(column: str, parts: int, part: int) -> Column:
    """Whether the checksum of the number as text leaves the remainder; false for null."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string")), F.lit(parts)) == part, F.lit(False))
