"""Importance resampling towards a target's distribution of hashed word runs.

The frequent words and pairs (the head) are broadcast with their checksum states and
buckets; a run outside of the head gets its checksum directly. Both ways give the same
bucket, so all totals are exact whatever the head holds.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, materialize

BUCKETS = 10_000
HEAD = 1 << 16  # words and pairs that are broadcast at most, of at most HEAD_BYTES each
HEAD_BYTES = 64
SHARE = 1 / (1 << 18)  # a run that is rarer than this in all parts of the data is no head
PART = 1 << 18  # distinct runs that a task counts at once

_TO = bytearray(b" " * 128 + bytes(range(128, 256)))
_TO[0x30:0x3A] = bytes(range(0x30, 0x3A))
_TO[0x41:0x5B] = _TO[0x61:0x7B] = bytes(range(0x61, 0x7B))
_TO = bytes(_TO)


def words(text: bytes | None) -> list[bytes]:
    """Runs of letters, digits and bytes beyond ASCII, with A-Z lowered."""
    return text.translate(_TO).split() if text else []


class Head(dict):
    """Checksums of frequent words; those of others are made when asked for, and not kept."""

    def __missing__(self, word: bytes) -> int:
        return zlib.crc32(word)


def feature_buckets(found: list[bytes], states: Head, pairs: dict[bytes, int], longest: int, buckets: int) -> np.ndarray:
    """The bucket of every run of 1 to `longest` words: a run's checksum goes on from the
    state of the run that it lengthens, unless the head has its bucket."""
    last = np.fromiter(map(states.__getitem__, found), np.int64, len(found))
    out = [last % buckets]
    state = last.tolist() if longest > 1 else []
    for n in range(2, longest + 1):
        state = state[: max(0, len(found) - n + 1)]
        own = pairs if n == 2 else {}
        run = np.empty(len(state), np.int64)
        for i, s in enumerate(state):
            tail = b" " + found[i + n - 1]
            bucket = own.get(found[i] + tail) if own else None
            if bucket is None or n < longest:
                state[i] = zlib.crc32(tail, s)
            run[i] = state[i] % buckets if bucket is None else bucket
        out.append(run)
    return np.concatenate(out)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("text").cast("string").alias("text"))


def find_head(docs: DataFrame, longest: int = 1, buckets: int = BUCKETS, size: int = HEAD) -> tuple[dict[bytes, int], dict[bytes, int]]:
    """States of frequent words, and buckets of frequent pairs if runs have two words.

    A task counts all its words and sends those with a share of SHARE in a part of its
    texts; every word of that share in the whole has it in some part. The `size` most
    frequent of what is sent are the head.
    """

    def run(batches):
        counts, total = Counter(), 0

        def out():
            rows = [(w, n) for w, n in counts.items() if n >= SHARE * total and len(w) <= HEAD_BYTES]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64())], names=["run", "n"])

        for batch in batches:
            for text in as_bytes(batch.column(0)):
                found = words(text)
                counts.update(found)
                total += len(found)
                if longest > 1:
                    counts.update(a + b" " + b for a, b in zip(found, found[1:], strict=False))
                if len(counts) > PART:
                    yield out()
                    total = 0
        yield out()

    counted = _texts(docs).mapInArrow(run, "run binary, n long").groupBy("run").agg(F.sum("n").alias("n"))
    head = [bytes(r["run"]) for r in counted.orderBy(F.desc("n"), "run").limit(size).collect()]
    return {w: zlib.crc32(w) for w in head if b" " not in w}, {w: zlib.crc32(w) % buckets for w in head if b" " in w}


def bucket_totals(docs: DataFrame, head: Broadcast, longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Exact count of each bucket over all texts; a task sends a row for each bucket."""

    def run(batches):
        states, pairs = Head(head.value[0]), head.value[1]
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in as_bytes(batch.column(0)):
                total += np.bincount(feature_buckets(words(text), states, pairs, longest, buckets), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    sums = _texts(docs).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in sums.collect():  # a row for each bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the smoothed share of each bucket in the target over the source."""
    n = len(source)
    ratio = (target + 1.0) * (source.sum() + n) / ((source + 1.0) * (target.sum() + n))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def gumbel(doc_id: Column, seed: int) -> Column:
    """floor(1000 g) of a standard Gumbel draw that the seed and the doc_id decide."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.left(digits, F.lit(8)), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def importance_resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, seed: int = 2024, longest: int = 1, buckets: int = BUCKETS, least_words: int = 20, head_size: int = HEAD
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every document.

    A weight is the sum of the gains of a text's runs of 1 to `longest` words; the score
    adds the Gumbel draw, so the highest scores are a sample without replacement. Of the N
    documents with at least `least_words` words, the floor(N * percent / 100) highest have
    a rank from 1, ties to the smaller doc_id; others have none.

    Null, empty and wordless texts have no features and weight 0; texts are read whole. A
    null doc_id draws as an empty name and comes after others in ties; repeated rows are
    documents of their own with the same score. Empty tables give no rows or plain gains
    of a side without counts. Extra columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    head = spark.sparkContext.broadcast(find_head(docs, longest, buckets, head_size))
    gain = spark.sparkContext.broadcast(gains(bucket_totals(docs, head, longest, buckets), bucket_totals(target, head, longest, buckets)))

    def run(batches):
        states, pairs = Head(head.value[0]), head.value[1]
        for batch in batches:
            n_words, n_features, weight = [], [], []
            for text in as_bytes(batch.column(1)):
                found = words(text)
                at = feature_buckets(found, states, pairs, longest, buckets)
                n_words.append(len(found))
                n_features.append(len(at))
                weight.append(int(gain.value[at].sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n_words, n_features, weight))], names=["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    weighed = rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")
    scored = materialize(weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)).withColumn("row", F.monotonically_increasing_id()))
    some = F.col("n_words") >= least_words
    drawn = scored.where(some).count() * percent // 100
    ranked = ranks(scored.where(some), [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")])
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranked.unionByName(scored.where(~some).withColumn("rank", F.lit(None).cast("long"))).drop("row")


def ranks(df: DataFrame, order: list[Column]) -> DataFrame:
    """Rank of each row in the whole table: ranges of the order are sorted by themselves,
    and a range starts where the counts of those before it end."""
    placed = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    counts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = counts.selectExpr("part", "sum(n) over (order by part) - n as before")  # a row for each range
    return placed.join(F.broadcast(before), part == F.col("part")).withColumn("rank", F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1) + 1).drop("part", "before", "place")
