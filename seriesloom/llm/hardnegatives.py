"""Hard negatives by inner product, with candidates pruned by coordinates.

Vectors lie in buckets of like lengths. A score of at least t asks, within a bucket, for
an angle of at most acos(t / (anchor's length * bucket's greatest length)), and so for a
range of values in each coordinate. A bucket holds its unit vectors' coordinates as sorted
lists; the ranges of an anchor's focus coordinates (its greatest ones) are cut out of these
and intersected, and what is left is scored exactly. Thresholds rise while buckets are
searched, so later buckets are cut more.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

SCALE = 256
BUCKET_ROWS = 4096
PART_ROWS = 1 << 16  # of a task, where there are tasks enough
LENGTHS = 0.9  # a bucket ends where lengths fall below this share of its first
FOCUS = 4
BLOCK_BYTES = 1 << 25  # of the anchors that are searched in one job, and sent to all executors
SAMPLE = 4096  # rows that give the first thresholds, by hash
EXACT = 2.0**52  # up to here sums of whole doubles are exact in any order
SLACK = 1e-9
ANY, NONE = np.iinfo(np.int64).min, np.iinfo(np.int64).max  # thresholds that all or no scores reach


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of numbers as rows of floor(256 x); missing components at the end are zero."""
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = int(sizes.max(initial=0))
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = values
    return np.floor(SCALE * out)


def lengths(x: np.ndarray) -> np.ndarray:
    most = np.abs(x).max(axis=1, initial=0)
    return most * np.sqrt(((x / np.where(most > 0, most, 1)[:, None]) ** 2).sum(axis=1))


def widened(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, width - x.shape[1])))


class Bucket:
    """Vectors of like lengths with the sorted lists of their unit vectors' coordinates."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, length: np.ndarray):
        self.ids, self.labels, self.vectors, self.most = ids, labels, vectors, float(length.max(initial=0))
        unit = vectors / np.where(length > 0, length, 1)[:, None]
        self.order = np.argsort(unit, axis=0)
        self.sorted = np.ascontiguousarray(np.take_along_axis(unit, self.order, axis=0).T)

    def candidates(self, unit: np.ndarray, focus: np.ndarray, length: float, least: float) -> np.ndarray:
        """Rows that can have a score of at least `least` with a vector of this direction
        (`unit`) and length: those in the ranges of all focus coordinates."""
        everything = np.arange(len(self.ids))
        if least <= 0:
            return everything
        reach = length * self.most
        if reach <= 0 or least > reach * (1 + SLACK):
            return everything[:0]
        angle = math.acos(min(1.0, max(-1.0, least / reach - SLACK)))
        seen = np.zeros(len(self.ids), np.int8)
        for f in focus:
            own = math.acos(min(1.0, max(-1.0, unit[f])))
            low, high = math.cos(min(math.pi, own + angle)) - SLACK, math.cos(max(0.0, own - angle)) + SLACK
            a, b = np.searchsorted(self.sorted[f], (low, high))
            seen[self.order[a:b, f]] += 1
        return np.flatnonzero(seen == len(focus))

    def scores(self, rows: np.ndarray, vector: np.ndarray, length: float) -> np.ndarray:
        """Exact inner products."""
        if length * self.most < EXACT:
            return (self.vectors[rows] @ vector).astype(np.int64)
        whole = [int(v) for v in vector]
        return np.array([sum(a * int(b) for a, b in zip(whole, self.vectors[i], strict=True)) for i in rows], np.int64)  # beyond 64 bits: an error


def best(scores: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the n highest scores, ties to the smaller id."""
    if len(scores) > 4 * n:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - n)[len(scores) - n])
        return some[np.lexsort((ids[some], -scores[some]))[:n]]
    return np.lexsort((ids, -scores))[:n]


def _buckets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[Bucket]:
    """Rows (vec_id, label, embedding), mostly longest first, cut into buckets."""
    ids, labels, vectors = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, width))

    def cut(last: bool) -> Iterator[Bucket]:
        nonlocal ids, labels, vectors
        length = lengths(vectors)
        order = np.argsort(-length, kind="stable")
        ids, labels, vectors, length, at = ids[order], labels[order], vectors[order], length[order], 0
        while len(ids) - at >= (1 if last else BUCKET_ROWS):
            near = int(np.searchsorted(-length[at : at + BUCKET_ROWS], -LENGTHS * length[at], "right"))
            end = at + max(1, near)
            yield Bucket(ids[at:end], labels[at:end], vectors[at:end], length[at:end])
            at = end
        ids, labels, vectors = ids[at:], labels[at:], vectors[at:]

    for batch in batches:
        more = matrix(batch.column(2))
        wide = max(vectors.shape[1], more.shape[1])
        ids = np.concatenate([ids, batch.column(0).to_numpy()])
        labels = np.concatenate([labels, batch.column(1).to_numpy()])
        vectors = np.concatenate([widened(vectors, wide), widened(more, wide)])
        yield from cut(False)
    yield from cut(True)


class Anchors:
    """A block of anchors: ids, labels, vectors, and what prunes them."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.length = lengths(vectors)
        self.unit = vectors / np.where(self.length > 0, self.length, 1)[:, None]
        self.focus = np.argsort(-np.abs(self.unit), axis=1, kind="stable")[:, :FOCUS]

    def found(self, i: int, bucket: Bucket, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the bucket with a score of at least `least`, and their scores."""
        width = min(self.vectors.shape[1], bucket.vectors.shape[1])
        focus = self.focus[i][self.focus[i] < width]
        rows = bucket.candidates(self.unit[i], focus, self.length[i], least)
        vector = np.zeros(bucket.vectors.shape[1])
        vector[:width] = self.vectors[i, :width]
        scores = bucket.scores(rows, vector, self.length[i])
        return rows[scores >= least], scores[scores >= least]


class Best:
    """The n best (score, id) so far of each slot, and the score that a new one must reach."""

    def __init__(self, least: np.ndarray, n: int):
        self.least, self.n = least.copy(), n
        self.kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, slot: int, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(ids):
            return
        if slot in self.kept:
            scores, ids = np.concatenate([self.kept[slot][0], scores]), np.concatenate([self.kept[slot][1], ids])
        top = best(scores, ids, self.n)
        self.kept[slot] = scores[top], ids[top]
        if len(top) == self.n:
            self.least[slot] = max(self.least[slot], scores[top[-1]])

    def batch(self) -> pa.RecordBatch:
        slots = [np.full(len(ids), s) for s, (_, ids) in self.kept.items()]
        columns = [np.concatenate([np.zeros(0, np.int64), *x]) for x in (slots, [k[0] for k in self.kept.values()], [k[1] for k in self.kept.values()])]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["slot", "score", "vec_id"])


FOUND = "slot long, score long, vec_id long"


def _same_label(block, least, n):
    """The n best rows of the same label of each anchor, over a task's buckets."""

    def run(batches):
        anchors = block.value
        found = Best(least.value, n)
        for bucket in _buckets(batches, anchors.vectors.shape[1]):
            for i in range(len(anchors.ids)):
                rows, scores = anchors.found(i, bucket, found.least[i])
                own = (bucket.labels[rows] == anchors.labels[i]) & (bucket.ids[rows] != anchors.ids[i])
                found.add(i, scores[own], bucket.ids[rows[own]])
        yield found.batch()

    return run


def _other_labels(block, ranges, n):
    """The n best rows of other labels in each of an anchor's ranges of scores; a slot is
    an anchor's range, its low is NONE where there is none."""

    def run(batches):
        anchors, (low, high) = block.value, ranges.value
        a, k = low.shape
        found = Best(low.reshape(-1), n)
        for bucket in _buckets(batches, anchors.vectors.shape[1]):
            for i in range(a):
                least = found.least[i * k : i * k + k]
                if least.min() == NONE:
                    continue
                rows, scores = anchors.found(i, bucket, least.min())
                other = (bucket.labels[rows] != anchors.labels[i]) & (bucket.ids[rows] != anchors.ids[i])
                scores, ids = scores[other], bucket.ids[rows[other]]
                for j in range(k):
                    inside = (scores >= least[j]) & (scores <= high[i, j])
                    found.add(i * k + j, scores[inside], ids[inside])
        yield found.batch()

    return run


def _top(found: DataFrame, n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("slot").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= n)


def _blocks(anchors: DataFrame, size: int) -> Iterator[Anchors]:
    """Anchors (vec_id, label, embedding) in blocks of about `size` bytes at most, one after the other."""

    def pack(batches):
        for batch in batches:
            x = matrix(batch.column(2))
            step = max(1, size // max(1, x[:1].nbytes))
            for k in range(0, len(x), step):
                columns = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), x]
                yield pa.RecordBatch.from_arrays([pa.array([c[k : k + step].tobytes()], pa.binary()) for c in columns], names=["ids", "labels", "vectors"])

    def joined(held) -> Anchors:
        width = max(x.shape[1] for _, _, x in held)
        return Anchors(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), np.concatenate([widened(x, width) for _, _, x in held]))

    held, n = [], 0
    for row in anchors.mapInArrow(pack, "ids binary, labels binary, vectors binary").toLocalIterator():
        ids, labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        if held and n + len(row["vectors"]) > size:
            yield joined(held)
            held, n = [], 0
        held.append((ids, labels, np.frombuffer(row["vectors"], np.float64).reshape(len(ids), -1) if row["vectors"] else np.zeros((len(ids), 0))))
        n += len(row["vectors"])
    if held:
        yield joined(held)


def mine_hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    `rows` and `anchors` have vec_id, label and embedding; a component x counts as
    floor(256 x) and a score is the whole inner product, ties by smaller vec_id. An anchor's
    positives are its first rows of the same label; for each of them the first rows of other
    labels with low * positive <= 100 * score <= high * positive are its negatives.

    Rows without a vec_id, a label or a vector, or with a null or infinite component take no
    part; shorter vectors end in zeros, the empty one has score 0. A row with the anchor's
    own vec_id is neither its positive nor its negative; repeated rows count each; repeated
    anchors give their result each. Scores beyond 64 bits are an error. No anchors, or no
    rows, give no result; vectors of any length are read whole; extra columns are ignored.
    """
    spark = rows.sparkSession
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    usable = usable & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    columns = [F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding")]
    rows, anchors = (x.where(usable).select(columns) for x in (rows, anchors))
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + F.pow(F.floor(SCALE * x).cast("double"), 2))
    rows, by = rows.withColumn("length", F.sqrt(square)), [F.desc("length"), F.asc("vec_id")]
    n = rows.count()
    parts = max(-(-n // PART_ROWS), min(-(-n // BUCKET_ROWS), spark.sparkContext.defaultParallelism), 1)
    dealt = materialize(rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).drop("length"))
    sample = rows.drop("length").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    result = spark.createDataFrame([], schema)
    for block in _blocks(anchors, BLOCK_BYTES):
        shared = spark.sparkContext.broadcast(block)

        def search(table: DataFrame, least: np.ndarray, shared=shared) -> list:
            """At most `positives` rows for each anchor of the block."""
            return _top(table.mapInArrow(_same_label(shared, spark.sparkContext.broadcast(least), positives), FOUND), positives).collect()

        least = np.full(len(block.ids), ANY)
        for r in search(sample, least):
            if r["rank"] == positives:
                least[r["slot"]] = r["score"]
        there = np.zeros((len(block.ids), positives), bool)
        score, name = np.zeros(there.shape, np.int64), np.zeros(there.shape, np.int64)
        for r in search(dealt, least):
            at = r["slot"], r["rank"] - 1
            there[at], score[at], name[at] = True, r["score"], r["vec_id"]
        exact = score.astype(object)  # a score times 100 may need more than 64 bits
        lows, highs = (-(-low * exact // 100)).astype(np.int64), (high * exact // 100).astype(np.int64)
        ranges = spark.sparkContext.broadcast((np.where(there & (lows <= highs), lows, NONE), highs))
        top = _top(dealt.mapInArrow(_other_labels(shared, ranges, negatives), FOUND), negatives)
        who = spark.sparkContext.broadcast((block.ids, name.reshape(-1), score.reshape(-1)))
        result = result.unionByName(materialize(top.select("slot", "rank", "vec_id", "score").mapInArrow(_named(who, positives), schema)))
    discard(dealt)
    return result


def _named(who, positives):
    def run(batches):
        ids, name, score = who.value
        for batch in batches:
            slot = batch.column(0).to_numpy()
            columns = [pa.array(ids[slot // positives]), pa.array(name[slot]), batch.column(1), batch.column(2), pa.array(score[slot]), batch.column(3)]
            yield pa.RecordBatch.from_arrays(columns, names=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    return run
