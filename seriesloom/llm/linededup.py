"""Line dedup by a deletion-neighbourhood join.

Two lines one edit apart share a variant: one with a character deleted, at the same place
where one character was replaced, or the shorter line itself where one was put in. Every
line that can have a neighbour emits all its variants as hashed keys with the deleted
place; equal keys are joined and the edit distance is verified. Lines that agree with no
other line in a half can't have a neighbour and emit none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, document_key, materialize, mix

MIN_CHARS = 20  # shorter lines are left alone
SENT_IDS = 500_000  # hashes that are sent to all executors at most

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def normalized(line: Column) -> Column:
    """Trimmed, in lower case, white space runs as one blank."""
    lower = F.lower(line)
    odd = F.contains(lower, F.lit("  "))
    for c in "\t\r\x0b\x0c":
        odd = odd | F.contains(lower, F.lit(c))
    return F.trim(F.when(odd, F.regexp_replace(lower, r"[\x20\x09-\x0D]+", " ")).otherwise(lower))


def _halves(line: Column) -> list[Column]:
    """Hashes of halves: of two lines one edit apart, one half is the same.

    A line of n characters is cut as one of n, and as the longer of a pair with n - 1.
    """
    n = F.char_length(line)
    short, long = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    return [
        F.xxhash64(F.lit(1), n, F.left(line, long)),
        F.xxhash64(F.lit(2), n, F.right(line, n - long)),
        F.xxhash64(F.lit(1), n - 1, F.left(line, short)),
        F.xxhash64(F.lit(2), n - 1, F.right(line, n - 1 - short)),
    ]


def variants(line: str) -> tuple[int, np.ndarray]:
    """Hash of a line, and those of the line without each of its characters, by prefix sums."""
    codes = mix(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1))
    power = np.cumprod(np.full(len(codes), np.uint64(_BASE)), dtype=np.uint64)
    sums = np.cumsum(codes * power, dtype=np.uint64)
    before = np.concatenate([np.zeros(1, np.uint64), sums[:-1]])
    return int(sums[-1]), before + (sums[-1] - sums) * np.uint64(_INVERSE)


_VARIANT = pa.schema([("variant", pa.int64()), ("at", pa.int32()), ("h", pa.int64())])


def _emit(batches):
    """Lines (h, line) to their variants; `at` is the place deleted, -1 for the line itself."""
    for batch in batches:
        keys, places, owners, size = [], [], [], 0

        def out():
            columns = [pa.array(np.concatenate(x)) for x in (keys, places, owners)]
            for x in (keys, places, owners):
                x.clear()
            return pa.RecordBatch.from_arrays(columns, schema=_VARIANT)

        for h, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own, deleted = variants(line)
            keys += [np.array([own], np.uint64).view(np.int64), deleted.view(np.int64)]
            places += [np.arange(-1, len(deleted), dtype=np.int32)]
            owners += [np.full(len(deleted) + 1, h, np.int64)]
            size += len(deleted)
            if size > 1 << 18:
                yield out()
                size = 0
        if keys:
            yield out()


def _neighbours(texts: DataFrame) -> DataFrame:
    """(h, other): lines of `texts` (h, line, first) and the earliest one that shares a
    variant with them, if it is earlier. All lines that have one variant by deletion at one
    place differ in that place only, so no pairs among them are needed."""
    keyed = texts.select("h", "line").mapInArrow(_emit, "variant long, at int, h long")
    # a variant's lines differ in one character: at most length times alphabet of them
    each = Window.partitionBy("variant")
    keyed = keyed.withColumns({"low": F.min("h").over(each), "high": F.max("h").over(each)}).where("low <> high").select("variant", "at", "h")
    keyed = materialize(keyed).join(texts.select("h", "first"), "h")
    spot = F.struct("first", "h")
    least = keyed.groupBy("variant", "at").agg(F.min(spot).alias("least"))
    replaced = keyed.where("at >= 0").join(least, ["variant", "at"]).select("h", "first", "least")
    whole = least.where("at = -1").select("variant", "least")
    longer = least.where("at >= 0").groupBy("variant").agg(F.min("least").alias("least"))
    put_in = keyed.where("at >= 0").join(whole, "variant").select("h", "first", "least")
    left_out = keyed.where("at = -1").join(longer, "variant").select("h", "first", "least")
    found = replaced.unionByName(put_in).unionByName(left_out).where("least.first < first")
    return found.select("h", F.col("least.h").alias("other")).distinct()


def _only(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key is among the ids, which are sent to all if they are few."""
    return rows.join(F.broadcast(ids) if ids.limit(SENT_IDS + 1).count() <= SENT_IDS else ids, key, "left_semi")


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc (see document_key) and gone: the places of the lines to be removed.

    Lines are known by two hashes; texts of lines are fetched only of those that agree with
    another line in a half.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("doc", document_key(F.col("doc_id"), F.col("text")))

    def lines_of(some: DataFrame) -> DataFrame:
        cut_up = some.select("doc_id", "doc", F.posexplode(F.split("text", "\n")).alias("place", "raw"))
        return cut_up.select("doc_id", "doc", "place", normalized(F.col("raw")).alias("line")).where(F.char_length("line") >= max(min_chars, 2))

    names = [F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), F.col("line")).alias("g")]
    spot = F.struct("doc_id", "doc", "place")
    halves = F.array(*_halves(F.col("line"))).alias("halves")
    places = materialize(lines_of(rows).select("doc_id", "doc", "place", *names, halves))
    # where each distinct line comes first; copies are combined before the shuffle
    first = materialize(places.groupBy("h", "g").agg(F.min(spot).alias("first"), F.count("*").alias("copies")))
    again = places.join(first.where("copies > 1").select("h", "g", "first"), ["h", "g"]).where(~spot.eqNullSafe(F.col("first"))).select("doc", "place")
    halved = places.select("h", F.explode("halves").alias("half"))
    shared = materialize(halved.groupBy("half").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low <> high").select("half"))
    wanted = materialize(_only(halved, shared, "half").select("h").distinct())
    spots = materialize(_only(first, wanted, "h"))
    holders = materialize(spots.select("first.doc").distinct())
    texts = _only(lines_of(_only(rows, holders, "doc")).select(*names, "line"), wanted, "h").dropDuplicates(["h", "g"])
    texts = materialize(texts.join(spots, ["h", "g"]).select("h", "line", "first"))
    one, two = (texts.select(F.col("h").alias(x), F.col("line").alias(f"line_{x}"), F.col("first").alias(f"first_{x}")) for x in ("h", "other"))
    near = _neighbours(texts).join(one, "h").join(two, "other").where((F.levenshtein("line_h", "line_other", 1) == 1) & (F.col("first_other") < F.col("first_h")))
    near = near.select(F.col("first_h.doc").alias("doc"), F.col("first_h.place").alias("place"))
    gone = materialize(again.unionByName(near).groupBy("doc").agg(F.collect_set("place").alias("gone")))
    discard(places, first, shared, wanted, spots, holders, texts)
    return gone


def remaining(text: Column, gone: Column) -> Column:
    """The text without the lines at these places."""
    kept = F.filter(F.split(text, "\n"), lambda line, i: ~F.array_contains(gone, i))
    return F.when(gone.isNull(), text).otherwise(F.array_join(kept, "\n"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, text, n_lines and n_removed: documents without repeated lines.

    A line goes if an earlier one (by doc_id, then by place) is within one edit of it,
    both compared without case, outer blanks and runs of white space. Lines of fewer than
    `min_chars` characters stay. Null texts have no lines and stay null; a text whose lines
    all go becomes empty. Rows with a null doc_id come first; rows that repeat doc_id and
    text are one document and get the same result; texts and lines of any length are read
    whole; an empty table gives an empty result; extra columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.withColumn("doc", document_key(F.col("doc_id"), F.col("text"))).join(repeated_lines(docs, min_chars), "doc", "left")
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n")))
    return out.select("doc_id", remaining(F.col("text"), F.col("gone")).alias("text"), n_lines.cast("long").alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"))
