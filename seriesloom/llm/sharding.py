"""Sharding by histogram sort: exact counts below candidate keys refine the splitters
until the shards' bytes are within a tolerance; then rows are exchanged once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

SHARDS = 40
ROW_BYTES = 16
TOLERANCE = 0.0005  # of a shard's bytes
FIRST_PROBES = 1600
PROBES = 64  # candidates in each cell that still holds a splitter
ROWS_A_CELL = 200_000


def _keys(batch: pa.RecordBatch) -> np.ndarray:
    """Rows' sort keys (hash, doc_id, row) as 24 bytes that sort as the triples do."""
    out = np.empty((batch.num_rows, 3), ">u8")
    for j, name in enumerate(("hash", "id", "row")):
        out[:, j] = batch.column(name).to_numpy(zero_copy_only=False).view(np.uint64) ^ np.uint64(1 << 63)
    return np.ascontiguousarray(out).view("S24")[:, 0]


def _padded(probes: list[bytes]) -> np.ndarray:
    return np.array(probes, "S24")


def _histogram(probes):
    """Rows and bytes of each cell: above the probe before it, up to its own probe."""

    def run(batches):
        at = probes.value
        rows, size = np.zeros(len(at) + 1, np.int64), np.zeros(len(at) + 1, np.int64)
        for batch in batches:
            cell = np.searchsorted(at, _keys(batch), "left")
            rows += np.bincount(cell, minlength=len(rows))
            np.add.at(size, cell, batch.column("size").to_numpy(zero_copy_only=False))
        some = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(rows[some], pa.int64()), pa.array(size[some], pa.int64())], names=["cell", "rows", "size"])

    return run


def _candidates(probes, chance):
    """Keys of some rows of the cells that are still open, drawn by hash."""

    def run(batches):
        at, odds = probes.value, chance.value
        for batch in batches:
            keys = _keys(batch)
            cell = np.searchsorted(at, keys, "left")
            draw = batch.column("draw").to_numpy(zero_copy_only=False).view(np.uint64) / 2.0**64
            yield pa.RecordBatch.from_arrays([pa.array([bytes(k).ljust(24, b"\0") for k in keys[draw < odds[cell]]], pa.binary())], names=["key"])

    return run


def _count(keys: DataFrame, probes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    shared = keys.sparkSession.sparkContext.broadcast(_padded(probes))
    rows, size = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
    cells = keys.mapInArrow(_histogram(shared), "cell long, rows long, size long").groupBy("cell").agg(F.sum("rows"), F.sum("size"))
    for cell, n, b in cells.collect():  # one row for a cell
        rows[cell], size[cell] = n, b
    return rows, size


def find_splitters(keys: DataFrame, shards: int, tolerance: float = TOLERANCE) -> tuple[list[bytes], list[int], np.ndarray]:
    """(probes, splitters, rows): sorted candidate keys, for each of the shards - 1 cuts
    the number of probes up to it, and the exact rows in each cell.

    Each round draws candidates in the cells that hold an unmet target and counts rows
    and bytes below all of them over all partitions. A cell of one row can't be refined.
    """
    spark = keys.sparkSession
    n, total = keys.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    targets = [total * j / shards for j in range(1, shards)]
    slack = tolerance * total / shards
    probes: list[bytes] = []
    want = max(FIRST_PROBES, min(n // ROWS_A_CELL, 100_000))
    odds = np.array([min(1.0, want / max(n, 1))])
    for turn in range(64):
        draw = keys.withColumn("draw", F.xxhash64("hash", "id", "row", F.lit(turn)))
        names = spark.sparkContext.broadcast(_padded(probes)), spark.sparkContext.broadcast(odds)
        drawn = draw.mapInArrow(_candidates(*names), "key binary").distinct()
        probes = sorted({*probes, *(bytes(r[0]) for r in drawn.collect())})  # bounded by the odds
        rows, size = _count(keys, probes)
        below = np.concatenate([[0], np.cumsum(size)])
        cuts, odds = [], np.zeros(len(probes) + 1)
        for target in targets:
            cell = min(int(np.searchsorted(below, target, "left")), len(below) - 1)
            cell = max(cell, 1)  # below[cell - 1] < target <= below[cell]
            near = cell if below[cell] - target <= target - below[cell - 1] else cell - 1
            cuts.append(min(near, len(probes)))
            if abs(below[near] - target) > slack and rows[cell - 1] > 1:
                odds[cell - 1] = min(1.0, PROBES / rows[cell - 1])
        if not odds.any():
            break
    return probes, cuts, rows


def _deal(probes, shard_of, before):
    def run(batches):
        at = probes.value
        for batch in batches:
            cell = np.searchsorted(at, _keys(batch), "left")
            columns = {c: batch.column(c) for c in ("doc_id", "size", "text_crc32", "hash", "id", "row")}
            columns |= {"cell": pa.array(cell, pa.int64()), "shard": pa.array(shard_of.value[cell], pa.int32()), "before": pa.array(before.value[cell], pa.int64())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def shard_documents(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot for every document (doc_id, text).

    A shard is a range of keys (hash of the text, doc_id, row), so copies of a text lie
    together and yet split where the bytes ask for it. Sizes are UTF-8 bytes plus 16; a
    null text has no bytes and the checksum of the empty text; texts are counted whole. Slots count from 0 in key
    order. Null doc_ids sort first; repeated rows get slots of their own; extra columns
    are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keys = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("hash"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("id"),
        F.monotonically_increasing_id().alias("row"),
    )
    keys = materialize(keys)  # row numbers stay, and rounds don't read the texts
    probes, cuts, rows = find_splitters(keys, shards, tolerance)
    shard_of = np.searchsorted(np.array(cuts), np.arange(len(rows)), "right").astype(np.int32)
    first = np.concatenate([[0], np.cumsum(rows)[:-1]])
    start = np.array([rows[shard_of < s].sum() for s in range(shards)])
    share = [spark.sparkContext.broadcast(x) for x in (_padded(probes), shard_of, first - start[shard_of])]
    dealt = keys.mapInArrow(_deal(*share), "doc_id long, size long, text_crc32 long, hash long, id long, row long, cell long, shard int, before long")
    rank = F.expr("row_number() over (partition by cell order by hash, id, row)")
    return dealt.select("doc_id", "size", "text_crc32", "shard", (F.col("before") + rank - 1).alias("slot"))
