"""Places in trajectories of any length.

Rows are dealt by ranges of (trajectory, order), so a long trajectory lies in many
partitions of like size. Each partition numbers its rows by itself; what is joined is one
row for each partition that goes on with a trajectory: the rows before it. Steps that need a
row's neighbours work within (trajectory, part) and take what the neighbouring part ends or
begins with from such a table too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def join_same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Joined on equal keys, where nulls are equal."""
    renamed = right.withColumnsRenamed({k: f"_{k}_" for k in keys})
    return left.join(renamed, [F.col(k).eqNullSafe(F.col(f"_{k}_")) for k in keys], how).drop(*(f"_{k}_" for k in keys))


def _same_as_before(batch: pa.RecordBatch, keys: list[str], last: list | None) -> np.ndarray:
    """Whether each row has the key of the row before it; `last` is that of the first one."""
    same = np.ones(batch.num_rows, bool)
    for k, name in enumerate(keys):
        column = batch.column(name)
        if isinstance(column.type, pa.DataType) and pa.types.is_nested(column.type):
            raise TypeError(f"{name}: keys are plain values")
        a, b = column[1:], column[:-1]
        equal = pc.fill_null(pc.equal(a, b), False)
        both = pc.and_(pc.is_null(a), pc.is_null(b))
        same[1:] &= pc.or_(equal, both).to_numpy(zero_copy_only=False)
        same[0] &= last is not None and column[0].as_py() == last[k]
    return same


def place_rows(obs: DataFrame, key: list[str], order: list[str], folder: str, partitions: int | None = None) -> DataFrame:
    """obs with pos (from 0 in its trajectory, by `order`), n_rows (of the trajectory) and
    part (the range partition); the last order column should be unique.

    The rows are written to `folder`, a new one that all executors share, as ranges are drawn
    anew whenever they are computed. No task holds more than a range of rows, whatever the
    trajectories' lengths.
    """
    spark = obs.sparkSession
    by = [*key, *order]
    ranges = (obs.repartitionByRange(partitions, *by) if partitions else obs.repartitionByRange(*by)).sortWithinPartitions(*by)
    columns = obs.columns

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, run = TaskContext.get().partitionId(), None, -1
        for batch in batches:
            if not batch.num_rows:
                continue
            same = _same_as_before(batch, key, last)
            at = np.arange(batch.num_rows)
            start = np.maximum.accumulate(np.where(same, -1, at))
            place = np.where(start < 0, run + 1 + at, at - start)
            run, last = int(place[-1]), [batch.column(c)[-1].as_py() for c in key]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place, pa.int64()), pa.array(np.full(batch.num_rows, part), pa.int32())], names=[*columns, "pos", "part"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranges.schema)
    ranges.mapInArrow(number, f"{fields}, pos long, part int").write.parquet(folder)
    rows = spark.read.parquet(folder)
    counts = rows.groupBy(*key, "part").agg(F.count("*").alias("n"))
    window = Window.partitionBy(*key)
    # of the trajectories only those in more than one part have rows before one; these are
    # at most as many as there are parts
    before = counts.select(*key, "part", (F.sum("n").over(window.orderBy("part")) - F.col("n")).alias("before")).where("before > 0")
    lengths = rows.groupBy(*key).agg(F.count("*").alias("n_rows"))
    out = join_same(join_same(rows, F.broadcast(before), [*key, "part"], "left"), lengths, key)
    return out.select(*columns, (F.col("pos") + F.coalesce("before", F.lit(0))).alias("pos"), "n_rows", "part")


def _parts(placed: DataFrame, key: list[str], **ends: Column) -> DataFrame:
    return placed.groupBy(*key, "part").agg(*(c.alias(n) for n, c in ends.items()))


def row_before(placed: DataFrame, key: list[str], column: str, name: str) -> DataFrame:
    """With the value of `column` in the row before, null in a trajectory's first row."""
    last = _parts(placed, key, end=F.max_by(F.struct(F.col(column).alias("v")), "pos"))
    carry = last.select(*key, "part", F.lag("end").over(Window.partitionBy(*key).orderBy("part")).alias("carry"))
    near = F.lag(F.struct(F.col(column).alias("v"))).over(Window.partitionBy(*key, "part").orderBy("pos"))
    both = join_same(placed.withColumn("_near", near), carry.where("carry is not null"), [*key, "part"], "left")
    return both.select(*placed.columns, F.coalesce("_near", "carry")["v"].alias(name))


def interpolate_placed(placed: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Missing values by the line between their neighbours in row order, as `interpolate`
    does, a part at a time: the nearest values outside of a part come from the other parts."""
    known = {c: F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"), F.col("pos").alias("p"))) for c in columns}
    ends = {f"_{c}_last": F.max_by(k, F.when(F.col(c).isNotNull(), F.col("pos"))) for c, k in known.items()} | {f"_{c}_first": F.min_by(k, F.when(F.col(c).isNotNull(), F.col("pos"))) for c, k in known.items()}
    parts = _parts(placed, key, **ends)
    earlier = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*key).orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    carry = parts.select(*key, "part", *(F.last(f"_{c}_last", True).over(earlier).alias(f"_{c}_0") for c in columns), *(F.last(f"_{c}_first", True).over(later).alias(f"_{c}_1") for c in columns))
    before = Window.partitionBy(*key, "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*key, "part").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.withColumns({f"_{c}_2": F.last(k, True).over(before) for c, k in known.items()})
    out = join_same(out.withColumns({f"_{c}_3": F.last(k, True).over(after) for c, k in known.items()}), carry, [*key, "part"])
    filled = []
    for c in columns:
        a, b = F.coalesce(f"_{c}_2", f"_{c}_0"), F.coalesce(f"_{c}_3", f"_{c}_1")
        line = a["v"] + F.try_divide((b["v"] - a["v"]) * (F.col("pos") - a["p"]), b["p"] - a["p"])
        filled.append(F.coalesce(F.col(c), line, a["v"], b["v"]).alias(f"{c}_filled"))
    return out.select(*placed.columns, *filled)
