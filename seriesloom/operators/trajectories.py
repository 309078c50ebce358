"""Trajectories: order, cleaning, splits and leakage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import slug, stable_rank_key, trajectory_id
from .audit import window_counts
from .places import join_same


def ordered(obs: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """pos: place of a row in its trajectory, from 0; the last order column is unique."""
    return obs.withColumn("pos", F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1)


def drop_sparse(obs: DataFrame, key: list[str], limit: float = 0.3) -> DataFrame:
    """Without the trajectories of which some channel misses more than `limit`."""
    missing = obs.select(*key, F.posexplode("x").alias("channel", "value")).groupBy(*key, "channel").agg(F.avg(F.col("value").isNull().cast("int")).alias("m"))
    bad = missing.where(F.col("m") > limit).select(*key).distinct()
    return obs.join(bad, key, "left_anti")


def interpolate(obs: DataFrame, key: list[str], columns: list[str], order: str = "pos") -> DataFrame:
    """Missing values by the line between their neighbours in row order.

    At the ends the nearest value is taken; a trajectory without values stays missing.
    """
    # running frames in both directions: one pass each, however long a trajectory is
    before = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*key).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    known = {c: F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"), F.col(order).alias("p"))) for c in columns}
    out = obs.withColumns({f"_{c}_0": F.last(k, ignorenulls=True).over(before) for c, k in known.items()})
    out = out.withColumns({f"_{c}_1": F.last(k, ignorenulls=True).over(after) for c, k in known.items()})
    filled = {}
    for c in columns:
        v0, p0, v1, p1 = (F.col(f"_{c}_{side}.{part}") for side in "01" for part in "vp")
        line = v0 + F.try_divide((v1 - v0) * (F.col(order) - p0), p1 - p0)
        filled[f"{c}_filled"] = F.coalesce(F.col(c), line, v0, v1)
    return out.withColumns(filled).drop(*(f"_{c}_{side}" for c in columns for side in "01"))


def hold_out(units: DataFrame, key: list[str], share: float, seed: int, by: list[str] | None = None) -> DataFrame:
    """held: whether a unit is of the share held out (at least one of each group).

    Units are ranked by a hash of seed, group and key, so the choice is the same on every
    run and whatever the partitions; the count rounds half to even.
    """
    by = by or []
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    rank = F.row_number().over(group.orderBy(stable_rank_key(seed, *map(F.col, by), *map(F.col, key)), *key))
    most = F.greatest(F.lit(1), F.bround(F.count("*").over(group) * F.lit(share)))
    return units.withColumn("held", rank <= most)


def with_validation(rows: DataFrame, share: float = 0.10, seed: int = 42, subset: str | None = None) -> DataFrame:
    """Rows (dataset, split, unit, ...) where every dataset with training rows has a val split.

    A dataset without one gives a share of its training units, at least one, to val (units of
    two subsets are two units, if `subset` names their column); datasets that have one, or
    no training rows, stay. trajectory_id is made anew from the new split where the rows
    have one.
    """
    by = ["dataset", *([subset] if subset else [])]
    lacking = rows.groupBy("dataset").agg((~F.bool_or(F.col("split") == "val")).alias("lacks")).where("lacks").select("dataset")
    units = rows.where("split = 'train'").join(lacking, "dataset", "left_semi").select(*by, "unit").distinct()
    held = hold_out(units, [*by, "unit"], share, seed, ["dataset"]).where("held").withColumn("_held", F.lit(True))
    out = join_same(rows, held.drop("held"), [*by, "unit"], "left")
    split = F.when((F.col("split") == "train") & F.col("_held"), "val").otherwise(F.col("split"))
    out = out.withColumn("split", split).drop("_held")
    if "trajectory_id" in rows.columns:
        kinds = dict(rows.dtypes)
        part = slug(F.col(subset), kinds[subset]) if subset else F.lit("none")
        out = out.withColumn("trajectory_id", trajectory_id(F.col("dataset"), part, F.col("split"), slug(F.col("unit"), kinds["unit"])))
    return out.select(*rows.columns)


def split_patches(obs: DataFrame, window: int, stride: int, patch: int, policy: str = "pad") -> DataFrame:
    """Per dataset and split: rows, units, windows and valid patches, from the units'
    lengths alone."""
    lengths = obs.groupBy("dataset", "split", "unit").agg(F.count("*").alias("n"))
    counts = window_counts(F.col("n"), window, stride, patch, policy)
    return lengths.groupBy("dataset", "split").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_units"), F.sum(counts["n_windows"]).alias("n_windows"), F.sum(counts["valid_patches"]).alias("n_valid_patches"))


def sample_units(units: DataFrame, key: list[str], most: int, seed: int) -> DataFrame:
    """At most `most` units, by rank of their hash."""
    return units.orderBy(stable_rank_key(seed, *map(F.col, key)), *key).limit(most)


def split_overlap(ids: DataFrame, key: str = "trajectory_id") -> DataFrame:
    """How many keys two splits share, for every pair of splits (n = 0 where none)."""
    distinct = ids.select("split", key).distinct()
    splits = distinct.select("split").distinct()  # a handful
    pairs = splits.alias("a").join(splits.alias("b"), F.expr("a.split < b.split")).select(F.col("a.split").alias("split_a"), F.col("b.split").alias("split_b"))
    both = distinct.select(F.col("split").alias("split_a"), key).join(distinct.select(F.col("split").alias("split_b"), key), key).where("split_a < split_b")
    return pairs.join(both.groupBy("split_a", "split_b").agg(F.count("*").alias("n_shared")), ["split_a", "split_b"], "left").withColumn("n_shared", F.coalesce("n_shared", F.lit(0)))


def representative(units: DataFrame, by: list[str], length: str = "n") -> DataFrame:
    """The unit of each group whose length is nearest the median."""
    middle = units.groupBy(*by).agg(F.percentile(length, F.lit(0.5)).alias("middle"))
    near = units.join(middle, by).withColumn("off", F.abs(F.col(length) - F.col("middle")))
    return near.groupBy(*by).agg(F.min_by("unit", F.struct("off", "unit")).alias("unit"))


def checks(**named: tuple[Column, Column]) -> list[Column]:
    """Structs (name, observed, expected, passed) of checks, to be exploded."""
    return [F.struct(F.lit(k).alias("name"), o.cast("string").alias("observed"), e.cast("string").alias("expected"), o.eqNullSafe(e).alias("passed")) for k, (o, e) in named.items()]


def check_table(totals: DataFrame, **named: tuple[Column, Column]) -> DataFrame:
    """One row for each check over a table of one row."""
    return totals.select(F.inline(F.array(*checks(**named))))


def split_statistics(samples: DataFrame) -> DataFrame:
    """Per dataset and split: samples, units and the range of the target."""
    return samples.groupBy("dataset", "split").agg(
        F.count("*").alias("n_samples"), F.count_distinct("unit").alias("n_units"), F.min("target").alias("target_min"), F.max("target").alias("target_max")
    )


def unit_lengths(obs: DataFrame) -> DataFrame:
    """Per dataset and split: the units' lengths in order of the units, as a list."""
    per = obs.groupBy("dataset", "split", "unit").agg(F.count("*").alias("n"))
    units = F.sort_array(F.collect_list(F.struct("unit", "n")))  # two numbers for each unit
    return per.groupBy("dataset", "split").agg(F.sum("n").alias("n_rows"), units.alias("u")).select("dataset", "split", "n_rows", F.transform("u", lambda x: x["n"]).alias("lengths"))


def join_splits(**splits: DataFrame) -> DataFrame:
    """One table of several splits, each row with its split's name; missing columns are null."""
    named = [table.withColumn("split", F.lit(name)) for name, table in splits.items()]
    out = named[0]
    for table in named[1:]:
        out = out.unionByName(table, allowMissingColumns=True)
    return out
