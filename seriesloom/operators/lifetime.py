"""Remaining useful life: targets, official values and the preview of samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import capped
from .windows import emission_counts, emission_places


def train_life(obs: DataFrame, key: list[str], cycle: str = "cycle") -> DataFrame:
    """rul: the unit's last cycle less the row's."""
    return obs.withColumn("rul", F.max(cycle).over(Window.partitionBy(*key)) - F.col(cycle))


def test_life(obs: DataFrame, official: DataFrame, key: list[str], cycle: str = "cycle") -> DataFrame:
    """rul of units that were cut off: the official value is added to the cycles left."""
    left = train_life(obs, key, cycle)
    return left.join(official.select(*key, F.col("rul").alias("official")), key).withColumn("rul", F.col("rul") + F.col("official")).drop("official")


def unmatched(obs: DataFrame, official: DataFrame, key: list[str]) -> DataFrame:
    """Units without an official value and official values without a unit."""
    a, b = obs.select(*key).distinct(), official.select(*key).distinct()
    return a.join(b, key, "left_anti").withColumn("missing", F.lit("official")).unionByName(b.join(a, key, "left_anti").withColumn("missing", F.lit("unit")))


def preview(obs: DataFrame, group: list[str], unit: str, window: int, stride: int, least: int | None, cap: float | None = None, keep_last: bool = True) -> DataFrame:
    """Counts and ranges of the samples that rolling windows would give, by group and in
    total (null group), without cutting a window. obs: (group, unit, pos, rul)."""
    order = [*group, unit]
    lengths = obs.groupBy(*order).agg(F.count("*").cast("int").alias("n"))
    dropped, added = emission_counts(F.col("n"), stride, least, keep_last)
    lengths = lengths.select(*order, "n", dropped.alias("dropped"), added.alias("added"), F.size(emission_places(F.col("n"), stride, least, keep_last)).alias("windows"))
    per_unit = lengths.rollup(*group).agg(F.count("*").alias("n_units"), F.sum("windows").alias("n_windows"), F.sum("dropped").alias("n_dropped"), F.sum("added").alias("n_last_added"), F.min("n").alias("cycles_min"), F.percentile("n", F.lit(0.5)).alias("cycles_median"), F.max("n").alias("cycles_max"))
    emitted = lengths.select(*order, F.explode(emission_places(F.col("n"), stride, least, keep_last)).alias("pos"))
    rows = emitted.join(obs.select(*order, "pos", "rul"), [*order, "pos"])
    life = capped(F.col("rul"), cap)
    real = F.least(F.col("pos") + 1, F.lit(window))
    per_window = rows.rollup(*group).agg(F.min(life).alias("rul_min"), F.percentile(life, F.lit(0.5)).alias("rul_median"), F.max(life).alias("rul_max"), F.count_if(real == window).alias("n_full"), F.count_if(real < window).alias("n_padded"), (F.sum(real) / (F.count("*") * window)).alias("valid_share"))
    same = F.lit(True)
    for g in group:
        same = same & F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}"))
    return per_unit.alias("a").join(per_window.alias("b"), same).select("a.*", *(f"b.{c}" for c in per_window.columns if c not in group))
