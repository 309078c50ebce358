"""Exact quantiles of groups in bounded memory.

A first pass finds, with a sketch of fixed size, a bracket around each quantile's rank; a
second one counts what lies below the bracket and the distinct values inside. No buffer grows
with a group's rows or distinct values, and the result is the exact, interpolated one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .places import join_same

ACCURACY = 10_000  # a sketch's ranks are right to a share of 1 / ACCURACY
SMALL = 4 * ACCURACY


def exact_quantiles(df: DataFrame, by: list[str], value: Column, shares: list[float]) -> DataFrame:
    """by, n (values that aren't null) and q: the quantiles at the shares, linear between
    neighbouring ranks. Groups without values have none; nulls in `by` are a group."""
    rows = df.select(*by, value.cast("double").alias("_v"))
    ends = [min(1.0, max(0.0, s + side * 3 / ACCURACY)) for s in shares for side in (-1, 1)]
    sketch = rows.groupBy(*by).agg(F.count("_v").alias("n"), F.percentile_approx("_v", F.array(*map(F.lit, ends)), ACCURACY).alias("_e"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    brackets = []
    for i, s in enumerate(shares):
        rank = (F.col("n") - 1) * F.lit(float(s))
        # ends are off by a share of 1 / ACCURACY and by two ranks; small groups need no bracket
        few = F.col("n") < SMALL
        low = F.col("_low") if ends[2 * i] == 0 else F.when(few, F.col("_low")).otherwise(F.col("_e")[2 * i])
        high = F.col("_high") if ends[2 * i + 1] == 1 else F.when(few, F.col("_high")).otherwise(F.col("_e")[2 * i + 1])
        brackets.append(F.struct(F.lit(i).alias("i"), low.alias("low"), high.alias("high"), F.floor(rank).alias("r0"), F.ceil(rank).alias("r1"), (rank - F.floor(rank)).alias("part")))
    placed = sketch.select(*by, "n", F.array(*brackets).alias("_b"))
    some = rows.where("_v is not null")
    both = join_same(some, placed, by) if by else some.crossJoin(placed)  # one row
    near = both.select(*by, "n", F.explode(F.filter("_b", lambda b: F.col("_v") <= b["high"])).alias("_b"), "_v")
    inside = near.select(*by, "n", "_b", F.when(F.col("_v") >= F.col("_b.low"), F.col("_v")).alias("_x"))
    counts = inside.groupBy(*by, "n", "_b", "_x").agg(F.count("*").alias("_k"))
    # null, which is below the bracket, comes first
    upto = F.sum("_k").over(Window.partitionBy(*by, "_b.i").orderBy(F.asc_nulls_first("_x")).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumn("_upto", upto)
    at = lambda r: F.min_by(F.struct("_x"), F.when(F.col("_upto") > F.col(f"_b.{r}"), F.col("_upto")))["_x"]
    found = ranked.groupBy(*by, "n", "_b").agg(at("r0").alias("_x0"), at("r1").alias("_x1"))
    off = F.col("_x0").isNull() | F.col("_x1").isNull()
    exact = F.when(off, F.raise_error(F.lit("a rank lies outside of its bracket"))).otherwise(F.col("_x0") + (F.col("_x1") - F.col("_x0")) * F.col("_b.part"))
    per = found.select(*by, "n", F.struct(F.col("_b.i").alias("i"), exact.alias("x")).alias("_q"))
    q = F.transform(F.sort_array(F.collect_list("_q")), lambda s: s["x"])  # a value for each share
    return per.groupBy(*by, "n").agg(q.alias("q"))
