"""Averages of client parameters in long tables (client, param, idx, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def client_weights(metrics: DataFrame, plan: DataFrame, policy: str = "final_client_weight") -> DataFrame:
    """client, w: by the plan's weight, alike, or by steps times channel batch."""
    clients = metrics.groupBy("client").agg(F.sum(F.col("steps") * F.greatest(F.lit(1), F.col("effective_bc"))).alias("work"))
    if policy == "uniform":
        return clients.select("client", F.lit(1.0).alias("w"))
    if policy == "work":
        return clients.select("client", F.col("work").cast("double").alias("w"))
    planned = plan.groupBy("client").agg(F.max("final_client_weight").alias("w"))
    return clients.join(planned, "client", "left").select("client", F.coalesce("w", F.lit(0.0)).alias("w"))


def mean_state(states: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted mean of every parameter value over the clients."""
    w = states.join(weights, "client")
    return w.groupBy("param", "idx").agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("value"))


def state_faults(states: DataFrame, weights: DataFrame) -> DataFrame:
    """What forbids a mean: parameters that some client lacks, shapes that differ,
    negative weights, or weights that add up to nothing."""
    sizes = states.groupBy("client", "param").agg(F.count("*").alias("n"))
    n_clients = weights.agg(F.count("*").alias("k"))
    shapes = sizes.groupBy("param").agg(F.count("*").alias("c"), F.min("n").alias("low"), F.max("n").alias("high")).crossJoin(n_clients)
    rules = F.array_compact(F.array(F.when(F.col("c") < F.col("k"), F.lit("missing")), F.when(F.col("low") != F.col("high"), F.lit("shape"))))
    found = shapes.select("param", F.explode(rules).alias("fault"))
    bad = weights.where("w < 0").select(F.col("client").alias("param"), F.lit("negative weight").alias("fault"))
    none = weights.agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("s")).where("s <= 0").select(F.lit("weights").alias("param"), F.lit("zero sum").alias("fault"))
    return found.unionByName(bad).unionByName(none)


def delta(new: DataFrame, old: DataFrame) -> DataFrame:
    joined = new.select("param", "idx", F.col("value").alias("a")).join(old.select("param", "idx", F.col("value").alias("b")), ["param", "idx"])
    return joined.select("param", "idx", (F.col("a") - F.col("b")).alias("value"))


def norm(state: DataFrame, *by: str) -> DataFrame:
    return state.groupBy(*by).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("l2"))


def drift(states: DataFrame, center: DataFrame) -> DataFrame:
    """Distance of each client's parameters from the common ones."""
    d = states.join(center.select("param", "idx", F.col("value").alias("c")), ["param", "idx"])
    return d.groupBy("client").agg(F.sqrt(F.sum((F.col("value") - F.col("c")) ** 2)).alias("l2"))


def momentum(state: DataFrame, velocity: DataFrame | None, change: DataFrame, beta: float, nesterov: bool = False) -> DataFrame:
    """param, idx, value and velocity after a server step: v = beta * v + d, then the
    state grows by v, or with Nesterov's rule by d + beta * v."""
    if not 0 <= beta <= 1:
        raise ValueError("beta must lie in [0, 1]")
    key = ["param", "idx"]
    d = change.select(*key, F.col("value").alias("d"))
    out = state.join(d, key, "left").withColumn("d", F.coalesce("d", F.lit(0.0)))
    if velocity is None:
        out = out.withColumn("v0", F.lit(0.0))
    else:
        out = out.join(velocity.select(*key, F.col("velocity").alias("v0")), key, "left").withColumn("v0", F.coalesce("v0", F.lit(0.0)))
    v = F.col("v0") * beta + F.col("d")
    step = F.col("d") + v * beta if nesterov else v
    return out.select(*key, (F.col("value") + step).alias("value"), v.alias("velocity"))


def round_summary(rounds: DataFrame, communication: Column) -> DataFrame:
    """Per round: the weighted mean of finite losses, mean and deviation of the clients'
    norms, and the communication so far. rounds: (round, client, w, loss, norm, ...)."""
    good = F.col("loss").isNotNull() & ~F.isnan("loss")
    w = F.when(good, F.col("w"))
    per = rounds.groupBy("round").agg(
        F.count("*").alias("n_clients"),
        F.when(F.sum(w) > 0, F.sum(F.when(good, F.col("w") * F.col("loss"))) / F.sum(w)).alias("loss"),
        F.avg("norm").alias("norm_mean"),
        F.stddev_pop("norm").alias("norm_std"),
        F.max(communication).alias("mb"),
    )
    so_far = Window.orderBy("round").rowsBetween(Window.unboundedPreceding, 0)  # one row a round
    return per.withColumn("mb_total", F.sum("mb").over(so_far))
