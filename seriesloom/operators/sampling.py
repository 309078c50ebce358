"""Sampling plans over datasets and clients, and batches drawn by them.

Capping with redistribution has a closed form: with rows sorted by cap / weight, all rows
before the first that a common factor doesn't lift over its cap get their cap, the
others are scaled by the factor. Two running sums give it, so no iteration is needed.
Plan tables have one row for each dataset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import stable_rank_key

_EPS = 1e-12


def cap_weights(table: DataFrame, weight: str, cap: Column, key: str, by: list[str] | None = None, total: Column | None = None, out: str = "capped") -> DataFrame:
    """Weights of each group scaled to `total` (1) with none above its cap.

    If the caps don't sum up to the total, the weights are equal. Rows of weight 0 get
    nothing unless all others are at their caps: then they share what is left equally.
    Where all weights are 0 they stay so.
    """
    group = [F.col(c) for c in by] if by else [F.lit(1)]
    whole = total if total is not None else F.lit(1.0)
    everything = Window.partitionBy(*group)
    ratio = F.coalesce(F.try_divide(F.col("_cap"), F.col(weight)), F.lit(float("inf")))
    t = table.withColumn("_cap", cap).withColumn("_total", whole).withColumn("_ratio", ratio)
    # running sums from both ends
    t = t.withColumn("_before", F.sum("_cap").over(everything.orderBy("_ratio", key).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_cap"))
    t = t.withColumn("_rest", F.sum(weight).over(everything.orderBy(F.desc("_ratio"), F.desc(key)).rowsBetween(Window.unboundedPreceding, 0)))
    t = t.withColumn("_factor", F.try_divide(F.col("_total") - F.col("_before"), F.col("_rest")))
    free = (F.col(weight) > 0) & (F.col("_factor") * F.col(weight) <= F.col("_cap") + _EPS)
    t = t.withColumn("_first", F.min(F.when(free, F.struct(F.col("_ratio").alias("r"), F.col(key).alias("k"), F.col("_factor").alias("f")))).over(everything))
    n, room, sums = F.count("*").over(everything), F.sum("_cap").over(everything), F.sum(weight).over(everything)
    idle = F.col(weight) <= 0
    left = F.col("_total") - F.sum(F.when(~idle, F.col("_cap"))).over(everything)
    share = F.least(F.col("_cap"), F.greatest(left, F.lit(0.0)) / F.count_if(idle).over(everything))
    scaled = F.least(F.col("_cap"), F.col("_first.f") * F.col(weight))
    value = F.when(room < F.col("_total") - _EPS, F.col("_total") / n).when(sums <= 0, 0.0)
    value = value.when(idle, F.when(F.col("_first").isNull(), share).otherwise(0.0)).otherwise(F.coalesce(scaled, F.col("_cap")))
    return t.withColumn(out, value).drop("_cap", "_total", "_ratio", "_before", "_rest", "_factor", "_first")


def floor_weights(table: DataFrame, weight: str, floor: float, key: str, by: list[str] | None = None, out: str = "floored") -> DataFrame:
    """Weights of each group summing to 1 with none below the floor; the others shrink.

    Where all weights are 0 they stay so.
    """
    group = [F.col(c) for c in by] if by else [F.lit(1)]
    everything = Window.partitionBy(*group)
    order = everything.orderBy(F.col(weight), key)
    n_before = F.row_number().over(order) - 1
    rest = F.sum(weight).over(everything.orderBy(F.desc(weight), F.desc(key)).rowsBetween(Window.unboundedPreceding, 0))
    t = table.withColumn("_factor", F.try_divide(1.0 - n_before * floor, rest))
    free = F.col("_factor") * F.col(weight) >= floor - _EPS
    t = t.withColumn("_first", F.min(F.when(free, F.struct(F.col(weight).alias("w"), F.col(key).alias("k"), F.col("_factor").alias("f")))).over(everything))
    n = F.count("*").over(everything)
    value = F.when(F.sum(weight).over(everything) <= 0, 0.0).when(F.lit(floor) * n > 1, 1.0 / n).otherwise(F.greatest(F.lit(floor), F.coalesce(F.col("_first.f") * F.col(weight), F.lit(floor))))
    return t.withColumn(out, value).drop("_factor", "_first")


def normalized(table: DataFrame, weight: str, by: list[str] | None = None, out: str = "share") -> DataFrame:
    """Weights over their group's sum; equal ones where that is zero."""
    everything = Window.partitionBy(*([F.col(c) for c in by] if by else [F.lit(1)]))
    total = F.sum(weight).over(everything)
    return table.withColumn(out, F.when(total > 0, F.col(weight) / total).otherwise(1.0 / F.count("*").over(everything)))


def sampling_plan(datasets: DataFrame, cap_dataset: float = 0.10, cap_client: float = 0.25, min_client: float = 0.005, min_dataset: float = 0.0, steps: int | None = None) -> DataFrame:
    """Weights of datasets (dataset, client, patches): raw, capped and final, and flags.

    Raw shares are capped for each dataset, then the clients' sums for each client (at most
    its datasets can hold), then lifted to the client floor; each client's weight goes to
    its datasets by their capped weights under the cap, and a dataset floor comes last.
    """
    plan = normalized(datasets, "patches", out="raw_dataset_weight")
    plan = cap_weights(plan, "raw_dataset_weight", F.lit(cap_dataset), "dataset", out="capped_dataset_weight")
    clients = plan.groupBy("client").agg(F.sum("capped_dataset_weight").alias("w"), F.count("*").alias("k"), F.sum("raw_dataset_weight").alias("raw_client_weight"))
    clients = cap_weights(clients, "w", F.least(F.lit(cap_client), F.lit(cap_dataset) * F.col("k")), "client", out="capped_client")
    clients = floor_weights(clients, "capped_client", min_client, "client", out="client_target")
    flags = [(F.col("capped_client") < F.col("w") - 1e-9).alias("client_capped"), (F.col("client_target") > F.col("capped_client") + 1e-9).alias("client_lifted")]
    plan = plan.join(clients.select("client", "raw_client_weight", "client_target", *flags), "client")
    plan = cap_weights(plan, "capped_dataset_weight", F.lit(cap_dataset), "dataset", ["client"], F.col("client_target"), out="_final")
    plan = normalized(plan, "_final", out="_share")
    if min_dataset:
        plan = floor_weights(plan, "_share", min_dataset, "dataset", out="final_dataset_weight")
    else:
        plan = plan.withColumn("final_dataset_weight", F.col("_share"))
    client_sum = F.sum("final_dataset_weight").over(Window.partitionBy("client"))
    expected = F.col("final_dataset_weight") * steps if steps else F.lit(None).cast("double")
    return plan.select(
        "dataset", "client", "patches", "raw_dataset_weight", "capped_dataset_weight", "final_dataset_weight", "raw_client_weight",
        client_sum.alias("final_client_weight"), expected.alias("expected_batches"),
        (F.col("capped_dataset_weight") < F.col("raw_dataset_weight") - 1e-9).alias("dataset_capped"),
        (F.col("final_dataset_weight") > F.col("_share") + 1e-9).alias("dataset_lifted"), "client_capped", "client_lifted",
    )


def number_batches(samples: DataFrame, by: list[str], key: str, size: Column, seed: int | None = None, drop_last: bool = True) -> DataFrame:
    """batch: samples of each group in batches of `size`, shuffled by hash if seeded."""
    order = [stable_rank_key(seed, F.col(key)), F.col(key)] if seed is not None else [F.col(key)]
    group = Window.partitionBy(*by)
    rank = F.row_number().over(group.orderBy(*order)) - 1
    out = samples.withColumn("batch", F.floor(rank / size)).withColumn("_n", F.count("*").over(group))
    if drop_last:
        out = out.where((F.col("batch") + 1) * size <= F.col("_n"))
    return out.drop("_n")


CELLS = 1024  # of the weights' line, for the join of steps and datasets


def draw_schedule(plan: DataFrame, steps: DataFrame, weight: str = "share", strategy: str = "weighted", seed: int = 0) -> DataFrame:
    """dataset of each step: by weight, each alike, or in turn. The plan is small."""
    n = F.count("*").over(Window.partitionBy(F.lit(1)))
    order = Window.partitionBy(F.lit(1)).orderBy("dataset")
    w = F.col(weight) if strategy == "weighted" else F.lit(1.0) / n
    upper = F.sum(w).over(order.rowsBetween(Window.unboundedPreceding, 0))
    ranked = plan.select("dataset", (F.row_number().over(order) - 1).alias("i"), n.alias("n"), upper.alias("upper"), (upper - w).alias("lower"))
    if strategy == "round_robin":
        sized = steps.crossJoin(plan.agg(F.greatest(F.lit(1), F.count("*")).alias("_n")))  # one row
        return sized.select("step", F.pmod(F.col("step"), F.col("_n")).alias("i")).join(ranked.select(F.col("i").cast("long").alias("i"), "dataset"), "i").select("step", "dataset")
    u = F.conv(F.substring(stable_rank_key(seed, F.col("step")), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    # a dataset lies in all cells that its interval touches, so the join is on equal cells
    last = F.col("i") == F.col("n") - 1
    cell = lambda c: F.least(F.lit(CELLS - 1), F.floor(c * CELLS))
    ends = F.sequence(cell(F.col("lower")), F.when(last, F.lit(CELLS - 1).cast("long")).otherwise(cell(F.col("upper"))))
    spread = ranked.select("dataset", "lower", F.when(last, F.greatest(F.col("upper"), F.lit(1.0))).otherwise(F.col("upper")).alias("upper"), F.explode(ends).alias("cell"))
    found = steps.withColumn("u", u).withColumn("cell", cell(F.col("u"))).join(spread, "cell")
    return found.where("u >= lower and u < upper").select("step", "dataset")


CHUNK = 1 << 20
# Primes under 2**31, which no number of batches is a multiple of.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579, 2147483563, 2147483549)


def count_up(rows: DataFrame, by: str, at: str, chunk: int = CHUNK) -> DataFrame:
    """nth: how many rows of the group come before, in the order of the whole number `at`.

    Groups are counted in chunks of `at`, whose sizes are bounded as `at` is unique in a
    group; what is added is one row for each group and chunk.
    """
    cut = rows.withColumn("_chunk", F.floor(F.col(at) / chunk))
    counts = cut.groupBy(by, "_chunk").agg(F.count("*").alias("_n"))
    before = counts.select(by, "_chunk", (F.sum("_n").over(Window.partitionBy(by).orderBy("_chunk")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(by, "_chunk").orderBy(at)) - 1
    return cut.withColumn("_inside", inside).join(before, [by, "_chunk"]).withColumn("nth", F.col("_before") + F.col("_inside")).drop("_chunk", "_before", "_inside")


def draw_batches(plan: DataFrame, batches: DataFrame, steps: DataFrame, weight: str = "share", strategy: str = "weighted", seed: int = 0) -> DataFrame:
    """step, dataset, opening and batch: which batch (from 0) of the drawn dataset a step gets.

    `batches` (dataset, n_batches) says how many there are; `steps` has whole numbers `step`.
    A dataset gives each of its batches once, in an order that the seed and the opening
    decide, and is then opened again. Datasets without a batch are never drawn; the others'
    weights count in proportion. The k-th draw of a dataset is arithmetic: no state is kept,
    and no order of all batches is made.
    """
    there = plan.join(batches.where("n_batches > 0").select("dataset", "n_batches"), "dataset")
    if strategy == "weighted":
        total = F.sum(weight).over(Window.partitionBy(F.lit(1)))  # a row for each dataset
        there = there.withColumn(weight, F.col(weight) / total)
    drawn = count_up(draw_schedule(there.drop("n_batches"), steps, weight, strategy, seed), "dataset", "step")
    out = drawn.join(there.select("dataset", "n_batches"), "dataset").withColumn("opening", F.floor(F.col("nth") / F.col("n_batches")))
    h = F.conv(F.substring(stable_rank_key(seed, F.col("dataset"), F.col("opening")), 1, 8), 16, 10).cast("long")
    # a prime that doesn't divide the number of batches turns their order into another one
    prime = F.get(F.array(*map(F.lit, PRIMES)), (h % len(PRIMES)).cast("int"))
    batch = F.pmod(prime * F.pmod("nth", "n_batches") + h, F.col("n_batches"))
    return out.select("step", "dataset", "opening", batch.alias("batch"))


def evaluation_order(batches: DataFrame, per_dataset: int | None = None, most: int | None = None) -> DataFrame:
    """Batches (dataset, batch) in dataset order, at most so many for each and in total."""
    out = batches
    if per_dataset is not None:
        out = out.withColumn("_r", F.row_number().over(Window.partitionBy("dataset").orderBy("batch"))).where(F.col("_r") <= per_dataset).drop("_r")
    out = out.orderBy("dataset", "batch")
    return out.limit(most) if most is not None else out


def draw_shares(drawn: DataFrame, plan: DataFrame, weight: str = "share") -> DataFrame:
    """Observed and planned share of each dataset, and their distance."""
    counts = drawn.groupBy("dataset").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    seen = counts.select("dataset", (F.col("n") / total).alias("observed"))
    out = plan.select("dataset", F.col(weight).alias("expected")).join(seen, "dataset", "left").withColumn("observed", F.coalesce("observed", F.lit(0.0)))
    return out.withColumn("error", F.abs(F.col("observed") - F.col("expected")))


def plan_checks(plan: DataFrame, n_datasets: int, n_clients: int, cap_dataset: float = 0.10, cap_client: float = 0.25, min_client: float = 0.005, excluded: list[str] | None = None) -> DataFrame:
    """Checks (name, observed, passed) of a plan (dataset, client, final_dataset_weight)."""
    clients = plan.groupBy("client").agg(F.sum("final_dataset_weight").alias("w"))
    whole = plan.agg(F.count_distinct("dataset").alias("datasets"), F.sum("final_dataset_weight").alias("total"), F.max("final_dataset_weight").alias("largest"), F.count_if(F.col("dataset").isin(excluded or [])).alias("targets"))
    whole = whole.crossJoin(clients.agg(F.count("*").alias("clients"), F.max("w").alias("largest_client"), F.min("w").alias("least_client")))  # one row each

    def check(name: str, observed: str, passed: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), F.round(F.col(observed).cast("double"), 9).alias("observed"), F.coalesce(passed, F.lit(False)).alias("passed"))

    return whole.select(
        F.inline(
            F.array(
                check("datasets", "datasets", F.col("datasets") == n_datasets),
                check("clients", "clients", F.col("clients") == n_clients),
                check("weights sum to 1", "total", F.abs(F.col("total") - 1) < 1e-9),
                check("dataset cap", "largest", F.col("largest") <= cap_dataset + 1e-9),
                check("client cap", "largest_client", F.col("largest_client") <= cap_client + 1e-9),
                check("client floor", "least_client", F.col("least_client") >= min_client - 1e-9),
                check("no target dataset", "targets", F.col("targets") == 0),
            )
        )
    )
