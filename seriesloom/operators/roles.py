"""Column roles of a table, lookups of tasks and domains, and guards over plans."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: column names of each role, in the order in which they are looked for
UNIT_NAMES = ["unit", "unit_id", "id", "engine_id", "machine_id", "experiment", "series_id", "unit_number"]
TIME_NAMES = ["time", "cycle", "timestamp", "time_in_cycles", "t", "step"]
TARGET_NAMES = ["rul", "RUL", "target", "label", "class", "fault", "state", "condition", "anomaly", "y", "wear"]


@dataclass
class Roles:
    unit: str | None = None
    time: str | None = None
    subset: str | None = None
    target: str | None = None
    candidates: list[str] = field(default_factory=list)
    signals: list[str] = field(default_factory=list)


def detect_roles(df: DataFrame, unit: str | None = None, time: str | None = None, subset: str | None = None, targets: list[str] | None = None, override: str | None = None) -> Roles:
    """Roles by metadata first, then by name; the schema decides in the driver.

    A unit column that no name gives is the first whole-number or text column with fewer
    distinct values than half the rows, counted in one aggregation. Signals are numbers
    and booleans without another role; no target candidate is a signal.
    """
    types = {f.name: f.dataType for f in df.schema}
    named = lambda given, names: given if given in types else next((n for n in names if n in types), None)
    roles = Roles(time=named(time, TIME_NAMES), subset=subset if subset in types else None)
    roles.candidates = list(dict.fromkeys(c for c in [override, *(targets or []), *TARGET_NAMES] if c in types))
    roles.target = roles.candidates[0] if roles.candidates else None
    roles.unit = named(unit, UNIT_NAMES)
    taken = {roles.time, roles.subset, *roles.candidates}
    if roles.unit is None:
        possible = [c for c, t in types.items() if c not in taken and isinstance(t, (T.IntegerType, T.LongType, T.ShortType, T.StringType))]
        if possible:
            row = df.agg(F.count("*").alias("n"), *(F.count_distinct(c).alias(f"d{i}") for i, c in enumerate(possible))).first()
            roles.unit = next((c for i, c in enumerate(possible) if row[f"d{i}"] < row["n"] / 2), None)
    taken.add(roles.unit)
    roles.signals = [c for c, t in types.items() if c not in taken and isinstance(t, (T.NumericType, T.BooleanType))]
    return roles


def role_differences(roles: Roles, target: str | None, subset: str | None, n_channels: int) -> list[str]:
    """What differs from the audit, or overlaps."""
    wrong = [f"{name}: {a!r} is not {b!r}" for name, a, b in (("target", roles.target, target), ("subset", roles.subset, subset), ("channels", len(roles.signals), n_channels)) if a != b]
    single = [c for c in (roles.unit, roles.time, roles.subset, roles.target) if c]
    if len({*single, *roles.signals}) < len(single) + len(roles.signals):
        wrong.append("roles overlap")
    return wrong


def observations(df: DataFrame, roles: Roles, dataset: str, split: Column, row_id: str) -> DataFrame:
    """The table in the form of the audit: signals as one array, null for NaN."""
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    unit = F.col(roles.unit) if roles.unit else F.lit("all")
    order = F.row_number().over(Window.partitionBy(split, unit).orderBy(row_id)) - 1
    return df.select(F.lit(dataset).alias("dataset"), split.alias("split"), unit.alias("unit"), order.alias("pos"), (F.col(roles.time) if roles.time else order).cast("double").alias("time"), (F.col(roles.target) if roles.target else F.lit(None)).alias("target"), F.array(*map(number, roles.signals)).alias("x"))


def with_domain(datasets: DataFrame, domains: DataFrame, default: str = "misc") -> DataFrame:
    """domain of each dataset from a small mapping."""
    return datasets.join(domains, "dataset", "left").withColumn("domain", F.coalesce("domain", F.lit(default)))


def with_direction(results: DataFrame, directions: DataFrame) -> DataFrame:
    """Whether a higher metric is better, or unknown; directions is a small mapping."""
    return results.join(directions, "metric", "left").withColumn("direction", F.coalesce("direction", F.lit("unknown")))


def task_kind(text: Column) -> Column:
    """regression where a manifest speaks of it or of remaining life, else classification."""
    return F.when(F.lower(text).rlike("rul|regress"), "regression").otherwise("classification")


def batch_sizes(tasks: DataFrame, manifests: DataFrame, first_samples: DataFrame, fallback: int, batch: int, budget: int) -> DataFrame:
    """Batch size of each task and where its channel count comes from."""
    m = manifests.select("dataset", F.col("n_channels").alias("c_manifest"))
    s = first_samples.select("dataset", F.col("n_channels").alias("c_sample"))
    out = tasks.join(m, "dataset", "left").join(s, "dataset", "left")
    c = F.coalesce("c_manifest", "c_sample", F.lit(fallback))
    source = F.when(F.col("c_manifest").isNotNull(), "manifest").when(F.col("c_sample").isNotNull(), "first sample").otherwise("fallback")
    return out.select("dataset", c.alias("n_channels"), source.alias("source"), F.least(F.lit(batch), F.greatest(F.lit(1), F.floor(F.lit(budget) / c))).cast("int").alias("batch_size"))


def effective_policy(declared: Column, origin: Column) -> Column:
    """The weights' policy as it works out with a plan of this origin."""
    return F.when((declared == "final_client_weight") & (origin == "fallback"), "patch_share").otherwise(declared)


def not_sources(plan: DataFrame, roles: DataFrame) -> DataFrame:
    """Datasets of a plan that aren't sources; none may be."""
    return plan.select("dataset").join(roles, "dataset", "left").where("role is null or role <> 'source'").select("dataset", "role")


def clients_of_round(plan: DataFrame, groups: DataFrame, most: int | None = None) -> DataFrame:
    """Clients of the groups that have plan rows, the first so many by name."""
    clients = groups.select("client").distinct().join(plan.select("client").distinct(), "client", "left_semi")
    return clients.orderBy("client").limit(most) if most is not None else clients


def fallback_plan(groups: DataFrame, measure: str = "patches") -> DataFrame:
    """A plan from groups alone: patch shares, or equal shares where all are zero."""
    total = F.sum(measure).over(Window.partitionBy(F.lit(1)))  # one row for each dataset
    share = F.when(total > 0, F.col(measure) / total).otherwise(1.0 / F.count("*").over(Window.partitionBy(F.lit(1))))
    return groups.select("client", "dataset", share.alias("share"))


def count_differences(preview: DataFrame, written: DataFrame, key: list[str], counts: list[str]) -> DataFrame:
    """Groups whose counts differ between preview and what was written, missing ones too."""
    a, b = preview.select(*key, *(F.col(c).alias(f"{c}_preview") for c in counts)), written.select(*key, *(F.col(c).alias(f"{c}_written") for c in counts))
    off = F.lit(False)
    for c in counts:
        off = off | ~F.col(f"{c}_preview").eqNullSafe(F.col(f"{c}_written"))
    return a.join(b, key, "full").where(off)


def row_accounting(rows: DataFrame, tiles: DataFrame, key: list[str]) -> DataFrame:
    """Source rows, those that some window covers, valid places and dropped rows."""
    n = rows.groupBy(*key).agg(F.count("*").alias("n_source"))
    covered = tiles.groupBy(*key).agg(F.count_distinct("unit", "pos").alias("n_covered"), F.count("*").alias("n_valid"))
    return n.join(covered, key, "left").select(*key, "n_source", F.coalesce("n_covered", F.lit(0)).alias("n_covered"), F.coalesce("n_valid", F.lit(0)).alias("n_valid"), (F.col("n_source") - F.coalesce("n_covered", F.lit(0))).alias("n_dropped"))


def constant_channels(normalized: DataFrame, unit: str = "unit", window: str = "w_idx") -> DataFrame:
    """Trajectories of which the first flagged window has a constant channel, by channel."""
    flagged = normalized.where("constant").select(unit, window, "channel").distinct()
    first = flagged.groupBy(unit).agg(F.min(window).alias(window))
    return flagged.join(first, [unit, window]).groupBy("channel").agg(F.count_distinct(unit).alias("n_trajectories")).orderBy(F.desc("n_trajectories"), "channel")


def sampling_rates(audits: DataFrame) -> DataFrame:
    """Datasets whose rate is known, inferred or unknown, as sorted lists."""
    state = F.when(F.col("rate").isNotNull(), "known").when(F.col("inferred_rate").isNotNull(), "inferred").otherwise("unknown")
    return audits.groupBy(state.alias("state")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("dataset")).alias("datasets"))


def runnable(tasks: DataFrame, role: str | None = None, kind: str | None = None) -> DataFrame:
    out = tasks.where("status = 'ready'")
    out = out.where(F.col("role") == role) if role else out
    return out.where(F.col("task_type") == kind) if kind else out
