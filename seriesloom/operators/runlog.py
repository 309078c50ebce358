"""Training logs: buckets of steps, non-finite values, target statistics and trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import finite, nonfinite_kind
from .places import join_same
from .quantiles import exact_quantiles


def in_buckets(log: DataFrame, buckets: list[tuple[int, int | None]], step: str = "step") -> DataFrame:
    """bucket: the first half-open range that holds the step; rows in none are dropped.
    A range without a high end holds all later steps."""
    found = None
    for low, high in buckets:
        hit, name = F.col(step) >= low, f"{low}-" if high is None else f"{low}-{high}"
        hit = hit if high is None else hit & (F.col(step) < high)
        found = F.when(hit, name) if found is None else found.when(hit, name)
    return log.withColumn("bucket", found).where("bucket is not null")


def loss_statistics(log: DataFrame, *by: str, loss: str = "loss") -> DataFrame:
    """Count, mean, quantiles and range of finite losses, and the mean over clean steps
    (neither skipped by the optimizer nor with a bad gradient; unknown counts as clean)."""
    x = finite(F.col(loss))
    clean = F.coalesce(F.col("optimizer_applied"), F.lit(True)) & ~F.coalesce(F.col("bad_gradient"), F.lit(False))
    out = log.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.min(x).alias("low"), F.max(x).alias("high"), F.avg(F.when(clean, x)).alias("clean_mean"))
    out = join_same(out, exact_quantiles(log, list(by), x, [0.1, 0.5, 0.9]).drop("n"), list(by), "left")
    return out.select(*by, "n", "mean", *(F.col("q")[i].alias(k) for i, k in enumerate(("p10", "median", "p90"))), "low", "high", "clean_mean")


def nonfinite_counts(log: DataFrame, columns: list[str], by: str, noted: str | None = None) -> DataFrame:
    """Records with non-finite numbers by kind; a kind noted in the record counts only
    where no number shows it."""
    kinds = F.array_distinct(F.array_compact(F.array(*(nonfinite_kind(F.col(c)) for c in columns))))
    if noted:
        kinds = F.when(F.size(kinds) > 0, kinds).otherwise(F.array_compact(F.array(F.col(noted))))
    return log.select(by, F.explode(kinds).alias("kind")).groupBy(by, "kind").agg(F.count("*").alias("n"))


def huge_losses(log: DataFrame, threshold: float = 1000.0, loss: str = "loss") -> DataFrame:
    return log.where(finite(F.col(loss)) >= threshold)


def top_losses(log: DataFrame, n: int = 20, loss: str = "loss", key: str = "step") -> DataFrame:
    return log.where(finite(F.col(loss)).isNotNull()).orderBy(F.desc(loss), key).limit(n)


def target_statistics(samples: DataFrame, target: str = "target", by: str = "split") -> DataFrame:
    x = finite(F.col(target))
    middle = exact_quantiles(samples, [by], x, [0.5]).select(by, F.col("q")[0].alias("median"))
    out = samples.groupBy(by).agg(
        F.count("*").alias("n_samples"),
        F.count(x).alias("n"),
        (F.count("*") - F.count(x)).alias("n_missing"),
        F.min(x).alias("low"),
        F.max(x).alias("high"),
        F.avg(x).alias("mean"),
        F.count_if(x < 0).alias("n_negative"),
        F.coalesce(F.count_if(x < 0) / F.nullif(F.count(x), F.lit(0)), F.lit(0.0)).alias("negative_share"),
    )
    return join_same(out, middle, [by], "left")


def target_trends(samples: DataFrame, by: str = "split", unit: str = "unit", index: str = "idx", target: str = "target", still: float = 1e-9) -> DataFrame:
    """Per group the trajectories whose target falls, rises or stays from first to last."""
    change = F.max_by(target, index) - F.min_by(target, index)
    per = samples.groupBy(by, unit).agg(change.alias("d"), F.count("*").alias("n")).where("n > 1")
    return per.groupBy(by).agg(F.count("*").alias("n_multi"), F.count_if(F.col("d") < -still).alias("falling"), F.count_if(F.col("d") > still).alias("rising"), F.count_if(F.abs("d") <= still).alias("flat"))


def padding_statistics(samples: DataFrame, padding: str = "padding", by: str = "split", unit: str = "unit") -> DataFrame:
    """Mean and maximum of the samples' padding, and the share of trajectories with more
    than one window; samples without a unit count for the padding only."""
    x = finite(F.col(padding))
    per = samples.groupBy(by, unit).agg(F.sum(x).alias("s"), F.count(x).alias("c"), F.max(x).alias("high"), F.count("*").alias("n"))
    known = F.col(unit).isNotNull()
    share = F.coalesce(F.count_if(known & (F.col("n") > 1)) / F.nullif(F.count_if(known), F.lit(0)), F.lit(0.0))
    return per.groupBy(by).agg((F.sum("s") / F.nullif(F.sum("c"), F.lit(0))).alias("padding_mean"), F.max("high").alias("padding_max"), share.alias("multi_window_share"))


def diagnosis(trends: DataFrame, statistics: DataFrame, least: int = 5) -> DataFrame:
    """Whether some group has enough trajectories, and whether any target is negative."""
    return trends.agg(F.bool_or(F.col("n_multi") >= least).alias("enough_trajectories")).crossJoin(statistics.agg(F.bool_or(F.col("n_negative") > 0).alias("any_negative")))


def histogram(values: DataFrame, value: str, low: float, high: float, bins: int, *by: str, beyond: bool = False) -> DataFrame:
    """Values by bin from 1. Those under `low` are in bin 0; those from `high` on are in the
    last bin, or with `beyond` in one of their own after it."""
    at = F.least(F.lit(bins + beyond), F.width_bucket(F.col(value), F.lit(low), F.lit(high), F.lit(bins)))
    return values.where(F.col(value).isNotNull()).groupBy(*by, at.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def best_mode(rows: DataFrame, metric: str = "macro_f1") -> DataFrame:
    """The mode with the highest metric of each dataset; the first in mode order of ties."""
    ranked = rows.where(F.col(metric).isNotNull())
    return ranked.groupBy("dataset").agg(F.max_by(F.struct("mode", metric), F.struct(metric, -F.col("mode_order"))).alias("b")).select("dataset", "b.*")


def against_baseline(rows: DataFrame, baseline: str, metric: str = "macro_f1", better: Column | None = None, loss_limit: float = 0.10) -> DataFrame:
    """Differences of each mode to the baseline of its dataset, and a note where it lost
    more than the limit."""
    base = rows.where(F.col("mode") == baseline).select("dataset", F.col(metric).alias("base"))
    out = rows.where(F.col("mode") != baseline).join(base, "dataset", "left")
    delta = F.col(metric) - F.col("base")
    note = F.array_compact(F.array(F.when(delta < -loss_limit, F.lit("below the baseline")), F.when(F.col("base").isNull(), F.lit("no baseline"))))
    return out.select("dataset", "mode", metric, "base", delta.alias("delta"), (delta / F.nullif(F.col("base"), F.lit(0.0))).alias("relative"), F.array_join(note, "; ").alias("notes"))


def run_matrix(tasks: DataFrame, modes: DataFrame, checkpoints: DataFrame, most: int | None = None) -> DataFrame:
    """Runs of all tasks, modes and checkpoints; modes that need none come once, tasks that
    aren't ready once as skipped. All three inputs are small lists."""
    ready, rest = tasks.where("status = 'ready'"), tasks.where("status <> 'ready'")
    each = ready.crossJoin(modes.where("needs_checkpoint")).crossJoin(checkpoints.select("checkpoint"))
    once = ready.crossJoin(modes.where("not needs_checkpoint")).withColumn("checkpoint", F.lit(None).cast("string"))
    runs = each.unionByName(once).select("task", "mode", "checkpoint", F.lit("planned").alias("status"))
    if most is not None:
        runs = runs.orderBy("task", "mode", F.asc_nulls_first("checkpoint")).limit(most)
    return runs.unionByName(rest.select("task", F.lit(None).cast("string").alias("mode"), F.lit(None).cast("string").alias("checkpoint"), F.lit("skipped").alias("status")))


def pending(runs: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Runs without a result yet; null keys are equal."""
    same = None
    for k in key:
        one = F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        same = one if same is None else same & one
    return runs.alias("a").join(done.alias("b"), same, "left_anti")


def suite_caveats(results: DataFrame, *by: str) -> DataFrame:
    """The distinct caveats of a suite's runs in order, each with its dataset."""
    named = F.when(F.col("caveat") != "", F.concat(F.coalesce("dataset", F.lit("")), F.lit(": "), "caveat"))
    return results.groupBy(*by).agg(F.array_sort(F.collect_set(named)).alias("caveats"))


def suite_summary(results: DataFrame, *by: str) -> DataFrame:
    """Counts by status; ok if any run is ok or partial, else failed if any is, else skipped."""
    n = {s: F.count_if(F.col("status") == s) for s in ("ok", "partial", "failed", "skipped")}
    overall = F.when(n["ok"] + n["partial"] > 0, "ok").when(n["failed"] > 0, "failed").otherwise("skipped")
    return results.groupBy(*by).agg(*(c.alias(f"n_{k}") for k, c in n.items()), overall.alias("status"))


def ranked(table: DataFrame, order: list[str], column: str = "mode") -> DataFrame:
    """Adds place: a value's place in a given order (from 1); others come last, by name."""
    known = F.array_position(F.array(*map(F.lit, order)), F.col(column))
    return table.withColumn("place", F.when(known > 0, known).otherwise(F.lit(len(order) + 1))).orderBy("place", column)


# Notes and verdicts by their names.
UNCAPPED, FORGETTING = "historical_uncapped_batch_v0_1", "catastrophic_forgetting"
PENDING, CONFIRMED, WEAK, UNCONFIRMED = "PENDIENTE", "CONFIRMADA", "DEBIL", "NO_CONFIRMADA"
GO, CONDITIONAL, NO_GO = "GO", "CONDITIONAL", "NO-GO"


def run_notes(rows: DataFrame, channels: DataFrame, metric: str = "macro_f1", batch: int = 64, cap: int = 512, loss_limit: float = 0.10) -> DataFrame:
    """rows with notes: UNCAPPED where no effective batch is noted and the usual batch times
    the dataset's channels is over the cap (unknown channels: no note), FORGETTING where
    full finetuning lost more than the limit against training from scratch."""
    scratch = rows.where("mode = 'from_scratch'").groupBy("dataset").agg(F.max(metric).alias("_base"))
    out = rows.join(channels.select("dataset", F.col("n_channels").alias("_c")), "dataset", "left").join(scratch, "dataset", "left")
    uncapped = F.col("batch_size_effective").isNull() & (batch * F.col("_c") > cap)
    forgot = (F.col("mode") == "full_finetuning") & (F.col(metric) < F.col("_base") - loss_limit)
    notes = F.array_compact(F.array(F.when(uncapped, F.lit(UNCAPPED)), F.when(forgot, F.lit(FORGETTING))))
    return out.select(*rows.columns, notes.alias("notes"))


def transfer_verdict(rows: DataFrame, modes: list[str], metric: str = "rmse", baseline: str = "from_scratch", least: float = 0.01) -> DataFrame:
    """For each dataset whether the best of the modes (the lowest metric, the first in order
    of ties) is better than the baseline: verdict, best_mode, best, base, delta, relative."""
    place = F.array_position(F.array(*map(F.lit, modes)), F.col("mode"))
    known = F.col(metric).isNotNull()
    per = rows.groupBy("dataset").agg(
        F.min(F.when(F.col("mode") == baseline, F.col(metric))).alias("base"),
        F.min_by(F.struct("mode", F.col(metric).alias("x")), F.when(known & (place > 0), F.struct(metric, place))).alias("b"),
    )
    delta = F.col("b.x") - F.col("base")
    relative = delta / F.greatest(F.lit(1e-9), F.abs("base"))
    verdict = F.when(F.col("base").isNull() | F.col("b").isNull(), PENDING).when(delta >= 0, UNCONFIRMED).when(relative <= -least, CONFIRMED).otherwise(WEAK)
    return per.select("dataset", verdict.alias("verdict"), F.col("b.mode").alias("best_mode"), F.col("b.x").alias("best"), "base", delta.alias("delta"), relative.alias("relative"))


def decision(rows: DataFrame, before: DataFrame, hard: str, other: str, gain: float = 0.05, some: float = 0.01, recall: float = 0.30, metric: str = "macro_f1") -> DataFrame:
    """One row: whether a method goes on, by the new rows (dataset, metric, recall_0) and the
    former ones (dataset, metric). The hard dataset has to gain and its first class has to
    be found; the other one must not lose what the hard one has to gain."""
    new = rows.select("dataset", F.col(metric).alias("n"), "recall_0")
    both = new.join(before.select("dataset", F.col(metric).alias("o")), "dataset", "left")
    of = lambda name, c: F.max(F.when(F.col("dataset") == name, F.col(c)))
    facts = both.agg(of(hard, "n").alias("hn"), of(other, "n").alias("on"), (of(hard, "n") - of(hard, "o")).alias("delta_hard"), (of(other, "n") - of(other, "o")).alias("delta_other"), of(hard, "recall_0").alias("recall_0"))
    missing = F.col("hn").isNull() | F.col("on").isNull()
    verdict = F.when(missing | (F.col("recall_0") < recall), NO_GO).when((F.col("delta_hard") >= gain) & (F.col("delta_other") >= -gain), GO).otherwise(CONDITIONAL)
    reason = F.when(missing, "runs are missing").when(F.col("recall_0") < recall, "the first class isn't found").when(verdict == GO, "gains").when(F.col("delta_hard") >= some, "gains little").otherwise("no gain")
    return facts.select(verdict.alias("verdict"), reason.alias("reason"), "delta_hard", "delta_other", "recall_0")


def plot_tables(obs: DataFrame, bins: int = 30) -> DataFrame:
    """What plots of a dataset show, as one table (plot, dataset, key, low, high, n): lengths
    of units and numeric targets by bins of their own range, missing values by channel
    (of n rows: `low`), and the counts of other targets."""
    lengths = obs.groupBy("dataset", "split", "unit").agg(F.count("*").cast("double").alias("v")).select("dataset", "v")
    number = finite(F.col("target").cast("string").try_cast("double"))
    targets = obs.where("target is not null").select("dataset", number.alias("v"), F.col("target").cast("string").alias("text"))
    numeric = targets.groupBy("dataset").agg(F.bool_and(F.col("v").isNotNull()).alias("numeric"))
    targets = join_same(targets, numeric, ["dataset"])
    parts = [_own_bins(lengths, "lengths", bins), _own_bins(targets.where("numeric"), "targets", bins)]
    none = F.lit(None).cast("double")
    missing = obs.select("dataset", F.posexplode("x").alias("c", "v")).groupBy("dataset", "c").agg(F.count_if(F.col("v").isNull()).alias("m"), F.count("*").alias("n"))
    parts.append(missing.select(F.lit("missing").alias("plot"), "dataset", F.col("c").cast("string").alias("key"), F.col("m").cast("double").alias("low"), none.alias("high"), "n"))
    classes = targets.where("not numeric").groupBy("dataset", "text").agg(F.count("*").alias("n"))
    parts.append(classes.select(F.lit("classes").alias("plot"), "dataset", F.col("text").alias("key"), none.alias("low"), none.alias("high"), "n"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _own_bins(values: DataFrame, plot: str, bins: int) -> DataFrame:
    span = values.groupBy("dataset").agg(F.min("v").alias("a"), F.max("v").alias("b"))
    width = (F.col("b") - F.col("a")) / bins
    k = F.when(F.col("b") > F.col("a"), F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("a")) / width))).otherwise(0)
    per = join_same(values.select("dataset", "v"), span, ["dataset"]).groupBy("dataset", "a", "b", k.alias("k")).agg(F.count("*").alias("n"))
    return per.select(F.lit(plot).alias("plot"), "dataset", F.col("k").cast("string").alias("key"), (F.col("a") + F.col("k") * width).alias("low"), (F.col("a") + (F.col("k") + 1) * width).alias("high"), "n")
