"""Audit metrics of observation tables.

Observations are rows (dataset, split, unit, pos, time, target, x): pos orders a unit's
rows, x holds the signals in a fixed order with null for missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import exact_quantiles

SHARD_SAMPLES = 5000


def channels(obs: DataFrame, *keep: str) -> DataFrame:
    """One row for each signal of each observation: channel, value."""
    return obs.select(*keep, F.posexplode("x").alias("channel", "value"))


def shape(obs: DataFrame) -> DataFrame:
    """Rows, units, channels, bytes as float32 and quartiles of lengths of each split."""
    lengths = obs.groupBy("dataset", "split", "unit").agg(F.count("*").alias("n"), F.max(F.size("x")).alias("c"))
    totals = lengths.groupBy("dataset", "split").agg(
        F.sum("n").alias("n_rows"), F.count("*").alias("n_units"), F.min("n").alias("len_min"), F.max("n").alias("len_max"), F.max("c").alias("n_channels"), (F.sum("n") * F.max("c") * 4).alias("float32_bytes")
    )
    cuts = exact_quantiles(lengths, ["dataset", "split"], F.col("n"), [0.25, 0.5, 0.75]).drop("n")
    out = totals.join(cuts, ["dataset", "split"])
    return out.select(*totals.columns, *(F.col("q")[i].cast("long").alias(c) for i, c in enumerate(("len_q25", "len_median", "len_q75"))))


def channel_quality(obs: DataFrame, z: float = 5.0) -> DataFrame:
    """Missing share, variance, range and outlier share of each channel.

    Outliers are further than z sample deviations from the mean; missing values and
    constant channels have none but count in the share. The statistics joined back are
    one row a channel.
    """
    long = channels(obs, "dataset")
    stats = long.groupBy("dataset", "channel").agg(
        F.count("*").alias("n"),
        F.round(F.avg(F.col("value").isNull().cast("int")) * 100, 2).alias("missing_pct"),
        F.coalesce(F.var_samp("value"), F.lit(0.0)).alias("variance"),
        F.avg("value").alias("mean"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
    )
    far = F.abs(F.col("value") - F.col("mean")) > z * F.sqrt("variance")
    marked = long.join(stats.select("dataset", "channel", "mean", "variance"), ["dataset", "channel"])
    outliers = marked.groupBy("dataset", "channel").agg((F.avg(F.when(far & (F.col("variance") > 0), 1.0).otherwise(0.0)) * 100).alias("outlier_pct"))
    return stats.drop("mean").join(outliers, ["dataset", "channel"])


def quality(obs: DataFrame, z: float = 5.0, constant: float = 1e-10) -> DataFrame:
    """Per dataset: worst and median missing share, constant channels, range, outliers."""
    per = channel_quality(obs, z)
    still = F.col("variance") < constant
    return per.groupBy("dataset").agg(
        F.max("missing_pct").alias("missing_max_pct"),
        F.percentile("missing_pct", F.lit(0.5)).alias("missing_median_pct"),
        F.count_if(still).alias("n_constant"),
        (F.avg(still.cast("int")) * 100).alias("constant_pct"),
        F.min("low").alias("global_min"),
        F.max("high").alias("global_max"),
        F.avg("outlier_pct").alias("outlier_pct"),
    )


def corrected_kurtosis(c: str) -> Column:
    """Excess kurtosis with the small-sample correction; null for fewer than four."""
    n = F.count(c)
    value = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6)
    return F.when(n >= 4, value)


def drift(obs: DataFrame) -> DataFrame:
    """Variance and kurtosis of the units' channel means, averaged over channels."""
    means = channels(obs, "dataset", "unit").groupBy("dataset", "channel", "unit").agg(F.avg("value").alias("m"))
    per = means.groupBy("dataset", "channel").agg(F.var_samp("m").alias("v"), corrected_kurtosis("m").alias("k"))
    return per.groupBy("dataset").agg(F.avg("v").alias("drift_variance"), F.avg("k").alias("drift_kurtosis"))


def labels(obs: DataFrame) -> DataFrame:
    """Coverage, classes and balance (least over most frequent) of the target."""
    counts = obs.groupBy("dataset", "target").agg(F.count("*").alias("n"))
    there = F.col("target").isNotNull()
    n = F.when(there, F.col("n"))
    return counts.groupBy("dataset").agg(
        F.round(F.coalesce(F.sum(n), F.lit(0)) * 100 / F.sum("n"), 4).alias("label_coverage_pct"),
        F.count(n).alias("n_classes"),
        F.when(F.count(n) >= 2, F.round(F.min(n) / F.max(n), 4)).alias("class_balance"),
    )


def target_ranges(obs: DataFrame) -> DataFrame:
    """Coverage, mean and range of a numeric target of each dataset, to four digits; null
    and not finite numbers are missing."""
    x = F.col("target").cast("double")
    x = F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
    return obs.groupBy("dataset").agg(
        F.round(F.count(x) * 100 / F.count("*"), 4).alias("label_coverage_pct"), F.round(F.min(x), 4).alias("target_min"), F.round(F.max(x), 4).alias("target_max"), F.round(F.avg(x), 4).alias("target_mean")
    )


def time_regularity(obs: DataFrame) -> DataFrame:
    """Regularity of each unit's time column, averaged over units of two rows or more.

    Deltas are taken in row order; only positive ones enter the statistics. A gap is a
    delta over three medians. The rate is the inverse median where the deviation is
    below 5 % of it.
    """
    order = Window.partitionBy("dataset", "unit").orderBy("pos")
    steps = obs.select("dataset", "unit", "time", (F.col("time") - F.lag("time").over(order)).alias("d"))
    good = F.when(F.col("d") > 0, F.col("d"))
    cuts = exact_quantiles(steps, ["dataset", "unit"], good, [0.25, 0.5, 0.75]).select("dataset", "unit", *(F.col("q")[i].alias(c) for i, c in enumerate(("q25", "median", "q75"))))
    per = steps.groupBy("dataset", "unit").agg(
        F.count("*").alias("n"),
        F.stddev_pop(good).alias("deviation"),
        (F.count("time") - F.count_distinct("time")).alias("duplicates"),
        (F.coalesce(F.min("d"), F.lit(0.0)) > 0).alias("increasing"),
    )
    per = per.where("n >= 2").join(cuts, ["dataset", "unit"], "left")
    gaps = steps.join(per.select("dataset", "unit", "median"), ["dataset", "unit"]).groupBy("dataset").agg(F.count_if(F.col("d") > 3 * F.col("median")).alias("gaps"), F.max(F.when(F.col("d") > 3 * F.col("median"), F.col("d"))).alias("gap_max"))
    out = per.groupBy("dataset").agg(
        *(F.percentile(c, F.lit(0.5)).alias(f"delta_{c}") for c in ("q25", "median", "q75")),  # a number for each unit
        F.avg(F.col("deviation") / F.col("median")).alias("irregularity"),
        F.sum("duplicates").alias("duplicates"),
        (F.avg(F.col("increasing").cast("int")) * 100).alias("increasing_pct"),
    )
    rate = F.when(F.col("irregularity") < 0.05, 1 / F.col("delta_median")).alias("inferred_rate")
    return out.join(gaps, "dataset").select("*", rate)


def window_counts(length: Column, window: int, stride: int, patch: int, policy: str = "pad") -> dict[str, Column]:
    """Windows, patches and dropped rows of one trajectory, from its length alone.

    A trajectory of at most one window gives one, padded at the right. Longer ones give
    windows at every stride; with "pad" the rows after the last make one more window,
    with "drop" they are lost.
    """
    n = window // patch
    full = F.when(length <= window, 0).otherwise(F.floor((length - window) / stride) + 1).cast("long")
    rest = F.when(length <= window, length).otherwise(length - ((full - 1) * stride + window)).cast("long")
    tail = F.when(length <= window, 1).when(rest > 0, 1 if policy == "pad" else 0).otherwise(0).cast("long")
    return {
        "n_windows": full + tail,
        "n_padded": F.when((tail == 1) & (rest < window), 1).otherwise(0).cast("long"),
        "valid_patches": full * n + tail * F.ceil(rest / patch),
        "dense_patches": (full + tail) * n,
        "dropped_rows": F.when(length <= window, 0).otherwise(rest * (1 - tail)).cast("long"),
    }


def window_estimate(obs: DataFrame, window: int, stride: int, patch: int, policy: str = "pad") -> DataFrame:
    """Window and patch totals of each split without cutting a window."""
    lengths = obs.groupBy("dataset", "split", "unit").agg(F.count("*").alias("n"), F.max(F.size("x")).alias("c"))
    counts = window_counts(F.col("n"), window, stride, patch, policy)
    per = lengths.select("dataset", "split", "c", *(v.alias(k) for k, v in counts.items()))
    total = per.groupBy("dataset", "split").agg(*(F.sum(k).alias(k) for k in counts), F.max("c").alias("n_channels"))
    return total.select(
        "*",
        (F.col("valid_patches") * F.col("n_channels")).alias("channel_patches"),
        (F.col("n_padded") / F.col("n_windows")).alias("padding_ratio"),
        (1 - F.col("valid_patches") / F.col("dense_patches")).alias("invalid_ratio"),
        (F.col("dense_patches") / F.col("valid_patches")).alias("dense_over_valid"),
        F.ceil(F.col("n_windows") / SHARD_SAMPLES).alias("n_shards"),
        (F.col("n_windows") * F.col("n_channels") * window * 4 / 1e6).alias("size_mb"),
    )


def decide_role(dropped: Column, missing_max: Column, padding: Column, target_listed: Column, median_length: Column, windows: Column) -> tuple[Column, Column]:
    """(role, reason) by the first rule that holds."""
    rules = [
        (dropped, "drop", F.lit("listed as dropped")),
        (missing_max > 50, "drop", F.format_string("missing %.1f %% > 50 %%", missing_max)),
        (padding > 0.8, "drop", F.format_string("padding %.2f > 0.80", padding)),
        (target_listed, "target", F.lit("listed as target")),
        (median_length < 200, "drop", F.format_string("median length %d < 200", median_length)),
        (windows < 100, "drop", F.format_string("%d windows < 100", windows)),
    ]
    role = reason = None
    for rule, name, why in rules:
        role = F.when(rule, name) if role is None else role.when(rule, name)
        reason = F.when(rule, why) if reason is None else reason.when(rule, why)
    return role.otherwise("source"), reason.otherwise("meets all rules")


def warnings(audit: DataFrame, rules: dict[str, Column], key: str = "dataset") -> DataFrame:
    """One row (key, warning) for each rule that holds of a row."""
    found = F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items())))
    return audit.select(key, F.explode(found).alias("warning"))


def shares(table: DataFrame, measures: list[str], where: Column | None = None, digits: int = 6) -> DataFrame:
    """w_<measure>: each row's share of the total, over the rows where the filter holds.

    Shares are null where the total is zero.
    """
    table = table.where(where) if where is not None else table
    total = Window.partitionBy(F.lit(1))  # one row for each dataset
    return table.select("*", *(F.round(F.try_divide(F.col(m), F.sum(m).over(total)), digits).alias(f"w_{m}") for m in measures))


def group_clients(sources: DataFrame, fusible: list[str]) -> DataFrame:
    """Client of each dataset: its domain, or "fused" for fusible domains of one dataset."""
    alone = F.count("*").over(Window.partitionBy("domain")) == 1
    return sources.withColumn("client", F.when(alone & F.col("domain").isin(fusible), "fused").otherwise(F.col("domain")))


def client_summary(grouped: DataFrame, measures: list[str]) -> DataFrame:
    """Per client: datasets with their measures by falling first measure, and totals."""
    item = F.struct(*(F.col(m) for m in measures), F.col("dataset"))
    out = grouped.groupBy("client").agg(F.count("*").alias("n_datasets"), *(F.sum(m).alias(m) for m in measures), F.sort_array(F.collect_list(item), asc=False).alias("datasets"))
    total = Window.partitionBy(F.lit(1))  # one row for each client
    return out.select("*", *(F.round(F.try_divide(F.col(m) * 100, F.sum(m).over(total)), 2).alias(f"{m}_pct") for m in measures))


def compare_audits(before: DataFrame, now: DataFrame) -> DataFrame:
    """Change of windows and patches of datasets that both audits have."""
    a = before.select("dataset", F.col("n_windows").alias("windows_before"), F.col("valid_patches").alias("patches_before"))
    b = now.select("dataset", F.col("n_windows").alias("windows_now"), F.col("valid_patches").alias("patches_now"))
    change = F.when(F.col("patches_before") != 0, (F.col("patches_now") - F.col("patches_before")) * 100.0 / F.col("patches_before"))
    out = a.join(b, "dataset").select("*", (F.col("windows_now") - F.col("windows_before")).alias("delta_windows"), change.alias("patch_change_pct"))
    return out.orderBy(F.desc_nulls_last("patch_change_pct"), "dataset")


def corpus_totals(parts: DataFrame, audit: DataFrame, measures: list[str], tolerance: float = 1e-9) -> DataFrame:
    """One row for each measure: its total over the parts and over the audit, and whether
    they agree up to the tolerance, which is relative (sums in another order differ)."""
    sums = [F.struct(F.lit(m).alias("measure"), F.sum(m).cast("double").alias("total")).alias(f"s{i}") for i, m in enumerate(measures)]
    found, expected = (t.agg(*sums).select(F.inline(F.array(*(f"s{i}" for i in range(len(measures)))))) for t in (parts, audit))
    out = found.join(expected.withColumnRenamed("total", "expected"), "measure")  # a row for each measure
    near = F.abs(F.col("total") - F.col("expected")) <= tolerance * F.greatest(F.abs("total"), F.abs("expected"))
    return out.withColumn("passed", F.coalesce(near, F.col("total").isNull() & F.col("expected").isNull()))


def with_excluded(audit: DataFrame, excluded: DataFrame, role: str = "EXCLUDED") -> DataFrame:
    """The audit with the datasets that weren't audited; what isn't known of them is null."""
    return audit.unionByName(excluded.withColumn("role", F.lit(role)), allowMissingColumns=True)


def audit_order(audit: DataFrame) -> DataFrame:
    """By role, domain and dataset."""
    return audit.orderBy(F.asc_nulls_last("role"), F.asc_nulls_last("domain"), "dataset")


def smallest_first(plan: DataFrame, size: str = "size", key: str = "dataset") -> DataFrame:
    """A work plan by rising size, unknown sizes last."""
    return plan.orderBy(F.asc_nulls_last(size), key)


def file_states(files: DataFrame) -> DataFrame:
    """Files and bytes by dataset and state, and each state's share of the dataset's files."""
    per = files.groupBy("dataset", "state").agg(F.count("*").alias("n_files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("n_bytes"))
    all_of = F.sum("n_files").over(Window.partitionBy("dataset"))  # a row for each state
    return per.withColumn("share", F.col("n_files") / all_of)


def largest_files(files: DataFrame, most: int = 10) -> DataFrame:
    """The largest files with a known size."""
    return files.where("bytes is not null").orderBy(F.desc("bytes"), "file").limit(most)


def top_by_measure(table: DataFrame, measures: list[str], most: int = 10, key: str = "dataset") -> DataFrame:
    """measure, dataset, value and place: the largest rows by each of the measures."""
    values = F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures))
    rows = table.select(key, F.inline(values))
    place = F.row_number().over(Window.partitionBy("measure").orderBy(F.desc("value"), key))
    return rows.withColumn("place", place).where(F.col("place") <= most).select("measure", key, "value", "place")
