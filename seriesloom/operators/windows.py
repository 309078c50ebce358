"""Windows, normalization, patches, masks and pooling.

A row goes to its windows by arithmetic on its place, so a window's group holds at most
`window` rows however long the trajectory is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _with_lengths(obs: DataFrame, key: list[str]) -> DataFrame:
    return obs if "n_rows" in obs.columns else obs.withColumn("n_rows", F.count("*").over(Window.partitionBy(*key)))


def tile(obs: DataFrame, key: list[str], window: int, stride: int, policy: str = "pad") -> DataFrame:
    """Rows of tiling windows: the observations with w_idx, w_start and w_pos.

    Starts are 0, stride, ... as far as a window fits; a shorter trajectory is one window;
    with "pad" the rows after the last full window are one more. Rows that have n_rows
    (`places.place_rows`) are taken as they are; else a trajectory is counted in one task.
    """
    rows = _with_lengths(obs, key)
    full = F.when(F.col("n_rows") <= window, 1).otherwise(F.floor((F.col("n_rows") - window) / stride) + 1).cast("int")
    pos = F.col("pos")
    low = F.greatest(F.lit(0), F.floor((pos - window) / stride) + 1).cast("int")
    high = F.least(full - 1, F.floor(pos / stride)).cast("int")
    end = (full - 1) * stride + window
    inside = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    if policy == "pad":
        inside = F.when((pos >= end) & (F.col("n_rows") > window), F.array(full)).otherwise(inside)
    rows = rows.select("*", F.explode(inside).alias("w_idx"), full.alias("n_full"))
    start = F.when((F.col("w_idx") == F.col("n_full")) & (F.col("n_full") > 0) & (F.col("n_rows") > window), (F.col("n_full") - 1) * stride + window).otherwise(F.col("w_idx") * stride)
    return rows.withColumn("w_start", start.cast("int")).withColumn("w_pos", (F.col("pos") - F.col("w_start")).cast("int")).drop("n_rows", "n_full")


def emission_places(length: Column, stride: int, least: int | None = None, keep_last: bool = True) -> Column:
    """Ends of rolling windows of a trajectory of the given length.

    They start where `least` rows are there and go by the stride; the last row is added
    if the stride misses it. A trajectory shorter than `least` has its last row only.
    """
    start = max(0, (least or 1) - 1)
    grid = F.when(length > start, F.sequence(F.lit(start), (length - 1).cast("int"), F.lit(stride))).otherwise(F.array().cast("array<int>"))
    if not keep_last:
        return grid
    return F.when(length > 0, F.array_distinct(F.concat(grid, F.array((length - 1).cast("int"))))).otherwise(grid)


def emission_counts(length: Column, stride: int, least: int | None = None, keep_last: bool = True) -> tuple[Column, Column]:
    """(dropped, added): grid places lost at the start, and last rows off the grid."""
    start = max(0, (least or 1) - 1)
    short = length <= start
    dropped = F.when(short, F.lit(0) if keep_last else length).otherwise(F.ceil(F.lit(start / stride)))
    off = (length - 1 - start) % stride != 0
    added = F.when(short, F.lit(1 if keep_last else 0)).otherwise((off & F.lit(keep_last)).cast("int"))
    return dropped.cast("long"), F.when(length > 0, added).otherwise(0).cast("long")


def roll(obs: DataFrame, key: list[str], window: int, stride: int, least: int | None = None, keep_last: bool = True) -> DataFrame:
    """Rows of causal windows that end at emission places, padded at the left.

    Adds w_end (the place a window ends at) and w_pos (from 0, counted with the padding).
    Each row goes to at most ceil(window / stride) + 1 windows; n_rows as in `tile`.
    """
    rows = _with_lengths(obs, key).withColumn("n_rows", F.col("n_rows").cast("int"))
    start = max(0, (least or 1) - 1)
    pos = F.col("pos")
    first = F.greatest(F.lit(start), F.lit(start) + F.ceil((pos - start) / F.lit(stride)) * stride).cast("int")
    last = F.least(pos + window - 1, F.col("n_rows") - 1).cast("int")
    grid = F.when(first <= last, F.sequence(first, last, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    if keep_last:
        final = F.col("n_rows") - 1
        grid = F.when(pos > final - window, F.array_distinct(F.concat(grid, F.array(final)))).otherwise(grid)
    rows = rows.select("*", F.explode(grid).alias("w_end"))
    return rows.withColumn("w_pos", (F.lit(window - 1) - F.col("w_end") + pos).cast("int")).drop("n_rows")


def normalize(rows: DataFrame, window_key: list[str], policy: str = "tiling") -> DataFrame:
    """Instance normalization of windows' rows (.., x): mean, std and constant flag of
    each channel over the window's real rows, and z.

    "tiling": variance under 1e-6 divides by 1 and is flagged; fewer than two rows keep
    their values. "rolling": deviation up to 1e-4 or fewer than two rows gives zeros.
    """
    long = rows.select(*window_key, "w_pos", F.posexplode("x").alias("channel", "value"))
    group = Window.partitionBy(*window_key, "channel")
    n, mean, var = F.count("value").over(group), F.avg("value").over(group), F.var_pop("value").over(group)
    long = long.select("*", n.alias("n"), mean.alias("m"), var.alias("v"))
    few = F.col("n") < 2
    if policy == "tiling":
        still = ~few & (F.col("v") < 1e-6)
        used_mean = F.when(few, 0.0).otherwise(F.col("m"))
        used_std = F.when(few | still, 1.0).otherwise(F.sqrt("v"))
        z = (F.col("value") - used_mean) / used_std
    else:
        still = few | (F.sqrt("v") <= 1e-4)
        used_mean = F.coalesce("m", F.lit(0.0))
        used_std = F.when(still, 1e-6).otherwise(F.sqrt("v"))
        z = F.when(still, 0.0).otherwise((F.col("value") - used_mean) / used_std)
    return long.select(*window_key, "w_pos", "channel", "value", used_mean.alias("mean"), used_std.alias("std_used"), still.alias("constant"), z.alias("z"))


def patches(normalized: DataFrame, window_key: list[str], window: int, patch: int) -> DataFrame:
    """One row for each window: patches (C, N, P) and valid_time and valid_patch masks.

    Padding is zero and not valid; a patch is valid if any of its rows is.
    """
    if window % patch:
        raise ValueError("the window must be a multiple of the patch")
    n = window // patch
    cell = F.map_from_entries(F.collect_list(F.struct("w_pos", "z")))
    per = normalized.groupBy(*window_key, "channel").agg(cell.alias("z"))
    at = F.sequence(F.lit(0), F.lit(window - 1))
    per = per.select(*window_key, "channel", F.transform(at, lambda i: F.coalesce(F.col("z")[i], F.lit(0.0))).alias("line"), F.transform(at, lambda i: F.map_contains_key("z", i)).alias("valid"))
    cut = lambda c: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.slice(c, i * patch + 1, patch))
    per = per.withColumn("cut", cut(F.col("line")))
    out = per.groupBy(*window_key).agg(F.sort_array(F.collect_list(F.struct("channel", "cut"))).alias("c"), F.any_value("valid").alias("valid_time"))
    return out.select(*window_key, F.transform("c", lambda s: s["cut"]).alias("patches"), "valid_time", F.transform(cut(F.col("valid_time")), lambda p: F.exists(p, lambda x: x)).alias("valid_patch"))


def sample_rows(rows: DataFrame, window: int, patch: int, policy: str = "tiling", role: str | None = None, client: str | None = None, target_col: str = "target", target_policy: str = "ultimo_valor_valido") -> DataFrame:
    """A sample for each window of rows (dataset, split, unit, w_idx, w_start, w_pos, x,
    target): key, patches, masks over time and over patches (C, N), each channel's mean,
    std_used and constant flag, the target of the last row that has one, and where the
    window lies and what it belongs to."""
    key = ["dataset", "split", "unit", "w_idx"]
    scaled = normalize(rows, key, policy)
    per = scaled.groupBy(*key, "channel").agg(*(F.any_value(c).alias(c) for c in ("mean", "std_used", "constant")))
    stats = per.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("channel", "mean", "std_used", "constant"))).alias("s"))
    known = F.when(F.col("target").isNotNull(), F.col("w_pos"))
    where = rows.groupBy(*key).agg(F.min("w_start").alias("start"), F.count("*").alias("n_rows"), F.max_by("target", known).alias("label"))
    out = patches(scaled, key, window, patch).join(stats, key).join(where, key)
    said = {"dataset": F.col("dataset"), "role": F.lit(role).cast("string"), "client": F.lit(client).cast("string"), "split": F.col("split"), "trajectory_id": F.concat_ws("__", "dataset", "split", "unit")}
    return out.select(
        F.concat_ws("-", *key).alias("key"),
        "dataset",
        "split",
        F.col("unit").cast("string").alias("unit"),
        "patches",
        F.col("valid_time").alias("valid_time_mask"),
        F.array_repeat("valid_patch", F.size("patches")).alias("valid_patch_mask"),
        *(F.col(f"s.{c}").alias(c) for c in ("mean", "std_used", "constant")),
        F.struct("label", F.col("label").alias("target_window"), F.lit(target_col).alias("target_col"), F.lit(target_policy).alias("target_policy")).alias("target"),
        F.struct(F.col("w_idx").cast("long").alias("w_idx"), F.col("start").cast("long").alias("start"), "n_rows", *(c.alias(n) for n, c in said.items()), F.lit(window).alias("window_size"), F.lit(patch).alias("patch_size")).alias("meta"),
    )


def repeat_mask(mask: Column, channels: int) -> Column:
    """A mask over time as one over (channel, time)."""
    return F.array_repeat(mask, channels)


def partial_patches(valid_time: Column, patch: int, n: int) -> Column:
    """For each patch whether some but not all of its rows are valid."""
    cut = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.slice(valid_time, i * patch + 1, patch))
    return F.transform(cut, lambda p: F.exists(p, lambda x: x) & ~F.forall(p, lambda x: x))


def choose_masks(cells: DataFrame, group: list[str], ratio: float, least: int = 1, seed: int = 0) -> DataFrame:
    """masked: which valid patches of each group are hidden.

    cells has one row for each patch (group, patch, valid). The number is the rounded
    share of the valid ones, at least `least`, and all at most; picks are by hash.
    """
    n_valid = F.sum(F.col("valid").cast("int")).over(Window.partitionBy(*group))
    want = F.least(n_valid, F.greatest(F.lit(least), F.bround(n_valid * F.lit(ratio))))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in [*group, "patch"])))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.col("valid").desc(), key, "patch"))
    return cells.withColumn("masked", F.col("valid") & (rank <= want))


def mask_ratio(cells: DataFrame, *by: str) -> DataFrame:
    """Share of the valid patches that are masked; 0 where none is valid."""
    valid = F.sum(F.col("valid").cast("int"))
    both = F.sum((F.col("masked") & F.col("valid")).cast("int"))
    return cells.groupBy(*by).agg(F.when(valid > 0, both / valid).otherwise(0.0).alias("mask_ratio"))


def reconstruction_error(cells: DataFrame, *by: str, reduction: str = "mean") -> DataFrame:
    """Errors over masked patches' valid time steps: their "mean" or "sum"; "none" leaves the
    cells that count with their squared and absolute error.

    cells: one row for each time step (.., target, prediction, masked, valid). Gives mse,
    mae, the steps that count and the padding that was left out; 0 if nothing counts.
    """
    counts = F.col("masked") & F.col("valid")
    d = F.col("prediction") - F.col("target")
    if reduction == "none":
        return cells.where(counts).withColumns({"mse": d * d, "mae": F.abs(d)})
    if reduction not in ("mean", "sum"):
        raise ValueError(f"unknown reduction {reduction!r}")
    n = F.sum(counts.cast("int")) if reduction == "mean" else F.lit(1)
    elements = F.sum(counts.cast("int"))
    return cells.groupBy(*by).agg(
        (F.coalesce(F.sum(F.when(counts, d * d)), F.lit(0.0)) / F.greatest(n, F.lit(1))).alias("mse"),
        (F.coalesce(F.sum(F.when(counts, F.abs(d))), F.lit(0.0)) / F.greatest(n, F.lit(1))).alias("mae"),
        F.coalesce(elements, F.lit(0)).alias("n_elements"),
        F.count_if(F.col("masked") & ~F.col("valid")).alias("padding_ignored"),
    )


def pool(tokens: DataFrame, key: list[str]) -> DataFrame:
    """Masked mean over valid patches, then over channels that aren't constant.

    tokens: (key, channel, patch, dim, value, valid, constant). If all channels are
    constant those with a valid patch count; without any the embedding is 0.
    """
    per = tokens.groupBy(*key, "channel", "dim").agg(F.avg(F.when(F.col("valid"), F.col("value"))).alias("v"), F.max("constant").alias("constant"))
    varied = F.avg(F.when(~F.col("constant"), F.col("v")))
    return per.groupBy(*key, "dim").agg(F.coalesce(varied, F.avg("v"), F.lit(0.0)).alias("value"))


def channel_vector(settings: list[str], sensors: list[str]) -> Column:
    """The channels of a row: operating settings, then sensors."""
    return F.array(*(F.col(c).cast("double") for c in [*settings, *sensors]))


def patch_time_mask(valid: Column, n_patches: int, patch: int) -> Column:
    """valid_time cut into patches: for each of `n_patches` its `patch` steps' validity."""
    return F.transform(F.sequence(F.lit(0), F.lit(n_patches - 1)), lambda i: F.slice(valid, i * patch + 1, F.lit(patch)))
