"""Scalar values: slugs, labels, non-finite numbers, caps, hashes and sizes."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(c: Column, kind: str) -> Column:
    """Text of a value that can stand in an id. `kind` is the column's Spark type.

    Null and NaN give "none"; whole numbers their digits; other numbers "p" for the point
    and "n" for the sign; booleans true or false; other characters than letters and digits
    become "_".
    """
    if kind == "boolean":
        text = F.when(c, "true").otherwise("false")
    elif kind in ("float", "double"):
        whole = F.abs(c) < F.lit(2.0**63)
        text = F.when(whole & (c == F.floor(c)), c.cast("long").cast("string")).otherwise(F.replace(F.replace(c.cast("string"), F.lit("."), F.lit("p")), F.lit("-"), F.lit("n")))
        return F.when(c.isNull() | F.isnan(c), "none").otherwise(text)
    elif kind in ("tinyint", "smallint", "int", "bigint"):
        text = c.cast("string")
    else:
        text = F.regexp_replace(c.cast("string"), r"[^\p{L}\p{N}]", "_")
    return F.coalesce(text, F.lit("none"))


def trajectory_id(dataset: Column, subset: Column, split: Column, unit: Column) -> Column:
    """Key of a trajectory, from slugs."""
    return F.concat(dataset, F.lit("__subset-"), subset, F.lit("__split-"), split, F.lit("__unit-"), unit)


def asset_key(dataset: Column, subset: Column, unit: Column) -> Column:
    """Key of the unit whatever the split."""
    return F.concat(dataset, F.lit("__subset-"), subset, F.lit("__unit-"), unit)


def short_trajectory_id(split: Column, subset: Column | None, unit: Column) -> Column:
    """The audit's form of the id; null parts are left out."""
    return F.concat_ws("__", *[c.cast("string") for c in (split, subset, unit) if c is not None])


def finite(c: Column) -> Column:
    """Null in place of NaN and the infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def finite_array(c: Column) -> Column:
    return F.transform(c, finite)


def nonfinite_kind(c: Column) -> Column:
    """nan, inf or -inf; null for finite numbers and null."""
    return F.when(F.isnan(c), "nan").when(c == F.lit(float("inf")), "inf").when(c == F.lit(float("-inf")), "-inf")


def label_text(c: Column, kind: str) -> Column:
    """Class label as text: whole numbers without a point, booleans as 0 and 1."""
    if kind == "boolean":
        return c.cast("int").cast("string")
    if kind in ("float", "double"):
        return F.when(F.isnan(c), None).when(c == F.floor(c), c.cast("long").cast("string")).otherwise(c.cast("string"))
    return c.cast("string")


def first_target(*columns: Column) -> Column:
    """The first target that is there; non-finite numbers count as missing."""
    return F.coalesce(*(finite(c) for c in columns))


# The targets that samples of remaining life carry.
TARGET_KEYS = ("rul_physical", "rul_capped_125")


def pick_target(key: str, meta: Column, scalar: Column | None = None, sample: Column | None = None) -> Column:
    """A sample's target: the field target_<key> of its metadata (JSON), else its own scalar.
    Another key is an error, and so is a sample that has neither."""
    if key not in TARGET_KEYS:
        raise ValueError(f"unknown target {key!r}, one of {TARGET_KEYS} is expected")
    found = [F.get_json_object(meta, f"$.target_{key}").try_cast("double"), *([scalar.cast("double")] if scalar is not None else [])]
    lacking = F.raise_error(F.concat(F.lit("sample "), F.coalesce(sample.cast("string"), F.lit("?")) if sample is not None else F.lit("?"), F.lit(f" has no target {key}")))
    return F.coalesce(*found, lacking.cast("double"))


def capped(rul: Column, cap: float | None) -> Column:
    """Remaining life of at most `cap`, if that is a positive number."""
    return F.least(rul, F.lit(float(cap))) if cap and cap > 0 else rul


def source_split(split: Column) -> Column:
    """The raw split that a built split comes from; another name is an error."""
    return F.when(split.isin("train", "val"), "train").when(split == "test", "test").otherwise(F.raise_error(F.concat(F.lit("unknown split "), split)))


def sample_key(prefix: str, subset: Column, split: Column, source: Column, unit: Column, t: Column) -> Column:
    return F.format_string(f"{prefix}_%s_%s_%s_unit%d_w%06d", subset, split, source, unit, t)


def config_hash(config: dict, compact: bool = False) -> str:
    """16 hex digits of the SHA-256 of a configuration as JSON with sorted keys."""
    separators = (",", ":") if compact else None
    text = json.dumps(config, sort_keys=True, separators=separators, ensure_ascii=True)
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def row_hash(*columns: Column) -> Column:
    """16 hex digits for a row's columns."""
    return F.substring(F.sha2(F.to_json(F.struct(*columns)), 256), 1, 16)


def adaptive_batch(channels: Column, batch: int, max_batch_channels: int | None = None, least: int = 1) -> Column:
    """Batch size that keeps batch times channels within a budget."""
    if max_batch_channels is None:
        return F.lit(batch)
    return F.least(F.lit(batch), F.greatest(F.lit(least), F.floor(F.lit(max_batch_channels) / channels))).cast("int")


def communication_mb(params: Column, clients: Column, bytes_each: int = 4) -> Column:
    """Both ways, in MiB; invalid inputs cost nothing."""
    ok = (params > 0) & (clients > 0)
    return F.when(ok, 2.0 * params * bytes_each * clients / 2**20).otherwise(0.0)


def stable_rank_key(seed: int, *key: Column) -> Column:
    """A text that orders rows at random, the same on every run."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(k.cast("string") for k in key)))


def target_kind(name: str, kind: str, n: Column, distinct: Column, low: Column, high: Column, whole: Column) -> Column:
    """What a target is, from its name, type and a few aggregates."""
    lowered = name.lower()
    if "rul" in lowered:
        return F.when(n == 0, "sin_etiqueta").otherwise("rul")
    if "anomal" in lowered:
        return F.when(n == 0, "sin_etiqueta").otherwise("anomaly")
    if kind == "boolean":
        rest = F.lit("binary")
    elif kind in ("float", "double"):
        rest = F.when(distinct == 2, "binary").when((distinct <= 20) & whole, "multiclass").when((low >= 0) & (high > 10) & (distinct > 20), "regression_or_rul").otherwise("regression")
    else:
        rest = F.when(distinct == 2, "binary").when(distinct <= 100, "multiclass").otherwise("regression")
    return F.when(n == 0, "sin_etiqueta").otherwise(rest)
