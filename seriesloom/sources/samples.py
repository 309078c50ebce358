"""Samples at rest: Parquet by dataset and split, manifests, and idempotent writes."""

from __future__ import annotations

import io
import json
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .archives import REQUIRED, split_member

def write_samples(samples: DataFrame, path: str, per_file: int = 5000) -> None:
    """Samples by dataset and split; only the partitions that are written are replaced."""
    spread = samples.repartition("dataset", "split", F.floor(F.pmod(F.xxhash64("key"), F.lit(64))))
    ordered = spread.sortWithinPartitions("dataset", "split", "key")
    ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", per_file).partitionBy("dataset", "split").parquet(path)


def read_samples(spark: SparkSession, path: str, dataset: str | None = None, split: str | None = None) -> DataFrame:
    """Samples; dataset and split prune the partitions that are read."""
    df = spark.read.parquet(path)
    df = df.where(F.col("dataset") == dataset) if dataset else df
    return df.where(F.col("split") == split) if split else df


def inspect(samples: DataFrame, n: int) -> DataFrame:
    """Shapes of the first n samples, and whether some patch is partly padded."""
    p = F.col("patches")
    some = F.exists(F.col("valid_time_mask"), lambda x: ~x)
    return samples.orderBy("key").limit(n).select("key", F.size(p).alias("c"), F.size(p[0]).alias("n"), F.size(p[0][0]).alias("p"), F.size("valid_time_mask").alias("w"), some.alias("padded"))


def check_shapes(samples: DataFrame, c: int, n: int, p: int) -> DataFrame:
    """One row of a read-back: samples, and those of another shape or without a field.
    All rows are checked, not the first file's only."""
    x = F.col("patches")
    shape = (F.size(x) == c) & F.forall(x, lambda row: (F.size(row) == n) & F.forall(row, lambda q: F.size(q) == p))
    whole = F.col("key").isNotNull() & x.isNotNull() & F.col("valid_time_mask").isNotNull()
    return samples.agg(F.count("*").alias("n_samples"), F.count_if(~whole).alias("n_missing"), F.count_if(whole & ~shape).alias("n_shape"), F.count_if(F.size("valid_time_mask") != n * p).alias("n_mask"))


def mixed_batches(samples: DataFrame) -> DataFrame:
    """Batches whose samples differ in shape."""
    p = F.col("patches")
    shape = F.struct(F.size(p), F.size(p[0]), F.size(p[0][0]))
    return samples.groupBy("dataset", "batch").agg(F.count_distinct(shape).alias("n_shapes")).where("n_shapes > 1")


def import_archives(spark: SparkSession, pattern: str, strict: bool = True) -> DataFrame:
    """Samples of TAR archives of under 2 GB that only Spark can reach, a task for each
    archive: key, fields (name to bytes) and the members that aren't known. A sample that
    lacks a required field is an error if strict. `archives.read_archives` splits archives."""
    schema = "archive string, key string, fields map<string, binary>, unknown array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                samples: dict[str, dict[str, bytes]] = {}
                unknown: list[str] = []
                with tarfile.open(fileobj=io.BytesIO(content)) as archive:
                    for member in archive:
                        if not member.isfile():
                            continue
                        key, field = split_member(member.name)
                        if field is None:
                            unknown.append(member.name)
                        else:
                            samples.setdefault(key, {})[field] = archive.extractfile(member).read()
                for key, fields in samples.items():
                    if strict and not set(REQUIRED) <= set(fields):
                        raise ValueError(f"{path}: {key} lacks {sorted(set(REQUIRED) - set(fields))}")
                keys = sorted(samples)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(keys), pa.string()), pa.array(keys, pa.string()), pa.array([list(samples[k].items()) for k in keys], pa.map_(pa.string(), pa.binary())), pa.array([unknown] * len(keys), pa.list_(pa.string()))],
                    names=["archive", "key", "fields", "unknown"],
                )

    files = spark.read.format("binaryFile").load(pattern).select("path", "content")
    return files.mapInArrow(run, schema)


def manifest(samples: DataFrame, config: dict, config_hash: str) -> DataFrame:
    """A row for each dataset: samples, units, and target range of each split."""
    per = samples.groupBy("dataset", "split").agg(F.count("*").alias("n_samples"), F.count_distinct("unit").alias("n_units"), F.min("target").alias("target_min"), F.max("target").alias("target_max"))
    splits = F.map_from_entries(F.sort_array(F.collect_list(F.struct("split", F.struct("n_samples", "n_units", "target_min", "target_max")))))
    return per.groupBy("dataset").agg(F.sum("n_samples").alias("n_samples"), splits.alias("splits")).select("*", F.lit(config_hash).alias("config_hash"), F.lit(json.dumps(config, sort_keys=True)).alias("config"))


def manifest_summary(manifests: DataFrame) -> DataFrame:
    units = F.aggregate(F.map_values("splits"), F.lit(0).cast("long"), lambda a, s: a + s["n_units"])
    return manifests.select("dataset", "config_hash", "n_samples", units.alias("n_units"), F.size("splits").alias("n_splits"))


def manifest_differences(manifests: DataFrame, expected: DataFrame, metrics: list[str], tolerance: float = 1e-3) -> DataFrame:
    """Datasets whose hash or metrics differ from what is expected; nulls are equal."""
    both = manifests.alias("a").join(expected.alias("b"), "dataset")
    off = ~F.col("a.config_hash").eqNullSafe(F.col("b.config_hash"))
    for m in metrics:
        x, y = F.col(f"a.{m}"), F.col(f"b.{m}")
        off = off | ~(x.eqNullSafe(y) | F.coalesce(F.abs(x - y) <= tolerance, F.lit(False)))
    return both.where(off).select("dataset")


def planned_actions(wanted: DataFrame, manifests: DataFrame, force: bool = False) -> DataFrame:
    """FORCE, PROCESS, STALE or SKIP for each dataset (dataset, config_hash), and why."""
    last = latest_manifests(manifests) if "written" in manifests.columns else manifests
    there = last.select("dataset", F.col("config_hash").alias("old"))
    out = wanted.join(there, "dataset", "left")
    action = F.when(F.lit(force), "FORCE").when(F.col("old").isNull(), "PROCESS").when(F.col("old") != F.col("config_hash"), "STALE").otherwise("SKIP")
    reason = F.when(F.lit(force), "asked for").when(F.col("old").isNull(), "no manifest").when(F.col("old") != F.col("config_hash"), "another configuration").otherwise("up to date")
    return out.select("dataset", action.alias("action"), reason.alias("reason"))


def latest_manifests(manifests: DataFrame) -> DataFrame:
    """The row of each dataset that was written last."""
    return manifests.groupBy("dataset").agg(F.max_by(F.struct(*manifests.columns), "written").alias("m")).select("m.*")


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """name, size and SHA-256 of files; the content stays in the tasks."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def copy_status(source: DataFrame, copy: DataFrame, largest: int | None = None) -> DataFrame:
    """identical, different, to copy, too large or missing for each file of either side."""
    a, b = source.alias("a"), copy.alias("b")
    large = F.col("a.size") > largest if largest else F.lit(False)
    status = F.when(F.col("a.name").isNull(), "missing").when(F.col("a.sha256") == F.col("b.sha256"), "identical").when(large, "too large").when(F.col("b.name").isNull(), "to copy").otherwise("different")
    return a.join(b, F.col("a.name") == F.col("b.name"), "full").select(F.coalesce("a.name", "b.name").alias("name"), status.alias("status"))


def download_status(catalogue: DataFrame, files: DataFrame) -> DataFrame:
    """done, retry (another size) or pending for each dataset (name, size)."""
    f = files.select("name", F.col("size").alias("found"))
    status = F.when(F.col("found").isNull(), "pending").when(F.col("found") == F.col("size"), "done").otherwise("retry")
    return catalogue.join(f, "name", "left").select("name", "size", status.alias("status"))
