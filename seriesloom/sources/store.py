"""A versioned store of samples.

A run stages its files under its own name; what it staged is read back, and the manifest
that lists these files, with rows, sizes and checksums, is the commit: one file that appears
as a whole, written last. Readers follow the last manifest of a dataset, so a run that broke
off shows nothing, and a split that a new version doesn't have is gone. Files are never
changed once they are there; `expire` deletes those that no kept version lists.

    {path}/data/run=<run>/dataset=<dataset>/split=<split>/*.parquet
    {path}/manifest/*.parquet
"""

from __future__ import annotations

import json
import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOLERANCE = 1e-3  # within which a metric is the expected one
PLACE = T.StructType().add("run", "string").add("dataset", "string").add("split", "string")


def _files(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), place


def _there(spark: SparkSession, path: str) -> bool:
    system, place = _files(spark, path)
    return system.exists(place)


def _content(schema: T.StructType) -> Column:
    """Hash of a row; maps count by their sorted entries."""
    plain = [F.to_json(f.name) if isinstance(f.dataType, T.MapType) else F.col(f.name) for f in schema if f.name not in ("dataset", "split", "run")]
    return F.xxhash64(*plain)


def _placed(schema: T.StructType) -> T.StructType:
    """A schema of samples with the parts of their path at the end."""
    return T.StructType([f for f in schema if f.name not in PLACE.names] + PLACE.fields)


def _file_table(staged: DataFrame, *by: str) -> DataFrame:
    """dataset, split, name, bytes, rows and checksum of each file. The checksum doesn't
    depend on the order of rows, and counts repeated ones."""
    h = _content(staged.schema)
    rows = staged.select(*by, "dataset", "split", F.col("_metadata.file_path").alias("at"), F.col("_metadata.file_size").alias("bytes"), h.alias("h"))
    total = F.sum(F.col("h").cast("decimal(38,0)"))
    per = rows.groupBy(*by, "dataset", "split", "at", "bytes").agg(F.count("*").alias("rows"), F.concat_ws(":", F.hex(F.bit_xor("h")), total.cast("string")).alias("checksum"))
    return per.select(*by, "dataset", "split", F.regexp_extract("at", r"([^/]*)$", 1).alias("name"), "bytes", "rows", "checksum")


def _staged(spark: SparkSession, path: str, run: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/data/run={run}")


def stage(samples: DataFrame, path: str, run: str | None = None, per_file: int = 5000) -> str:
    """Write samples (dataset, split, key, ...) under the name of a run, which is returned.

    Files hold at most `per_file` rows of a dataset and split; however many there are, they
    are spread over tasks of like size.
    """
    run = run or uuid.uuid4().hex
    ordered = samples.hint("rebalance", "dataset", "split").sortWithinPartitions("dataset", "split", "key")
    ordered.write.mode("errorifexists").option("maxRecordsPerFile", per_file).partitionBy("dataset", "split").parquet(f"{path}/data/run={run}")
    return run


def commit(
    spark: SparkSession, path: str, run: str, schema: T.StructType, config: dict, config_hash: str, metrics: DataFrame | None = None, warnings: DataFrame | None = None
) -> int:
    """Make a staged run the current version of its datasets; how many these are.

    `schema` is that of the samples; metrics (dataset, metrics: map of name to double) and
    warnings (dataset, warnings: list) go into the manifest. A run without files changes
    nothing.
    """
    staged = _staged(spark, path, run, schema)
    files = _file_table(staged).groupBy("dataset").agg(F.sort_array(F.collect_list(F.struct("split", "name", "bytes", "rows", "checksum"))).alias("files"))
    per = staged.groupBy("dataset", "split").agg(F.count("*").alias("n_samples"), F.count_distinct("unit").alias("n_units"), F.min("target").alias("target_min"), F.max("target").alias("target_max"))
    splits = F.map_from_entries(F.sort_array(F.collect_list(F.struct("split", F.struct("n_samples", "n_units", "target_min", "target_max")))))
    out = per.groupBy("dataset").agg(F.sum("n_samples").alias("n_samples"), splits.alias("splits")).join(files, "dataset")
    none = F.lit(None).cast("map<string, double>")
    out = out.join(metrics.select("dataset", "metrics"), "dataset", "left") if metrics is not None else out.withColumn("metrics", none)
    out = out.join(warnings.select("dataset", "warnings"), "dataset", "left") if warnings is not None else out.withColumn("warnings", F.array().cast("array<string>"))
    before = _last_versions(spark, path)
    out = out.join(before, "dataset", "left").withColumn("version", F.coalesce(F.col("last") + 1, F.lit(1)).cast("long")).drop("last")
    out = out.select("*", F.lit(run).alias("run"), F.lit(config_hash).alias("config_hash"), F.lit(json.dumps(config, sort_keys=True)).alias("config"), F.current_timestamp().alias("written"))
    n = out.count()
    if n:
        out.coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return n


def history(spark: SparkSession, path: str) -> DataFrame:
    """All manifests, a row for each dataset and version."""
    if not _there(spark, f"{path}/manifest"):
        raise ValueError(f"nothing is committed at {path}")
    return spark.read.parquet(f"{path}/manifest")


def _last_versions(spark: SparkSession, path: str) -> DataFrame:
    if not _there(spark, f"{path}/manifest"):
        return spark.createDataFrame([], "dataset string, last long")
    return history(spark, path).groupBy("dataset").agg(F.max("version").alias("last"))


def current(manifests: DataFrame, version: int | None = None) -> DataFrame:
    """The last manifest of each dataset, or its last one up to a version. Of two runs that
    committed one version at once the later one holds."""
    rows = manifests.where(F.col("version") <= version) if version else manifests
    return rows.groupBy("dataset").agg(F.max_by(F.struct(*rows.columns), F.struct("version", "written", "run")).alias("m")).select("m.*")


def read(spark: SparkSession, path: str, schema: T.StructType, dataset: str | None = None, split: str | None = None, version: int | None = None) -> DataFrame:
    """Samples of the current version (or of an earlier one) of each dataset; dataset and
    split prune the partitions that are read."""
    last = current(history(spark, path), version).select("run", "dataset", F.explode(F.map_keys("splits")).alias("split"))
    data = spark.read.schema(_placed(schema)).parquet(f"{path}/data")
    for name, value in (("dataset", dataset), ("split", split)):
        if value:
            last, data = last.where(F.col(name) == value), data.where(F.col(name) == value)
    return data.join(last, ["run", "dataset", "split"]).select(*schema.names)


def _listing(spark: SparkSession, path: str) -> DataFrame:
    """run, dataset, split, name and size of all files at rest; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{path}/data").select("path", "length")
    part = lambda name: F.url_decode(F.regexp_replace(F.regexp_extract("path", f"/{name}=([^/]*)/", 1), r"\+", "%2B"))
    return files.select(part("run").alias("run"), part("dataset").alias("dataset"), part("split").alias("split"), F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), F.col("length").alias("found"))


def damaged_files(spark: SparkSession, path: str, content: bool = False, schema: T.StructType | None = None) -> DataFrame:
    """Files of current versions that are missing, of another size, or that no manifest of
    their run lists; with `content` also those with other rows: dataset, split, name, fault."""
    said = current(history(spark, path)).select("run", "dataset", F.inline("files"))
    runs = said.select("run", "dataset").distinct()
    key = ["run", "dataset", "split", "name"]
    both = said.join(_listing(spark, path).join(runs, ["run", "dataset"], "left_semi"), key, "full")
    fault = F.when(F.col("found").isNull(), "missing").when(F.col("bytes").isNull(), "not listed").when(F.col("found") != F.col("bytes"), "size")
    out = both.select("dataset", "split", "name", fault.alias("fault")).where("fault is not null")
    if not content:
        return out
    now = _file_table(spark.read.schema(_placed(schema)).parquet(f"{path}/data"), "run").withColumnRenamed("checksum", "now")
    return out.unionByName(said.join(now.select(*key, "now"), key).where("checksum <> now").select("dataset", "split", "name", F.lit("content").alias("fault")))


def _metric_faults(tolerance: float) -> Column:
    """Names of metrics that differ; those that one side lacks are no fault."""
    both = F.array_intersect(F.map_keys("metrics"), F.map_keys("expected"))
    off = F.filter(both, lambda k: F.abs(F.col("metrics")[k] - F.col("expected")[k]) > tolerance)
    return F.coalesce(off, F.array().cast("array<string>"))


def actions(spark: SparkSession, path: str, wanted: DataFrame, force: bool = False, tolerance: float = TOLERANCE) -> DataFrame:
    """dataset, action and reason for each wanted dataset (dataset, config_hash, and perhaps
    expected: map of metrics): FORCE, PROCESS (no manifest), STALE (another configuration or
    metric, lost or changed files) or SKIP."""
    wanted = wanted if "expected" in wanted.columns else wanted.withColumn("expected", F.lit(None).cast("map<string, double>"))
    if _there(spark, f"{path}/manifest"):
        last = current(history(spark, path)).select("dataset", F.col("config_hash").alias("old"), "metrics")
        bad = damaged_files(spark, path).groupBy("dataset").agg(F.min(F.concat_ws(" ", "fault", "name")).alias("bad"))
    else:
        last, bad = (spark.createDataFrame([], s) for s in ("dataset string, old string, metrics map<string, double>", "dataset string, bad string"))
    both = wanted.join(last, "dataset", "left").join(bad, "dataset", "left").withColumn("off", _metric_faults(tolerance))
    cases = [
        (F.lit(force), "FORCE", F.lit("asked for")),
        (F.col("old").isNull(), "PROCESS", F.lit("no manifest")),
        (F.col("old") != F.col("config_hash"), "STALE", F.lit("another configuration")),
        (F.size("off") > 0, "STALE", F.concat(F.lit("metric "), F.array_join("off", ", "))),
        (F.col("bad").isNotNull(), "STALE", F.concat(F.lit("file "), F.col("bad"))),
        (F.lit(True), "SKIP", F.lit("up to date")),
    ]
    chosen = F.coalesce(*(F.when(when, F.struct(F.lit(action).alias("action"), reason.alias("reason"))) for when, action, reason in cases))
    return both.select("dataset", chosen.alias("c")).select("dataset", "c.*")


def publish(
    samples: DataFrame,
    path: str,
    config: dict,
    config_hash: str,
    metrics: DataFrame | None = None,
    force: bool = False,
    strict: bool = False,
    run: str | None = None,
    per_file: int = 5000,
) -> int:
    """Stage and commit the datasets that don't stand in this configuration; how many these
    were. `metrics` (dataset, metrics) are what the manifests have to agree with, and go
    into the new ones; strict: another configuration is an error, nothing is written."""
    spark = samples.sparkSession
    wanted = samples.select("dataset").distinct().withColumn("config_hash", F.lit(config_hash))
    if metrics is not None:
        wanted = wanted.join(metrics.select("dataset", F.col("metrics").alias("expected")), "dataset", "left")
    todo = actions(spark, path, wanted, force).where("action <> 'SKIP'")
    if strict and (bad := todo.where("reason = 'another configuration'").first()):
        raise ValueError(f"{bad['dataset']} is there in another configuration")
    if todo.isEmpty():
        return 0
    run = stage(samples.join(todo.select("dataset"), "dataset", "left_semi").select(*samples.columns), path, run, per_file)
    return commit(spark, path, run, samples.schema, config, config_hash, metrics)


def summary(manifests: DataFrame) -> DataFrame:
    """What a run reports of datasets that stand: units over all splits, files, sizes, and
    how many warnings."""
    units = F.aggregate(F.map_values("splits"), F.lit(0).cast("long"), lambda a, s: a + s["n_units"])
    size = F.aggregate("files", F.lit(0).cast("long"), lambda a, f: a + f["bytes"])
    return current(manifests).select(
        "dataset", "version", "run", "config_hash", "n_samples", units.alias("n_units"), F.size("splits").alias("n_splits"), F.size("files").alias("n_files"), (size / 1e6).alias("size_mb"), F.coalesce(F.size("warnings"), F.lit(0)).alias("n_warnings")
    )


def expire(spark: SparkSession, path: str, keep: int = 1, also_runs: list[str] | None = None) -> int:
    """Delete the files of versions before the last `keep` of their dataset, and runs named
    in `also_runs` that broke off; how many directories went. Other runs without a manifest
    may be under way and stay."""
    system, _ = _files(spark, path)
    rows = history(spark, path)
    last = current(rows).select("dataset", F.col("version").alias("last"))
    kept = rows.join(last, "dataset").withColumn("old", F.col("version") <= F.col("last") - keep).select("run", "dataset", "old").distinct().collect()  # a row for each version
    gone = {(r["run"], r["dataset"]) for r in kept if r["old"]} - {(r["run"], r["dataset"]) for r in kept if not r["old"]}
    committed = {r["run"] for r in kept}
    n = 0
    for status in system.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/data/run=*/dataset=*")) or []:
        place = status.getPath()
        name = unquote(place.getParent().getName()[4:]), unquote(place.getName()[8:])
        if name in gone or (name[0] in (also_runs or []) and name[0] not in committed):
            n += system.delete(place, True)
    return n
