"""Tables, logs, run results and groups as JSON and CSV, and reports written back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG_SCHEMA = "step long, kind string, dataset string, client string, loss double, grad_norm double, optimizer_applied boolean, amp_nonfinite_grad boolean, grad_norm_nonfinite_kind string"
RUN_SCHEMA = "dataset string, mode string, config_hash string, n_classes int, best_epoch int, best_value string, batch_size_effective int, elapsed_seconds double, status string, test_metrics struct<n_samples: int, accuracy: double, balanced_accuracy: double, macro_f1: double>"
REQUIRED = ["experiment_id", "dataset", "mode", "status", "primary_metric_name"]


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").csv(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def read_log(spark: SparkSession, path: str, schema: str = LOG_SCHEMA) -> DataFrame:
    """Lines of a log; NaN and Infinity are numbers, broken lines stand in `broken`."""
    return spark.read.schema(f"{schema}, broken string").option("columnNameOfCorruptRecord", "broken").json(path)


def log_overview(log: DataFrame) -> DataFrame:
    """Lines, broken lines, steps and records of another kind."""
    good = F.col("broken").isNull()
    return log.agg(F.count("*").alias("n_lines"), F.count_if(~good).alias("n_broken"), F.count_if(good & F.col("kind").isNull()).alias("n_steps"), F.count_if(good & F.col("kind").isNotNull()).alias("n_other"))


def flatten_groups(groups: DataFrame, text: str = "json") -> DataFrame:
    """client, dataset and counts from nested groups in any of their three shapes: lists
    of structs, maps of structs, lists of names. Missing counts are 0."""
    counts = "n_windows: bigint, n_temporal_patches: bigint, n_channel_patches: bigint"
    outer = F.from_json(F.get_json_object(text, "$.clients"), "map<string, struct<datasets: string>>")
    items = groups.select(F.explode(outer).alias("client", "v")).select("client", F.col("v.datasets").alias("d"))
    listed = items.where(F.col("d").startswith("[{")).select("client", F.explode(F.from_json("d", f"array<struct<dataset: string, {counts}>>")).alias("x")).select("client", "x.*")
    named = items.where(~F.col("d").startswith("[{") & F.col("d").startswith("[")).select("client", F.explode(F.from_json("d", "array<string>")).alias("dataset"))
    mapped = items.where(F.col("d").startswith("{")).select("client", F.explode(F.from_json("d", f"map<string, struct<{counts}>>")).alias("dataset", "x")).select("client", "dataset", "x.*")
    out = listed.unionByName(mapped).unionByName(named, allowMissingColumns=True)
    return out.select("client", "dataset", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_windows", "n_temporal_patches", "n_channel_patches")))


def read_runs(spark: SparkSession, pattern: str, schema: str = RUN_SCHEMA) -> DataFrame:
    """Run infos with dataset and mode from their paths .../dataset/mode/run_info.json."""
    rows = spark.read.schema(schema).option("multiLine", "true").json(pattern).withColumn("path", F.col("_metadata.file_path"))
    return rows.withColumn("dataset", F.regexp_extract("path", r"([^/]*)/[^/]*/[^/]*$", 1)).withColumn("mode", F.regexp_extract("path", r"([^/]*)/[^/]*$", 1))


def run_results(runs: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """Result rows: the primary metric is the best value if it is a number."""
    best = F.col("best_value").try_cast("double")
    out = runs.select("dataset", "mode", "config_hash", best.alias("primary_metric_value"), F.when(best.isNotNull(), "ok").otherwise("partial").alias("status"), "elapsed_seconds", F.lit(None).cast("string").alias("error"))
    return out.unionByName(failures, allowMissingColumns=True) if failures is not None else out


def comparison_rows(runs: DataFrame) -> DataFrame:
    return runs.select("dataset", "mode", "config_hash", "n_classes", "best_epoch", "batch_size_effective", "test_metrics.*")


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Result rows of a tree; a broken file is a row with its text in `broken`."""
    return spark.read.schema(f"{schema}, broken string").option("columnNameOfCorruptRecord", "broken").option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "result_row.json").json(path)


def missing_fields(rows: DataFrame, required: list[str] = REQUIRED) -> DataFrame:
    """Rows that lack required fields, with their names."""
    lacking = F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in required)))
    return rows.withColumn("missing", lacking).where(F.size("missing") > 0)


def unknown_categories(rows: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    return rows.where(F.col(column).isNotNull() & ~F.col(column).isin(allowed))


def flatten_extra(rows: DataFrame, column: str = "extra", most: int = 1000) -> DataFrame:
    """The map's keys as columns extra__key, in key order; more than `most` are an error."""
    keys = sorted(r[0] for r in rows.select(F.explode(F.map_keys(column)).alias("k")).distinct().limit(most + 1).collect())
    if len(keys) > most:
        raise ValueError(f"{column} has more than {most} keys")
    return rows.select(*(c for c in rows.columns if c != column), *(F.col(column)[k].alias(f"{column}__{k}") for k in keys))


def report(df: DataFrame, path: str, form: str = "csv") -> None:
    """A table as CSV (lists as JSON text) or JSON; what was there is replaced at commit."""
    if form == "csv":
        nested = (T.ArrayType, T.MapType, T.StructType)
        df = df.select(*(F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema))
    writer = df.write.mode("overwrite")
    writer.option("header", "true").csv(path) if form == "csv" else writer.json(path)


def write_results(rows: DataFrame, path: str) -> None:
    """Result rows as JSON and as CSV with the extra columns; lacking fields are an error."""
    bad = missing_fields(rows).select("missing").first()
    if bad is not None:
        raise ValueError(f"required fields are missing: {bad['missing']}")
    report(rows, f"{path}/json", "json")
    report(flatten_extra(rows) if "extra" in rows.columns else rows, f"{path}/csv")


def value_check(runs: DataFrame, expected: DataFrame) -> DataFrame:
    """Fields that differ from what is expected: (dataset, mode, field, value) in text."""
    fields = [c for c, t in runs.dtypes if c not in ("dataset", "mode") and not t.startswith(("struct", "array", "map"))]
    long = runs.select("dataset", "mode", F.inline(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("observed")) for c in fields))))
    return long.join(expected, ["dataset", "mode", "field"]).where("not (observed <=> value)")


def bank_checkpoints(spark: SparkSession, path: str) -> DataFrame:
    """name and path of the included checkpoints that have one."""
    bank = spark.read.schema("included array<struct<name: string, path: string>>").option("multiLine", "true").json(path)
    return bank.select(F.inline("included")).where("path is not null")
