"""Engine sensor text: rows, official lifetimes and the inventory of raw files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

N_SETTINGS, N_SENSORS = 3, 21


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 0, as in the file) and value of text files, in splits of any number.

    A row knows its split's place in the file and its own place in the split, so what is
    joined is one row for each split: the lines before it.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    splits = rows.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")
    return rows.join(splits.withColumn("before", before), ["file", "block"]).select("file", (F.col("before") + F.col("at") - F.col("first")).alias("line"), "value")


def parse_sensor_lines(lines: DataFrame) -> DataFrame:
    """Lines (fd, source_split, line, value) as unit, cycle, settings and sensors; `fault`
    says what is wrong with a line, blank ones are left out."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = lines.where(F.trim("value") != "").select("fd", "source_split", "line", parts.alias("p"))
    number = lambda i: F.get("p", F.lit(i)).try_cast("double")
    unit, cycle = number(0), number(1)
    whole = lambda c: c.isNotNull() & (c == F.floor(c)) & (c > 0)
    floats = F.transform("p", lambda x: x.try_cast("float"))
    width = F.size("p") == 2 + N_SETTINGS + N_SENSORS
    fault = F.when(~width, "columns").when(~whole(unit), "unit").when(~whole(cycle), "cycle")
    return rows.select(
        "fd",
        "source_split",
        unit.cast("long").alias("unit_id"),
        cycle.cast("long").alias("cycle"),
        F.slice(floats, 3, N_SETTINGS).alias("op"),
        F.slice(floats, 3 + N_SETTINGS, N_SENSORS).alias("sensors"),
        fault.alias("fault"),
        "line",
    )


def read_sensor_text(spark: SparkSession, path: str, subset: str, split: str) -> DataFrame:
    """Lines of unit, cycle, settings and sensors, with their line in the file."""
    lines = numbered_lines(spark, path)
    return parse_sensor_lines(lines.select(F.lit(subset).alias("fd"), F.lit(split).alias("source_split"), "line", "value"))


def order_faults(rows: DataFrame) -> DataFrame:
    """Rows whose cycle doesn't exceed the one before of their unit, in the file's order:
    repeats, and cycles that fall."""
    before = F.lag("cycle").over(Window.partitionBy("fd", "source_split", "unit_id").orderBy("line"))
    return rows.withColumn("before", before).where("cycle <= before")


def parse_life_lines(lines: DataFrame) -> DataFrame:
    """Lines (fd, line, value) of one whole number of at least 0; the i-th that isn't blank
    is of unit i."""
    some = lines.where(F.trim("value") != "").select("fd", F.trim("value").alias("text"), "line")
    unit = F.row_number().over(Window.partitionBy("fd").orderBy("line"))  # a line for each test unit
    rul = F.when(F.col("text").rlike(r"^\d+(\.0+)?$"), F.col("text").cast("double").cast("int"))
    return some.select("fd", unit.cast("long").alias("unit_id"), rul.alias("rul"), F.when(rul.isNull(), "rul").alias("fault"))


def read_official_life(spark: SparkSession, path: str, subset: str) -> DataFrame:
    """One whole number of at least 0 a line; line i is unit i."""
    return parse_life_lines(numbered_lines(spark, path).select(F.lit(subset).alias("fd"), "line", "value"))


def life_faults(rows: DataFrame, official: DataFrame) -> DataFrame:
    """Subsets whose test units aren't 1..n for the n official values."""
    units = rows.where("source_split = 'test'").groupBy("fd").agg(F.count_distinct("unit_id").alias("n_units"), F.max("unit_id").alias("last"))
    values = official.groupBy("fd").agg(F.count("*").alias("n_values"))
    return units.join(values, "fd", "full").where("not (n_units <=> n_values and last <=> n_values)")


def raw_inventory(spark: SparkSession, path: str) -> DataFrame:
    """fd and how many train, test and RUL files there are of it; fd is null for others."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    pattern = r"^(train|test|RUL)_(FD\d{3})\.txt$"
    found = files.select(F.nullif(F.regexp_extract(name, pattern, 2), F.lit("")).alias("fd"), F.regexp_extract(name, pattern, 1).alias("kind"))
    return found.groupBy("fd").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("train", "test", "RUL")), F.count("*").alias("n_files"))
