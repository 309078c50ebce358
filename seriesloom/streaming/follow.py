"""A metrics log followed as a stream.

Statistics are kept for pages of PAGE steps: sums, counts of a histogram with bins of 2 %,
and a bit for each step that was seen, so repeated lines count once. Pages merge into
buckets, and a page's state has a fixed size, whatever the number of lines and batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.values import finite, nonfinite_kind
from ..operators.runlog import in_buckets
from ..sources.records import LOG_SCHEMA

PAGE = 1 << 15
GROWTH = 1.02  # of the histogram's bins
LEAST, MOST = 1e-9, 1e9  # sizes beyond are in the bins at the ends
TOP = math.ceil(math.log(MOST / LEAST) / math.log(GROWTH))

_STATE = "seen binary, n long, n_nonfinite long, total double, low double, high double, clean_n long, clean_total double, counts binary"
_PAGES = "bucket string, page long, n long, n_nonfinite long, total double, low double, high double, clean_n long, clean_total double, bins array<int>, counts array<long>"


def follow_log(spark: SparkSession, path: str, schema: str = LOG_SCHEMA, files_at_once: int | None = None) -> DataFrame:
    """Lines of JSON as they arrive in a folder; broken ones stand in `broken`."""
    reader = spark.readStream.schema(f"{schema}, broken string").option("columnNameOfCorruptRecord", "broken")
    return (reader.option("maxFilesPerTrigger", files_at_once) if files_at_once else reader).json(path)


def nonfinite_stream(log: DataFrame) -> DataFrame:
    """Running counts of non-finite losses and gradients; its state has a row for each
    dataset and kind."""
    kinds = F.array_distinct(F.array_compact(F.array(nonfinite_kind(F.col("loss")), nonfinite_kind(F.col("grad_norm")))))
    return log.select("dataset", F.explode(kinds).alias("kind")).groupBy("dataset", "kind").agg(F.count("*").alias("n"))


def loss_bin(x: Column) -> Column:
    """The histogram bin of a finite number: 0 near zero, negative ones for negative numbers."""
    k = F.least(F.lit(TOP), F.floor(F.log(F.abs(x) / LEAST) / math.log(GROWTH)) + 1)
    return F.when(F.abs(x) < LEAST, 0).otherwise(F.signum(x) * k).cast("int")


def step_rows(log: DataFrame, buckets: list[tuple[int, int | None]]) -> DataFrame:
    """What counts of a log: its steps in buckets, with page, place in the page, finite loss,
    its bin, and whether the step is clean. Broken lines and other records are left out."""
    steps = log.where(F.col("step").isNotNull() & F.col("kind").isNull())
    steps = steps.where(F.col("broken").isNull()) if "broken" in log.columns else steps
    x = finite(F.col("loss"))
    clean = F.coalesce(F.col("optimizer_applied"), F.lit(True)) & ~F.coalesce(F.col("amp_nonfinite_grad"), F.lit(False))
    page = F.floor(F.col("step") / PAGE)
    return in_buckets(steps, buckets).select("bucket", page.alias("page"), (F.col("step") - page * PAGE).cast("int").alias("at"), x.alias("x"), nonfinite_kind(F.col("loss")).isNotNull().alias("odd"), clean.alias("clean"), loss_bin(x).alias("bin"))


def _add(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One page: the lines that are new are added to its sums, bins and seen steps."""
    if state.exists:
        seen, n, odd, total, low, high, clean_n, clean_total, counts = state.get
        seen, counts = np.frombuffer(seen, np.uint8).copy(), np.frombuffer(counts, np.int64).copy()
    else:
        seen, counts = np.zeros(PAGE // 8, np.uint8), np.zeros(2 * TOP + 1, np.int64)
        n, odd, total, low, high, clean_n, clean_total = 0, 0, 0.0, math.inf, -math.inf, 0, 0.0
    bits = np.unpackbits(seen)
    for part in parts:
        part = part.sort_values(["at", "x"], na_position="last").drop_duplicates("at")
        part = part[bits[part["at"].to_numpy()] == 0]
        bits[part["at"].to_numpy()] = 1
        odd += int(part["odd"].sum())
        there = part[part["x"].notna()]
        x = there["x"].to_numpy()
        if len(x):
            n, total, low, high = n + len(x), total + float(x.sum()), min(low, float(x.min())), max(high, float(x.max()))
            good = x[there["clean"].to_numpy()]
            clean_n, clean_total = clean_n + len(good), clean_total + float(good.sum())
            np.add.at(counts, there["bin"].to_numpy().astype(np.int64) + TOP, 1)
    state.update((np.packbits(bits).tobytes(), n, odd, total, low, high, clean_n, clean_total, counts.tobytes()))
    some = np.flatnonzero(counts)
    row = [*key, n, odd, total, low if n else None, high if n else None, clean_n, clean_total, (some - TOP).tolist(), counts[some].tolist()]
    yield pd.DataFrame([row], columns=[f.split()[0] for f in _PAGES.split(", ")])


def page_stream(log: DataFrame, buckets: list[tuple[int, int | None]]) -> DataFrame:
    """The pages that a batch touches, each with all that it has so far. Of lines with one
    step the first to arrive counts; within a batch the one with the least loss."""
    return step_rows(log, buckets).groupBy("bucket", "page").applyInPandasWithState(_add, _PAGES, _STATE, "update", GroupStateTimeout.NoTimeout)


def pages(log: DataFrame, buckets: list[tuple[int, int | None]]) -> DataFrame:
    """The same pages from a whole log, without a stream."""
    rows = step_rows(log, buckets).groupBy("bucket", "page", "at").agg(F.min_by(F.struct("x", "odd", "clean", "bin"), F.struct(F.col("x").isNull(), "x")).alias("r")).select("bucket", "page", "r.*")
    x, good = F.col("x"), F.when(F.col("clean"), F.col("x"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    per = rows.groupBy("bucket", "page", "bin").agg(F.count(x).alias("n"), F.count_if("odd").alias("odd"), F.sum(x).alias("s"), F.min(x).alias("low"), F.max(x).alias("high"), F.count(good).alias("cn"), F.sum(good).alias("cs"))
    held = F.sort_array(F.collect_list(F.when(F.col("bin").isNotNull(), F.struct("bin", "n"))))  # at most 2 * TOP + 1
    out = per.groupBy("bucket", "page").agg(F.sum("n").alias("n"), F.sum("odd").alias("n_nonfinite"), zero(F.sum("s")).alias("total"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("cn").alias("clean_n"), zero(F.sum("cs")).alias("clean_total"), held.alias("h"))
    return out.select("bucket", "page", "n", "n_nonfinite", "total", "low", "high", "clean_n", "clean_total", F.transform("h", lambda h: h["bin"]).alias("bins"), F.transform("h", lambda h: h["n"]).alias("counts"))


def bucket_statistics(pages: DataFrame, shares: tuple[float, ...] = (0.1, 0.5, 0.9)) -> DataFrame:
    """Statistics of each bucket from its pages: exact but for the quantiles p<share>, which
    are right to half a bin (1 %), and within the range of the values."""
    sums = pages.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("n_nonfinite").alias("n_nonfinite"), F.sum("total").alias("s"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("clean_n").alias("cn"), F.sum("clean_total").alias("cs"))
    bins = pages.select("bucket", F.inline(F.arrays_zip("bins", "counts"))).groupBy("bucket", "bins").agg(F.sum("counts").alias("k"))
    upto = F.sum("k").over(Window.partitionBy("bucket").orderBy("bins"))  # a row for each bin
    ranked = bins.withColumn("upto", upto).join(sums, "bucket")
    size = LEAST * F.pow(F.lit(GROWTH), F.abs("bins") - 0.5)
    value = F.least(F.greatest(F.when(F.col("bins") == 0, 0.0).otherwise(F.signum("bins") * size), F.col("low")), F.col("high"))
    at = lambda s: F.min_by(value, F.when(F.col("upto") >= F.greatest(F.lit(1), F.ceil(F.lit(s) * F.col("n"))), F.col("bins")))
    cuts = ranked.groupBy("bucket").agg(*(at(s).alias(f"p{round(100 * s)}") for s in shares))
    mean = (F.col("s") / F.nullif(F.col("n"), F.lit(0))).alias("mean")
    clean = (F.col("cs") / F.nullif(F.col("cn"), F.lit(0))).alias("clean_mean")
    return sums.join(cuts, "bucket", "left").select("bucket", "n", "n_nonfinite", mean, "low", "high", clean, *(f"p{round(100 * s)}" for s in shares))


def bucket_statistics_stream(log: DataFrame, out: str, buckets: list[tuple[int, int | None]], checkpoint: str) -> StreamingQuery:
    """Keep the pages of a log at `out`: a batch replaces those that it touches, so one that
    is run again does no harm. `bucket_statistics` of the table are the log's."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "page").parquet(out)

    return page_stream(log, buckets).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_pages(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(_PAGES).parquet(out)
