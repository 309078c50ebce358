"""Parquet files judged by their footers: no data is read."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .archives import opened

SCHEMA = "path string, bytes long, n_rows long, column string, type string, n_null long, low string, high string, error string"


def _text(value) -> str | None:
    return None if value is None else value.decode("utf-8", "replace") if isinstance(value, bytes) else str(value)


def _of_file(path: str, size: int) -> list[tuple]:
    system, place = opened(path)
    try:
        with system.open_input_file(place) as file:
            footer = pq.read_metadata(file)
    except (pa.ArrowException, OSError) as broken:
        return [(path, size, None, None, None, None, None, None, str(broken)[:200])]
    types: dict[str, str] = {}
    for i in range(footer.num_columns):
        column = footer.schema.column(i)
        types[column.path] = column.physical_type.lower() if column.logical_type.type == "NONE" else str(column.logical_type.type).lower()
    out = []
    for i, (name, kind) in enumerate(types.items()):
        nulls, lows, highs = 0, [], []
        for g in range(footer.num_row_groups):
            stats = footer.row_group(g).column(i).statistics
            known = stats is not None and stats.has_null_count
            nulls = nulls + stats.null_count if known and nulls is not None else None
            if stats is not None and stats.has_min_max:
                lows.append(stats.min)
                highs.append(stats.max)
        out.append((path, size, footer.num_rows, name.replace(".list.element", "[]"), kind, nulls, _text(min(lows, default=None)), _text(max(highs, default=None)), None))
    return out or [(path, size, footer.num_rows, None, None, None, None, None, None)]


def read_footers(spark: SparkSession, path: str, tasks: int | None = None) -> DataFrame:
    """A row for each file and column of a folder: rows, type, nulls and range, as the
    footers say. A file that is no Parquet has its fault in `error`. Footers are read in
    tasks, a number of files each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        for batch in batches:
            for at, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = _of_file(at, size)
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).select("path", "length")
    files = files.repartition(tasks, "path") if tasks else files
    return files.mapInArrow(run, SCHEMA)


def _part(name: str) -> Column:
    """The value of name=value in a path."""
    return F.url_decode(F.regexp_replace(F.regexp_extract("path", f"/{name}=([^/]*)/", 1), r"\+", "%2B"))


def footer_faults(footers: DataFrame, types: dict[str, str], files: DataFrame | None = None, constant: dict[str, str] | None = None, not_signals: list[str] | None = None) -> DataFrame:
    """path, fault, observed and expected of files that don't fit.

    `types` are the columns (those of lists end in []) and their types. `files` (name, rows,
    and the parts of the path that tell files of one name apart, as dataset and split) is
    what the manifest says. `constant` are columns that have one value, which the path
    names: {"dataset": "dataset"} asks for the value of .../dataset=x/... in all rows.
    `not_signals` must not be among the columns, as a target that is also a signal.
    """
    none = F.lit(None).cast("string")
    row = lambda fault, observed, expected: (F.lit(fault).alias("fault"), observed.cast("string").alias("observed"), expected.cast("string").alias("expected"))
    readable = footers.where("error is null")
    out = footers.where("error is not null").select("path", *row("unreadable", F.col("error"), none))
    want = F.create_map(*(F.lit(x) for pair in types.items() for x in pair))
    per = readable.groupBy("path").agg(F.first("n_rows").alias("n_rows"), F.collect_set("column").alias("columns"))  # a file's columns
    expected = F.array(*map(F.lit, sorted(types)))
    out = out.unionByName(per.select("path", F.explode(F.array_except(expected, "columns")).alias("c")).select("path", *row("missing column", none, F.col("c"))))
    out = out.unionByName(readable.where(F.map_contains_key(want, F.col("column"))).where(F.col("type") != want[F.col("column")]).select("path", *row("type", F.concat_ws(" ", "column", "type"), want[F.col("column")])))
    if not_signals:
        out = out.unionByName(readable.where(F.col("column").isin(not_signals)).select("path", *row("target among signals", F.col("column"), none)))
    for column, part in (constant or {}).items():
        named = _part(part)
        bad = readable.where((F.col("column") == column) & ~(F.col("low").eqNullSafe(named) & F.col("high").eqNullSafe(named)))
        out = out.unionByName(bad.select("path", *row(column, F.concat_ws(" to ", "low", "high"), named)))
    if files is not None:
        parts = [c for c in files.columns if c not in ("name", "rows", "bytes", "checksum")]
        placed = per.select("path", "n_rows", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), *(_part(c).alias(c) for c in parts))
        both = placed.join(files.select("name", "rows", *parts), ["name", *parts], "full")
        off = both.where("not (n_rows <=> rows)").select(F.coalesce("path", "name").alias("path"), "n_rows", "rows")
        out = out.unionByName(off.select("path", *row("rows", F.col("n_rows"), F.col("rows"))))
    return out
