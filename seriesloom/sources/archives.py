"""Archives of samples and of sensor text, read by offsets.

A TAR archive's headers are looked through once, without its content; the archive is then
read in ranges that begin and end between samples, a task for each range, however large the
archive is. Paths are opened through Arrow's file systems. Where only Spark can reach the
files, `samples.import_archives` reads whole ones.
"""

from __future__ import annotations

import fnmatch
import io
import posixpath
import tarfile
import zipfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import sensors

# The members of a sample, by their names in the archives; the required ones
# are those without which a sample can't be used.
FIELDS = (
    "patches.npy",
    "valid_time_mask.npy",
    "valid_patch_mask.npy",
    "mean.npy",
    "std_used.npy",
    "canales_constantes_mask.npy",
    "rul_physical.npy",
    "rul_capped_125.npy",
    "target.json",
    "meta.json",
)
REQUIRED = ("patches.npy", "valid_time_mask.npy", "valid_patch_mask.npy", "meta.json")

RANGE_BYTES = 1 << 27
BATCH_BYTES = 1 << 24  # of the rows that a task hands on at once
AT_ONCE = 16  # archives whose headers are looked through side by side
SCHEMA = "archive string, key string, fields map<string, binary>, unknown array<string>"


def split_member(name: str) -> tuple[str, str | None]:
    """(key, field) of a member; keys may hold points, the longest field that fits wins."""
    fits = [f for f in FIELDS if name.endswith("." + f)]
    field = max(fits, key=len, default=None)
    return (name[: -len(field) - 1], field) if field else (name, None)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def list_files(pattern: str) -> list[str]:
    """Files of a folder, or those whose names fit a pattern in the last part of the path."""
    system, path = opened(pattern)
    prefix = pattern[: -len(path)] if pattern.endswith(path) else ""
    if any(c in path for c in "*?["):
        folder, name = posixpath.split(path)
        found = [f.path for f in system.get_file_info(fs.FileSelector(folder)) if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, name)]
    else:
        info = system.get_file_info(path)
        found = [path] if info.type == fs.FileType.File else [f.path for f in system.get_file_info(fs.FileSelector(path, recursive=True)) if f.type == fs.FileType.File and f.base_name.endswith(".tar")]
    if not found:
        raise FileNotFoundError(f"there is no archive at {pattern}")
    return sorted(prefix + f for f in found)


def find_ranges(path: str, most: int = RANGE_BYTES) -> list[tuple[int, int]]:
    """Parts of an archive of about `most` bytes at most (more only for one sample), each
    with whole samples. Members of one sample may be apart: no part ends between them."""
    system, place = opened(path)
    starts, keys = [], []
    with system.open_input_file(place) as file, tarfile.open(fileobj=file, mode="r:") as archive:
        for member in archive:
            starts.append(member.offset)
            keys.append(hash(split_member(member.name)[0]) if member.isfile() else None)
            archive.members = []  # else all headers of the archive are kept
        end = archive.offset
    last = {k: i for i, k in enumerate(keys)}
    out, begin, open_until = [], 0, -1
    for i, start in enumerate(starts):
        nearest = starts[i + 1] if i + 1 < len(starts) else end
        if open_until < i and start > begin and nearest - begin > most:
            out.append((begin, start))
            begin = start
        open_until = max(open_until, last[keys[i]] if keys[i] is not None else i)
    return [*out, (begin, end)] if starts else []


class _Part(io.RawIOBase):
    """A stretch of a file as a file of its own."""

    def __init__(self, file, start: int, stop: int):
        self.file, self.start, self.size, self.at = file, start, stop - start, 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, at: int, whence: int = 0) -> int:
        self.at = at + (0, self.at, self.size)[whence]
        return self.at

    def tell(self) -> int:
        return self.at

    def readinto(self, target) -> int:
        n = max(0, min(len(target), self.size - self.at))
        if n:
            self.file.seek(self.start + self.at)
            target[:n] = self.file.read(n)
            self.at += n
        return n


def read_range(path: str, start: int, stop: int, strict: bool = True) -> Iterator[pa.RecordBatch]:
    """The samples of a part of an archive; members that belong to none are in `unknown` of
    a row without a key."""
    types = [pa.string(), pa.string(), pa.map_(pa.string(), pa.binary()), pa.list_(pa.string())]
    names = ["archive", "key", "fields", "unknown"]

    def batch(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    system, place = opened(path)
    with system.open_input_file(place) as file:
        members: dict[str, dict[str, tarfile.TarInfo]] = {}
        unknown: list[str] = []
        with tarfile.open(fileobj=io.BufferedReader(_Part(file, start, stop), 1 << 16), mode="r:") as archive:
            for member in archive:
                if member.isfile():
                    key, field = split_member(member.name)
                    if field:
                        members.setdefault(key, {})[field] = member
                    else:
                        unknown.append(member.name)
            rows, size = [], 0
            for key in sorted(members):
                if strict and (missing := [f for f in REQUIRED if f not in members[key]]):
                    raise ValueError(f"{path}: {key} lacks {missing}; members of no sample: {unknown[:10]}")
                fields = [(f, archive.extractfile(m).read()) for f, m in sorted(members[key].items())]
                rows.append((path, key, fields, []))
                size += sum(len(b) for _, b in fields)
                if size > BATCH_BYTES:
                    yield batch(rows)
                    rows, size = [], 0
            if unknown:
                rows.append((path, None, [], unknown))
            if rows:
                yield batch(rows)


@dataclass
class ArchiveRange(InputPartition):
    path: str
    start: int
    stop: int


class ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.path = options.get("path")
        if not self.path:
            raise ValueError("the source needs a path")
        self.most = int(options.get("rangeBytes", RANGE_BYTES))
        self.strict = str(options.get("strict", "true")).lower() == "true"

    def partitions(self) -> list[ArchiveRange]:
        files = list_files(self.path)
        with ThreadPoolExecutor(AT_ONCE) as pool:
            return [ArchiveRange(f, *r) for f, ranges in zip(files, pool.map(lambda f: find_ranges(f, self.most), files), strict=True) for r in ranges]

    def read(self, partition: ArchiveRange) -> Iterator[pa.RecordBatch]:
        return read_range(partition.path, partition.start, partition.stop, self.strict)


class SampleArchives(DataSource):
    """spark.read.format("sample_archives").load(path): samples of TAR archives.

    Options: rangeBytes (of a task), strict (false: samples may lack fields).
    """

    @classmethod
    def name(cls) -> str:
        return "sample_archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, path: str, strict: bool = True, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """archive, key, fields (name to bytes) and unknown of the archives at a path: a folder,
    a file, or a pattern of names."""
    spark.dataSource.register(SampleArchives)
    return spark.read.format("sample_archives").option("strict", str(strict)).option("rangeBytes", range_bytes).load(path)


def nested(arrays: list[np.ndarray | None], dims: int, kind: pa.DataType) -> pa.Array:
    """Arrays of `dims` dimensions as nested lists; None is null."""
    for a in arrays:
        if a is not None and a.ndim != dims:
            raise ValueError(f"an array has {a.ndim} dimensions, {dims} are expected")
    there = [a for a in arrays if a is not None]
    flat = np.concatenate([a.ravel() for a in there]) if there else np.zeros(0)
    out = pa.array(flat.astype(kind.to_pandas_dtype()), kind)
    for d in reversed(range(dims)):
        if d:
            sizes = np.concatenate([np.zeros(0, int), *(np.full(int(np.prod(a.shape[:d])), a.shape[d]) for a in there)])
            out = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), out)
        else:
            sizes = np.array([0 if a is None else a.shape[0] for a in arrays], int)
            out = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), out, mask=pa.array([a is None for a in arrays]))
    return out


DECODED = (
    "archive string, key string, patches array<array<array<float>>>, valid_time_mask array<boolean>, valid_patch_mask array<array<boolean>>, mean array<float>, std_used array<float>,"
    " constant array<boolean>, rul_physical double, rul_capped_125 double, target string, meta string"
)
_ARRAYS = {
    "patches": ("patches.npy", 3, pa.float32()),
    "valid_time_mask": ("valid_time_mask.npy", 1, pa.bool_()),
    "valid_patch_mask": ("valid_patch_mask.npy", 2, pa.bool_()),
    "mean": ("mean.npy", 1, pa.float32()),
    "std_used": ("std_used.npy", 1, pa.float32()),
    "constant": ("canales_constantes_mask.npy", 1, pa.bool_()),
}


def decode_samples(archived: DataFrame) -> DataFrame:
    """Samples with their arrays: patches (C, N, P), validity of time steps (W) and patches
    (C, N), statistics and constant flags of channels (C), remaining lives, and the JSON of
    target and metadata. Fields that a sample lacks are null; an array of other dimensions
    is an error."""

    def array(fields: dict, name: str) -> np.ndarray | None:
        return np.load(io.BytesIO(fields[name]), allow_pickle=False) if name in fields else None

    def number(fields: dict, name: str) -> float | None:
        value = array(fields, name)
        return None if value is None else float(value.reshape(-1)[0])

    def text(fields: dict, name: str) -> str | None:
        return fields[name].decode() if name in fields else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields = [dict(x) for x in batch.column("fields").to_pylist()]
            columns = {"archive": batch.column("archive"), "key": batch.column("key")}
            columns |= {c: nested([array(f, name) for f in fields], dims, kind) for c, (name, dims, kind) in _ARRAYS.items()}
            columns |= {c: pa.array([number(f, f"{c}.npy") for f in fields], pa.float64()) for c in ("rul_physical", "rul_capped_125")}
            columns |= {c: pa.array([text(f, f"{c}.json") for f in fields], pa.string()) for c in ("target", "meta")}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return archived.where("key is not null").select("archive", "key", "fields").mapInArrow(run, DECODED)


def _members(sample: dict) -> dict[str, bytes]:
    """The members of a sample's row by their fields' names."""

    def npy(value, kind: type) -> bytes:
        held = io.BytesIO()
        np.save(held, np.asarray(value, kind), allow_pickle=False)
        return held.getvalue()

    out = {name: npy(sample[c], kind.to_pandas_dtype()) for c, (name, _, kind) in _ARRAYS.items() if sample.get(c) is not None}
    out |= {f"{c}.npy": npy(sample[c], float) for c in ("rul_physical", "rul_capped_125") if sample.get(c) is not None}
    return out | {f"{c}.json": sample[c].encode() for c in ("target", "meta") if sample.get(c) is not None}


def write_archives(samples: DataFrame, folder: str, per_archive: int = 5000) -> DataFrame:
    """Write samples as archives folder/dataset/split/dataset-split-<task>-<n>.tar of at most
    `per_archive` samples: archive, n_samples and n_bytes of each. Target and meta become
    JSON. An archive gets its name when it is whole, so a task that is run again leaves no
    part of one; samples of a dataset and split are written side by side."""
    spark = samples.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = opened(folder)
        task, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        number, now, done = 0, None, []

        def close() -> None:
            nonlocal now
            if now:
                name, part, stream, archive, n = now
                archive.close()
                size = stream.tell()
                stream.close()
                system.move(part, name)
                done.append((name, n, size))
            now = None

        group = None
        for batch in batches:
            for sample in batch.to_pylist():
                here = sample["dataset"], sample["split"]
                if now and (here != group or now[4] == per_archive):
                    close()
                if not now:
                    number, group = number + 1, here
                    inside = f"{top}/{here[0]}/{here[1]}"
                    system.create_dir(inside)
                    name = f"{inside}/{here[0]}-{here[1]}-{task:06d}-{number:06d}.tar"
                    part = f"{name}.{attempt}.part"
                    stream = system.open_output_stream(part)
                    now = [name, part, stream, tarfile.open(fileobj=stream, mode="w|"), 0]
                for field, data in _members(sample).items():
                    info = tarfile.TarInfo(f"{sample['key']}.{field}")
                    info.size = len(data)
                    now[3].addfile(info, io.BytesIO(data))
                now[4] += 1
        close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), *(pa.array([d[k] for d in done], pa.int64()) for k in (1, 2))], names=["archive", "n_samples", "n_bytes"])

    names = {"target", "meta"} & set(samples.columns)
    rows = samples.withColumns({c: F.to_json(c) for c in names if dict(samples.dtypes)[c] != "string"})
    ordered = rows.hint("rebalance", "dataset", "split").sortWithinPartitions("dataset", "split", "key")
    schema = "archive string, n_samples long, n_bytes long"
    return spark.createDataFrame(ordered.mapInArrow(run, schema).collect(), schema)  # a row for each archive


def _zip_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["fd", "kind", "line", "value"]
    for batch in batches:
        for path, entry, fd, kind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            system, place = opened(path)
            with system.open_input_file(place) as file, zipfile.ZipFile(file) as archive, archive.open(entry) as lines:
                held, first = [], 0
                for line in io.TextIOWrapper(lines, "utf-8"):
                    held.append(line.rstrip("\r\n"))
                    if len(held) == 50_000:
                        yield _lines(names, fd, kind, first, held)
                        held, first = [], first + len(held)
                yield _lines(names, fd, kind, first, held)


def _lines(names, fd, kind, first, held) -> pa.RecordBatch:
    n = len(held)
    return pa.RecordBatch.from_arrays([pa.array([fd] * n, pa.string()), pa.array([kind] * n, pa.string()), pa.array(range(first, first + n), pa.int64()), pa.array(held, pa.string())], names=names)


def read_paired_archives(spark: SparkSession, root: str, subsets: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, lives) of the sensor text in a train and a test archive, an entry for each
    task, read as it is unpacked. An archive or entry that isn't there is an error."""
    train, test = f"{root}/CMAPSS_train.zip", f"{root}/CMAPSS_test.zip"
    wanted = [(path, entry, fd, kind) for fd in subsets for path, entry, kind in ((train, f"CMAPSS/train/train_{fd}.txt", "train"), (test, f"CMAPSS/test/test_{fd}.txt", "test"), (test, f"CMAPSS/test/RUL_{fd}.txt", "RUL"))]
    there = {}
    for path in (train, test):
        system, place = opened(path)
        with system.open_input_file(place) as file, zipfile.ZipFile(file) as archive:
            there[path] = set(archive.namelist())
    if missing := [entry for path, entry, _, _ in wanted if entry not in there[path]]:
        raise ValueError(f"entries are missing: {missing}")
    entries = spark.createDataFrame(wanted, "path string, entry string, fd string, kind string").repartition(len(wanted))
    lines = entries.mapInArrow(_zip_lines, "fd string, kind string, line long, value string")
    rows = sensors.parse_sensor_lines(lines.where("kind <> 'RUL'").withColumnRenamed("kind", "source_split"))
    return rows, sensors.parse_life_lines(lines.where("kind = 'RUL'"))


def paired_faults(rows: DataFrame, lives: DataFrame) -> DataFrame:
    """fd and fault of subsets that don't fit together: lines at fault, cycles out of order,
    units that aren't 1 to n, or another number of lives than test units."""
    bad = rows.where("fault is not null").select("fd", F.concat_ws(" ", F.lit("line"), "fault").alias("fault")).unionByName(lives.where("fault is not null").select("fd", F.lit("life").alias("fault")))
    order = sensors.order_faults(rows.where("fault is null")).select("fd", F.lit("order").alias("fault"))
    counts = sensors.life_faults(rows.where("fault is null"), lives).select("fd", F.lit("lives and units differ").alias("fault"))
    return bad.unionByName(order).unionByName(counts).distinct()
