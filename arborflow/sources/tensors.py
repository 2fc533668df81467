"""Tensor files as a data source: spark.read.format("arborflow_tensors") and df.write.format("arborflow_tensors").

A file holds named float32 tensors end to end behind a JSON header (the safetensors layout).  Each write is one *commit*: its
tasks put files of up to ``maxFileBytes`` into the folder, and the driver then writes a small manifest that lists them.
Readers see the files of manifests only, so what a failed or repeated task leaves is never read; the commit and the abort
delete it too.  A manifest of an overwrite names the ones that it replaces, so readers change over at once.

Filters on stage, tensor_name and version can be pushed (read_tensors, where): by each file's range of names and its stage whole files are left out,
by the header single tensors are, and only the bytes of the rest are read.  The driver holds a line a file.

Tables to write have tensor_name and data (array of numbers, neither null) and may have stage and shape; other columns are
refused.  Names may repeat: every row is kept, with the number of its commit as version.  An empty table makes a commit
without files.  A folder without manifests is read as version 0 of its *.safetensors files.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

SCHEMA = "version long, stage int, tensor_name string, shape array<bigint>, data array<float>"
FORMAT = "arborflow_tensors"
FILE_BYTES = 256 << 20
#: Bytes of tensors in a record batch that is read.
BATCH_BYTES = 16 << 20


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    store, at = pafs.FileSystem.from_uri(path)
    return store, at.rstrip("/")


def _names(store: pafs.FileSystem, folder: str) -> list[str]:
    found = store.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
    return sorted(f.base_name for f in found if f.type == pafs.FileType.File)


def _commits(store: pafs.FileSystem, folder: str) -> list[dict]:
    """The manifests that hold, oldest first."""
    all_ = []
    for name in _names(store, folder):
        if name.startswith("commit-") and name.endswith(".json"):
            with store.open_input_stream(f"{folder}/{name}") as f:
                all_.append(json.loads(f.read()))
    gone = {x for c in all_ for x in c["replaces"]}
    return sorted((c for c in all_ if c["job"] not in gone), key=lambda c: (c["version"], c["job"]))


# -- writing


@dataclass
class _Written(D.WriterCommitMessage):
    files: list[dict]


class TensorWriter(D.DataSourceArrowWriter):
    """Task: files named by job, partition and attempt.  Driver: the manifest, or nothing."""

    def __init__(self, path: str, overwrite: bool, file_bytes: int):
        self.path, self.overwrite, self.file_bytes, self.job = path, overwrite, file_bytes, uuid.uuid4().hex

    def write(self, iterator) -> _Written:
        store, folder = _store(self.path)
        store.create_dir(folder, recursive=True)
        task = TaskContext.get()
        part = f"part-{self.job}-{task.partitionId()}-{task.taskAttemptId()}"
        files, held, size = [], {}, 0

        def flush():
            nonlocal held, size
            for stage, rows in held.items():
                name = f"{part}-{len(files)}.safetensors"
                files.append(_write_file(store, folder, name, stage, rows))
            held, size = {}, 0

        for batch in iterator:
            columns = {n: batch.column(n) for n in batch.schema.names}
            data = columns["data"]
            for i in range(batch.num_rows):
                name, values = columns["tensor_name"][i].as_py(), data[i].values
                if name is None or values is None or values.null_count:
                    raise ValueError(f"tensor {name} has no name, no data, or null elements")
                raw = values.to_numpy(zero_copy_only=False).astype("<f4")
                shape = columns["shape"][i].as_py() if "shape" in columns else None
                shape = [len(raw)] if shape is None else shape
                if math.prod(shape) != len(raw):
                    raise ValueError(f"tensor {name} has {len(raw)} elements; its shape is {shape}")
                stage = columns["stage"][i].as_py() if "stage" in columns else None
                if size + raw.nbytes > self.file_bytes or name in held.get(stage, ()):
                    flush()
                held.setdefault(stage, {})[name] = shape, raw
                size += raw.nbytes
        flush()
        return _Written(files)

    def commit(self, messages: list) -> None:
        store, folder = _store(self.path)
        store.create_dir(folder, recursive=True)
        before = _commits(store, folder)
        files = [f for m in messages if m is not None for f in m.files]
        self._sweep(store, folder, {f["file"] for f in files})
        manifest = {
            "job": self.job, "version": max([0, *(c["version"] for c in before)]) + 1,
            "replaces": [c["job"] for c in before] if self.overwrite else [], "files": sorted(files, key=lambda f: f["file"]),
        }
        with store.open_output_stream(f"{folder}/.commit-{self.job}.tmp") as f:
            f.write(json.dumps(manifest).encode())
        store.move(f"{folder}/.commit-{self.job}.tmp", f"{folder}/commit-{self.job}.json")  # from here on the rows are there
        if self.overwrite:
            for c in before:
                for x in c["files"]:
                    store.delete_file(f"{folder}/{x['file']}")

    def abort(self, messages: list) -> None:
        store, folder = _store(self.path)
        self._sweep(store, folder, set())

    def _sweep(self, store, folder: str, keep: set[str]) -> None:
        """Deletes what this job's failed and repeated tasks left."""
        for name in _names(store, folder):
            if name.startswith(f"part-{self.job}-") and name not in keep:
                store.delete_file(f"{folder}/{name}")


def _write_file(store, folder: str, name: str, stage: int | None, rows: dict) -> dict:
    header: dict = {} if stage is None else {"__metadata__": {"stage": str(stage)}}
    at = 0
    for n in sorted(rows):
        shape, raw = rows[n]
        header[n] = {"dtype": "F32", "shape": shape, "data_offsets": [at, at + raw.nbytes]}
        at += raw.nbytes
    text = json.dumps(header).encode()
    text += b" " * (-len(text) % 8)
    with store.open_output_stream(f"{folder}/{name}") as f:
        f.write(len(text).to_bytes(8, "little") + text)
        for n in sorted(rows):
            f.write(rows[n][1].tobytes())
    return {"file": name, "stage": stage, "tensors": len(rows), "first": min(rows), "last": max(rows), "bytes": at}


# -- reading


@dataclass
class _File(D.InputPartition):
    version: int
    name: str
    stage: int | None


_KINDS = (D.EqualTo, D.EqualNullSafe, D.In, D.GreaterThan, D.GreaterThanOrEqual, D.LessThan, D.LessThanOrEqual, D.StringStartsWith, D.IsNull, D.IsNotNull)


def _holds(f: D.Filter, x) -> bool:
    """Whether a value passes a filter; null passes the filters that ask for it alone."""
    if isinstance(f, D.IsNull):
        return x is None
    if isinstance(f, D.EqualNullSafe):
        return x == f.value
    if x is None:
        return False
    if isinstance(f, D.IsNotNull):
        return True
    if isinstance(f, D.In):
        return x in f.value
    if isinstance(f, D.StringStartsWith):
        return x.startswith(f.value)
    if f.value is None:
        return False
    return {D.EqualTo: x.__eq__, D.GreaterThan: x.__gt__, D.GreaterThanOrEqual: x.__ge__, D.LessThan: x.__lt__, D.LessThanOrEqual: x.__le__}[type(f)](f.value)


def _may_hold(f: D.Filter, first: str, last: str) -> bool:
    """Whether a name from first to last can pass a filter."""
    if isinstance(f, D.IsNull):
        return False
    if isinstance(f, D.IsNotNull):
        return True
    if isinstance(f, D.In):
        return any(v is not None and first <= v <= last for v in f.value)
    if f.value is None:
        return False
    if isinstance(f, D.StringStartsWith):
        return first[: len(f.value)] <= f.value <= last
    if isinstance(f, D.GreaterThan | D.GreaterThanOrEqual):
        return _holds(f, last)
    if isinstance(f, D.LessThan | D.LessThanOrEqual):
        return _holds(f, first)
    return first <= f.value <= last


class TensorReader(D.DataSourceReader):
    """A file a partition."""

    def __init__(self, path: str):
        self.path, self.filters = path, {"stage": [], "tensor_name": [], "version": []}

    def partitions(self) -> list:
        store, folder = _store(self.path)
        commits = _commits(store, folder)
        if not any(n.startswith("commit-") for n in _names(store, folder)):
            commits = [{"version": 0, "files": [{"file": n, "stage": None} for n in _names(store, folder) if n.endswith(".safetensors")]}]
        found = []
        for c in commits:
            if not all(_holds(f, c["version"]) for f in self.filters["version"]):
                continue
            for x in c["files"]:
                stats = "first" in x
                if stats and not (all(_holds(f, x["stage"]) for f in self.filters["stage"]) and all(_may_hold(f, x["first"], x["last"]) for f in self.filters["tensor_name"])):
                    continue
                found.append(_File(c["version"], x["file"], x["stage"]))
        return found or [_File(0, "", None)]

    def read(self, partition: _File):
        if not partition.name:
            return
        store, folder = _store(self.path)
        with store.open_input_file(f"{folder}/{partition.name}") as f:
            size = int.from_bytes(f.read(8), "little")
            header = json.loads(f.read(size))
            stage = header.pop("__metadata__", {}).get("stage")
            stage = None if stage is None else int(stage)
            if not all(_holds(x, stage) for x in self.filters["stage"]):
                return
            names = sorted(n for n in header if all(_holds(x, n) for x in self.filters["tensor_name"]))
            at = 0
            while at < len(names):
                rows, total = [], 0
                while at < len(names) and (not rows or total < BATCH_BYTES):
                    x = header[names[at]]
                    if x["dtype"] != "F32":
                        raise ValueError(f"{partition.name}: {names[at]} is {x['dtype']}; F32 is read")
                    first, end = x["data_offsets"]
                    f.seek(8 + size + first)
                    rows.append((names[at], x["shape"], np.frombuffer(f.read(end - first), "<f4")))
                    total, at = total + end - first, at + 1
                offsets = np.concatenate([[0], np.cumsum([len(r[2]) for r in rows])]).astype(np.int32)
                data = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([r[2] for r in rows])))
                yield pa.record_batch(
                    [pa.array([partition.version] * len(rows), pa.int64()), pa.array([stage] * len(rows), pa.int32()), pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.list_(pa.int64())), data],
                    ["version", "stage", "tensor_name", "shape", "data"],
                )


class FilteredReader(TensorReader):
    """Takes filters from the plan."""

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, _KINDS) and len(f.attribute) == 1 and f.attribute[0] in self.filters:
                self.filters[f.attribute[0]].append(f)
            else:
                yield f


class TensorSource(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TensorReader:
        return (FilteredReader if self.options.get("pushdown", "false") == "true" else TensorReader)(self.options["path"])

    def writer(self, schema, overwrite: bool) -> TensorWriter:
        names = set(schema.names)
        if not {"tensor_name", "data"} <= names <= {"tensor_name", "data", "stage", "shape"}:
            raise ValueError(f"tensor files take tensor_name, data, stage and shape; the table has {', '.join(schema.names)}")
        return TensorWriter(self.options["path"], overwrite, int(self.options.get("maxFileBytes", FILE_BYTES)))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, filters included."""
    spark.dataSource.register(TensorSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_tensors(spark: SparkSession, path: str, where: str | Column | None = None) -> DataFrame:
    """The tensors of a folder; where is pushed to the files.  Spark 4.1 keeps the filters of a Python source once for each
    load(), so two filters pushed on one load() would both get the later one's rows.  So only where is pushed, of which a
    load() has one, and a condition without a fixed value keeps later filters above it."""
    register(spark)
    load = spark.read.format(FORMAT)
    if where is None:
        return load.load(path)
    return load.option("pushdown", "true").load(path).where(where).where(F.spark_partition_id() >= 0)


def write_tensors(tensors: DataFrame, path: str, mode: str = "append", file_bytes: int = FILE_BYTES) -> None:
    register(tensors.sparkSession)
    tensors.write.format(FORMAT).mode(mode).option("maxFileBytes", file_bytes).save(path)


def latest(tensors: DataFrame) -> DataFrame:
    """The row of the last commit of each name."""
    return tensors.groupBy("tensor_name").agg(F.max_by(F.struct("version", "stage", "shape", "data"), "version").alias("r")).select("tensor_name", "r.*")
