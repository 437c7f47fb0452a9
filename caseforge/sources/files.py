"""Case directories, array shards and manifests as Spark data sources: tasks list, read, write and hash files as streams.

Paths may be of any store that Arrow's file systems open (a local or shared folder, HDFS, S3, GCS). What the driver holds is the names
of directories, files of one case at a time are held by a task, and hashing holds one piece of a file.
"""

from __future__ import annotations

import hashlib
import subprocess
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PIECE = 1 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI; Hadoop writes a local one with one slash."""
    return fs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one run's files in the checkpoint folder, which the driver and all executors share."""
    from ..operators.order import use_shared_folder

    use_shared_folder(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


class _Share(InputPartition):
    def __init__(self, value):
        self.value = value


def _shares(items: list, each: int) -> list[_Share]:
    return [_Share(items[i : i + each]) for i in range(0, len(items), each)] or [_Share([])]


class CaseSource(DataSource):
    """``case_id, file, text``: of each sub-directory of ``path``, in the order of their names, each of the named ``files``; null where a case lacks one. A partition is ``cases`` directories."""

    @classmethod
    def name(cls) -> str:
        return "case_files"

    def schema(self) -> str:
        return "case_id string, file string, text string"

    def reader(self, schema) -> DataSourceReader:
        return CaseReader(self.options)


class CaseReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.files, self.cases = options["path"], options["files"].split(","), int(options.get("cases", 500))

    def partitions(self) -> list[InputPartition]:
        store, root = opened(self.path)
        found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return _shares(sorted(f.base_name for f in found if f.type == fs.FileType.Directory), self.cases)

    def read(self, partition):
        store, root = opened(self.path)
        for case in partition.value:
            there = {f.base_name for f in store.get_file_info(fs.FileSelector(f"{root}/{case}")) if f.type == fs.FileType.File}
            for name in self.files:
                text = None
                if name in there:
                    with store.open_input_stream(f"{root}/{case}/{name}") as f:
                        text = f.read().decode("utf-8", "replace")
                yield case, name, text


class ManifestSource(DataSource):
    """``path, length, sha256`` of every file below ``path``, hashed piece by piece; paths are told from there. A partition is ``files`` files."""

    @classmethod
    def name(cls) -> str:
        return "manifest"

    def schema(self) -> str:
        return "path string, length long, sha256 string"

    def reader(self, schema) -> DataSourceReader:
        return ManifestReader(self.options)


class ManifestReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.files = options["path"], int(options.get("files", 200))

    def partitions(self) -> list[InputPartition]:
        store, root = opened(self.path)
        found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        return _shares(sorted(f.path for f in found if f.type == fs.FileType.File), self.files)

    def read(self, partition):
        store, root = opened(self.path)
        for path in partition.value:
            digest, length = hashlib.sha256(), 0
            with store.open_input_stream(path) as f:
                while piece := f.read(PIECE):
                    digest.update(piece)
                    length += len(piece)
            yield path[len(root) :].lstrip("/"), length, digest.hexdigest()


def register(spark: SparkSession) -> None:
    for source in (CaseSource, ManifestSource):
        spark.dataSource.register(source)


def cases(spark: SparkSession, path: str, files: list[str], each: int = 500) -> DataFrame:
    register(spark)
    return spark.read.format("case_files").option("path", path).option("files", ",".join(files)).option("cases", str(each)).load()


def case_table(spark: SparkSession, path: str, files: dict[str, tuple[str, str]]) -> DataFrame:
    """One row per case with a column per kind of file, ``column -> (file, schema)``; a missing or broken file gives null. Each case is read once: no join."""
    texts = cases(spark, path, [file for file, _ in files.values()]).groupBy("case_id").agg(*(F.max(F.when(F.col("file") == file, F.col("text"))).alias(c) for c, (file, _) in files.items()))
    bare = lambda c: F.get_json_object(F.concat(F.lit('{"x":'), c, F.lit("}")), "$.x")
    return texts.select("case_id", *((bare(F.col(c)) if schema == "string" else F.from_json(c, schema)).alias(c) for c, (_, schema) in files.items()))


def write_cases(rows: DataFrame, path: str) -> int:
    """Writes ``rows(case_id, file, text)`` as ``path/case_id/file``; how many files there are. A task that runs again writes the same files; a null text writes none."""

    def write(batches):
        store, root = opened(path)
        for b in batches:
            for case, name, text in zip(*(b.column(c).to_pylist() for c in range(3))):
                if text is not None:
                    store.create_dir(f"{root}/{case}")
                    with store.open_output_stream(f"{root}/{case}/{name}") as f:
                        f.write(text.encode())
            yield pa.RecordBatch.from_pydict({"n": [sum(t is not None for t in b.column(2).to_pylist())]})

    return rows.select(F.col("case_id").cast("string"), "file", "text").mapInArrow(write, "n long").agg(F.sum("n").alias("n")).first()["n"] or 0


def save_arrays(rows: DataFrame, path: str) -> int:
    """Writes ``rows(id, v)`` as shards of NumPy files, ``<shard>.ids.npy`` and ``<shard>.npy``; how many shards there are. Rows of null or ragged vectors are refused."""

    def write(batches):
        store, root = opened(path)
        store.create_dir(root)
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column(1)
            sizes = set(pa.compute.list_value_length(v).to_pylist())
            if len(sizes) != 1 or None in sizes:
                raise ValueError(f"vectors of lengths {sorted(sizes, key=str)}")
            ids, m = b.column(0).to_numpy(), np.asarray(v.flatten()).reshape(len(v), -1)
            shard = hashlib.sha256(ids.tobytes() + m.tobytes()).hexdigest()[:24]
            for name, a in ((f"{shard}.ids.npy", ids), (f"{shard}.npy", m)):
                with store.open_output_stream(f"{root}/{name}") as f:
                    np.lib.format.write_array(_Writes(f), a)
            yield pa.RecordBatch.from_pydict({"n": [1]})

    return rows.select(F.col("id").cast("long"), F.col("v").cast("array<double>")).mapInArrow(write, "n long").agg(F.sum("n").alias("n")).first()["n"] or 0


class _Writes:
    """What NumPy's writer needs of a stream."""

    def __init__(self, f):
        self.write = lambda b: f.write(bytes(b))


def load_arrays(spark: SparkSession, path: str) -> DataFrame:
    """``id, v`` of all shards; a task reads whole shards."""
    store, root = opened(path)
    found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
    shards = sorted(f.base_name[: -len(".ids.npy")] for f in found if f.base_name.endswith(".ids.npy"))

    def read(batches):
        store, root = opened(path)
        for b in batches:
            for shard in b.column(0).to_pylist():
                ids, m = (np.lib.format.read_array(store.open_input_file(f"{root}/{shard}{end}")) for end in (".ids.npy", ".npy"))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(list(m), pa.list_(pa.float64()))], names=["id", "v"])

    names = spark.createDataFrame([(s,) for s in shards], "shard string")
    return names.repartition(max(1, min(len(shards), 1000))).mapInArrow(read, "id long, v array<double>")


def manifest(spark: SparkSession, path: str, each: int = 200) -> DataFrame:
    register(spark)
    return spark.read.format("manifest").option("path", path).option("files", str(each)).load()


def commit_stamp(folder: str) -> str | None:
    """The commit that a folder's files are at, null where there is none."""
    got = subprocess.run(["git", "-C", folder, "rev-parse", "HEAD"], capture_output=True, text=True, check=False)
    return got.stdout.strip() or None if got.returncode == 0 else None
