"""Archives of line-delimited JSON: discovery, manifests, and a scan that never unpacks them to disk."""

from __future__ import annotations

import glob
import json
import os
import tarfile
import time
import zlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.numeric import REPLAY_TIME, first_positive

LIVE_MEMBER, DENSE_PREFIX = "market.jsonl", "records_"


def discover(root: str, folders: tuple[str, ...] = ("archive", "archives", "data/archive", ".")) -> list[str]:
    """Archives (.tar.gz) in the first of the folders that has any, else anywhere below root."""
    for folder in folders:
        if found := sorted(glob.glob(os.path.join(root, folder, "*.tar.gz"))):
            return found
    return sorted(glob.glob(os.path.join(root, "**", "*.tar.gz"), recursive=True))


def listed(path: str) -> list[str]:
    """Paths from a list file; empty lines and those after # don't count."""
    with open(path, encoding="utf-8") as f:
        return [s for line in f if (s := line.split("#", 1)[0].strip())]


def readable(path: str) -> bool:
    """Whether an archive can be read to its end, with at least one file in it."""
    try:
        with tarfile.open(path, "r|gz") as archive:
            files = 0
            for member in archive:
                if not member.isfile():
                    continue
                stream = archive.extractfile(member)
                while stream.read(1 << 20):
                    pass
                files += 1
            return files > 0
    except (OSError, EOFError, tarfile.TarError, zlib.error):
        return False


def freeze(paths: Sequence[str], list_file: str | None = None, pause: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> list[str]:
    """Those of the paths that nobody writes to: same size and time of change after the pause, and readable to the end.

    Sorted, each once. With list_file they are written there for `listed()`, so that later steps of a study read the
    same inputs whatever comes in meanwhile; the file is replaced at once, never half written.
    """

    def state(path: str) -> tuple[int, int] | None:
        try:
            now = os.stat(path)
        except OSError:
            return None
        return now.st_size, now.st_mtime_ns

    before = {p: state(p) for p in sorted(set(paths))}
    if before:
        sleep(pause)
    found = [p for p, was in before.items() if was is not None and state(p) == was and readable(p)]
    if list_file is not None:
        with open(f"{list_file}.part", "w", encoding="utf-8") as f:
            f.writelines(f"{p}\n" for p in found)
        os.replace(f"{list_file}.part", list_file)
    return found


class ArchivePartition(InputPartition):
    def __init__(self, path: str):
        self.path = path


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.dense = options.get("allowdense", "false").lower() == "true"
        self.every = options.get("allmembers", "false").lower() == "true"
        self.paths = json.loads(options["paths"]) if "paths" in options else discover(options["path"])

    def partitions(self) -> list[ArchivePartition]:
        return [ArchivePartition(p) for p in self.paths]

    def _wanted(self, member: str) -> bool:
        name = os.path.basename(member)
        if self.every:
            return name.endswith(".jsonl")
        return name == LIVE_MEMBER or (self.dense and name.startswith(DENSE_PREFIX) and name.endswith(".jsonl"))

    def read(self, partition: ArchivePartition) -> Iterator[pa.RecordBatch]:
        """Streams an archive; lines that are blank or no JSON object are left out."""
        name, lines, numbers = os.path.basename(partition.path), [], []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"archive": [name] * len(lines), "line": pa.array(numbers, pa.int64()), "value": lines})

        at = 0
        with tarfile.open(partition.path, "r|gz") as tar:
            for member in tar:
                if not member.isfile() or not self._wanted(member.name):
                    continue
                for raw in tar.extractfile(member):
                    at += 1
                    text = raw.decode("utf-8", "replace").strip()
                    try:
                        if not text or not isinstance(json.loads(text), dict):
                            continue
                    except ValueError:
                        continue
                    lines.append(text)
                    numbers.append(at)
                    if len(lines) >= 5000:
                        yield batch()
                        lines, numbers = [], []
        if lines:
            yield batch()


class ArchiveSource(DataSource):
    """spark.read.format("jsonl_archive"): archive, line, value. Options: path or paths (a JSON list), allowDense, allMembers.

    A partition for each archive: they are gzip streams and can't be split. Archives are read by path on the executors,
    which therefore need a shared mount.
    """

    @classmethod
    def name(cls) -> str:
        return "jsonl_archive"

    def schema(self) -> str:
        return "archive string, line long, value string"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader({k.lower(): v for k, v in self.options.items()})


def read_archives(spark: SparkSession, paths: list[str], dense: bool = False, every: bool = False) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("jsonl_archive").option("paths", json.dumps(paths)).option("allowDense", str(dense)).option("allMembers", str(every)).load()


def read_binary(spark: SparkSession, folder: str) -> DataFrame:
    """The same rows where archives lie in a store that only Spark reads: whole files through binaryFile."""

    def unpack(batches):
        import io

        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                lines, numbers, at = [], [], 0
                with tarfile.open(fileobj=io.BytesIO(content), mode="r|gz") as tar:
                    for member in tar:
                        if member.isfile() and os.path.basename(member.name) == LIVE_MEMBER:
                            for raw in tar.extractfile(member):
                                at += 1
                                text = raw.decode("utf-8", "replace").strip()
                                try:
                                    if text and isinstance(json.loads(text), dict):
                                        lines.append(text)
                                        numbers.append(at)
                                except ValueError:
                                    continue
                yield pa.RecordBatch.from_pydict({"archive": [os.path.basename(path)] * len(lines), "line": pa.array(numbers, pa.int64()), "value": pa.array(lines, pa.string())})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tar.gz").load(folder).select("path", "content")
    return files.mapInArrow(unpack, "archive string, line long, value string")


def manifests(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row for each archive from the manifest inside: batch_id, start_ms, end_ms, rows; nulls where there is none."""
    rows = []
    for p in paths:  # a catalogue: one small file for each archive
        found: dict = {}
        with tarfile.open(p, "r|gz") as tar:
            for member in tar:
                if member.isfile() and os.path.basename(member.name) == "manifest.json":
                    found = json.loads(tar.extractfile(member).read())
                    break
        pick = lambda *names, f=found: next((f[n] for n in names if f.get(n) is not None), None)
        rows.append((os.path.basename(p), pick("batchId", "batch_id"), pick("startMs", "start_ms"), pick("endMs", "end_ms"), pick("rows", "record_count")))
    return spark.createDataFrame(rows, "archive string, batch_id string, start_ms long, end_ms long, n_rows long").orderBy("start_ms", "end_ms", "archive")


def measured(rows: DataFrame) -> DataFrame:
    """What a manifest would say, read from the rows themselves (archive, value)."""
    fields = F.from_json("value", ", ".join(f"{c} string" for c in REPLAY_TIME))
    at = rows.select("archive", fields.alias("f")).select("archive", "f.*").withColumn("ts_ms", first_positive(*REPLAY_TIME))
    return at.groupBy("archive").agg(F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("end_ms"), F.count(F.lit(1)).alias("n_rows"))


def catalogue(parts: dict[str, DataFrame]) -> DataFrame:
    """Batches from several places (archive, staging, current), each once: the archive's before staging before current."""
    rank = {"archive": 3, "staging": 2, "current": 1}
    both = None
    for place, df in parts.items():
        some = df.withColumns({"place": F.lit(place), "__rank": F.lit(rank.get(place, 0))})
        both = some if both is None else both.unionByName(some, allowMissingColumns=True)
    row = F.struct(*(c for c in both.columns if c not in ("batch_id", "__rank")))
    return both.groupBy("batch_id").agg(F.max_by(row, "__rank").alias("__row")).select("batch_id", "__row.*")
