"""What the operators of this subpackage share: tables, the shared folder, batch limits."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import weakref
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows that the JVM hands to a Python worker at once. Texts are long; the default of 10,000 rows would hold
#: hundreds of MB in a worker when a run of very long texts meets.
ROWS_PER_BATCH = 500
#: Bytes that end such a batch before that; a longer row is a batch of its own.
BYTES_PER_BATCH = 8 << 20
BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
BYTES_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application, so that their workers can import it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="tidemark-")  # the driver serves the file for as long as it lives
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, f"{top.name}-{uuid.uuid4().hex}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def small_batches(spark: SparkSession) -> None:
    """Python workers can import this package and get at most ROWS_PER_BATCH rows, or about BYTES_PER_BATCH, at once."""
    ship(spark)
    if int(spark.conf.get(BATCH_CONF)) > ROWS_PER_BATCH or int(spark.conf.get(BATCH_CONF)) <= 0:
        spark.conf.set(BATCH_CONF, str(ROWS_PER_BATCH))
    if int(spark.conf.get(BYTES_CONF).removesuffix("b")) > BYTES_PER_BATCH:
        spark.conf.set(BYTES_CONF, str(BYTES_PER_BATCH))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, which driver and executors share; a temporary folder where it is unset,
    which a cluster's executors couldn't read: there it must be set."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, top, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/tidemark/{name}-{uuid.uuid4().hex}"


_places: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder and read back: cuts the lineage and survives lost executors."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _places[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what written() wrote for these, which nothing may read any more: all that came of them is written itself."""
    for df in tables:
        if (place := _places.pop(df, None)) is not None:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(place)
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def text_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, None for null."""
    return column.cast(pa.binary()).to_pylist()


def chunked(texts: list[bytes | None], most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Index ranges whose texts together hold about `most` bytes; a longer text stands alone."""
    start = held = 0
    for i, t in enumerate(texts):
        size = len(t) if t is not None else 0
        if held and held + size > most:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(texts):
        yield start, len(texts)


def rows_where(df: DataFrame, keep, text_col: str = "text") -> DataFrame:
    """The rows of df, columns as they are, whose texts `keep()` marks.

    keep is called once in each task and gives a function from texts (bytes or None) to a list of booleans.
    """
    small_batches(df.sparkSession)
    at = df.columns.index(text_col)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = keep()
        for batch in batches:
            yield batch.filter(pa.array(marks(text_bytes(batch.column(at).cast(pa.string()))), pa.bool_()))

    return df.mapInArrow(emit, df.schema)
