"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words everywhere in this subpackage: space, tab to carriage return.
SPACE_CLASS = "[\\x20\\x09-\\x0D]+"


#: Spark deletes an execution's shuffle files as soon as it ends, where this is set.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where that is unset and driver and executors are one process (a local master), a new folder is set.
    On a cluster it must be set: a folder of one machine would lose what executors write.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="chronofold-")
        spark.conf.set("spark.checkpoint.dir", path)
        atexit.register(shutil.rmtree, path, True)
    return path.rstrip("/")


#: Rows of an Arrow batch that goes to a Python worker: of long texts 10,000 take up tens of MB on either side.
BATCH_ROWS = 512
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Let the session send at most ``BATCH_ROWS`` rows at a time to Python workers, which they keep all through a job."""
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


class Scratch:
    """Intermediate Parquet tables in the shared folder.

    A table cuts lineage: what it holds survives the loss of any executor.  The shuffle files of the
    job that writes it go when it ends.  ``drop`` removes tables that no later step reads.  What a
    returned DataFrame still reads is removed by ``release``, once its caller has used it, or at the
    end of the process.
    """

    _made: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        Scratch._made.append(self)

    def table(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{name}"
        before = self.spark.conf.get(_TIDY, "false")
        self.spark.conf.set(_TIDY, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(_TIDY, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def _delete(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.root}/{name}")

    def keep(self, *names: str) -> None:
        """Drop every table but these."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        store = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for found in store.listStatus(path) if store.exists(path) else []:
            if found.getPath().getName() not in names:
                store.delete(found.getPath(), True)


def mark() -> int:
    """A place in the list of scratch folders, for ``release``."""
    return len(Scratch._made)


def release(since: int = 0) -> None:
    """Delete the scratch folders made after ``since``: call it when the results that read them are used up."""
    while len(Scratch._made) > since:
        scratch = Scratch._made.pop()
        scratch._delete(scratch.root)


@atexit.register
def _release_at_exit() -> None:
    try:
        release()
    except Exception:  # the JVM has ended before this process
        Scratch._made.clear()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(text: str = "text"):
    """The text column as a string, null as empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def whole_row(docs: DataFrame):
    """All columns as one struct, so that names we add can't clash with theirs; ``select("_row.*")`` gives them back."""
    return F.struct(*[docs[c] for c in docs.columns]).alias("_row")


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column without a copy, and its n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.binary())
    if column.null_count:
        empty = b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else ""
        column = column.fill_null(empty)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Each batch in parts of at most ``rows`` rows: what a worker builds from one stays small."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def chunks(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes each; a longer row has a range of its own."""
    n = len(offsets) - 1
    a = 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b
        a = b
