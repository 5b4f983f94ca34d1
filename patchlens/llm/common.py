"""What the operators of this subpackage share.

Inputs are read by column name (`doc_id`, `text`, ...); any other column of the
input is ignored unless the operator says that it passes columns through, so
extra columns can't clash with working columns.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII white-space characters.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
BATCH_BYTES = 4 << 20
_LOWER = {c: c + 32 for c in range(65, 91)}


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8. bytes.split() cuts at exactly the six ASCII white-space characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def lower_words_of(text: str | None) -> list[bytes]:
    """The words with A-Z (and nothing else) lower-cased: bytes.lower() touches ASCII alone."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def ascii_lower(text: str) -> str:
    return text.translate(_LOWER)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices that bound the copies in memory."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            yield batch.slice(at, 1024)


def rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples of Python values."""
    for part in parts(batches):
        yield from zip(*(part.column(part.schema.get_field_index(n)).to_pylist() for n in names))


def emit(schema: pa.Schema, columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def tidy(run: Callable) -> Callable:
    """A function of Arrow batches for mapInArrow. When a task ends, the worker, which waits for the next one, gives its free memory back."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            _release()

    return wrapped


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints that the cluster names; one under /tmp only where it is unset, as in tests."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir", "/tmp/checkpoints"))
    return sc._jsc.sc().getCheckpointDir().get()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in the shared folder, which outlives any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_batches(df: DataFrame) -> DataFrame:
    """df itself. Its session sends at most BATCH_BYTES at once to Python, unless it says itself how many.

    Ten thousand rows, the usual batch, of texts or sets take a worker and the JVM beside it hundreds of MB.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in conf.getAll:
        conf.set(key, str(BATCH_BYTES))
    return df


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores behind it: no column of df."""
    while name in df.columns:
        name += "_"
    return name


def bucket(column, n: int):
    """crc32 of an id as text, modulo n (a null id falls to bucket 0)."""
    return F.coalesce(F.crc32(F.encode(column.cast("string"), "UTF-8")) % n, F.lit(0))
