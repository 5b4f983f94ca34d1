"""Small files in a store that driver and executors share, by address: file:, hdfs:, s3: or whatever Arrow knows."""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

BATCH_BYTES = 4 << 20


def folder(spark: SparkSession) -> str:
    """The folder for checkpoints that the cluster names. Where none is named, one under /tmp if all runs on this machine; else it is an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        sc.setCheckpointDir(named or "/tmp/checkpoints")
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df as a leaf of later plans, computed once and written to the shared folder, where it outlives executors. What was shuffled for it goes
    when it is written, not when the driver happens to collect its garbage."""
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    folder(spark)
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        own = df.select("*")  # a plan takes its settings when it is made
    finally:
        spark.conf.set(key, before)
    return own.checkpoint(eager=True)


def small_batches(df: DataFrame) -> DataFrame:
    """df itself. Its session sends at most BATCH_BYTES at once to Python, unless it says itself how many: ten thousand rows, the usual batch, may be hundreds of MB of diffs."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in conf.getAll:
        conf.set(key, str(BATCH_BYTES))
    return df


def at(address: str) -> tuple[fs.FileSystem, str]:
    """The store of an address, and the path in it."""
    if address.startswith("file:///"):
        return fs.LocalFileSystem(), address[7:]
    if address.startswith("file:/"):
        return fs.LocalFileSystem(), address[5:]
    return fs.FileSystem.from_uri(address) if "://" in address else (fs.LocalFileSystem(), address)


def read(address: str) -> bytes | None:
    """A file's bytes, or null if there is none."""
    store, path = at(address)
    if store.get_file_info(path).type != fs.FileType.File:
        return None
    with store.open_input_stream(path) as f:
        return f.read()


def read_range(address: str, offset: int, length: int) -> bytes:
    store, path = at(address)
    with store.open_input_file(path) as f:
        f.seek(offset)
        return f.read(length)


def write(address: str, content: bytes) -> None:
    """The file is there whole or not at all: it is renamed when it is complete."""
    store, path = at(address)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(f"{path}.tmp") as f:
        f.write(content)
    store.move(f"{path}.tmp", path)


def move(source: str, target: str) -> None:
    store, path = at(target)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    store.move(at(source)[1], path)


def remove(address: str) -> None:
    store, path = at(address)
    if store.get_file_info(path).type == fs.FileType.Directory:
        store.delete_dir(path)
