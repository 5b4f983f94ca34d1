"""Reviews of an inbox of diff files as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..plans.scan import scan
from ..sources.files import decoded


def diffs(spark: SparkSession, path: str, per_batch: int = 1000) -> DataFrame:
    """A stream of diff_id, raw, arrived: one row for each new file of the inbox."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", "*.diff").option("maxFilesPerTrigger", per_batch).load(path)
    return files.select(F.xxhash64("path").alias("diff_id"), decoded(F.col("content")).alias("raw"), F.col("modificationTime").alias("arrived"))


def review(stream: DataFrame, scorer: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, cfg: Config = Config(), late: str = "1 day"):
    """Reviews each diff once, by micro-batches; a diff that comes again within `late` is dropped. A batch that is run again overwrites its own rows."""
    once = stream.withWatermark("arrived", late).dropDuplicatesWithinWatermark(["diff_id"])

    def batch(df: DataFrame, n: int) -> None:
        scan(df.select("diff_id", "raw"), scorer, cfg).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return once.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
