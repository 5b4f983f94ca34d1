"""Reports of many diffs in few files: a data source whose writes take effect whole or not at all.

`df.write.format("review_reports").mode("append").save(folder)` writes rows of diff_id and report. Each task gathers its reports in
files of some max_bytes, with a Parquet index of where each report is. Both are staged below the folder; the driver moves them to
`reports/` and `index/` when all tasks have succeeded, and takes them away if one hasn't; a mark of that stays, by which tasks that still
run know that nobody waits for them. It sees names of files, never reports.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from . import shared

FORMAT = "review_reports"
MAX_BYTES = 64 << 20
INDEX = pa.schema([("diff_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class _Writer(DataSourceArrowWriter):
    def __init__(self, folder: str, max_bytes: int, overwrite: bool):
        self.folder, self.max_bytes, self.overwrite = folder, max_bytes, overwrite
        self.staged = f"{folder}/_staged/{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        names: list[str] = []
        text, index = io.BytesIO(), []

        def close() -> None:
            nonlocal text, index
            if index and not self._given_up():
                name = uuid.uuid4().hex
                shared.write(f"{self.staged}/reports/{name}.txt", text.getvalue())
                table = io.BytesIO()
                pq.write_table(pa.table([[r[0] for r in index], [f"{name}.txt"] * len(index), [r[1] for r in index], [r[2] for r in index]], schema=INDEX), table)
                shared.write(f"{self.staged}/index/{name}.parquet", table.getvalue())
                names.append(name)
                self._given_up()
            text, index = io.BytesIO(), []

        for batch in iterator:
            for diff_id, report in zip(batch.column("diff_id").to_pylist(), batch.column("report").to_pylist()):
                told = (report or "").encode()
                index.append((diff_id, text.tell(), len(told)))
                text.write(told)
                if text.tell() >= self.max_bytes:
                    close()
        close()
        return Written(names)

    def _given_up(self) -> bool:
        """Whether the write was aborted while this task went on; what it has staged since goes."""
        gone = shared.read(f"{self.staged}.aborted") is not None
        if gone:
            shared.remove(self.staged)
        return gone

    def commit(self, messages: list[Written | None]) -> None:
        if self.overwrite:
            for part in ("reports", "index"):
                shared.remove(f"{self.folder}/{part}")
        for name in (n for m in messages if m for n in m.names):
            shared.move(f"{self.staged}/reports/{name}.txt", f"{self.folder}/reports/{name}.txt")
            shared.move(f"{self.staged}/index/{name}.parquet", f"{self.folder}/index/{name}.parquet")  # last: what has no index isn't there
        shared.remove(self.staged)

    def abort(self, messages: list[Written | None]) -> None:
        shared.write(f"{self.staged}.aborted", b"")
        shared.remove(self.staged)


class Reports(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], int(self.options.get("max_bytes", MAX_BYTES)), overwrite)


def write(reports: DataFrame, folder: str, append: bool = False, max_bytes: int = MAX_BYTES) -> None:
    """diff_id, report of each row into a folder of the shared store; append: beside what is there."""
    reports.sparkSession.dataSource.register(Reports)
    rows = reports.select(reports["diff_id"].cast("bigint").alias("diff_id"), reports["report"].cast("string").alias("report"))
    rows.write.format(FORMAT).mode("append" if append else "overwrite").option("max_bytes", max_bytes).save(folder)


def index(spark: SparkSession, folder: str) -> DataFrame:
    """diff_id, file, offset, length of every report."""
    return spark.read.schema("diff_id bigint, file string, offset bigint, length bigint").parquet(f"{folder}/index")


def fetch(folder: str, file: str, offset: int, length: int) -> str:
    """One report, read from its place alone."""
    return shared.read_range(f"{folder}/reports/{file}", offset, length).decode()


def read(spark: SparkSession, folder: str, where: str = "true") -> DataFrame:
    """diff_id, report of the index rows that pass the condition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                rows = part.to_pylist()
                yield pa.RecordBatch.from_pydict({"diff_id": pa.array([r["diff_id"] for r in rows], pa.int64()), "report": [fetch(folder, r["file"], r["offset"], r["length"]) for r in rows]})

    return index(spark, folder).where(where).mapInArrow(run, "diff_id bigint, report string")
