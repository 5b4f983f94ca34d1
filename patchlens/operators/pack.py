"""Ranking and first-fit packing of files into chunks of a character budget."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Config
from ..functions import columns as C
from ..functions import patterns as P
from . import parse


def ranked(files: DataFrame) -> DataFrame:
    """Adds priority, unless files have it, and rank: by priority, ties in diff order."""
    scored = files if "priority" in files.columns else files.withColumn("priority", C.priority(F.col("path"), F.col("added")))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("diff_id").orderBy(F.desc("priority"), "file_no")))


class Chunks:
    """Chunks of one diff. A heap of rooms, each node the most that is below it, finds and takes the first place in log(chunks) steps."""

    def __init__(self, budget: int, most: int):
        self.budget, self.most, self.opened, self.leaves, self.room = budget, most, 0, 1, [-1, -1]

    def _set(self, leaf: int, room: int) -> None:
        at, rooms = self.leaves + leaf, self.room
        rooms[at] = room
        while at > 1:
            at //= 2
            rooms[at] = max(rooms[2 * at], rooms[2 * at + 1])

    def _open(self, room: int) -> int | None:
        if self.opened == self.most:
            return None
        if self.opened == self.leaves:  # twice as many, which is n steps for n chunks in all
            rooms = [-1] * self.leaves * 2 + self.room[self.leaves:] + [-1] * self.leaves
            self.leaves *= 2
            for at in range(self.leaves - 1, 0, -1):
                rooms[at] = max(rooms[2 * at], rooms[2 * at + 1])
            self.room = rooms
        self._set(self.opened, room)
        self.opened += 1
        return self.opened

    def place(self, n: int) -> tuple[int | None, str]:
        """The chunk, from 1, of an item of n characters (null: none has room and no more may be opened), and the state that it is in."""
        if n > self.budget:
            chunk = self._open(-1)
            return chunk, "overflow" if chunk is None else "truncated"
        if self.room[1] < n:
            chunk = self._open(self.budget - n)
            return chunk, "overflow" if chunk is None else "packed"
        at = 1
        while at < self.leaves:
            at = 2 * at + (self.room[2 * at] < n)
        self._set(at - self.leaves, self.room[at] - n)
        return at - self.leaves + 1, "packed"


def first_fit(items: DataFrame, by: str, budget: int, max_chunks: int) -> DataFrame:
    """items with chunk_no (null: overflow) and state: each goes to the first chunk of its group that has room for its n, in the order of rank.

    An item over the budget has a chunk of its own, which is then closed. A group's items pass through a task in order, and the
    task holds the rooms of one group's chunks and a batch, however many items there are. So items have numbers and names, not texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, chunks = object(), Chunks(budget, max_chunks)
        for batch in batches:
            placed = []
            for of, n in zip(batch.column(by).to_pylist(), batch.column("n").to_pylist()):
                if of != group:
                    group, chunks = of, Chunks(budget, max_chunks)
                placed.append(chunks.place(n))
            more = [pa.array([c for c, _ in placed], pa.int32()), pa.array([s for _, s in placed], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "chunk_no", "state"])

    schema = T.StructType([*items.schema.fields, T.StructField("chunk_no", T.IntegerType()), T.StructField("state", T.StringType())])
    return items.repartition(by).sortWithinPartitions(by, "rank").mapInArrow(run, schema)


def placements(files: DataFrame, cfg: Config = Config()) -> DataFrame:
    """diff_id, file_no, path, rank, chunk_no, state of ranked files. Only lengths (n_chars, or file_diff's) are looked at; texts stay out of it."""
    n = F.col("n_chars") if "n_chars" in files.columns else F.length("file_diff")
    items = files.select("diff_id", F.col("file_no").cast("bigint").alias("file_no"), "path", "rank", n.cast("bigint").alias("n"))
    return first_fit(items, "diff_id", cfg.max_chars, cfg.max_chunks).drop("n")


def truncated(text: Column, budget: int) -> Column:
    return F.when(F.length(text) > budget, F.concat(F.substring(text, 1, budget), F.lit(P.TRUNCATED))).otherwise(text)


def chunks(files: DataFrame, placed: DataFrame, cfg: Config = Config()) -> DataFrame:
    """diff_id, chunk_no, text, paths, n_chars, attempted (false from the deadline's cut on). A file's text is cut before it goes anywhere,
    and goes once, to its diff: there it meets its place (as a group, since a join by file would move it again), and its chunk is put together.
    """
    own = placed.where("chunk_no IS NOT NULL").select("diff_id", "file_no", "path", "rank", "chunk_no")
    texts = files.where("file_diff IS NOT NULL").select("diff_id", F.col("file_no").cast("bigint").alias("file_no"), truncated(F.col("file_diff"), cfg.max_chars).alias("part"), F.lit(True).alias("there"))  # or who asks for paths alone moves texts, too
    met = own.unionByName(texts, allowMissingColumns=True).repartition("diff_id").groupBy("diff_id", "file_no")
    whole = met.agg(*(F.max(c).alias(c) for c in ("path", "rank", "chunk_no", "part", "there"))).where("chunk_no IS NOT NULL AND there")
    paths = F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda s: s["path"])
    grouped = whole.groupBy("diff_id", "chunk_no").agg(parse.joined(F.col("part"), "rank").alias("text"), paths.alias("paths"))
    cut = F.lit(True) if cfg.chunks_before_deadline is None else F.col("chunk_no") <= cfg.chunks_before_deadline
    return grouped.withColumns({"n_chars": F.length("text"), "attempted": cut})
