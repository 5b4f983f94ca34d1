"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in a keyed random order, form blocks of BLOCK_DOCS. With target weight w, block k of a source has
release time floor(k / w) and deadline ceil((k + 1) / w), in slots of one block each. Earliest deadline first over these
windows meets every deadline, as the weights sum to 1; so at any slot each source has got within less than one block of
its weight's share. Weights are taken as exact fractions, so nothing drifts, however long the mix and however small a weight.

Tasks lay the slots out in stretches, each on its own. What earliest deadline first has done before slot T follows from the weights:
every block with a deadline up to T, and of each source's next blocks, in order of their deadlines, those that still find a slot
between their release and T (`done_before`). For the latter only windows that reach beyond T matter, so a task looks back no
further than the longest window, and stretches are at least as long.

Every document gets a slot; none is dropped or repeated, and no slot is empty. The shares hold up to the horizon, the first slot for which
a source may have no block left; after it the other sources' blocks follow by deadline, which they still meet.

A document's rank in its source comes from counts by buckets of its hash, so that no source, however large, is ranked in
one task. The driver holds one number for each source, and the bounds of the stretches.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

BLOCK_DOCS = 64
#: Slots that a task lays out at once.
STRETCH = 1 << 18
#: The longest window that tasks look back over; with a longer one, a single task lays out all slots up to the horizon.
MAX_WINDOW = 1 << 22
#: Documents for each bucket of the hash.
BUCKET_DOCS = 4_000
NO_SOURCE = "(none)"
OTHERS = "(others)"
_MIX = "struct<block: bigint, position: bigint, slot: bigint, release: bigint, deadline: bigint, in_mix: boolean>"
_BLOCKS = pa.schema([("s", pa.string()), ("k", pa.int64()), ("slot", pa.int64()), ("release", pa.int64()), ("deadline", pa.int64())])


def _exact(weights: dict[str, float]) -> tuple[dict[str, int], int]:
    """Whole numbers in the exact proportions of the weights, and their sum."""
    if any(not 0 < w < math.inf for w in weights.values()):
        raise ValueError("weights must be positive and finite")
    parts = {s: Fraction(w) for s, w in weights.items()}
    unit = math.lcm(*(f.denominator for f in parts.values()))
    whole = {s: int(f * unit) for s, f in parts.items()}
    return whole, sum(whole.values())


def longest_window(part: dict[str, int], total: int) -> int:
    """No window of a block has more slots."""
    return -(-total // min(part.values())) + 1


def done_before(slot: int, part: dict[str, int], total: int) -> dict[str, int]:
    """Blocks of each source that earliest deadline first (ties by source) has put before a slot."""
    done = {s: slot * p // total for s, p in part.items()}
    spare = slot - sum(done.values())
    if not spare:
        return done
    first = max(0, slot - longest_window(part, total))
    later = list(range(slot - first + 1))  # from each slot on, a slot that is free, with the paths to it

    def take(release: int) -> bool:
        at = path = release - first
        while later[at] != at:
            at = later[at]
        while later[path] != at:
            later[path], path = at, later[path]
        if at == slot - first:
            return False
        later[at] = at + 1
        return True

    for s, p in part.items():
        for k in range(-(-first * p // total), done[s]):
            take(k * total // p)
    pending = sorted((-(-(done[s] + 1) * total // p), s) for s, p in part.items() if slot * p % total)
    for _, s in pending:
        if spare and take(done[s] * total // part[s]):
            done[s] += 1
            spare -= 1
    return done


def laid_out(part: dict[str, int], total: int, start: int, end: int) -> Iterator[tuple[str, int, int, int, int]]:
    """Source, block number, slot, release, deadline of slots start to end - 1, for whole-numbered weights and their sum."""
    pending = [(k * total // part[s], s, k) for s, k in done_before(start, part, total).items()]
    heapq.heapify(pending)
    ready: list[tuple[int, str, int, int]] = []
    for slot in range(start, end):
        while pending and pending[0][0] <= slot:
            release, s, k = heapq.heappop(pending)
            heapq.heappush(ready, (-(-(k + 1) * total // part[s]), s, k, release))
        deadline, s, k, release = heapq.heappop(ready)
        yield s, k, slot, release, deadline
        heapq.heappush(pending, ((k + 1) * total // part[s], s, k + 1))


def _batches(rows: Iterator[tuple[str, int, int, int, int]]) -> Iterator[pa.RecordBatch]:
    while some := list(itertools.islice(rows, 1 << 14)):
        yield common.emit(_BLOCKS, [list(c) for c in zip(*some)])


def slots_of(spark: SparkSession, weights: dict[str, float], blocks: dict[str, int], stretch: int = STRETCH) -> tuple[DataFrame, int]:
    """s, k, slot, release, deadline of every block of every source, and the horizon. Sources have both a weight and blocks."""
    part, total = _exact(weights)
    horizon = min(blocks[s] * total // p for s, p in part.items())
    window = longest_window(part, total)
    step = max(1, horizon if window > MAX_WINDOW else max(stretch, window))
    schema = "s string, k bigint, slot bigint, release bigint, deadline bigint"

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (start,) in common.rows(batches, "start"):
            yield from _batches(laid_out(part, total, start, min(start + step, horizon)))

    starts = spark.range(0, horizon, step, max(1, -(-horizon // step))).select(F.col("id").alias("start"))
    mixed = starts.mapInArrow(common.tidy(lay), schema)
    done = done_before(horizon, part, total) if window <= MAX_WINDOW else None
    if sum(blocks.values()) == horizon:
        return mixed, horizon
    if done is None:  # what is done follows from what was laid out
        mixed = common.cut(mixed)
        done = dict.fromkeys(part, 0) | {r["s"]: r["count"] for r in mixed.groupBy("s").count().toLocalIterator()}
    pieces = [(s, at, min(at + stretch, n)) for s, n in blocks.items() for at in range(done[s], n, stretch)]

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, first, end in common.rows(batches, "s", "first", "end"):
            p = part[s]
            yield from _batches((s, k, -1, k * total // p, -(-(k + 1) * total // p)) for k in range(first, end))

    table = spark.createDataFrame(pieces, "s string, first bigint, end bigint").repartition(min(len(pieces), 1 << 12))
    by_deadline = table.mapInArrow(common.tidy(left), schema).repartitionByRange("deadline", "s").withColumn("part", F.spark_partition_id())
    fixed = common.cut(by_deadline)  # which range a block is in stays as it is when a task is lost
    sizes = fixed.groupBy("part").agg(F.count("*").alias("n"))
    # One row for each range: no more than a shuffle has partitions.
    base = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n") + horizon).alias("base"))
    at = F.row_number().over(Window.partitionBy("part").orderBy("deadline", "s")) - 1
    tail = fixed.withColumn("at", at).join(F.broadcast(base), "part").select("s", "k", (F.col("base") + F.col("at")).alias("slot"), "release", "deadline")
    return mixed.unionByName(tail), horizon


def tempered(counts: dict[str, int], exponent: float = 0.5) -> dict[str, float]:
    return {s: n**exponent for s, n in counts.items()}


def keyed_order(doc_id: Column, seed: int) -> Column:
    """60 bits from the digest of seed and id, which any SQL engine can make again."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed} "), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary")), 1, 15), 16, 10).cast("bigint")


def mix(docs: DataFrame, weights: dict[str, float] | DataFrame | None = None, block_docs: int = BLOCK_DOCS, stretch: int = STRETCH, seed: int = 1, column: str = "mix") -> DataFrame:
    """docs with a column: block, position (in the block), slot, release, deadline and in_mix (before the horizon).

    weights: of the sources, positive and in any unit, as a dict or a table (source, weight) with a row for each; by default the root of a
    source's number of documents. A null source is one of its own; sources that given weights don't name share one, named OTHERS, with
    the weight given to that name or the least of all; the weight of a source without documents counts for nothing. stretch: slots laid out at once. The order in a source follows
    from seed and doc_id; documents with equal ids follow each other, and a null doc_id is a value like any other. An empty table gives
    no rows. Every column is passed through, save for one with the name of the new one.
    """
    spark = docs.sparkSession
    named = F.coalesce(docs["source"].cast("string"), F.lit(NO_SOURCE))
    counts = {r["s"]: r["count"] for r in docs.select(named.alias("s")).groupBy("s").count().toLocalIterator()}
    if not counts:
        return docs.drop(column).withColumn(column, F.lit(None).cast(_MIX))
    buckets = max(1, sum(counts.values()) // BUCKET_DOCS)
    source = named
    if isinstance(weights, DataFrame):
        told = weights.select(F.coalesce(weights["source"].cast("string"), F.lit(NO_SOURCE)).alias("s"), weights["weight"].cast("double").alias("w"))
        weights = {r["s"]: r["w"] for r in told.toLocalIterator()}
    if weights is None:
        weights = tempered(counts)
    elif others := sum(n for s, n in counts.items() if s not in weights):
        source = F.when(named.isin(list(weights)), named).otherwise(F.lit(OTHERS))
        counts = {s: n for s, n in counts.items() if s in weights} | {OTHERS: others + (counts.get(OTHERS, 0) if OTHERS in weights else 0)}
        weights = {OTHERS: min(weights.values(), default=1.0)} | weights
    blocks = {s: -(-n // block_docs) for s, n in counts.items()}
    doc_id = docs["doc_id"].cast("bigint")
    order = keyed_order(doc_id, seed)
    row = F.struct(*[docs[f"`{c}`"].alias(c) for c in docs.columns if c != column])
    keyed = docs.select(row.alias("row"), source.alias("s"), F.pmod(F.shiftright(order, 20), F.lit(buckets)).alias("b"), order.alias("o"), doc_id.alias("id"))
    sizes = keyed.groupBy("s", "b").agg(F.count("*").alias("n"))
    before = common.cut(sizes.select("s", "b", "n", (F.sum("n").over(Window.partitionBy("s").orderBy("b")) - F.col("n")).alias("before")))
    slots, horizon = slots_of(spark, {s: weights[s] for s in blocks}, blocks, stretch)
    # The slots come to the buckets, not the rows to the slots: rows move once, to be ranked.
    first, last = F.floor(F.col("before") / block_docs), F.floor((F.col("before") + F.col("n") - 1) / block_docs)
    held = before.select("s", "b", "before", F.explode(F.sequence(first, last)).alias("k")).join(slots, ["s", "k"])
    placed = held.groupBy("s", "b", "before").agg(F.array_sort(F.collect_list(F.struct("k", "slot", "release", "deadline"))).alias("blocks"))
    ranked = keyed.withColumn("r", F.row_number().over(Window.partitionBy("s", "b").orderBy("o", "id")) - 1)
    rank = F.col("before") + F.col("r")
    block = F.get("blocks", F.floor(rank / block_docs) - first)
    # One projection, or unused columns of the rows would move as well.
    told = F.struct(block["k"].alias("block"), (rank % block_docs).alias("position"), block["slot"].alias("slot"), block["release"].alias("release"), block["deadline"].alias("deadline"), (block["slot"] < horizon).alias("in_mix"))
    return ranked.join(placed, ["s", "b"]).select("row.*", told.alias(column))


def ordered(mixed: DataFrame, column: str = "mix") -> DataFrame:
    """The rows of mix() in the order of their slots, over range partitions and in them, without the column."""
    order = [F.col(f"`{column}`.slot"), F.col(f"`{column}`.position")]
    return mixed.repartitionByRange(*order).sortWithinPartitions(*order).drop(column)
