"""Training-order materialisation: token sequences at slots of a keyed permutation, in fixed-stride shards.

One pass cuts the token stream of each input partition (documents, each with an end id) into sequences of LENGTH tokens;
the last of a partition is padded. Sequences are numbered densely by partition, and a keyed Feistel network with
cycle-walking permutes the numbers [0, N): every sequence gets a slot of its own, and any slot's sequence can be told from
the key alone. Partitions are ranges of slots, each of whole shards of SHARD_SLOTS sequences. `write` makes a raw file of each shard, in
which slot s begins at byte (s - first_slot) * stride, so a reader that stopped at a slot goes on from there with one seek.

What travels is two bytes for each token (four with a vocabulary beyond 65,536 ids), twice: to the shared folder, which fixes the numbering against lost
tasks, and to the shards.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import shared
from . import common
from .packing import END_ID, tokenizer

LENGTH = 1024
SHARD_SLOTS = 1024
#: Shards of a range partition at most.
RANGE_SHARDS = 32
PAD_ID = 0
ROUNDS = 6
KEY = 0x5EED


def _round(half: np.ndarray, key: int, i: int, bits: int) -> np.ndarray:
    u = np.uint64
    h = half + u(xxhash.xxh3_64_intdigest(f"{key}/{i}".encode()))
    h = (h ^ (h >> u(30))) * u(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> u(27))) * u(0x94D049BB133111EB)
    return (h ^ (h >> u(31))) & u((1 << bits) - 1)


def permute(numbers: np.ndarray, n: int, key: int = KEY, back: bool = False) -> np.ndarray:
    """The keyed permutation of [0, n), or its inverse. The network covers less than 4 n; what falls outside goes through it again."""
    bits = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask, out = np.uint64((1 << bits) - 1), np.asarray(numbers, np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(bits), out[todo] & mask
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                left, right = right ^ _round(left, key, i, bits), left
            else:
                left, right = right, left ^ _round(right, key, i, bits)
        out[todo] = (left << np.uint64(bits)) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


_SEQUENCES = pa.schema([("part", pa.int64()), ("number", pa.int64()), ("ids", pa.binary()), ("n_tokens", pa.int64()), ("id_bytes", pa.int32())])


def sequences(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """part, number (dense in part), ids (little-endian, of id_bytes each: 2 if the vocabulary has at most 65,536 ids, else 4), n_tokens (without padding)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tok, part, number = tokenizer(tokenizer_path), TaskContext.get().partitionId() if TaskContext.get() else 0, 0
        width = 2 if max(tok.size, end_id + 1, PAD_ID + 1) <= 1 << 16 else 4
        rest, buffer, held = np.zeros(0, f"<u{width}"), [], 0

        def cut(stream: np.ndarray, n_tokens: int) -> pa.RecordBatch:
            """stream: whole sequences, of which the last has n_tokens."""
            nonlocal number
            n, raw = len(stream) // length, stream.tobytes()
            rows = [raw[i * length * width: (i + 1) * length * width] for i in range(n)]
            out = common.emit(_SEQUENCES, [[part] * n, list(range(number, number + n)), rows, [length] * (n - 1) + [n_tokens] * min(n, 1), [width] * n])
            number += n
            return out

        for batch in common.parts(batches):
            ids, ends = tok.ids(batch.column(0))
            buffer.append(np.insert(ids, ends, end_id).astype(rest.dtype))
            held += len(buffer[-1])
            if held > 1 << 20:
                stream = np.concatenate([rest, *buffer])
                whole = len(stream) // length * length
                rest, buffer, held = stream[whole:], [], 0
                yield cut(stream[:whole], length)
        stream = np.concatenate([rest, *buffer])
        tail = len(stream) % length
        yield cut(np.concatenate([stream, np.full(-len(stream) % length, PAD_ID, rest.dtype)]), tail or length)

    return common.small_batches(docs).select("text").mapInArrow(common.tidy(run), "part bigint, number bigint, ids binary, n_tokens bigint, id_bytes int")


def placed(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, key: int = KEY) -> tuple[DataFrame, int]:
    """slot, number, ids, n_tokens and id_bytes of every sequence, and how many there are.

    A null or empty text is its end id alone; repeated rows count as often as they occur; an empty table gives no rows; the
    other columns are ignored.
    """
    cut = common.cut(sequences(docs, tokenizer_path, length))
    sizes = cut.groupBy("part").agg(F.count("*").alias("n"))
    # One row for each input partition: the prefix sums of their sizes are 16 bytes for each split of the input.
    base = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    total = cut.count()
    numbered = cut.join(F.broadcast(base), "part").select((F.col("base") + F.col("number")).alias("number"), "ids", "n_tokens", "id_bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = permute(batch.column(0).to_numpy(zero_copy_only=False), total, key)
            yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), *batch.columns], ["slot", "number", "ids", "n_tokens", "id_bytes"])

    return numbered.mapInArrow(common.tidy(run), "slot bigint, number bigint, ids binary, n_tokens bigint, id_bytes int"), total


_SHARDS = pa.schema([("shard", pa.int64()), ("first_slot", pa.int64()), ("stride", pa.int64()), ("id_bytes", pa.int32()), ("payload", pa.binary()), ("slots", pa.list_(pa.struct([("number", pa.int64()), ("crc32", pa.int64()), ("n_tokens", pa.int64())])))])


def shards(at: DataFrame, total: int, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """shard, first_slot, stride, id_bytes, payload, and for each slot number, crc32 (of its bytes) and n_tokens.

    at, total: as placed() has them. A partition is a range of slots, in order; a task holds one shard at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def close() -> pa.RecordBatch:
            first, _, ids, _, id_bytes = held[0]
            slots = [{"number": number, "crc32": zlib.crc32(x), "n_tokens": n} for _, number, x, n, _ in held]
            return common.emit(_SHARDS, [[first // shard_slots], [first], [len(ids)], [id_bytes], [b"".join(r[2] for r in held)], [slots]])

        for row in common.rows(batches, "slot", "number", "ids", "n_tokens", "id_bytes"):
            if held and held[0][0] // shard_slots != row[0] // shard_slots:
                yield close()
                held = []
            held.append(row)
        if held:
            yield close()

    n_shards = max(1, -(-total // shard_slots))
    each = max(1, min(RANGE_SHARDS, n_shards // int(at.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    ranged = common.small_batches(at).repartitionById(-(-n_shards // each), F.floor(F.col("slot") / (shard_slots * each)).cast("int")).sortWithinPartitions("slot")
    return ranged.mapInArrow(common.tidy(run), "shard bigint, first_slot bigint, stride bigint, id_bytes int, payload binary, slots array<struct<number: bigint, crc32: bigint, n_tokens: bigint>>")


_INDEX = pa.schema([(c, pa.int64()) for c in ("shard", "bytes", "stride", "id_bytes", "crc32")])


def _file(path: str, shard: int) -> str:
    return f"{path}/data/shard-{shard:012d}.bin"


def write(shards_: DataFrame, path: str, shard_slots: int = SHARD_SLOTS) -> None:
    """Raw files of the shards, an index (a Parquet table of them: shard, bytes, stride, id_bytes, crc32) and, last, order.json, without which nothing is there.

    A task renames a file when it is whole; a second attempt at it writes the same bytes. path: an address in a store that driver and
    executors share. What was written there before goes first.
    """
    spark = shards_.sparkSession
    common.remove(spark, f"{path}/order.json")  # first: from here on nothing is there
    for old in ("data", "index", "_staged"):
        common.remove(spark, f"{path}/{old}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, payload, stride, id_bytes in common.rows(batches, "shard", "payload", "stride", "id_bytes"):
            staged = f"{path}/_staged/{uuid.uuid4().hex}"
            shared.write(staged, payload)
            shared.move(staged, _file(path, shard))
            yield pa.RecordBatch.from_pylist([{"shard": shard, "bytes": len(payload), "stride": stride, "id_bytes": id_bytes, "crc32": zlib.crc32(payload)}], schema=_INDEX)

    written = shards_.select("shard", "payload", "stride", "id_bytes").mapInArrow(common.tidy(run), "shard bigint, bytes bigint, stride bigint, id_bytes bigint, crc32 bigint")
    written.write.parquet(f"{path}/index")
    of = {c: F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("stride", "id_bytes")}
    told = spark.read.parquet(f"{path}/index").agg(F.coalesce(F.sum(F.expr("bytes div stride")), F.lit(0)).alias("n_slots"), *of.values()).first()
    about = told.asDict() | {"shard_slots": shard_slots}
    shared.write(f"{path}/order.json", json.dumps(about).encode())
    common.remove(spark, f"{path}/_staged")


def read_from(path: str, slot: int, at_once: int = 64) -> Iterator[tuple[int, np.ndarray]]:
    """(slot, ids) from a slot on: what resumes a run that stopped there. Each read is a seek in a shard's file, of at_once slots at most."""
    about = json.loads(shared.read(f"{path}/order.json"))
    size, stride = about["shard_slots"], about["stride"]
    while slot < about["n_slots"]:
        n = min(at_once, size - slot % size, about["n_slots"] - slot)
        raw = shared.read_range(_file(path, slot // size), slot % size * stride, n * stride)
        for i in range(n):
            yield slot + i, np.frombuffer(raw, f"<u{about['id_bytes']}", stride // about["id_bytes"], i * stride)
        slot += n
