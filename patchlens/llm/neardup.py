"""Near-duplicates: one-permutation MinHash with optimal densification, banded buckets, star-shaped candidate edges.

1. One pass makes for each document the set of its hashed 5-word shingles, a digest of the set and a signature: one
   permutation of the hashes dealt over BINS bins, the least of each bin; an empty bin takes the value of the first
   non-empty bin in a fixed random order of its own (optimal densification). BANDS groups of ROWS bins give bucket keys.
   A pair at the threshold shares a bucket with probability 1 - (1 - 0.75^4)^32, all but 6 in a million.
2. Documents with equal sets form a class, of which the smallest doc_id goes on. So copies cost one row, not pairs.
3. In each bucket of several classes the member whose buckets hold the most others (the likely origin of a group of copies) is
   the centre, and each other member makes one candidate edge with it. Edges are confirmed on the full sets. Links give components by label propagation.
4. Members that aren't in their centre's component may still link with other members. Jaccard distance is a metric, so
   distances to the centre tell which: only those whose distances differ by no more than the threshold's. What a bucket
   has left is settled on the full sets in one task, or in blocks; members of one component aren't compared, and only
   links that connect components leave the task. So no link between components is given up for a bucket's size.

Sets are made again from whole texts for the documents in the edges to confirm; they aren't stored for the others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WORDS = 5
PERCENT = 75
BINS, ROWS = 128, 4
BANDS = BINS // ROWS
#: So many ids are broadcast at most (16 bytes each); beyond, the join is shuffled.
MAX_BROADCAST_IDS = 2_000_000
#: Members of a bucket, and shingles of theirs, that are settled together (about: blocks are drawn by a hash); a larger bucket
#: is cut into blocks, and every two blocks meet.
SETTLE_MEMBERS, SETTLE_SHINGLES = 2048, 1 << 20
#: A class of copies counts as hot if it has more than this share of all copies: so at most as many classes are hot as its inverse.
HOT_SHARE = 1e-4

_U = np.uint64
_ORDERS = np.random.default_rng(11).integers(0, BINS, (2048, BINS))  # attempts x bins: where an empty bin looks


def mix(h: np.ndarray) -> np.ndarray:
    """The finalizer of a 64-bit hash: every bit of the input bears on every bit of the output."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; of the whole sequence if it has fewer words."""
    words = common.lower_words_of(text)
    if not words:
        return np.empty(0, _U)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U, len(words))
    if len(w) < n:
        return mix(np.array([int.from_bytes(hashlib.blake2b(b" ".join(words), digest_size=8).digest(), "little")], _U))
    h = w[: len(w) - n + 1].copy()
    for i in range(1, n):
        h = h * _U(0x9E3779B97F4A7C15) + w[i: len(w) - n + 1 + i]
    return np.unique(mix(h))


def signature(s: np.ndarray) -> np.ndarray:
    """s: a non-empty sorted set of hashes."""
    width = 64 - BINS.bit_length() + 1
    bins = (s >> _U(width)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
    full = np.zeros(BINS, bool)
    full[bins[first]] = True
    out = np.zeros(BINS, _U)
    out[bins[first]] = s[first]
    if len(first) < BINS:
        empty = np.flatnonzero(~full)
        for some in (_ORDERS[:64], _ORDERS):
            hits = full[some[:, empty]]
            if hits.any(0).all():
                break
        out[empty] = np.where(hits.any(0), out[some[hits.argmax(0), empty]], s[0])
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=_U)
    for i in range(ROWS):
        key = mix(key * _U(0x9E3779B97F4A7C15) + rows[:, i])
    return key.view(np.int64)


def features(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest (null without words), keys (empty without words)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in schema]
            for doc_id, text in common.rows(iter([batch]), "doc_id", "text"):
                s, digest, keys = shingles(text), None, []
                if len(s):
                    digest, keys = hashlib.blake2b(s.tobytes(), digest_size=16).digest(), band_keys(signature(s))
                for c, v in zip(columns, (doc_id, len(s), digest, keys)):
                    c.append(v)
            yield common.emit(schema, columns)

    return common.small_batches(docs).select(docs["doc_id"].cast("bigint").alias("doc_id"), "text").mapInArrow(common.tidy(run), "doc_id bigint, n_shingles bigint, digest binary, keys array<bigint>")


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id, shingles (as bytes) of the documents whose id is in ids (id, unique)."""
    few = ids.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS
    found = docs.select(docs["doc_id"].cast("bigint").alias("id"), "text").join(F.broadcast(ids) if few else ids, "id", "left_semi")
    schema = pa.schema([("id", pa.int64()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(i, shingles(text).tobytes()) for i, text in common.rows(iter([batch]), "id", "text")]
            yield common.emit(schema, [[g[0] for g in got], [g[1] for g in got]])

    return common.small_batches(found).mapInArrow(common.tidy(run), "id bigint, shingles binary")


def confirm(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (a, b) with the sizes of intersection and union of their full sets: a, b, both, either."""
    ids = common.cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    sets = _sets(docs, ids)
    joined = pairs.join(sets.withColumnsRenamed({"id": "b", "shingles": "sb"}), "b").join(sets.withColumnsRenamed({"id": "a", "shingles": "sa"}), "a")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("both", pa.int64()), ("either", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            last, x = None, None
            for a, b, sa, sb in common.rows(iter([batch]), "a", "b", "sa", "sb"):
                if sa is not last:
                    last, x = sa, np.frombuffer(sa, _U)
                y = np.frombuffer(sb, _U)
                merged = np.sort(np.concatenate([x, y]))
                both = int((merged[1:] == merged[:-1]).sum())
                for c, v in zip(out, (a, b, both, len(merged) - both)):
                    c.append(v)
            yield common.emit(schema, out)

    counted = joined.select("a", "b", "sa", "sb").mapInArrow(common.tidy(run), "a bigint, b bigint, both bigint, either bigint")
    return counted.groupBy("a", "b").agg(F.max_by(F.struct("both", "either"), F.col("both") / F.col("either")).alias("m")).select("a", "b", "m.both", "m.either")


def components(links: DataFrame) -> DataFrame:
    """id, label (the smallest id that can be reached) of every id in links (a, b)."""
    edges = common.cut(links.select("a", "b").union(links.select("b", "a")).toDF("id", "other").distinct())
    labels = edges.groupBy("id").agg(F.min("other").alias("m")).select("id", F.least("id", "m").alias("label"))
    labels = common.cut(labels)
    while True:
        near = edges.join(labels.select(F.col("id").alias("other"), "label"), "other").groupBy("id").agg(F.min("label").alias("m"))
        step = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("further"))
        new = common.cut(step.join(jump, "label", "left").select("id", "old", F.least("label", "further").alias("label")))
        labels = new.select("id", "label")
        if new.where("label < old").isEmpty():
            return labels


def _settle(docs: DataFrame, state: DataFrame) -> DataFrame:
    """state: key, id, n, label. Links (a, b) that join what is linked within a bucket: as many as components grow together.

    The full sets of a bucket's members meet in one task, or of two blocks of a bucket's, so its memory is bounded by the sizes of
    the sets. Only links leave it.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def one(table: pa.Table) -> pa.Table:
        ids, n, label = (table.column(c).to_numpy() for c in ("id", "n", "label"))
        flat = np.frombuffer(b"".join(table.column("shingles").to_pylist()), _U)
        _, flat = np.unique(flat, return_inverse=True)
        ends = np.cumsum(n)
        starts, label, mark, out = ends - n, label.copy(), np.zeros(flat.max() + 1, bool), []
        for i in range(len(ids) - 1):
            rest = np.flatnonzero((label[i + 1:] != label[i]) & (100 * np.minimum(n[i], n[i + 1:]) >= PERCENT * np.maximum(n[i], n[i + 1:]))) + i + 1
            if not len(rest):
                continue
            mark[flat[starts[i]: ends[i]]] = True
            both = np.add.reduceat(mark[flat[starts[i + 1]:]], starts[i + 1:] - starts[i + 1], dtype=np.int64)[rest - i - 1]
            mark[flat[starts[i]: ends[i]]] = False
            for j in rest[100 * both >= PERCENT * (n[i] + n[rest] - both)]:
                if label[j] != label[i]:
                    out.append((ids[i], ids[j]))
                    label[label == label[j]] = label[i]
        return pa.table([pa.array([min(x) for x in out], pa.int64()), pa.array([max(x) for x in out], pa.int64())], schema=schema)

    sets = _sets(docs, common.cut(state.select("id").distinct()))
    sizes = state.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / SETTLE_MEMBERS), F.least(F.ceil(F.sum("n") / SETTLE_SHINGLES), F.count("*"))).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = state.join(sizes, "key").select("key", "id", "n", "label", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select(F.struct("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).alias("meeting"), "id", "n", "label")
    return dealt.join(sets, "id").groupBy("meeting").applyInArrow(one, "a bigint, b bigint").distinct()


def links(docs: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """members: key, id, n (the set's size), rank (the least is the centre). Confirmed links (a, b), enough to connect what is linked, and the components (id, label)."""
    spark = docs.sparkSession
    label = spark.createDataFrame([], "id bigint, label bigint")
    centres = members.groupBy("key").agg(F.min(F.struct("rank", "id", "n")).alias("c"))
    pairs = common.cut(members.join(centres, "key").where("id <> c.id").select("key", "id", "n", F.col("c.id").alias("c"), F.col("c.n").alias("cn")))
    fits = F.least("n", "cn") * 100 >= F.greatest("n", "cn") * PERCENT
    asked = common.cut(pairs.where(fits).select(F.least("c", "id").alias("a"), F.greatest("c", "id").alias("b")).distinct())
    seen = common.cut(confirm(docs, asked))
    found = seen.where(F.col("both") * 100 >= F.col("either") * PERCENT).select("a", "b")
    if not found.isEmpty():
        label = components(found)
    # What is left of a bucket: those in another component than the centre, and those of the centre's that may link with one.
    known = seen.select("a", "b", (1 - F.col("both") / F.col("either")).alias("d"))
    now = pairs.select("key", "id", "n", "c", F.least("c", "id").alias("a"), F.greatest("c", "id").alias("b")).join(known, ["a", "b"], "left")
    now = now.join(label.withColumnRenamed("label", "l1"), "id", "left").join(label.select(F.col("id").alias("c"), F.col("label").alias("l2")), "c", "left")
    now = common.cut(now.select("key", "id", "n", "d", F.coalesce("l1", "id").alias("label"), (F.coalesce("l1", "id") != F.coalesce("l2", "c")).alias("straggler")))
    reach = now.groupBy("key").agg(F.min(F.when(F.col("straggler"), F.coalesce("d", F.lit(0.0)))).alias("nearest"), F.min("label").alias("least"), F.max("label").alias("most")).where("nearest IS NOT NULL AND least < most")
    near = F.col("straggler") | F.col("d").isNull() | (F.col("d") >= F.col("nearest") - (100 - PERCENT) / 100 - 1e-9)
    state = common.cut(now.join(reach, "key").where(near).select("key", "id", "n", "label"))
    if not state.isEmpty():
        more = common.cut(_settle(docs, state))
        if not more.isEmpty():
            found = found.union(more)
            label = components(found)
    return found, label


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs (doc_id, text).

    A null, empty or blank text has no shingles and links with nothing. A row with a null doc_id links with nothing, is
    kept and has a null component_id. Rows that share a doc_id are one document, which links as any of its texts does.
    An empty table gives no rows; other columns are ignored.
    """
    f = common.cut(features(docs))
    known = f.where("doc_id IS NOT NULL AND digest IS NOT NULL")
    classes = known.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size"))
    copies = common.cut(classes.where("size > 1"))
    total = copies.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    # The members of a hot class learn its representative by a broadcast, of 1 / HOT_SHARE rows at most; the rest by a join.
    hot = F.col("size") > total * HOT_SHARE
    told = known.join(F.broadcast(copies.where(hot).select("digest", F.col("rep").alias("hot_rep"))), "digest", "left")
    away = F.concat(F.encode(F.lit("hot "), "UTF-8"), F.encode(F.col("doc_id").cast("string"), "UTF-8"))  # no digest is as short
    told = told.withColumn("to", F.when(F.col("hot_rep").isNotNull(), away).otherwise(F.col("digest")))
    told = told.join(copies.where(~hot).select(F.col("digest").alias("to"), "rep"), "to", "left").withColumn("rep", F.coalesce("hot_rep", "rep", "doc_id"))
    of = common.cut(told.select("doc_id", "rep"))
    reps = told.where("rep = doc_id").select("doc_id", "n_shingles", "digest", "keys").dropDuplicates(["digest"])
    banded = reps.select("doc_id", F.col("n_shingles").alias("n"), F.explode("keys").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = common.cut(banded.join(shared, "key").select("key", F.col("doc_id").alias("id"), "n", "size"))
    met = members.groupBy("id").agg((-F.sum("size")).alias("rank"))
    members = common.cut(members.join(met, "id").select("key", "id", "n", "rank"))
    found, label = links(docs, members)
    # A document of several texts, and so of several classes, ties them together.
    ties = of.where("rep <> doc_id").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct()
    several = known.groupBy("doc_id").agg(F.count_distinct("digest").alias("n")).where("n > 1").select(F.col("doc_id").alias("b"))
    if not several.isEmpty():
        label = components(found.union(ties))
    one = of.dropDuplicates(["doc_id"]) if not several.isEmpty() else of.distinct()
    named = one.join(label.withColumnRenamed("id", "rep"), "rep", "left").select("doc_id", F.coalesce("label", "rep").alias("component"))
    out = f.select("doc_id", "n_shingles").join(named, "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, without those that groups() doesn't keep; of rows that share a doc_id and their text one stays.

    Which one is the same on every run: the first in the order of their JSON. Rows without words, or with a null doc_id, stay. Any column
    name may occur.
    """
    of = common.cut(groups(docs))
    gone = of.where(~F.col("kept")).select(F.col("doc_id").alias("id_")).distinct()
    several = of.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("id_"))
    few = lambda ids: F.broadcast(ids) if ids.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS else ids
    rows = docs.select(docs["doc_id"].cast("bigint").alias("id_"), docs["text"].alias("text_"), F.struct(*[docs[f"`{c}`"].alias(c) for c in docs.columns]).alias("row_"))
    left = rows.join(few(gone), "id_", "left_anti")
    if several.isEmpty():
        return left.select("row_.*")
    repeated = left.join(few(several), "id_", "left_semi").groupBy("id_", "text_").agg(F.min_by("row_", F.to_json("row_")).alias("row_"))
    return left.join(few(several), "id_", "left_anti").select("row_.*").unionByName(repeated.select("row_.*"))
