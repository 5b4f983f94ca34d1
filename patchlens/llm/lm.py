"""Language-model scoring by deleted interpolation.

P(w | v) = l2(b) c(v, w) / c(v) + l1(b) c(w) / N + l0(b) / (V + 1): maximum-likelihood estimates of bigrams and words, and
the uniform share of one of the V known tokens or an unknown one. The weights depend on b, the bucket of the context's
frequency c(v) (powers of two; 0 for an unseen context), and are learned by expectation-maximisation on held-out counts:
the training documents fall into two parts, and the tokens of each are held out against the counts of the other. The
first token's context is the end of the text before.

Counting without moving tokens. One pass packs documents into chunks of about CHUNK_TOKENS tokens: their distinct words (as
64-bit hashes, the most frequent first) and the tokens as indexes, and deals the chunks out by their number. From then on, only
each chunk's distinct words and bigrams travel, as sorted blobs of hashes, one for each chunk and slice of the hash range:
a slice is summed over all chunks in one task, and the totals go back to where the chunks that asked for them lie. A word
as frequent as may be adds one entry for each chunk, so no key is hot, and the number of slices grows with the number of
chunks. Of many chunks, teams merge their blobs first, so that these keep a useful size. All counts cover all training documents.

Words have hashes of 64 bits. Bigrams have as many bits as the corpus needs for a bigram to share its hash with any other
at a chance of SHARED at most, whatever the size of the corpus (64 bits from 2 ** 44 tokens on).
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CHUNK_TOKENS = 1_500_000
#: Chunks for each slice of the hash range: a slice then holds about as many entries as so many chunks have distinct ones.
CHUNKS_PER_SLICE = 1
#: Up to so many chunks, each has a blob for each slice (of some hundred entries at least); beyond, blobs are merged in between.
DIRECT_CHUNKS = 2048
#: log2 of the chance that a bigram's hash is another's, too.
SHARED = -20
BUCKETS = 34
#: The histogram from which the weights are learned has so many steps for each factor of two of an estimate.
STEPS, LEVELS = 4, 40
EM_ROUNDS = 50
_U = np.uint64
_END = np.array([0x5F3759DF5F3759DF], _U)


def _pack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def _unpack(raw: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype)


def _delta(hashes: np.ndarray) -> bytes:
    """Of sorted distinct hashes: their differences take fewer bytes."""
    d = np.diff(hashes, prepend=_U(0))
    return _pack(d.view(np.uint8).reshape(-1, 8).T)


def _undelta(raw: bytes) -> np.ndarray:
    return np.cumsum(_unpack(raw, np.uint8).reshape(8, -1).T.copy().view(_U).ravel(), dtype=_U)


def bigram_bits(n_tokens: int) -> int:
    return min(64, n_tokens.bit_length() - SHARED)


def bigram_hash(v: np.ndarray, w: np.ndarray, bits: int = 64) -> np.ndarray:
    h = v * _U(0x9E3779B97F4A7C15) + (w ^ (w >> _U(31))) * _U(0xC2B2AE3D27D4EB4F)
    h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return (h ^ (h >> _U(32))) >> _U(64 - bits)


def _pack_counts(n: np.ndarray, width: int = 4) -> bytes:
    """Of non-negative counts, byte by byte: most are small, and bytes of zeros take no room. width: 4 within a chunk, 8 for totals."""
    return _pack(n.astype(f"<u{width}").ravel().view(np.uint8).reshape(-1, width).T)


def _unpack_counts(raw: bytes, width: int = 4) -> np.ndarray:
    return _unpack(raw, np.uint8).reshape(width, -1).T.copy().view(f"<u{width}").ravel()


class Chunk:
    """The tokens of some documents: tokens[i] indexes words; part 0, 1 (training) or 2 (held out) and length by document."""

    def __init__(self, words: np.ndarray, tokens: np.ndarray, lengths: np.ndarray, parts: np.ndarray):
        self.words, self.tokens, self.lengths, self.parts = words, tokens, lengths, parts
        self.end = int(np.flatnonzero(words == _END[0])[0])

    def contexts(self) -> np.ndarray:
        out = np.empty_like(self.tokens)
        out[1:] = self.tokens[:-1]  # a document's last token is its end, so the next one's first context is the end
        out[0] = self.end
        return out

    def word_counts(self) -> np.ndarray:
        """2 x words: of parts 0 and 1."""
        part = np.repeat(self.parts, self.lengths)
        return np.stack([np.bincount(self.tokens[part == k], minlength=len(self.words)) for k in (0, 1)])

    def bigrams(self, bits: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct hashes, the counts of parts 0 and 1, a token's place among them, and one token of each."""
        v, w = self.words[self.contexts()], self.words[self.tokens]
        hashes, first, inverse = np.unique(bigram_hash(v, w, bits), return_index=True, return_inverse=True)
        part = np.repeat(self.parts, self.lengths)
        return hashes, np.stack([np.bincount(inverse[part == k], minlength=len(hashes)) for k in (0, 1)]), inverse, first


def _chunks(docs: DataFrame, held_out_of: int, held_out: int) -> DataFrame:
    """One row for each chunk: chunk, n_tokens, ids, lengths, parts, words, tokens (packed)."""
    schema = pa.schema([("chunk", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int64())), ("lengths", pa.binary()), ("parts", pa.binary()), ("words", pa.binary()), ("tokens", pa.binary())])

    def part_of(doc_id: int | None) -> int:
        r = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 0
        return 2 if r % held_out_of == held_out else (r // held_out_of) % 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, n = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32, 0
        at: dict[bytes, int] = {}
        ids: list = []
        docs_tokens: list[np.ndarray] = []
        parts: list[int] = []

        def flush():
            nonlocal at, ids, docs_tokens, parts, n
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, at), _U, len(at))
            tokens = np.concatenate([np.append(t, np.uint32(len(at))) if t is not None else [np.uint32(len(at))] for t in docs_tokens]).astype(np.uint32)
            hashes = np.append(hashes, _END)
            hashes, same = np.unique(hashes, return_inverse=True)
            tokens = same[tokens]
            order = np.argsort(-np.bincount(tokens, minlength=len(hashes)), kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            lengths = np.array([1 if t is None else len(t) + 1 for t in docs_tokens], np.uint32)
            out = common.emit(schema, [[base + n], [len(tokens)], [ids], [_pack(lengths)], [_pack(np.array(parts, np.uint8))], [_pack(hashes[order])], [_pack_counts(rank[tokens])]])
            at, ids, docs_tokens, parts, n = {}, [], [], [], n + 1
            return out

        size = 0
        for doc_id, text in common.rows(batches, "doc_id", "text"):
            words = common.lower_words_of(text)
            docs_tokens.append(np.array([at.setdefault(w, len(at)) for w in words], np.uint32) if words else None)
            ids.append(doc_id)
            parts.append(part_of(doc_id))
            size += len(words) + 1
            if size >= CHUNK_TOKENS:
                yield flush()
                size = 0
        if ids:
            yield flush()

    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), "text").mapInArrow(common.tidy(run), "chunk bigint, n_tokens bigint, ids array<bigint>, lengths binary, parts binary, words binary, tokens binary")


def _chunk(row: dict) -> Chunk:
    return Chunk(_unpack(row["words"], _U), _unpack_counts(row["tokens"]).astype(np.int64), _unpack(row["lengths"], np.uint32).astype(np.int64), _unpack(row["parts"], np.uint8))


def _dicts(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


WORDS, BIGRAMS = 0, 1
_BLOBS = pa.schema([("kind", pa.int64()), ("slice", pa.int64()), ("chunk", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())])
_TOTALS = pa.schema([("chunk", pa.int64()), ("kind", pa.int64()), ("slice", pa.int64()), ("counts", pa.binary()), ("sum0", pa.int64()), ("sum1", pa.int64()), ("known", pa.int64())])
_BLOBS_SQL = "kind bigint, slice bigint, chunk bigint, hashes binary, counts binary"
_TOTALS_SQL = "chunk bigint, kind bigint, slice bigint, counts binary, sum0 bigint, sum1 bigint, known bigint"


def _cuts(lo: int, hi: int, step: int, slices: int, width: int) -> np.ndarray:
    """The hashes at which slices lo + step, lo + 2 step, ... below hi begin."""
    return np.array([(i << width) // slices for i in range(lo + step, hi, step)], _U)


def _sliced(hashes: np.ndarray, counts: np.ndarray, cuts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Number, hashes and counts of the slices that have some."""
    at = np.searchsorted(hashes, cuts)
    for k, (h, n) in enumerate(zip(np.split(hashes, at), np.split(counts, at, axis=1))):
        if len(h):
            yield k, h, n


class _Merged:
    """The blobs of a slice: their hashes together, their summed counts, and where each blob's entries are among them."""

    def __init__(self, table: pa.Table, width: int):
        self.rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
        parts = [_undelta(r["hashes"]) for r in self.rows]
        self.hashes, back = np.unique(np.concatenate(parts), return_inverse=True)
        counts = np.concatenate([_unpack_counts(r["counts"], width).reshape(2, -1) for r in self.rows], axis=1)
        self.sums = np.stack([np.bincount(back, counts[k], len(self.hashes)) for k in (0, 1)]).astype(np.int64)  # sums in doubles: exact to 2 ** 53
        self.places = np.split(back, np.cumsum([len(h) for h in parts])[:-1])

    def answers(self, sums: np.ndarray, own: tuple[int, int, int]) -> pa.Table:
        """For each blob the sums of its entries; own goes with the first one."""
        out: list[list] = [[] for _ in _TOTALS]
        for i, (r, place) in enumerate(zip(self.rows, self.places)):
            for c, v in zip(out, (r["chunk"], r["kind"], r["slice"], _pack_counts(sums[:, place], 8), *(own if i == 0 else (0, 0, 0)))):
                c.append(v)
        return pa.Table.from_batches([common.emit(_TOTALS, out)])


def _summed(blobs: DataFrame, width: int) -> DataFrame:
    """The answers to all blobs of each slice. width: of their counts."""

    def total(table: pa.Table) -> pa.Table:
        m = _Merged(table, width)
        return m.answers(m.sums, (int(m.sums[0].sum()), int(m.sums[1].sum()), int((m.sums.sum(0) > 0).sum())))

    return blobs.groupBy("kind", "slice").applyInArrow(total, _TOTALS_SQL)


def _totals(chunks: DataFrame, n_chunks: int, slices: int, bits: int, partitions: int) -> DataFrame:
    """chunk, kind, slice, counts: the totals (2 x entries) of the chunk's words or bigrams in the slice, in order of their hashes.

    sum0, sum1 and known are the slice's own totals, given with one of its rows: tokens of parts 0 and 1, and distinct
    entries that occur in training.

    With more than DIRECT_CHUNKS chunks, teams of about as many chunks as the root of their number merge what they have of a
    coarse slice, ask for the totals of its fine slices as one, and hand them on. Blobs then number n_chunks ** 1.5, not its square.
    """
    width_of = {WORDS: 64, BIGRAMS: bits}
    coarse = slices if n_chunks <= DIRECT_CHUNKS else math.isqrt(slices - 1) + 1
    fine = -(-slices // coarse)
    slices = coarse * fine

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _dicts(batches):
            c = _chunk(row)
            order = np.argsort(c.words)
            for kind, (hashes, counts) in ((WORDS, (c.words[order], c.word_counts()[:, order])), (BIGRAMS, c.bigrams(bits)[:2])):
                for k, h, n in _sliced(hashes, counts, _cuts(0, slices, fine, slices, width_of[kind])):
                    yield common.emit(_BLOBS, [[kind], [k], [row["chunk"]], [_delta(h)], [_pack_counts(n)]])

    blobs = chunks.mapInArrow(common.tidy(spread), _BLOBS_SQL)
    if n_chunks <= DIRECT_CHUNKS:
        return _summed(blobs, 4)

    def merge(table: pa.Table) -> pa.Table:
        m = _Merged(table, 4)
        kind, k, team = (table.column(c)[0].as_py() for c in ("kind", "slice", "team"))
        cuts = _cuts(k * fine, (k + 1) * fine, 1, slices, width_of[kind])
        got = [(kind, k * fine + j, team, _delta(h), _pack_counts(n, 8)) for j, h, n in _sliced(m.hashes, m.sums, cuts)]
        return pa.Table.from_batches([common.emit(_BLOBS, [list(c) for c in zip(*got)])])

    def hand_on(table: pa.Table, totals: pa.Table) -> pa.Table:
        m = _Merged(table, 4)
        rows = sorted(totals.to_pylist(), key=lambda r: r["slice_"])
        sums = np.concatenate([_unpack_counts(r["counts"], 8).reshape(2, -1) for r in rows], axis=1)
        return m.answers(sums, tuple(sum(r[x] for r in rows) for x in ("sum0", "sum1", "known")))

    keys = ("kind", "slice", "team")
    teams = -(-n_chunks // (math.isqrt(n_chunks - 1) + 1))
    of_teams = _placed(blobs.withColumn("team", F.pmod(F.xxhash64("chunk"), F.lit(teams))), partitions, *keys)
    asked = of_teams.groupBy(*keys).applyInArrow(merge, _BLOBS_SQL)
    told = _summed(asked, 8).withColumn("team", F.col("chunk")).withColumn("slice_", F.col("slice")).withColumn("slice", F.expr(f"slice div {fine}"))
    told = told.select(*keys, "slice_", "counts", "sum0", "sum1", "known")
    return of_teams.groupBy(*keys).cogroup(told.groupBy(*keys)).applyInArrow(hand_on, _TOTALS_SQL)


def _placed(df: DataFrame, partitions: int, *keys: str) -> DataFrame:
    """df cut by a checkpoint that knows that it's dealt out by keys: such ones meet without another shuffle.

    Spark forgets that of an adaptive plan, so the plan isn't one.
    """
    conf, key = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    before = conf.get(key)
    conf.set(key, "false")
    try:
        return common.cut(df.repartition(partitions, *keys))
    finally:
        conf.set(key, before)


def bucket_of(context_counts: np.ndarray) -> np.ndarray:
    """0 for an unseen context, then by powers of two."""
    return np.minimum(BUCKETS - 1, np.ceil(np.log2(context_counts + 1)).astype(np.int64))


def _ratio(a: np.ndarray, b) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(np.broadcast(a, b).shape), where=np.asarray(b) > 0)


def _estimates(chunk: pa.Table, totals: pa.Table, bits: int) -> tuple[Chunk, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The chunk, its words' totals and its bigrams' totals (2 x entries), local counts, a token's bigram, and each bigram's words."""
    c = _chunk(chunk.to_pylist()[0])
    rows = sorted(totals.select(["kind", "slice", "counts"]).to_pylist(), key=lambda r: r["slice"])
    of = [np.concatenate([_unpack_counts(r["counts"], 8).reshape(2, -1) for r in rows if r["kind"] == kind], axis=1).astype(np.int64) for kind in (WORDS, BIGRAMS)]
    words = np.empty_like(of[WORDS])
    words[:, np.argsort(c.words)] = of[WORDS]
    _, local, inverse, first = c.bigrams(bits)
    return c, words, of[BIGRAMS], local, inverse, c.contexts()[first], c.tokens[first]


def level(p: np.ndarray) -> np.ndarray:
    """A step of an estimate for the histogram: 0 for 0, else STEPS for each factor of two, down to 2 ** -LEVELS."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, 1 + np.clip(np.round(-STEPS * np.log2(np.maximum(p, 1e-300))), 0, STEPS * LEVELS), 0).astype(np.int64)


def value(step: np.ndarray) -> np.ndarray:
    return np.where(step > 0, 2.0 ** (-(step - 1) / STEPS), 0.0)


def learn(histogram: np.ndarray, uniform: float, rounds: int = EM_ROUNDS) -> np.ndarray:
    """The weights l2, l1, l0 by bucket, from rows (bucket, step of the bigram's estimate, step of the word's, count)."""
    out = np.tile([0.4, 0.5, 0.1], (BUCKETS, 1))
    out[0] = [0.0, 0.9, 0.1]
    for b in range(BUCKETS):
        h = histogram[histogram[:, 0] == b]
        if not len(h):
            if b > 1:
                out[b] = out[b - 1]
            continue
        p = np.stack([value(h[:, 1]), value(h[:, 2]), np.full(len(h), uniform)])
        for _ in range(rounds):
            share = out[b][:, None] * p
            share = share / share.sum(0) * h[:, 3]
            out[b] = (share.sum(1) + 0.01) / (share.sum() + 0.03)
        if b == 0:
            out[b] = np.array([0, *out[b][1:]]) / out[b][1:].sum()
    return out


def score(docs: DataFrame, held_out_of: int = 7, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of docs (doc_id, text).

    Learned from are the documents whose crc32(doc_id as text) modulo held_out_of isn't held_out (a null doc_id has
    remainder 0). A null or empty text has its end as its one token. Repeated rows count as often as they occur and get
    a row each. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    dealt = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    chunks = _placed(_chunks(docs, held_out_of, held_out), dealt, "chunk")
    size = chunks.agg(F.count("*").alias("chunks"), F.sum("n_tokens").alias("tokens")).first()
    slices, bits = max(1, size["chunks"] // CHUNKS_PER_SLICE), bigram_bits(size["tokens"] or 0)
    totals = _placed(_totals(chunks, size["chunks"], slices, bits, dealt), dealt, "chunk")
    t = totals.where(F.col("kind") == WORDS).agg(F.sum("sum0").alias("n0"), F.sum("sum1").alias("n1"), F.sum("known").alias("v")).first()
    n0, n1, v = (int(x or 0) for x in (t["n0"], t["n1"], t["v"]))
    total = np.array([n0, n1])
    both = chunks.groupBy("chunk").cogroup(totals.groupBy("chunk"))

    def held_out_counts(chunk: pa.Table, own_totals: pa.Table) -> pa.Table:
        _, w, p, local, _, context, word = _estimates(chunk, own_totals, bits)
        keys, counts = [], []
        for held in (0, 1):
            own = np.flatnonzero(local[held])
            c, base = w[1 - held][context[own]], max(1, total[1 - held])
            keys.append((bucket_of(c) * 1024 + level(_ratio(p[1 - held][own], c))) * 1024 + level(w[1 - held][word[own]] / base))
            counts.append(local[held][own])
        k, back = np.unique(np.concatenate(keys), return_inverse=True)
        return pa.table({"key": pa.array(k, pa.int64()), "n": pa.array(np.bincount(back, np.concatenate(counts), len(k)).astype(np.int64), pa.int64())})

    # At most BUCKETS x (STEPS x LEVELS + 2)^2 rows, whatever the size of the corpus.
    rows = both.applyInArrow(held_out_counts, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).collect()
    histogram = np.array([(r["key"] >> 20, (r["key"] >> 10) & 1023, r["key"] & 1023, r["n"]) for r in rows], np.int64).reshape(-1, 4)
    weights = learn(histogram, 1 / (v + 1))
    n = n0 + n1
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), *((x, pa.int64()) for x in ("n_tokens", "n_known", "train_tokens")), ("base_score", pa.float64()), ("score", pa.float64())])

    def scores(chunk: pa.Table, own_totals: pa.Table) -> pa.Table:
        c, w, p, _, inverse, context, word = _estimates(chunk, own_totals, bits)
        w, p = w.sum(0), p.sum(0)
        base = np.log10((w + 1) / (n + v + 1))[c.tokens]
        lam = weights[bucket_of(w[context])]
        mixed = np.log10(lam[:, 0] * _ratio(p, w[context]) + lam[:, 1] * _ratio(w[word], n) + lam[:, 2] / (v + 1))[inverse]
        starts = np.r_[0, np.cumsum(c.lengths)[:-1]]
        add = lambda x: np.add.reduceat(x, starts).tolist()
        ids = chunk.column("ids").to_pylist()[0]
        return pa.Table.from_batches([common.emit(schema, [ids, (c.parts == 2).tolist(), c.lengths.tolist(), add((w > 0)[c.tokens].astype(np.int64)), [n] * len(starts), add(base), add(mixed)])])

    return both.applyInArrow(scores, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
