"""Toxicity: a factorization machine over hashed terms.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), with x_i = 1 for each hashed term of the text: its
distinct words (ASCII letters lower-cased, outer punctuation removed) and their prefixes. The pairwise part, computed in
linear time by the usual identity, learns interactions that additive weights miss.

Terms get weights if their documents' labels differ from the rest's, or if they are in a pair whose four combinations of
presence show an interaction (p11 - p10 - p01 + p00, in standard errors), whatever the terms tell alone. Pairs are
counted among the PAIR_TERMS terms of the most sampled documents.

The model is fitted on the driver over a bounded sample of labelled rows: at most MAX_TRAIN_DOCS, those with the smallest
hash of their id, and at most MAX_TRAIN_BYTES of their terms' hashes, which are all that leaves the executors. Scoring is one pass over the documents without a shuffle;
the model that is sent along has a fixed size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BITS = 18
RANK = 8
PREFIX = 4
MAX_TRAIN_DOCS, MAX_TRAIN_BYTES = 12_000, 64 << 20
THRESHOLD = 0.3
#: A term counts alone if it is in so many sampled documents at least, and if its shares of the two labels' documents differ by
#: so many standard errors: chance differences of rare terms would else drown the rest in long documents.
MIN_DOCS, MIN_Z = 3, 4.0
#: A pair counts if each of its combinations is in so many sampled documents, and its interaction has so many standard errors.
PAIR_TERMS, MIN_CELL, MIN_PAIR_Z = 2048, 10, 9.0
EPOCHS, BATCH, RATE, L2, SEED = 12, 64, 0.1, 1e-3, 1
CACHE_WORDS = 200_000
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
FIELD = "_label"


@dataclass
class Model:
    """slot: for each hash, the row of its weights, or 0 for none; w and v have zeros there."""

    w0: float
    slot: np.ndarray
    w: np.ndarray
    v: np.ndarray

    def raw(self, slots: np.ndarray) -> float:
        if not len(slots):
            return self.w0
        v = self.v[slots]
        return float(self.w0 + self.w[slots].sum() + 0.5 * ((v.sum(0) ** 2).sum() - (v * v).sum()))

    def score(self, slots: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.raw(slots), -35, 35))))


class Terms(dict):
    """Hashes of a word's terms, by word."""

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) > CACHE_WORDS:
            self.clear()
        core, mask = word.strip(PUNCTUATION), (1 << BITS) - 1
        got = ()
        if core:
            got = (zlib.crc32(core) & mask,)
            prefix = core.decode("utf-8", "replace")[:PREFIX]
            if len(prefix) == PREFIX:
                got += (zlib.crc32(b"^" + prefix.encode()) & mask,)
        self[word] = got
        return got


def terms_of(text: str | None, known: Terms) -> set[int]:
    out: set[int] = set()
    for got in map(known.__getitem__, set(common.lower_words_of(text))):
        out.update(got)
    return out


def interacting(rows: list[np.ndarray], y: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The terms in pairs with an interaction. seen: the documents of each term."""
    n = len(y)
    common_terms = np.flatnonzero((seen >= MIN_CELL) & (seen <= n - MIN_CELL))
    terms = np.sort(common_terms[np.argsort(-seen[common_terms], kind="stable")[:PAIR_TERMS]])
    if len(terms) < 2:
        return terms[:0]
    place = np.full(len(seen), -1)
    place[terms] = np.arange(len(terms))
    both, toxic = (np.zeros((len(terms), len(terms)), np.float32) for _ in range(2))
    for at in range(0, n, 512):
        x = np.zeros((min(512, n - at), len(terms)), np.float32)
        for k, r in enumerate(rows[at: at + 512]):
            own = place[r]
            x[k, own[own >= 0]] = 1
        both += x.T @ x
        x = x[y[at: at + 512] > 0]
        toxic += x.T @ x
    d, t, found = both.diagonal().copy(), toxic.diagonal().copy(), np.zeros(len(terms), bool)
    for at in range(0, len(terms), 256):
        n11, t11, some = both[at: at + 256], toxic[at: at + 256], slice(at, at + 256)
        cells = [(n11, t11), (d[some, None] - n11, t[some, None] - t11), (d[None] - n11, t[None] - t11), (n - d[some, None] - d[None] + n11, y.sum() - t[some, None] - t[None] + t11)]
        shares = [(k + 0.5) / (m + 1) for m, k in cells]
        error = sum(p * (1 - p) / (m + 1) for p, (m, _) in zip(shares, cells))
        z = np.abs(shares[0] - shares[1] - shares[2] + shares[3]) / np.sqrt(error)
        hit = (z >= MIN_PAIR_Z) & np.minimum.reduce([m for m, _ in cells]).__ge__(MIN_CELL)
        found[some] |= hit.any(1)
        found |= hit.any(0)
    return terms[found]


def fit(rows: list[tuple[np.ndarray, int]], rank: int = RANK) -> Model:
    """rows: the hashes and the label (0 or 1) of each document. Without both labels, the score is the labels' mean."""
    rng, y = np.random.default_rng(SEED), np.array([label for _, label in rows], float)
    rate = float((y.sum() + 0.5) / (len(y) + 1)) if len(y) else 1e-3
    slot = np.zeros(1 << BITS, np.int32)
    if len(set(y)) < 2:
        return Model(float(np.log(rate / (1 - rate))), slot, np.zeros(1), np.zeros((1, rank)))
    in1, in0 = (np.bincount(np.concatenate([r for r, label in rows if label == k]), minlength=1 << BITS) for k in (1, 0))
    n1, n0, seen = y.sum(), len(y) - y.sum(), in1 + in0
    share = np.clip(seen / len(y), 1e-9, 1 - 1e-9)
    z = np.abs(in1 / n1 - in0 / n0) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0))
    known = np.union1d(np.flatnonzero((seen >= MIN_DOCS) & (z >= MIN_Z)), interacting([r for r, _ in rows], y, seen))
    slot[known] = np.arange(1, len(known) + 1)
    docs = [(s := slot[r])[s > 0] for r, _ in rows]
    m = len(known) + 1
    w, v = np.zeros(m), rng.normal(0, 0.05, (m, rank))
    v[0] = 0
    w0, gw0, gw, gv = float(np.log(rate / (1 - rate))), 1.0, np.ones(m), np.ones((m, rank))
    for _ in range(EPOCHS):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), BATCH):
            some = order[at: at + BATCH]
            idx = np.concatenate([docs[i] for i in some])
            doc = np.repeat(np.arange(len(some)), [len(docs[i]) for i in some])
            vi = v[idx]
            sums = np.stack([np.bincount(doc, vi[:, f], len(some)) for f in range(rank)], 1)
            squares = np.bincount(doc, (vi * vi).sum(1), len(some))
            z = w0 + np.bincount(doc, w[idx], len(some)) + 0.5 * ((sums**2).sum(1) - squares)
            g = 1 / (1 + np.exp(-np.clip(z, -35, 35))) - y[some]
            d0 = g.sum()
            gw0 += d0 * d0
            w0 -= RATE * d0 / np.sqrt(gw0)
            touched, back = np.unique(idx, return_inverse=True)
            dw = np.bincount(back, g[doc]) + L2 * len(some) * w[touched]
            gw[touched] += dw * dw
            w[touched] -= RATE * dw / np.sqrt(gw[touched])
            each = g[doc][:, None] * (sums[doc] - vi)
            dv = np.stack([np.bincount(back, each[:, f]) for f in range(rank)], 1) + L2 * len(some) * v[touched]
            gv[touched] += dv * dv
            v[touched] -= RATE * dv / np.sqrt(gv[touched])
    w[0], v[0] = 0, 0
    return Model(w0, slot, w, v)


def sample(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_TRAIN_DOCS) -> list[tuple[np.ndarray, int]]:
    """The terms and labels of at most max_docs labelled documents, the same ones on every run.

    labels: doc_id, toxic. Rows with a null are ignored; of several labels of a document the largest holds.
    """
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias(FIELD)).dropna().groupBy("doc_id").agg(F.max(FIELD).alias(FIELD))
    bounded = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)  # at most 16 bytes times max_docs are broadcast

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Terms()
        for batch in batches:
            got = [(np.array(sorted(terms_of(text, known)), "<i4").tobytes(), label) for text, label in common.rows(iter([batch]), "text", FIELD)]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.binary()), pa.array([g[1] for g in got], pa.int32())], ["terms", FIELD])

    joined = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), "text").join(F.broadcast(bounded), "doc_id").select("doc_id", "text", FIELD)
    found = common.small_batches(joined).select("text", FIELD).mapInArrow(common.tidy(run), f"terms binary, {FIELD} int")
    found = common.cut(found.withColumn("size", F.length("terms")))
    sizes = sorted((r["h"], r["size"]) for r in found.select(F.xxhash64("terms", FIELD).alias("h"), "size").collect())
    total, last = 0, None
    for h, size in sizes:  # all, unless they are too many bytes
        total += size
        if total > MAX_TRAIN_BYTES:
            break
        last = h
    found = found.where(F.xxhash64("terms", FIELD) <= F.lit(last)).select("terms", FIELD).collect() if sizes and last is not None else []
    return [(np.frombuffer(r[0], "<i4"), min(1, max(0, r[1]))) for r in sorted(found)]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and predicted of each row. A null or empty text has no terms: its score is the bias alone.

    Repeated rows get a row each; an empty table gives none; other columns are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, known = sent.value, Terms()
        for batch in batches:
            ids, scores = [], []
            for doc_id, text in common.rows(iter([batch]), "doc_id", "text"):
                terms = terms_of(text, known)
                slots = m.slot[np.fromiter(terms, np.int64, len(terms))]
                ids.append(doc_id)
                scores.append(m.score(slots[slots > 0]))
            yield common.emit(schema, [ids, scores, [int(s >= THRESHOLD) for s in scores]])

    return common.small_batches(docs).select(docs["doc_id"].cast("bigint").alias("doc_id"), "text").mapInArrow(common.tidy(run), "doc_id bigint, score double, predicted int")


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with all their columns, whose score is below THRESHOLD. Rows are handled as score() does."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, known = sent.value, Terms()
        for batch in batches:
            keep = []
            for (text,) in common.rows(iter([batch]), "text"):
                terms = terms_of(text, known)
                slots = m.slot[np.fromiter(terms, np.int64, len(terms))]
                keep.append(m.score(slots[slots > 0]) < THRESHOLD)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return common.small_batches(docs).mapInArrow(common.tidy(run), docs.schema)


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_TRAIN_DOCS) -> Model:
    return fit(sample(docs, labels, max_docs))
