"""Periodic run detection: heavy/light lag counting, then island scans of the lags with enough matches.

A text's words are numbered. At lag q word i matches if word i + q is the same. A run is a stretch with smallest period q and
length >= max(6, 4 q) that no neighbouring word extends: an island of max(6 - q, 3 q) or more matches in a row at lag q.

* Matches of all lags up to n / 4 are counted first. A frequent (heavy) word's by the autocorrelation of the places where it
  stands: the power spectra of all heavy words are summed, and one inverse transform of the sum gives the counts, which are
  whole numbers and rounded to these. A rare (light) word's by the differences of its places, pair by pair.
* A lag with fewer matches than an island needs has no run. The others are scanned, from the smallest: a run of period p
  explains length - q matches at each multiple q of p, which are taken off that lag's count, so a text that is one word a
  million times has one scan and not a quarter of a million.
* A scan of a large lag looks at every (need // 4)th place first, of which an island has at least four in a row.

Rows are worked on one by one and nothing is shuffled. A text of n words takes some 100 n bytes while it is worked on.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

MIN_LENGTH, MIN_POWER = 6, 4
#: A word of fewer places than this is never heavy; a text of n words has heavy words from sqrt(n log n) places on.
MIN_HEAVY = 64
#: Lags up to this are scanned place by place.
SMALL_LAG = 16


def heavy_from(n: int) -> int:
    """The number of places from which a word is heavy: pairs of light words and transforms of heavy ones then cost the same."""
    return max(MIN_HEAVY, math.isqrt(n * max(1, n.bit_length())))


def needed(lags: np.ndarray) -> np.ndarray:
    """Matches in a row that a run of each period has at least."""
    return np.maximum(MIN_LENGTH - lags, (MIN_POWER - 1) * lags)


def lag_counts(ids: np.ndarray, heavy: int | None = None) -> np.ndarray:
    """How many words match at each lag from 0 (not counted) to n // 4. ids: the words as numbers from 0."""
    n = len(ids)
    longest = n // MIN_POWER
    counts = np.zeros(longest + 1, np.int64)
    if not longest:
        return counts
    often = np.bincount(ids)
    is_heavy = often >= (heavy_from(n) if heavy is None else heavy)
    if is_heavy.any():
        size = 1 << (n + longest).bit_length()
        power = np.zeros(size // 2 + 1)
        for word in np.flatnonzero(is_heavy):
            spectrum = np.fft.rfft(ids == word, size)
            power += spectrum.real**2 + spectrum.imag**2
        counts += np.rint(np.fft.irfft(power, size)[: longest + 1]).astype(np.int64)
    places = np.argsort(ids, kind="stable")
    places = places[~is_heavy[ids[places]] & (often[ids[places]] > 1)]
    words = ids[places]
    left, k = np.arange(len(places)), 0
    while len(left):  # places with another of the same word k further on, near enough
        k += 1
        left = left[: np.searchsorted(left, len(places) - k)]
        left = left[words[left] == words[left + k]]
        lags = places[left + k] - places[left]
        near = lags <= longest
        left = left[near]
        counts += np.bincount(lags[near], minlength=longest + 1)
    counts[0] = 0
    return counts


def _islands(ids: np.ndarray, q: int, need: int) -> Iterator[tuple[int, int]]:
    """First place and number of matches of each island of at least `need` matches at lag q."""
    n = len(ids) - q
    if q <= SMALL_LAG:
        ends = np.flatnonzero(np.concatenate(([True], ids[:-q] != ids[q:], [True])))
        long = np.flatnonzero(np.diff(ends) > need)
        yield from zip(ends[long].tolist(), (ends[long + 1] - ends[long] - 1).tolist())
        return
    step = need // 4
    at = np.arange(0, n, step)
    ends = np.flatnonzero(np.concatenate(([True], ids[at] != ids[at + q], [True])))
    for k in np.flatnonzero(np.diff(ends) > 4).tolist():  # places ends[k] .. ends[k + 1] - 2 of `at` match
        first, last = max(0, int(ends[k] - 1) * step), min(n, int(ends[k + 1] - 1) * step + 1)
        here = np.flatnonzero(np.concatenate(([True], ids[first:last] != ids[first + q : last + q], [True])))
        for j in np.flatnonzero(np.diff(here) > need).tolist():
            yield int(first + here[j]), int(here[j + 1] - here[j] - 1)


def _primes(q: int) -> list[int]:
    found, p = [], 2
    while p * p <= q:
        if q % p == 0:
            found.append(p)
            while q % p == 0:
                q //= p
        p += 1
    return [*found, q] if q > 1 else found


def find(ids: np.ndarray, heavy: int | None = None) -> list[tuple[int, int, int]]:
    """start, length, period of every run of words (as numbers from 0), by start, then period."""
    counts = lag_counts(ids, heavy)
    lags = np.arange(len(counts))
    need = needed(lags)
    found = []
    q = 0
    while True:
        more = np.flatnonzero(counts[q + 1 :] >= need[q + 1 :])
        if not len(more):
            return sorted(found, key=lambda r: (r[0], r[2]))
        # Later counts fall with the runs of this lag, so the next lag is looked up again only after one is found.
        for q in (more + q + 1).tolist():
            new = []
            for start, matches in _islands(ids, q, int(need[q])):
                head = ids[start : start + q]
                if not any(np.array_equal(head[: q - q // p], head[q // p :]) for p in _primes(q)):
                    new.append((start, matches + q, q))
            for start, length, _ in new:
                explained = lags[2 * q : length : q]
                counts[explained] -= length - explained
            found += new
            if new:
                break
        else:
            return sorted(found, key=lambda r: (r[0], r[2]))


def numbered(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def kept(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """True for each of n words that no run has after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, q in runs:
        change[start + q] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) == 0


def scan(docs: DataFrame, edit: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """doc_id, n_runs, runs (array of start, length, period, by start, then period) and collapsed (the words that no run repeats,
    joined by one space) for each row of docs (doc_id, text).

    edit: from doc_id and words to the words that are looked at. A null text, or one without words, has no run and collapses to an
    empty text. Repeated rows get a row each; an empty table gives none; other columns are ignored.
    """
    run_type = pa.struct([(x, pa.int64()) for x in ("start", "length", "period")])
    schema = pa.schema([("doc_id", pa.int64()), ("n_runs", pa.int64()), ("runs", pa.list_(run_type)), ("collapsed", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.parts(batches):
            out: list[list] = [[], [], [], []]
            for doc_id, text in common.rows(iter([part]), "doc_id", "text"):
                words = common.words_of(text)
                if edit:
                    words = edit(doc_id, words)
                found = find(numbered(words))
                if found:
                    words = list(itertools.compress(words, kept(len(words), found).tolist()))
                told = [dict(zip(("start", "length", "period"), r)) for r in found]
                for column, value in zip(out, (doc_id, len(found), told, b" ".join(words).decode("utf-8"))):
                    column.append(value)
            yield common.emit(schema, out)

    rows = common.small_batches(docs).select(docs["doc_id"].cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(common.tidy(run), "doc_id bigint, n_runs bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")
