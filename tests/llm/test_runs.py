"""Periodic runs against brute force on small texts, and the counts of lags against pairs."""

import hashlib
import random
import zlib

import numpy as np
import pytest

pytest.importorskip("patchlens.llm.queries")
from patchlens.llm import queries, runs  # noqa: E402


def brute(words):
    """Every run, by trying each period at each place."""
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            end = i
            while end + q < n and words[end] == words[end + q]:
                end += 1
            start, length = i, end + q - i
            if length >= max(6, 4 * q) and not any(all(words[k] == words[k + p] for k in range(start, start + length - p)) for p in range(1, q)):
                found.append((start, length, q))
            i = end + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def texts():
    r = random.Random(5)
    out = [[], ["a"], ["a"] * 5, ["a"] * 6, ["a", "b"] * 3, ["a", "b"] * 4, ["a"] * 400, ["a", "a", "b"] * 50, ["a"] * 7 + ["b"] * 9 + ["a"] * 7]
    for _ in range(400):
        n, kinds = r.choice((20, 60, 150)), r.choice((2, 3, 30))
        w = [str(r.randrange(kinds)) for _ in range(n)]
        for _ in range(r.randrange(3)):
            p, at = r.randrange(1, 25), r.randrange(n)
            unit = w[at : at + p]
            w[at:at] = unit * r.randrange(1, 6) + unit[: r.randrange(p + 1)]
        out.append(w)
    return out


@pytest.mark.parametrize("heavy", [None, 0, 5])
def test_runs_against_brute_force(heavy):
    for words in texts():
        assert runs.find(runs.numbered([w.encode() for w in words]), heavy) == brute(words), words


def test_counts_of_lags():
    r = np.random.default_rng(1)
    ids = np.minimum(r.zipf(1.3, 3000), 400) - 1
    want = [0, *(int((ids[:-q] == ids[q:]).sum()) for q in range(1, 751))]
    for heavy in (None, 0, 40, 10**9):
        assert runs.lag_counts(ids, heavy).tolist() == want


def test_long_texts_take_near_linear_time():
    r = np.random.default_rng(2)
    same = np.zeros(300_000, np.int64)
    assert runs.find(same) == [(0, 300_000, 1)]
    unit = r.integers(0, 5000, 20_000)
    assert runs.find(np.concatenate((np.tile(unit, 5), r.integers(5000, 9000, 1000)))) == [(0, 100_000, 20_000)]
    noise = np.minimum(r.zipf(1.2, 200_000), 50_000)
    assert all(length >= max(6, 4 * q) for _, length, q in runs.find(noise))


def test_query_and_edges(spark, tmp_path):
    rows = [(i, " ".join(w), "x") for i, w in enumerate(texts()[:90])] + [(None, None, None), (7, None, "y"), (-3, " \t\n", ""), (-30, "é ü é ü " * 9, ""), (5, "a b " * 9, "x"), (5, "a b " * 9, "x")]
    schema = "doc_id bigint, text string, runs string"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")

    def told(doc_id, text):
        words = (text or "").replace("\t", " ").replace("\n", " ").split(" ")
        words = [w for w in words if w]
        h, n = zlib.crc32(str(doc_id).encode() if doc_id is not None else b""), len(words)
        g, old = h // 10, list(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [old[i] if i < a else old[a + (i - a) % p] for i in range(n)]
        found = brute(words)
        dropped = {i for s, length, q in found for i in range(s + q, s + length)}
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))

    got = queries.op13_periodic_runs(spark, str(tmp_path)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(told(i, t)) for i, t, _ in rows)
    empty = spark.createDataFrame([], schema)
    assert runs.scan(empty).count() == 0
