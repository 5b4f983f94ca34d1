"""The operators against brute force, on small tables with nulls, ties, repeats, empty and long texts, and clashing columns."""

import collections
import math
import random
import zlib

import numpy as np
import pytest

pytest.importorskip("patchlens.llm.queries")
import public_tokenizers  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from patchlens.llm import cws, licenses, lm, mixing, neardup, order, packing, pii, quality, toxicity  # noqa: E402

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, label int, a int, b int, block int, rank int, d double"
VOCAB = public_tokenizers.path("word_bpe_49k.json")
_R = random.Random(3)
_WORDS = [f"w{i}" for i in range(300)]
_BASE = [" ".join(_R.choices(_WORDS, k=60)) for _ in range(6)]


def _edited(text, n):
    w = text.split()
    for _ in range(n):
        w[_R.randrange(len(w))] = _R.choice(_WORDS)
    return " ".join(w)


TEXTS = [*_BASE, *(_edited(t, 1) for t in _BASE), *(_edited(t, 2) for t in _BASE[:3]), _BASE[0], _BASE[0].upper(), None, "", " \n\t ", "one two", "one two", "é ü\x1cx", " ".join(_R.choices(_WORDS, k=9000))]
ROWS = [(i, t, "en" if i % 2 else None, None if i % 5 == 0 else f"s{i % 3}", 0, "k", 1, 2, 3, 4, 5, 0.5) for i, t in enumerate(TEXTS)] + [(None, "a b c", None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS + ROWS[:1], SCHEMA).repartition(2).persist()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_packing_round_trip(docs, none):
    pieces = packing.pack(docs, VOCAB).collect()
    tok = packing.tokenizer(VOCAB)
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for i, text, *_ in ROWS[1:]:
        want = np.array([*(tok.whole.encode(text, add_special_tokens=False).ids if text else []), 2], "<u4").tobytes()
        assert b"".join(bytes(p.ids) for p in sorted(by_doc[i], key=lambda p: p.start)) == want
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == list(np.cumsum([0, *(p.length for p in own)])[:-1]) and sum(p.length for p in own) <= own[0].tier <= 4096
    assert packing.pack(none, VOCAB).count() == 0


def test_plan_fills_sequences():
    pieces = [(k, 0, _R.randrange(1, 9000)) for k in range(200)]
    made, left = packing.plan(pieces, last=False)
    assert all(sum(n for _, _, n in s) == t for t, s in made) and sum(n for _, _, n in left) < 4096
    total = sum(n for _, s in made for _, _, n in s) + sum(n for _, _, n in left)
    assert total == sum(n for _, _, n in pieces)


def test_near_duplicates(docs, none):
    sets = {r[0]: set(neardup.shingles(r[1]).tolist()) for r in ROWS if r[0] is not None}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    for r in neardup.groups(docs).collect():
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), find(r.doc_id), find(r.doc_id) == r.doc_id)
    ids = [r.doc_id for r in neardup.keep_one(docs).select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == sorted(i for i in up if find(i) == i) and None in ids
    assert neardup.groups(none).count() == 0


def test_settle_blocks(spark, docs):
    ids = [0, 6, 12, 1, 7]
    n = {r[0]: len(neardup.shingles(r[1])) for r in ROWS}
    state = spark.createDataFrame([(9, i, n[i], i) for i in ids], "key bigint, id bigint, n bigint, label bigint")
    whole = {tuple(r) for r in neardup._settle(docs, state).collect()}
    old, neardup.SETTLE_MEMBERS = neardup.SETTLE_MEMBERS, 2
    try:
        parts = {tuple(r) for r in neardup._settle(docs, state).collect()}
    finally:
        neardup.SETTLE_MEMBERS = old
    assert whole and whole <= parts


def test_language_model(docs, none):
    got = [r for r in lm.score(docs).collect()]
    rows = ROWS + ROWS[:1]
    tokens = [(t.encode().lower().split() if t else []) + [b"\n"] for _, t, *_ in rows]
    held = [(zlib.crc32(str(r[0]).encode()) if r[0] is not None else 0) % 7 == 2 for r in rows]
    c = collections.Counter(w for t, h in zip(tokens, held) if not h for w in t)
    n, v = sum(c.values()), len(c)
    want = collections.Counter((r[0], len(t), sum(c[w] > 0 for w in t), h, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 6)) for r, t, h in zip(rows, tokens, held))
    assert collections.Counter((r.doc_id, r.n_tokens, r.n_known, r.held_out, round(r.base_score, 6)) for r in got) == want
    assert all(r.train_tokens == n and math.isfinite(r.score) and r.score < 0 for r in got)
    assert lm.score(none).count() == 0


def test_weights_sum_to_one():
    w = lm.learn(np.array([[3, 5, 40, 10], [0, 0, 30, 4]]), 1e-4)
    assert np.allclose(w.sum(1), 1) and (w >= 0).all() and w[0, 0] == 0


def test_fingerprints(docs, none):
    got = {r.doc_id: r for r in cws.fingerprints(docs.where("doc_id > 0")).collect()}
    ids = sorted(got, reverse=True)
    texts = {r[0]: r[1] or "" for r in ROWS}
    for k, i in enumerate(ids):
        t, nxt = texts[i], texts[ids[(k + 1) % len(ids)]]
        half = len(t) // 2
        a, b = (collections.Counter(x.encode().split()) for x in (t, t[: len(t) - half] + nxt[:half]))
        exact = sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0
        assert got[i].n_chars == len(t) and abs(got[i].near_edited - exact) < 0.3
    assert got[15].fingerprint != got[1].fingerprint and got[20].fingerprint == got[21].fingerprint
    assert cws.fingerprints(none).count() == 0


def test_pii_formats(spark):
    texts = ["call +1 (743) 555-3824 or a.b@c.org", "4962251213359604 4962251213359605", "227.5.221.1", "2024-02-29", None, "", "plain", "DE89370400440532013000", "283 4962251213359604 and 1234 4962251213359604"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts * 2)], "doc_id bigint, text string, pii string")
    out = {r.doc_id: r for r in pii.pseudonymize(df).collect()}
    for i, t in enumerate(texts):
        assert out[i].text == out[i + len(texts)].text  # equal values stay linked
    assert [out[i].text for i in (4, 5, 6)] == [None, "", "plain"]
    card = out[1].text.split()
    digits = [int(c) for c in card[0][::-1]]
    assert sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(digits)) % 10 == 0 and card[0] != "4962251213359604" and card[1] == "4962251213359605"
    assert "555-3824" not in out[0].text and "a.b@" not in out[0].text and out[0].text.endswith("@c.org")
    assert out[8].text == f"283 {card[0]} and 1234 {card[0]}"  # a number beside another
    iban = out[7].text
    assert iban[:2] == "DE" and int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def test_pii_is_a_bijection(spark):
    df = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("x"))
    assert df.select(pii.feistel(F.col("x"), "k", "t").alias("y")).distinct().count() == 1000


def test_quality(docs, none):
    for r in quality.judge(docs).collect():
        t = next(x[1] for x in ROWS if x[0] == r.doc_id)
        w = (t or "").encode().split()
        c = collections.Counter(zip(w, w[1:], w[2:]))
        marked = {i + k for i, x in enumerate(zip(w, w[1:], w[2:])) if c[x] > 1 for k in range(3)}
        assert (r.n_words, r.n_repeat_words, r.word_chars) == (len(w), len(marked), sum(len(x.decode()) for x in w))
        assert r.base_failed == (len(w) < 50 or 100 * len(marked) > 50 * len(w)) and not (r.kept and r.base_failed)
    assert quality.judge(none).count() == 0
    assert quality.js_distance(np.array([1.0, 0]), np.array([0, 2.0])) == 1 and quality.js_distance(np.array([1.0, 3]), np.array([2.0, 6])) == 0


def test_toxicity_learns(spark, none):
    rows = [(i, " ".join(_R.choices(_WORDS, k=40)) + (" vile crowd" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = toxicity.train(df, df.select("doc_id", "toxic"))
    hit = {r.doc_id: r.predicted for r in toxicity.score(df, model).collect()}
    assert sum(hit[i] == y for i, _, y in rows) >= 198 and toxicity.clean(df, model).columns == df.columns
    empty = toxicity.train(none, none.select("doc_id", F.lit(1).alias("toxic")))
    assert toxicity.score(none, empty).count() == 0


def test_licences(docs):
    s = licenses.Scanner(licenses.TEMPLATES, 0.8)
    assert [x[2] for x in s.scan("text here\nReleased under the MIT License.\nmore words follow")] == ["MIT"]
    assert s.scan("the mit of nothing") == [] and s.scan(None) == []
    assert licenses.scan(docs).where(F.size("licences") > 0).count() == 0


def test_permutation():
    for n in (1, 2, 17, 1000):
        p = order.permute(np.arange(n), n)
        assert sorted(p.tolist()) == list(range(n)) and (order.permute(p, n, back=True) == np.arange(n)).all()


def test_shards(spark, docs, none, tmp_path):
    """Raw files of a fixed stride: slot s of a shard's file is at s - first_slot strides, and reading goes on from any slot."""
    placed, total = order.placed(docs, VOCAB, length=16)
    want = {r.slot: bytes(r.ids) for r in placed.collect()}
    assert sorted(want) == list(range(total)) and total > 24
    path = str(tmp_path / "s")
    for _ in range(2):  # the second replaces the first
        order.write(order.shards(placed, total, shard_slots=8), path, shard_slots=8)
        files = sorted((tmp_path / "s" / "data").iterdir())
        assert len(files) == -(-total // 8) and b"".join(f.read_bytes() for f in files) == b"".join(want[k] for k in range(total))
        assert not (tmp_path / "s" / "_staged").exists()
    with open(files[1], "rb") as f:
        f.seek(3 * 32)
        assert f.read(32) == want[11]
    for slot, at_once in ((0, 64), (11, 3), (total - 1, 1), (total, 1)):
        got = [(k, ids.tobytes()) for k, ids in order.read_from(path, slot, at_once)]
        assert got == [(k, want[k]) for k in range(slot, total)]
    index = spark.read.parquet(path + "/index").collect()
    assert {r.shard: r.crc32 for r in index} == {i: zlib.crc32(f.read_bytes()) for i, f in enumerate(files)}
    empty, nothing = order.placed(none, VOCAB, length=16)
    order.write(order.shards(empty, nothing), str(tmp_path / "e"))
    assert list(order.read_from(str(tmp_path / "e"), 0)) == []


def test_partitions_are_ranges_of_slots(spark):
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.lit("some words of a text").alias("text"))
    placed, total = order.placed(docs, VOCAB, length=4)
    rows = order.shards(placed, total, shard_slots=8).select("first_slot", F.size("slots").alias("n"), F.spark_partition_id().alias("p")).collect()
    at = sorted(rows, key=lambda r: r.first_slot)
    assert [r.p for r in at] == sorted(r.p for r in at) and len({r.p for r in at}) > 1
    assert [r.first_slot for r in at] == list(range(0, total, 8)) and sum(r.n for r in at) == total


def test_mixing_keeps_all(docs, none):
    out = mixing.mix(docs, block_docs=2, stretch=16).collect()
    assert len(out) == docs.count() and len({(r.mix.slot, r.mix.position) for r in out}) == len(out)
    assert mixing.mix(none).count() == 0


def test_mixing_by_exact_weights(spark):
    """2,000 sources, one with a third of the weight, and one of a weight far below 1 / 4096: no slot too many or too few."""
    weights = {"big": 1 / 3, "tiny": 1e-5} | {f"s{i}": (2 / 3 - 1e-5) / 1998 for i in range(1998)}
    got = collections.Counter()
    part, total = mixing._exact(weights)
    for s, k, slot, release, deadline in mixing.laid_out(part, total, 0, 30_000):
        assert k == got[s] and release == k * total // part[s] <= slot < deadline == -(-(k + 1) * total // part[s])
        got[s] += 1
        assert abs(got["big"] * total - (slot + 1) * part["big"]) < total
    assert got["big"] in (9_999, 10_000, 10_001) and got["tiny"] <= 1 and all(abs(got[x] * total - 30_000 * part[x]) < total for x in weights)
    assert mixing.done_before(30_000, part, total) == {s: got[s] for s in weights}


def test_stretches_start_where_the_one_before_ended():
    """From any slot on, the layout is that of a plain heap that began at slot 0."""
    r = random.Random(5)
    for _ in range(60):
        weights = {f"s{i}": r.choice([r.randrange(1, 8), r.random() + 1e-3, r.choice([0.01, 5])]) for i in range(r.randrange(1, 9))}
        part, total = mixing._exact(weights)
        waiting, got = [(0, s, 0) for s in part], []
        for slot in range(150):
            ready = [(-(-(k + 1) * total // part[s]), s, k, release) for release, s, k in waiting if release <= slot]
            deadline, s, k, release = min(ready)
            got.append((s, k, slot, release, deadline))
            waiting.remove((release, s, k))
            waiting.append(((k + 1) * total // part[s], s, k + 1))
        for start in range(0, 150, 13):
            assert list(mixing.laid_out(part, total, start, 150)) == got[start:]


@pytest.mark.parametrize("stretch, window", [(1, 1 << 22), (7, 1 << 22), (1 << 18, 1 << 22), (7, 1)])
def test_slots_are_the_same_for_all_stretches(spark, monkeypatch, stretch, window):
    """In stretches or by one task: slots 0 to n - 1, up to the horizon those of laid_out, then by deadline, which all meet."""
    monkeypatch.setattr(mixing, "MAX_WINDOW", window)
    weights, blocks = {"a": 5.0, "b": 3.3, "c": 0.7, "d": 1.0}, {"a": 60, "b": 90, "c": 30, "d": 9}
    part, total = mixing._exact(weights)
    slots, horizon = mixing.slots_of(spark, weights, blocks, stretch)
    got = sorted((tuple(r) for r in slots.collect()), key=lambda r: r[2])
    assert [r[2] for r in got] == list(range(sum(blocks.values()))) and {(s, k) for s, k, *_ in got} == {(s, k) for s, n in blocks.items() for k in range(n)}
    assert got[:horizon] == list(mixing.laid_out(part, total, 0, horizon)) and horizon == min(n * total // part[s] for s, n in blocks.items())
    assert all(slot < deadline for _, _, slot, _, deadline in got)
    left = [(deadline, s) for s, _, _, _, deadline in got[horizon:]]
    assert left and left == sorted(left)


def test_weights_as_a_table(spark):
    """A null source has a weight, one without documents takes no share, those without a weight share one."""
    df = spark.createDataFrame([(i, s) for i, s in enumerate(["a"] * 9 + ["b"] * 5 + ["c"] * 3 + ["d"] + [None] * 6)], "doc_id bigint, source string")
    table = spark.createDataFrame([("a", 4), (None, 2), ("gone", 9), ("(others)", 3)], "source string, weight int")
    by_table, by_dict = (mixing.mix(df, w, block_docs=1).orderBy("doc_id").collect() for w in (table, {"a": 4.0, "(none)": 2.0, "(others)": 3.0}))
    assert by_table == by_dict and sorted(r.mix.slot for r in by_table) == list(range(24))
    assert max(r.mix.slot for r in by_table if r.mix.in_mix) == min(9 * 9 // 4, 6 * 9 // 2, 9 * 9 // 3) - 1


def test_mixing_has_no_limit_on_sources(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 5000).alias("source"))
    out = mixing.mix(df, block_docs=1).collect()
    assert len({r.mix.slot for r in out}) == 6000
    assert {(r.source, r.mix.block) for r in out} == {(f"s{i % 5000}", i // 5000) for i in range(6000)}


def test_pii_beside_other_words(spark):
    card, rest = "4111 1111 1111 1111", [" 12/27", " 123", " 555-123-4567", " 2024-01-02"]
    texts = [*(card + x for x in rest), "1234 " + card, "BE68 5390 0754 7034 EUR", "ES91 2100 0418 4502 0005 1332 OK", "+15551234567", "+4915112345678", "1-555-123-4567", "555 123 4567", "1234 5678 1234 5678 99"]
    out = {r.doc_id: r for r in pii.pseudonymize(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    new = out[0].text[:19]
    assert new != card and [out[0].text, out[1].text, out[4].text] == [new + " 12/27", new + " 123", "1234 " + new]
    assert all(out[i].text[:19] == new and rest[i] not in out[i].text for i in (2, 3))
    for i, tail in ((5, " EUR"), (6, " OK")):
        plain = out[i].text.removesuffix(tail).replace(" ", "")
        assert out[i].text.endswith(tail) and out[i].text != texts[i] and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
    for i, code in ((7, "+1"), (8, "+49"), (9, "1-"), (10, "")):
        assert out[i].text.startswith(code) and out[i].text != texts[i] and [p.kind for p in out[i].pii] == ["phone"]
    assert out[11].text == texts[11] and [p.pseudonym for p in out[11].pii] == [None]
