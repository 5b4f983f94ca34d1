"""The methods against brute force, on cases that were made for them."""

import collections
import datetime
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("patchlens.llm.queries")
import public_tokenizers  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from patchlens.llm import cws, licenses, lm, mixing, order, packing, pii, quality, toxicity  # noqa: E402

VOCAB = public_tokenizers.path("word_bpe_49k.json")
R = random.Random(8)
WORDS = [f"k{i}" for i in range(200)]


def test_tokens_are_the_library_s(spark):
    from tokenizers import Tokenizer

    whole, letters = Tokenizer.from_file(VOCAB), "abXYZ '0129.,!_-éÉßÿ×÷ªº²½\x1c\x0b\x85\xa0ΣσİıЖ中一́’   \n<|"
    texts = ["a <|endoftext|> b<|startoftext|>", "<|ENDOFTEXT|>", "don't we'll 'S x's", None, "", *("".join(R.choices(letters, k=R.randrange(50))) for _ in range(3000))]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = collections.defaultdict(bytes)
    for p in sorted(packing.pack(rows, VOCAB).collect(), key=lambda p: p.start):
        got[p.doc_id] += bytes(p.ids)
    want = [np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes() for t in texts]
    assert [got[i] for i in range(len(texts))] == want
    shards = order.shards(*order.placed(rows.coalesce(1), VOCAB, length=64), shard_slots=16).collect()
    at = {s.number: bytes(r.payload[k * r.stride: (k + 1) * r.stride]) for r in shards for k, s in enumerate(r.slots)}
    stream = np.frombuffer(b"".join(at[k] for k in range(len(at))), "<u2")
    flat = np.frombuffer(b"".join(want), "<u4")
    assert (stream[: len(flat)] == flat).all() and not stream[len(flat):].any() and len(stream) - len(flat) < 64
    assert all(s.crc32 == zlib.crc32(r.payload[k * r.stride: (k + 1) * r.stride]) and s.number == order.permute(np.array([r.first_slot + k]), len(at), back=True)[0] for r in shards for k, s in enumerate(r.slots))


def test_remembered_pieces(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(packing, "CACHE_PIECES", 20)
    tok, texts = packing.WordTokenizer(VOCAB), [" ".join(R.choices(WORDS, k=30)) for _ in range(40)]
    for at in range(0, 40, 4):
        ids, ends = tok.ids(pa.array(texts[at: at + 4]))
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == [e.ids for e in tok.whole.encode_batch(texts[at: at + 4], add_special_tokens=False)]


def test_step_groups_cost_about_the_same():
    sequences = [(512, [(0, 0, n), (1, 0, 512 - n)]) for n in (R.randrange(1, 512) for _ in range(256))]
    cost = collections.Counter()
    for s, g in zip(sequences, packing.step_groups(sequences, 512 * 32)):
        cost[g] += sum(n * n for _, _, n in s[1])
    assert len(cost) == 8 and max(cost.values()) < 1.05 * min(cost.values())


def test_fingerprints_of_odd_ids(spark):
    rows = [(i << 40 if i % 3 else None, " ".join(R.choices(WORDS, k=R.randrange(40)))) for i in range(60)] + [(7, "same text twice")] * 30 + [(8, None), (8, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    for blocks in (1, 3, 40):
        chain = cws.with_next(df, blocks).collect()
        assert collections.Counter((r.doc_id, r.text) for r in chain) == collections.Counter((r.next_id, r.next_text) for r in chain) == collections.Counter((a, b or "") for a, b in rows)
        after = {r.doc_id: r.next_id for r in chain if r.doc_id is not None and r.doc_id > 8}
        assert all(after[a] == b for a, b in itertools.pairwise(sorted(after, reverse=True)))
    got = cws.fingerprints(df).collect()
    assert len(got) == len(rows) and len({r.fingerprint for r in got if r.doc_id == 7}) == 1


def test_weighted_sampling_meets_generalised_jaccard(spark):
    """Many hashes and unequal weights: the collision rate is the sum of lesser weights over that of greater ones."""
    a, b = ["x"] * 5 + ["y"] * 2 + ["z"], ["x"] * 2 + ["y"] * 4 + ["w"] * 2
    df = spark.createDataFrame([(1, " ".join(a)), (0, " ".join(b))], "doc_id bigint, text string")
    hi = next(r for r in cws.fingerprints(df, 4096).collect() if r.doc_id == 1)
    assert abs(hi.near_next - 4 / 12) < 0.03
    text = " ".join(a)
    edited = text[: len(text) - len(text) // 2] + " ".join(b)[: len(text) // 2]
    assert hi.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    x, y = collections.Counter(text.split()), collections.Counter(edited.split())
    assert abs(hi.near_edited - sum((x & y).values()) / sum((x | y).values())) < 0.03


def test_pseudonyms_stay_in_their_class(spark):
    days = [datetime.date(1900, 1, 1) + datetime.timedelta(d) for d in R.sample(range(73_049), 300)] + [datetime.date(1900, 1, 1), datetime.date(2099, 12, 31)]
    ssns = [f"{a:03}-{g:02}-{s:04}" for a, g, s in ((R.choice([1, 665, 667, 899]), R.randrange(1, 100), R.randrange(1, 10_000)) for _ in range(300))]
    phones = [f"({R.randrange(1000):03}) {R.randrange(1000):03}-{R.randrange(10_000):04}" for _ in range(600)]
    ips = [".".join(str(R.randrange(256)) for _ in range(4)) for _ in range(200)]
    texts = [*map(str, days), *ssns, *phones, *ips]
    out = [r.text for r in pii.pseudonymize(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(2)).orderBy("doc_id").collect()]
    n = len(days)
    new_days, new_ssns, new_phones, new_ips = out[:n], out[n: n + 300], out[n + 300: n + 900], out[n + 900:]
    assert all(1900 <= datetime.date.fromisoformat(x).year <= 2099 for x in new_days)
    assert all(re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", x) for x in new_ssns)
    dialable = lambda x: bool(re.fullmatch(r"\([2-9]\d\d\) [2-9]\d\d-\d{4}", x))
    assert all(re.fullmatch(r"\(\d{3}\) \d{3}-\d{4}", b) and dialable(a) == dialable(b) for a, b in zip(phones, new_phones)) and {dialable(a) for a in phones} == {True, False}
    assert all(all(0 <= int(o) < 256 for o in x.split(".")) for x in new_ips)
    for old, new in ((texts[:n], new_days), (ssns, new_ssns), (phones, new_phones), (ips, new_ips)):
        assert len(set(zip(old, new))) == len(set(old)) == len(set(new)) and sum(a != b for a, b in zip(old, new)) > len(old) - 5
    other = pii.pseudonymize(spark.createDataFrame([(0, str(days[0]))], "doc_id bigint, text string"), key="another").first().text
    assert other != new_days[0]


def test_pairs_are_products():
    days = (datetime.date(2099, 12, 31) - datetime.date(1900, 1, 1)).days + 1
    sizes = {pii.DAY_PAIR: days, pii.DIALABLE_PAIR: 800 * 800 * 10_000, pii.OTHER_PAIR: 10**10 - 800 * 800 * 10_000, pii.SSN_PAIR: 898 * 99 * 9999}
    assert all(a * b == n for (a, b), n in sizes.items())


def test_pii_of_long_and_no_texts(spark):
    df = spark.createDataFrame([(1, "x 2024-02-29 " * 5000), (2, None)], "doc_id bigint, text string")
    out = pii.pseudonymize(df, column="told").orderBy("doc_id").collect()
    assert len(out[0].told) == 5000 and len(set(out[0].text.split())) == 2 and out[1].text is None
    assert pii.pseudonymize(df.limit(0)).count() == 0


@pytest.mark.parametrize("label", [lambda a, b: a ^ b, lambda a, b: a & b])
def test_terms_that_matter_in_pairs(spark, label):
    """Of the exclusive or, no term tells anything alone: an additive model can't be better than a coin."""
    rows = []
    for i in range(1600):
        a, b = R.random() < 0.5, R.random() < 0.5
        rows.append((i, " ".join(R.choices(WORDS, k=20) + ["insult"] * a + ["group"] * b), int(label(a, b)), "x"))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int, _label string")
    train, test = df.where("doc_id < 1200"), df.where("doc_id >= 1200").unionByName(spark.createDataFrame([(9000, None, 0, None), (9001, "", 0, None)], df.schema))
    model = toxicity.train(train, train.select("doc_id", "toxic"))
    hit = {r.doc_id: r.score for r in toxicity.score(test, model).collect()}
    assert np.mean([(hit[i] >= 0.5) == y for i, _, y, _ in rows[1200:]]) > 0.97 and hit[9000] == hit[9001] and 0 <= hit[9000] <= 1
    assert toxicity.clean(test, model).columns == df.columns


def test_training_sample_is_bounded(spark, monkeypatch):
    df = spark.createDataFrame([(i, " ".join(R.choices(WORDS, k=20)), i % 2) for i in range(50)], "doc_id bigint, text string, toxic int")
    assert len(toxicity.sample(df, df.select("doc_id", "toxic"), 20)) == 20
    monkeypatch.setattr(toxicity, "MAX_TRAIN_BYTES", 500)
    got = toxicity.sample(df, df.select("doc_id", "toxic"))
    assert 0 < len(got) < 50 and sum(4 * len(r) for r, _ in got) <= 500


def test_licence_windows_are_the_best_of_all(spark):
    """A template hidden in noise, whole and damaged: the window that holds is as good as any window of the text."""
    scanner = licenses.Scanner(licenses.TEMPLATES, 0.8)
    for name, notices in licenses.TEMPLATES.items():
        for notice in notices:
            words = notice.split()
            for damage in range(2):
                own = words[:]
                for _ in range(damage if len(words) > 12 else 0):
                    own[R.randrange(len(own))] = "zzz"
                text = " ".join(R.choices(WORDS, k=9)) + "\n * " + "\n * ".join(" ".join(own[i: i + 7]) for i in range(0, len(own), 7)) + " " + " ".join(R.choices(WORDS, k=9))
                found = scanner.scan(text)
                plain = re.findall(r"[^\W_]+", text.lower())
                best = {}
                for n, b, size in scanner.templates:
                    for i in range(len(plain)):
                        for j in range(i + 1, min(len(plain), i + int(1.5 * size) + 1)):
                            c = sum((collections.Counter(itertools.pairwise(plain[i: j + 1])) & b).values())
                            if 2 * c / (j - i + size) >= 0.8:
                                best[n] = max(best.get(n, (0, 0)), (c, 2 * c / (j - i + size)))
                    if size > 40:
                        break
                if len(words) <= 40:
                    assert name in {f[2] for f in found} and max(best.get(name, (0, 0))[1], 0) - 1e-9 <= max(f[3] for f in found if f[2] == name)
    assert [f[2] for f in scanner.scan("This work is licensed under the GNU General Public License, version 3.")] == ["GPL-3.0"]
    assert [f[2] for f in scanner.scan("so it is Licensed under CC BY-SA 4.0. and more")] == ["CC-BY-SA-4.0"]
    text = "The notes. Released under the MIT License. Please send"
    (start, end, _, dice), = scanner.scan(text)
    assert (text[start:end], dice) == ("Released under the MIT License", 1.0)
    assert licenses.scan(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_licence_places_with_letters_that_grow():
    """The lower case of U+0130 is two code points, the second no letter: places are those of the text all the same."""
    for n in (0, 1, 5):
        text = "\u0130stanbul, " * n + "see: Released under the MIT License."
        (start, end, name, dice), = licenses.Scanner(licenses.TEMPLATES, licenses.THRESHOLD).scan(text)
        assert text[start:end] == "Released under the MIT License" and (name, dice) == ("MIT", 1.0)


def test_rows_of_the_mix_keep_to_the_weights(spark):
    n = {"a": 3000, "b": 900, "c": 50, None: 40}
    rows = [(i, s) for s, k in n.items() for i in range(k)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string").withColumn("row", F.lit(1)).withColumn("s", F.lit("x"))
    weights = {"a": 5.0, "b": 3.3, "c": 0.01}  # null shares (others)
    out = mixing.mix(df, weights, block_docs=8).collect()
    assert len(out) == len(rows) and collections.Counter((r.doc_id, r.source) for r in out) == collections.Counter(rows)
    w = weights | {"(others)": 0.01}
    total, got, last = sum(w.values()), collections.Counter(), -1
    for slot, some in itertools.groupby(sorted(out, key=lambda r: r.mix.slot), key=lambda r: r.mix.slot):
        some = list(some)
        s = some[0].source or "(others)"
        assert all((r.source or "(others)") == s and r.mix.block == got[s] for r in some) and sorted(r.mix.position for r in some) == list(range(len(some)))
        got[s] += 1
        if some[0].mix.in_mix:
            assert slot == last + 1 and all(abs(got[x] - (slot + 1) * y / total) < 1 + 1e-9 for x, y in w.items())
            last = slot
    assert last > 100


def test_scores_by_hand(spark):
    """The interpolated score from counts that are made again word by word, with the weights that were learned."""
    docs = [(i, " ".join(R.choices(WORDS[:30], k=25))) for i in range(80)] + [(200, None)]
    learned = {}
    old = lm.learn
    lm.learn = lambda h, u, rounds=lm.EM_ROUNDS: learned.setdefault("w", old(h, u, rounds))
    try:
        got = {r.doc_id: r for r in lm.score(spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(2)).collect()}
    finally:
        lm.learn = old
    tokens = {i: (t.split() if t else []) + ["\n"] for i, t in docs}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    one, two = collections.Counter(), collections.Counter()
    for i, t in tokens.items():
        if not held[i]:
            one.update(t)
            two.update(zip(["\n", *t], t))
    n, v = sum(one.values()), len(one)
    for i, t in tokens.items():
        want = 0
        for a, b in zip(["\n", *t], t):
            l2, l1, l0 = learned["w"][int(lm.bucket_of(np.array([one[a]]))[0])]
            want += np.log10(l2 * (two[a, b] / one[a] if one[a] else 0) + l1 * one[b] / n + l0 / (v + 1))
        assert abs(got[i].score - want) < 1e-6 and got[i].train_tokens == n


def test_many_chunks_count_as_few_do(spark, monkeypatch):
    """Chunks that merge by teams first get the same totals, and so the same scores, as one chunk or directly dealt ones."""
    docs = spark.createDataFrame([(i, " ".join(R.choices(WORDS[:60], k=R.randrange(40)))) for i in range(400)] + [(None, "x y"), (7, None)], "doc_id bigint, text string").repartition(3)
    asked = []
    old = lm._totals
    monkeypatch.setattr(lm, "_totals", lambda chunks, n, *rest: asked.append(n) or old(chunks, n, *rest))

    def run(tokens, direct):
        monkeypatch.setattr(lm, "CHUNK_TOKENS", tokens)
        monkeypatch.setattr(lm, "DIRECT_CHUNKS", direct)
        return collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 8), round(r.score, 8)) for r in lm.score(docs).collect())

    few = run(1_000_000, 10)
    assert few == run(200, 1000) == run(200, 1) and asked[1] == asked[2] > 30


def test_weights_climb_in_likelihood():
    """Expectation-maximisation never makes the held-out counts less likely."""
    h = np.array([[4, R.randrange(1, 60), R.randrange(1, 100), R.randrange(1, 9)] for _ in range(40)])
    p = np.stack([lm.value(h[:, 1]), lm.value(h[:, 2]), np.full(40, 1e-4)])
    seen = [float((np.log(lm.learn(h, 1e-4, rounds)[4] @ p) * h[:, 3]).sum()) for rounds in (1, 2, 5, 20, 50)]
    assert all(b >= a - 1e-3 for a, b in itertools.pairwise(seen))


def test_quality_keeps_and_rejects(spark):
    """Ordinary documents pass; ones with the characters, or the common words, of something else don't."""
    def text(k):
        return " ".join(R.choice(quality.COMMON_WORDS["en"]) if R.random() < 0.4 else "".join(R.choices("abcdefghij", k=6)) for _ in range(k))

    rows = [(i, text(200), "en") for i in range(60)] + [(100, " ".join("".join(R.choices("#*$%&|<>0123456789", k=6)) for _ in range(200)), "en"), (101, "a $ b\n\nx y\nx y\n", "en"), (102, None, None), (103, "word " * 20_000, "en")]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert all(got[i].kept for i in range(60)) and not got[100].kept and not got[100].base_failed and got[100].char_distance > quality.MAX_CHAR_DISTANCE
    assert (got[101].n_symbols, got[101].n_dup_lines, got[101].n_words) == (1, 1, 7) and got[102].base_failed and got[103].base_failed
