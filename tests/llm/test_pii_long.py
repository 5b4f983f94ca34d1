"""Matches of any length: cards in runs of groups against a search by hand, and texts that a recursive or quadratic matcher wouldn't survive."""

import random
import re
import time

import pytest

pytest.importorskip("patchlens.llm.queries")
from patchlens.llm import pii  # noqa: E402

_R = random.Random(6)


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def group(n=4):
    return "".join(_R.choice("0123456789") for _ in range(n))


def cards(run):
    """Numbers of four or five groups (only the last of the run may be short) that pass, from the left, the longest first."""
    groups = re.split("[ -]", run)
    out, i = [], 0
    while i < len(groups):
        for k in (5, 4):
            d = "".join(groups[i : i + k])
            if i + k <= len(groups) and 13 <= len(d) <= 19 and luhn(d):
                out.append((i, k))
                i += k
                break
        else:
            i += 1
    return out


def runs():
    out = ["0000 0000 0000", "4111 1111 1111 1111", "1234 4111 1111 1111 1111 5678", "4111-1111-1111-1111-1111", "0000 0000 0000 0000 0000"]
    for _ in range(120):
        n = _R.choice((3, 4, 5, 6, 9, 40))
        out.append("".join((_R.choice(" -") if i else "") + group() for i in range(n)) + (_R.choice(" -") + group(_R.randrange(1, 4)) if _R.random() < 0.5 else ""))
    return out


def test_cards_in_runs_of_groups(spark):
    texts = runs()
    got = pii.pseudonymize(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).orderBy("doc_id").collect()
    for old, r in zip(texts, got):
        want = cards(old)
        seps, groups, new = re.findall("[ -]", old), re.split("[ -]", old), re.split("[ -]", r.text)
        assert re.findall("[ -]", r.text) == seps and [len(g) for g in new] == [len(g) for g in groups]
        inside = {j for i, k in want for j in range(i, i + k)}
        assert all(a == b for j, (a, b) in enumerate(zip(groups, new)) if j not in inside), (old, r.text)
        assert all(luhn("".join(new[i : i + k])) for i, k in want)
        assert [p.value for p in r.pii if p.pseudonym] == [re.match(rf"(?:\d+[ -]?){{{k}}}", old[sum(len(g) + 1 for g in groups[:i]) :])[0].rstrip(" -") for i, k in want]


def test_numbers_of_other_lengths_stay(spark):
    texts = ["0" * 12, "0" * 20, "0" * 400, "0000 0000 0000", "0000 0000 0000 00000"]
    got = pii.pseudonymize(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).orderBy("doc_id").collect()
    assert [r.text for r in got] == texts


def test_very_long_matches(spark):
    n = 100_000
    name = "n" * n
    texts = ["x@" + "ab." * n, "x@" + "a" * n + ".de", name + "@example.org", "a.b@example.org " * 2000, " ".join(["1234"] * n), "0" * n, "1.2.3.4." * n, "-".join(["12"] * n), "+49" + " 123" * n, "DE89" + " 3704" * n, "@" * n, "a@b." * n]
    began = time.time()
    got = pii.pseudonymize(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)).orderBy("doc_id").collect()
    assert time.time() - began < 240
    assert got[0].text != texts[0] and got[0].text[1:] == texts[0][1:] and got[1].text[1:] == texts[1][1:]
    assert got[2].text == texts[2] and len({t for t in got[3].text.split()}) == 1 and "a.b@" not in got[3].text
    assert [len(r.text) for r in got[4:6]] == [len(t) for t in texts[4:6]]
