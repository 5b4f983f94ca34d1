"""Tokens in a text of many rows against a plain search."""

import random
import re

import pytest
from pyspark.sql import functions as F

from patchlens.operators import evaluate, grams


def rows(r):
    """Rows that cut words anywhere, some of a character or none."""
    text = "".join(r.choice("abcAB1 -\n") for _ in range(6000)) + "x" * 50 + "".join(r.choice("abé") for _ in range(900))
    out, at = [], 0
    while at < len(text):
        step = r.choice((0, 1, 1, 2, 5, 30, 900))
        out.append(text[at : at + step])
        at += step
    return text, [(10 * n - 500, t if t or n % 2 else None) for n, t in enumerate(out)]


@pytest.mark.parametrize("stretch", [16, 4096])
def test_contained(spark, monkeypatch, stretch):
    monkeypatch.setattr(grams, "STRETCH", stretch)
    r = random.Random(4)
    text, parts = rows(r)
    plain = re.sub("[^a-z0-9]", "", text.lower())
    cuts = [plain[i : i + n] for n in (*range(4, 34), 200) for i in (0, len(plain) - n, *(r.randrange(len(plain) - n) for _ in range(6)))]
    near = [c[:-1] + "z" for c in cuts] + ["z" + c[1:] for c in cuts] + [c[:8] + c[7:] for c in cuts] + ["x" * n for n in (8, 9, 16, 49, 50, 51, 52, 60)]
    tokens = sorted({*cuts, *near})
    df = spark.createDataFrame([(t,) for t in tokens], "t string").repartition(3)
    got = grams.contained(df, spark.createDataFrame(parts, "part bigint, text string").repartition(4), 4)
    assert sorted(x.t for x in got.collect()) == [t for t in tokens if t in plain]
    cut = grams.stretches(spark.createDataFrame(parts, "part bigint, text string")).orderBy("start").collect()
    assert [(c.start, c.plain) for c in cut] == [(k, plain[k : k + stretch + 7]) for k in range(0, len(plain), stretch)] or stretch == 16
    assert "".join(c.plain[:stretch] for c in cut) == plain


def test_samples_and_plan(spark):
    samples = spark.createDataFrame([(1, "a_reverse_shellcode prompted"), (2, "backdoor token"), (3, None), (4, "")], "id bigint, name string")
    prompt = spark.createDataFrame([(1, "never be Prom"), (2, "pted by shell-"), (3, "CODE")], "part bigint, prompt string")
    found = evaluate.contaminated_by(samples, prompt)
    assert sorted((r.id, r.overlap, r.contaminated) for r in found.collect()) == [(1, ["prompted", "shellcode"], True), (2, [], False), (3, [], False), (4, [], False)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    none = evaluate.contaminated_by(samples, prompt.limit(0))
    assert not any(r.contaminated for r in none.select(F.col("contaminated")).collect())
