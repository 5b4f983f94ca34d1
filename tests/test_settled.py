"""Texts of reviews: what goes to Python, how lines are cut, and perturbations in a diff's own row."""

import random
import re
import unicodedata

import pandas as pd
import pytest
from pyspark.sql import functions as F

from patchlens.functions import columns as C
from patchlens.functions import patterns as P
from patchlens.operators import evaluate, parse

SPACES = "\n\r\x0b\x0c\x1c\x1d\x1e\x85  "


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def texts(n, pieces, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 40))) for _ in range(n)]


def test_settled_characters_never_change():
    second = {int(d.split()[1], 16) for d in map(unicodedata.decomposition, map(chr, range(0x110000))) if d and d[0] != "<" and " " in d}
    jamo = {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}
    settled = [c for c in range(0x110000) if not re.match(P.UNSETTLED, chr(c))]
    assert len(settled) == 128 + 64
    assert all(unicodedata.normalize("NFKC", chr(c)) == chr(c) and not unicodedata.combining(chr(c)) and c not in second | jamo for c in settled)


def test_letters_of_latin_1_stay_out_of_python(spark, monkeypatch):
    @F.pandas_udf("string")
    def broken(t: pd.Series) -> pd.Series:
        if t.notna().any():
            raise ValueError("went to Python")
        return t

    monkeypatch.setattr(parse, "_nfkc", broken)
    df = spark.createDataFrame([(1, "naïve Übermaß à l'été"), (2, None), (3, "plain")], "diff_id int, raw string")
    assert [r.clean for r in parse.sanitize(df).orderBy("diff_id").collect()] == ["naïve Übermaß à l'été", None, "plain"]
    with pytest.raises(Exception, match="went to Python"):
        parse.sanitize(spark.createDataFrame([(1, "é")], "diff_id int, raw string")).collect()


def test_python_gets_a_few_megabytes_of_diffs_at_once(spark, monkeypatch):
    @F.pandas_udf("string")
    def size(t: pd.Series) -> pd.Series:
        return pd.Series([str(t.str.len().sum())] * len(t))

    monkeypatch.setattr(parse, "_nfkc", size)
    own = spark.newSession()
    diffs = own.range(0, 300, 1, 1).select(F.col("id").alias("diff_id"), F.concat(F.lit("ﬁ"), F.repeat(F.lit("x"), 100_000)).alias("raw"))
    assert max(int(r.clean) for r in parse.sanitize(diffs).select("clean").collect()) < 6 << 20


def test_lines_of_odd_texts(spark):
    given = texts(300, ["a", "b c", "é", "\n", "\n", "\r\n", "\n\n", *SPACES], 1) + texts(300, ["a", "b c", "\n", "\n\n", "@@"], 2) + ["\n", "x", "x\n", "\r\n\r", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(given)] + [(-1, None)], "diff_id int, raw string")
    got = {}
    for r in parse.lines(df, "raw").orderBy("diff_id", "line_no").collect():
        assert r.line_no == len(got.setdefault(r.diff_id, []))
        got[r.diff_id].append((r.full, r.text))
    want = {i: [(x, x.rstrip(SPACES)) for x in re.findall(rf"[^{SPACES}]*(?:\r\n|[{SPACES}])|[^{SPACES}]+", t)] for i, t in enumerate(given)}
    assert got == {i: w for i, w in want.items() if w}


def swapped(lines):
    at = [i for i, x in enumerate(lines) if x.startswith("@@")]
    if len(at) < 2 or any(x.startswith("diff --git") for x in lines[at[0]:at[1]]):
        return "".join(lines)
    end = next((i for i in range(at[1] + 1, len(lines)) if lines[i].startswith(("@@", "diff --git"))), len(lines))
    return "".join(lines[:at[0]] + lines[at[1]:end] + lines[at[0]:at[1]] + lines[end:])


def test_perturbations_of_odd_diffs(spark):
    given = texts(300, ["diff --git a/x b/x\n", "@@ -1 +1 @@\n", "@@ 2\r\n", "+alpha beta\n", " alpha\n", "-x ", "--- a\n", "\n", "@@"], 3)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(given)] + [(-1, None), (-2, "")], "diff_id int, raw string")
    cut = {i: re.findall(P.LINE, t) for i, t in enumerate(given)}
    assert {r.diff_id: r.raw for r in evaluate.reorder(df).collect()} == {i: swapped(x) for i, x in cut.items()}
    assert {r.diff_id: r.raw for r in evaluate.blank_lines(df).collect()} == {i: "".join(y + "+\n" * y.startswith("@@") for y in x) for i, x in cut.items()}
    new = {r.diff_id: r.raw for r in evaluate.rename(df).collect()}
    for i, x in cut.items():
        word = "alpha" if any(y.startswith("+alpha") for y in x) else None
        assert new[i] == ("".join(re.sub(r"\balpha\b", "alpha_v2", y) if y[0] in "+- " and not y.startswith("---") else y for y in x) if word else "".join(x))
    changes = {(r.diff_id, r.perturbation) for r in evaluate.robustness(df, lambda d: d.select("diff_id", F.lit("pass").alias("verdict"))).collect()}
    assert changes == {(i, "reorder") for i, x in cut.items() if swapped(x) != given[i]} | {(i, "blank-line") for i, x in cut.items() if any(y.startswith("@@") for y in x)} | {(i, "rename") for i in new if new[i] != given[i]}


def test_lines_of_a_perturbed_diff_stay_in_its_row(spark):
    df = spark.createDataFrame([(1, "@@ 1\n+a\n")], "diff_id int, raw string")
    assert "Generate" not in plan_of(evaluate.blank_lines(df)) + plan_of(evaluate.reorder(df))


def test_identifiers_are_counted_without_sorting_what_is_met(spark):
    lines = spark.createDataFrame([(1, 7, "beta alpha alpha beta"), (2, 1, "class x")], "diff_id bigint, line_no int, line string")
    best = evaluate.common_identifier(lines)
    assert "SortAggregate" not in plan_of(best)
    assert [tuple(r) for r in best.collect()] == [(1, "beta", 2)]


def test_has_text_is_what_strip_leaves(spark):
    given = texts(200, ["\x1c", " ", "\t", "\x85", " ", "\n", "　"], 5) + texts(50, [" ", "\x1f", "x", "é"], 6) + ["", "​"]
    df = spark.createDataFrame([(t,) for t in given], "t string").select("t", C.has_text(F.col("t")).alias("some"), (F.length(C.strip(F.col("t"))) > 0).alias("left"))
    assert all(r.some == r.left for r in df.collect())
