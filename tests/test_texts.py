"""What texts cost Python's workers."""

import os
import random
import re
import subprocess
import sys
import tracemalloc
import unicodedata

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from patchlens.functions import patterns as P
from patchlens.operators import parse
from patchlens.plans import queries

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_a_worker_holds_a_batch_as_strings_once():
    batch = pa.array(["ﬁ" + "x" * 40_000] * 100 + [None])
    tracemalloc.start()
    try:
        made = parse._nfkc.func(batch)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert made.to_pylist() == ["fi" + "x" * 40_000] * 100 + [None]
    assert peak < 5 << 20  # a batch is 4 MB


def test_a_worker_that_sanitizes_loads_no_pandas():
    code = "import pyspark.worker, patchlens.operators.parse, sys; sys.exit('pandas' in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT).returncode == 0


def test_texts_are_sanitized_as_python_does(spark):
    rng = random.Random(11)
    pieces = ["a", "e", "é", "\u0301", "\u0327", "ﬁ", "…", "’", "“", "й", "и\u0306", "漢", "가", "각", "\u11a8", "か", "\u3099", "，", "Å", "Ⅳ", "\u200b", "\u200d", "\ufeff", "\ufe0f", "\U0001f600", "\u00a0", "ſ", "\n"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(12))) for _ in range(3000)] + [None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "diff_id int, raw string")
    want = [t and unicodedata.normalize("NFKC", t).translate(dict.fromkeys(map(ord, P.ZERO_WIDTH))) for t in texts]
    assert [r.clean for r in parse.sanitize(df).orderBy("diff_id").collect()] == want


def test_stable_characters_never_change():
    second = {int(d.split()[1], 16) for d in map(unicodedata.decomposition, map(chr, range(0x110000))) if d and d[0] != "<" and " " in d}
    jamo = {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}
    kept = [c for c in range(0x110000) if not re.match(P.CHANGING, chr(c))]
    assert len(kept) == 128 + 64 + sum(b - a + 1 for a, b in P.STABLE)
    assert all(unicodedata.normalize("NFKC", chr(c)) == chr(c) and not unicodedata.combining(chr(c)) and c not in second | jamo and chr(c) not in P.ZERO_WIDTH for c in kept)


def test_the_engine_finds_the_same_characters_as_python(spark):
    every = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(c, chr(c)) for c in every if c < 0x11000 or 0x1F000 <= c < 0x20000], "c int, t string")
    found = {r.c for r in df.where(F.col("t").rlike(P.CHANGING)).select("c").collect()}
    assert found == {c for c in every if (c < 0x11000 or 0x1F000 <= c < 0x20000) and re.match(P.CHANGING, chr(c))}


@pytest.mark.parametrize("name, n", [("p4_metadata", 5), ("a4_bootstrap", 2)])
def test_diffs_of_stable_characters_stay_out_of_python(spark, monkeypatch, tmp_path, name, n):
    @F.pandas_udf("string")
    def broken(t: pd.Series) -> pd.Series:
        if t.notna().any():
            raise ValueError("went to Python")
        return t

    monkeypatch.setattr(parse, "_nfkc", broken)
    docs = spark.range(20).select(F.col("id").alias("doc_id"), F.lit("“it’s” – Привет, Ελλάδα, 漢字かな가각 → €5 \U0001f600️\nnaïve").alias("text"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert len(queries.QUERIES[name](spark, str(tmp_path)).collect()) == n
    other = docs.withColumn("text", F.concat("text", F.lit("…")))
    other.write.parquet(str(tmp_path / "other" / "documents.parquet"))
    with pytest.raises(Exception, match="went to Python"):
        queries.QUERIES[name](spark, str(tmp_path / "other")).collect()
