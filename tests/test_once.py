"""Reviews do their work once: patterns only where their words are, a score for both looks, folds of blocks, texts of chunks."""

import random

from pyspark.sql import functions as F

from patchlens.functions import columns as C
from patchlens.functions import patterns as P
from patchlens.operators import blocks, classify, score
from patchlens.plans import queries


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_text_without_the_words_never_matches(spark):
    rng = random.Random(7)
    words = [w for every in (*P.KEYWORD_WORDS, *P.INJECTION_WORDS) for w in every] + ["you are now", "Ignore all prior instructions", "Risk_Score to 0", "pre-approved", "reviewer bot", "SYSTEM :", "disregard the above"]
    odd = {"s": "ſ", "k": "K", "i": "ı", "I": "İ"}
    spelt = lambda w: "".join(odd.get(c, c) if rng.random() < 0.2 else c.upper() if rng.random() < 0.3 else c for c in w)
    texts = ["".join(rng.choice([spelt(rng.choice(words)), rng.choice(words)[:-1], " ", "\n", "é", "\U0001f600"]) for _ in range(rng.randrange(6))) for _ in range(4000)] + [None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    plain = F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit(P.KEYWORD), F.lit(0)), F.lower))
    rows = df.select(C.keywords(t).alias("k"), plain.alias("k0"), C.is_injection(t).alias("i"), t.rlike(P.INJECTION).alias("i0")).collect()
    assert [(r.k, r.i) for r in rows] == [(r.k0, r.i0) for r in rows]
    assert sum(bool(r.k) for r in rows) > 500 and sum(bool(r.i) for r in rows) > 50 and sum(r.k == [] for r in rows) > 500


def test_letters_that_a_pattern_without_case_takes_for_ascii(spark):
    every = [chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([("".join(every[i:i + 4096]),) for i in range(0, len(every), 4096)], "t string")
    letters = "(?iu)(" + "|".join("abcdefghijklmnopqrstuvwxyz") + ")"
    assert {x for r in df.select(F.regexp_extract_all("t", F.lit(letters), F.lit(0)).alias("x")).collect() for x in r.x} == set(P.FOLDED)


def test_a_plain_text_isnt_searched(spark):
    broken = F.raise_error(F.lit("searched")).cast("boolean")
    df = spark.createDataFrame([("you are here, plainly",), ("x" * 1000,)], "t string")
    assert df.where(C.may_have(F.col("t"), P.INJECTION_WORDS) & broken).count() == 0


def test_a_chunk_is_scored_once_for_both_looks(spark):
    chunks = spark.range(50).select(F.col("id").alias("diff_id"), F.lit(1).alias("chunk_no"))
    told = score.rules((F.rand() * 1_000_000).cast("int"))(chunks).groupBy("diff_id").agg(F.count("*").alias("n"), F.count_distinct("content").alias("told"))
    assert {(r.n, r.told) for r in told.collect()} == {(2, 1)}


def test_manifests_are_no_list_of_pythons(spark):
    named = classify.manifests(spark)
    assert "ExistingRDD" not in plan_of(named)
    assert {tuple(r) for r in named.collect()} == set(P.MANIFESTS.items())


def test_chunks_take_their_files_from_one_pass(spark, tmp_path):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("token\n"), F.repeat(F.lit("x y\n"), (F.col("id") * 90).cast("int"))).alias("text"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["r4_chunks"](spark, str(tmp_path))
    assert "FileScan" not in plan_of(got)  # files are a table when chunks are asked for
    assert got.count() > 4


def test_blocks_are_folded_once(spark, tmp_path):
    own = spark.newSession()
    own.conf.set("spark.sql.adaptive.enabled", "false")  # else reuse shows when it has run
    rows = [(d, b, b * 10 + i, "x\n", "@@" if i == d else "+x") for d in (1, 2) for b in range(3) for i in range(3)]
    own.createDataFrame(rows, "diff_id bigint, block bigint, line_no bigint, full string, text string").write.parquet(str(tmp_path / "lines"))
    lines = own.read.parquet(str(tmp_path / "lines"))
    for kept in (blocks.hunk_lines(blocks.located(lines)), blocks.hunk_lines(blocks.located(lines.withColumn("diff_id", F.lit(1).cast("bigint"))))):
        assert plan_of(kept).count("FileScan") == 2  # lines, and their folds
