"""Paths in quotes, allowlists of many domains, trimming and alerts inside a review."""

import pytest
from pyspark.sql import functions as F

from patchlens.config import Config
from patchlens.functions import columns as C
from patchlens.operators import blocks, classify, parse, score
from patchlens.plans.scan import scan

QUOTED = r'''diff --git a/one.py b/one.py
--- a/one.py
+++ b/one.py
@@ -1 +1 @@
+first
diff --git "a/caf\303\251 \"x\".py" "b/caf\303\251 \"x\".py"
--- "a/caf\303\251 \"x\".py"
+++ "b/caf\303\251 \"x\".py"
@@ -1 +1 @@
+second
diff --git a/plain.py "b/tab\there\\.py"
new file mode 100755
--- a/plain.py
+++ "b/tab\there\\.py"
@@ -1 +1 @@
+third
'''
PATHS = ["one.py", 'café "x".py', "tab\there\\.py"]


@pytest.fixture(scope="module")
def diffs(spark):
    return spark.createDataFrame([(1, QUOTED)], "diff_id bigint, raw string")


def test_quoted_paths(spark, diffs):
    lines = parse.lines(diffs, "raw")
    loose = parse.files(parse.hunk_lines(lines)).collect()
    assert [(r.path, r.added_lines) for r in loose] == [("one.py", 3)]
    kept = parse.hunk_lines(lines)
    assert [(r.file_no, r.path, r.added) for r in parse.files(kept, strict=True).orderBy("file_no").collect()] == [(1, PATHS[0], "+first"), (2, PATHS[1], "+second"), (3, PATHS[2], "+third")]
    assert [r.path for r in parse.added_lines(kept, strict=True).orderBy("line_no").collect()] == PATHS
    assert [r.file for r in parse.metadata_findings(lines, strict=True).collect()] == [PATHS[2]]
    placed = blocks.located(lines.withColumn("block", F.floor(F.col("line_no") / 2)), strict=True)
    assert [r.path for r in blocks.files(blocks.hunk_lines(placed)).orderBy("file_no").collect()] == PATHS


@pytest.mark.parametrize("written, path", [("plain", "plain"), (r"\303\251", "é"), (r"a\"b\\c", 'a"b\\c'), (r"\a\b\t\n\v\f\r", "\a\b\t\n\v\f\r"), (r"\377x", "�x"), (r"\360\237\230\200é", "😀é"), ("", ""), ("\\", "\\")])
def test_unquoted(spark, written, path):
    assert spark.createDataFrame([(written,)], "p string").select(C.unquoted(F.col("p"))).first()[0] == path


def test_a_review_with_strict_paths_trimming_and_alerts(spark, diffs):
    seen = []
    far = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1 +1 @@\n" + "".join(f" far {i}\n" for i in range(9)) + "+near\n" + " after\n" * 9
    both = diffs.union(spark.createDataFrame([(2, far)], "diff_id bigint, raw string"))
    replies = spark.createDataFrame([(1, 1, 1, 1, "ok", '{"risk_score": 3}'), (2, 1, 1, 1, "infra", None)], score.REPLIES)
    texts = []

    def scorer(chunks):
        texts.append(chunks)
        return score.scripted(replies)(chunks)

    cfg = Config(strict_paths=True, trim_large=True, large_diff_chars=len(far) - 1)
    got = {r.diff_id: r for r in scan(both, scorer, cfg, monitor=seen.append).collect()}
    assert got[1].files_scanned == 3 and got[1].verdict == "pass" and [f.file for f in got[1].suspicious_findings] == [PATHS[2]] and got[2].failsafe == "infra"
    assert [(r.diff_id, r.kind, r.chunk_no, r.detail) for r in seen[0].collect()] == [(2, "infra", 1, "FAILSAFE kind=infra chunk=1 fail_closed=False")]
    sent = {r.diff_id: r.text for r in texts[0].collect()}
    large = len(QUOTED) > cfg.large_diff_chars
    assert [line for line in sent[2].splitlines() if line.startswith((" ", "+n"))] == [" far 8", "+near", " after"] and (large or "café" not in sent[2])


def test_allowlists_of_any_size(spark):
    domains = spark.range(100_000).select(F.concat(F.lit("D"), F.col("id").cast("string"), F.lit(".Example.org")).alias("domain")).union(spark.createDataFrame([("co.uk",)], "domain string"))
    hosts = {"d7.example.org": True, "a.b.D99999.example.org": True, "example.org": False, "xd7.example.org": False, "d7.example.org.evil.com": False, "d100000.example.org": False, "X.co.uk": True, "": False, "co.uk": True}
    found = classify.canonical_hosts(spark.createDataFrame([(h,) for h in (*hosts, "d7.example.org")], "host string"), domains)
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(hosts) and dict(got) == hosts
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    listed = spark.createDataFrame([(d,) for d in ("npmjs.org", "x.example.com")], "domain string")
    same = classify.canonical_hosts(spark.createDataFrame([("r.npmjs.org",), ("npmjs.org.x",), ("y.x.example.com",)], "host string"), listed).orderBy("host")
    assert [r.canonical for r in same.collect()] == [False, True, True]
