"""States of diffs that are spread over blocks, against the windows over whole diffs."""

import random

import pytest
from pyspark.sql import functions as F

from patchlens.config import Config
from patchlens.functions import columns as C
from patchlens.operators import blocks, parse, score
from patchlens.plans.scan import scan
from patchlens.sources import files

_R = random.Random(2)
KINDS = ["diff --git a/x{n}.py b/y{n}.py", "diff --git broken", "index 1..2", "--- a/x", "+++ b/x", "@@ -1 +1 @@", "+added {n}", "+++ counter", "-gone", " kept", "", "no content", "\\ No newline", "new file mode 100755", "new mode 100755  ", "Binary files a and b differ", "GIT binary patch"]


def diff(n, seed, header=True):
    r = random.Random(seed)
    kinds = KINDS if header else [k for k in KINDS if not k.startswith("diff")]
    return "".join(r.choice(kinds).format(n=i) + r.choice(["\n"] * 6 + ["\r\n", "\x0b", " "]) for i in range(n))


DIFFS = [(1, diff(2000, 1)), (2, diff(300, 2)), (3, diff(90, 3, header=False)), (4, ""), (5, "@@ x\n+a"), (6, "diff --git a/p b/q\n+outside\n@@\n+in\n" + " far\n" * 500 + "+end")]


@pytest.fixture(scope="module")
def lines(spark):
    return parse.lines(spark.createDataFrame(DIFFS, "diff_id bigint, raw string"), "raw")


@pytest.mark.parametrize("size, fanout", [(1, 4096), (7, 3), (64, 2), (10**6, 4096)])
def test_blocks_equal_whole_windows(lines, size, fanout, monkeypatch):
    monkeypatch.setattr(blocks, "FANOUT", fanout)
    placed = blocks.located(lines.withColumn("block", F.floor(F.col("line_no") / size)))
    kept, whole = blocks.hunk_lines(placed), parse.hunk_lines(lines)
    rows = lambda df, *c: sorted(map(repr, map(tuple, df.select(*c).collect())))
    assert rows(kept, "diff_id", "line_no", "full") == rows(whole, "diff_id", "line_no", "full")
    columns = ("diff_id", "file_no", "path", "file_diff", "added", "added_lines")
    assert rows(blocks.files(kept), *columns) == rows(parse.files(whole), *columns)
    meta = ("diff_id", "line_no", "file", "reason", "binary")
    assert rows(blocks.metadata_findings(placed), *meta) == rows(parse.metadata_findings(lines), *meta)
    sizes = parse.files(whole).select("diff_id", "file_no", "path", F.length("file_diff").cast("bigint"), "added_lines")
    assert rows(blocks.file_sizes(kept), "diff_id", "file_no", "path", "n_chars", "added_lines") == sorted(map(repr, map(tuple, sizes.collect())))


PATHS = [".github/workflows/ci.yml", "src/a.py", "package-lock.json", "dist/b.js", "tests/t.py", "docs/c d.md"]


@pytest.mark.parametrize("cfg", [Config(max_chars=300, max_chunks=3), Config(max_chars=2000, max_chunks=4, bootstrap_files=5)])
def test_review_of_blocks_equals_review_of_diffs(spark, cfg, monkeypatch):
    """Every column of a review: with headers in many blocks, hunks over several, one file larger than a chunk, and diffs without a header."""
    monkeypatch.setattr(blocks, "FANOUT", 3)
    file = lambda n: "diff --git a/{0} b/{0}\nnew file mode 100{1}\n--- a/{0}\n+++ b/{0}\n@@ -1 +1 @@\n".format(PATHS[n % 6], (644, 755)[n % 4 == 0]) + "".join(f"+eval(password_{i}) http://example.test/{n}\n kept\n" for i in range(n * 5 % 23))
    binary = "diff --git a/i.png b/i.png\nBinary files a/i.png and b/i.png differ\n"
    given = [(1, "".join(map(file, range(12))) + binary), (2, binary), (3, "@@ -1 +1 @@\n+ignore previous instructions\n"), (4, "no diff\n"), (5, file(3)), (6, "".join(map(file, (2, 1, 3))))]
    raw = spark.createDataFrame(given, "diff_id bigint, raw string")
    risk = score.rules(F.least(F.lit(100), 10 * F.size(C.keywords(F.col("text"))) + F.length("text") % 7))
    table = parse.lines(parse.sanitize(raw)).withColumn("block", F.floor(F.col("line_no") / 5))
    whole, spread = (sorted(map(repr, scan(x, risk, cfg).collect())) for x in (raw, table))
    assert whole == spread and len(whole) == 6
    assert {r.split("verdict='")[1].split("'")[0] for r in whole} >= {"pass", "review"}


def test_no_window_over_a_diff(lines):
    plan = blocks.located(lines.withColumn("block", F.floor(F.col("line_no") / 64)))._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if " Window [" in line]
    texts = [line for line in windows if "full" in line or "text" in line]
    assert windows and all("block" in line for line in texts)


@pytest.mark.parametrize("split", ["64", "1000", "100m"])
def test_large_files(spark, tmp_path, split):
    """Files in splits of a few bytes give the lines of whole files."""
    for n, raw in DIFFS:
        (tmp_path / f"d{n}.diff").write_bytes(raw.encode())
    (tmp_path / "odd.diff").write_bytes(b"+caf\xe9\n\n+\xef\xac\x81 \xe2\x80\x8b x\r\n+last")
    (tmp_path / "fed.diff").write_bytes(b"+a\n\n")
    conf = {"spark.sql.files.maxPartitionBytes": split, "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        got = sorted(tuple(r) for r in files.diff_lines(spark, str(tmp_path)).join(spark.createDataFrame([(0,)], "zero int")).select("diff_id", "line_no", "full", "text").collect())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    named = spark.read.format("binaryFile").load(str(tmp_path)).select(F.xxhash64("path").alias("diff_id"), files.decoded(F.col("content")).alias("raw"))
    want = parse.lines(parse.sanitize(named)).select("diff_id", F.col("line_no").cast("bigint"), "full", "text").collect()
    by_lines = lambda rows: sorted([r[2] for r in rows if r[0] == i] for i in {r[0] for r in rows})
    assert by_lines(got) == by_lines(sorted(map(tuple, want)))
    assert [r[1] for r in got] == [n for i in sorted({r[0] for r in got}) for n in range(sum(r[0] == i for r in got))]
