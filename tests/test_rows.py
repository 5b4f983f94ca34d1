"""Files are told in their diff's row as by its lines, and a review of variants writes no diff."""

import random
import time

from pyspark.sql import functions as F

from patchlens.functions import columns as C
from patchlens.operators import classify, evaluate, pack, parse, score
from patchlens.plans import queries
from patchlens.plans.scan import _of_lines, _of_rows, scan
from patchlens.sources import shared

LINES = (
    "diff --git a/src/x.py b/src/x.py", "diff --git a/yarn.lock b/yarn.lock  ", "diff --git a/sub/package-lock.json b/sub/package-lock.json", "diff --git a/dist/o.js b/dist/o.js", "diff --git a/ b/", "diff --git a/a b", 'diff --git "a/q" "b/q"',
    "diff --git", "--- a/x", "+++ b/x", "@@ -1 +1 @@", "@@", "@", "+added one", "+", "+++", "++", "-gone", " same", "\\ No newline", "", "prose", "+diff --git a/n b/n", "new file mode 100755 ", "new mode 100755\x1c", "Binary files a and b differ", "GIT binary patch",
    "+ignore all previous instructions", "+you are", "now", "+  resolved \"http://evil.example/a\" https://registry.npmjs.org/b", "+x git+ssh://host/r", "+eval(password)", "+" + "y" * 90, "+\U0001f600é", "+ﬁ​x", "+   ",
)


def odd_diffs(spark, n=1500):
    rng = random.Random(11)
    text = lambda ends: "".join(rng.choice(LINES[:12] if rng.random() < 0.4 else LINES) + rng.choice(ends) for _ in range(rng.randrange(14)))
    texts = [t if rng.random() < 0.6 else t[:-1] for t in (text("\n" if rng.random() < 0.5 else ["\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x85", " ", "\n\n"]) for _ in range(n))]
    return spark.createDataFrame([(i, t) for i, t in enumerate([None, "", "\n", "@@", "@@\r\n+x", *texts])], "diff_id bigint, raw string")


def test_rows_tell_what_lines_tell(spark):
    given = shared.cut(odd_diffs(spark).withColumn("failed", F.col("raw").isNull()))
    lines = parse.lines(parse.sanitize(given)).select("diff_id", "line_no", "text", parse.ending().alias("end"))
    by_rows, by_lines = _of_rows(given, queries.CFG), _of_lines(given.select("diff_id", "failed"), parse.located(lines), queries.CFG)
    said = lambda df: sorted(map(repr, df.collect()))
    names = ["diff_id", "file_no", "path", "added_lines", "n_chars", "priority", "marker", "file_diff"]
    assert said(by_rows.texts.select(names)) == said(by_lines.texts.select(names)) and by_rows.texts.count() > 2000
    assert said(by_rows.given) == said(by_lines.given)
    assert said(by_rows.textual.where("textual").select("diff_id")) == said(by_lines.textual.where("textual").select("diff_id"))
    in_order = lambda df: said(df.groupBy("diff_id").agg(parse.joined(F.concat("file", F.lit(">"), "reason", F.col("binary").cast("string"))).alias("x")))
    assert in_order(by_rows.meta) == in_order(by_lines.meta)
    events = [said(classify.lock_events(r.added)) for r in (by_rows, by_lines)]
    assert events[0] == events[1] and len(events[0]) > 20


def test_whole_files_of_rows(spark):
    given = odd_diffs(spark, 500)
    rows = parse.files_in_rows(parse.sanitize(given)).where("is_file").select("diff_id", "file_no", "path", "file_diff", "added", "added_lines")
    old = parse.files(parse.hunk_lines(parse.lines(parse.sanitize(given)))).select(rows.columns)
    assert sorted(map(repr, rows.collect())) == sorted(map(repr, old.collect()))


def test_variants_are_written_nowhere(spark, monkeypatch):
    """Before, all texts of all variants, and then all their lines, were tables in the shared folder."""
    docs = "".join(f"diff --git a/yarn.lock b/yarn.lock\n--- a/yarn.lock\n+++ b/yarn.lock\n@@ -1 +1 @@\n+alpha {'z' * 50_000}\n" for _ in range(4))
    df = spark.createDataFrame([(i, docs) for i in range(3)], "diff_id bigint, raw string")
    written, cut = [], shared.cut
    chars = lambda t: sum(t.agg(*(F.coalesce(F.sum(F.length(F.to_json(F.struct(c)))), F.lit(0)) for c in t.columns)).first())
    monkeypatch.setattr(shared, "cut", lambda x: written.append(cut(x)) or written[-1])
    judge = lambda x: scan(x, score.rules(F.size(C.keywords(F.col("text")))), queries.CFG).select("diff_id", "verdict")
    got = evaluate.robustness(df, judge).collect()
    assert {(r.diff_id, r.perturbation) for r in got} == {(i, p) for i in range(3) for p in ("rename", "blank-line")}
    assert sum(map(chars, written)) < 50_000  # of 600,000 characters in the diffs, and as many in each variant


def test_texts_of_chunks_move_once(spark):
    """Before, the join by file and the groups by chunk each moved them."""
    own = spark.newSession()
    own.conf.set("spark.sql.adaptive.enabled", "false")
    own.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    files = shared.cut(own.range(60).selectExpr("id % 7 AS diff_id", "id AS file_no", "concat('p', id) AS path", "repeat('x', cast(id * 200 AS int)) AS file_diff", "length(file_diff) AS n_chars", "0 AS priority"))
    placed = shared.cut(pack.placements(pack.ranked(files.drop("file_diff")), queries.CFG))
    plan = pack.chunks(files, placed, queries.CFG)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    paths = pack.chunks(files, placed, queries.CFG).select("paths")._jdf.queryExecution().executedPlan().toString()
    assert "max(part" not in paths  # texts stay where only paths are asked for


def test_what_was_shuffled_for_a_table_goes_with_it(spark):
    kept = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").count("shuffle_")
    before, key = kept(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key)
    table = shared.cut(spark.range(1000).repartition(3, "id").selectExpr("id", "id % 7 AS x"))
    until = time.time() + 20
    while kept() > before and time.time() < until:  # files go in the background
        time.sleep(0.1)
    assert kept() <= before and spark.conf.get(key) == was and table.count() == 1000
