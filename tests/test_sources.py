"""Ledger of replies, reports in few files, git ranges in tasks, and comments over a stream."""

import re
import collections
import datetime
import http.server
import json
import os
import subprocess
import threading
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from patchlens.config import Config
from patchlens.operators import score
from patchlens.sources import files, reports
from patchlens.streaming import comments


class Counting(http.server.BaseHTTPRequestHandler):
    """Every first call of a text fails; texts with BAD are blocks."""

    calls: collections.Counter = collections.Counter()

    def do_POST(self):
        text = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["messages"][1]["content"]
        self.calls[text] += 1
        self.send_response(500 if self.calls[text] == 1 else 200)
        self.end_headers()
        self.wfile.write(json.dumps({"message": {"content": json.dumps({"risk_score": 90 if "BAD" in text else 5, "reasoning": "r", "key_changes": [], "suspicious_findings": []})}}).encode())

    def log_message(self, *args):
        pass


@pytest.fixture
def url():
    Counting.calls.clear()
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Counting)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


CFG = Config(retry_backoff=0.0)


def test_a_task_that_dies_asks_nothing_twice(url, tmp_path):
    rows = [(d, c, f"text {d} {c} {'BAD' if d == 2 else ''}") for d in range(4) for c in (1, 2)]
    frames = lambda: (pd.DataFrame([r], columns=["diff_id", "chunk_no", "text"]) for r in rows)
    once = score.asking(url, "m", "p", CFG, str(tmp_path / "ledger"))
    died = once(frames())
    first = [next(died) for _ in range(5)]
    died.close()
    seen = dict(Counting.calls)
    again = list(once(frames()))
    assert all(Counting.calls[t] == n for t, n in seen.items())  # what was answered isn't asked again
    assert all(a.equals(b) for a, b in zip(first, again))
    assert {t: n for t, n in Counting.calls.items()} == {t: 3 if "BAD" in t else 2 for _, _, t in rows}
    total = sum(Counting.calls.values())
    assert sum(map(len, again)) == total  # a reply for each call


def test_a_review_that_is_run_again_asks_nothing(spark, url, tmp_path):
    chunks = spark.createDataFrame([(d, 1, f"chunk {d}") for d in range(6)], "diff_id bigint, chunk_no int, text string")
    run = lambda k: score.over_http(url, "m", "p", CFG, f"{tmp_path}/stage{k}", f"{tmp_path}/ledger")(chunks)
    one = sorted(map(tuple, run(1).collect()))
    total = sum(Counting.calls.values())
    assert sorted(map(tuple, run(2).collect())) == one and sum(Counting.calls.values()) == total == 12
    other = score.over_http(url, "m", "another prompt", CFG, f"{tmp_path}/stage3", f"{tmp_path}/ledger")(chunks)
    assert other.count() == 6 and sum(Counting.calls.values()) == 18  # another question


def test_reports_in_few_files(spark, tmp_path):
    at = str(tmp_path / "out")
    many = spark.range(100_000).select(F.col("id").alias("diff_id"), F.concat(F.lit("# é report "), F.col("id").cast("string"), F.lit("\nline\n\n")).alias("report"), F.lit(1).alias("x")).repartition(4)
    reports.write(many, at, max_bytes=1 << 20)
    made = os.listdir(f"{at}/reports")
    size = sum(os.path.getsize(f"{at}/reports/{f}") for f in made)
    assert len(made) <= size / (1 << 20) + 4 and len(os.listdir(f"{at}/index")) == len(made)
    assert reports.index(spark, at).agg(F.count("*"), F.countDistinct("diff_id"), F.sum("length")).first() == (100_000, 100_000, size)
    got = {r.diff_id: r.report for r in reports.read(spark, at, "diff_id % 9973 = 7").collect()}
    assert got == {i: f"# é report {i}\nline\n\n" for i in range(100_000) if i % 9973 == 7}
    odd = spark.createDataFrame([(None, "no id"), (5, None), (6, "")], "diff_id bigint, report string")
    reports.write(odd, at, append=True)
    assert reports.index(spark, at).count() == 100_003 and {r.report for r in reports.read(spark, at, "diff_id IS NULL OR length = 0").collect()} == {"no id", ""}
    reports.write(odd.limit(0), at)
    assert not os.path.exists(f"{at}/reports")


def test_an_aborted_write_leaves_nothing(spark, tmp_path):
    at = str(tmp_path / "out")
    old = spark.createDataFrame([(1, "kept")], "diff_id bigint, report string")
    reports.write(old, at)
    bad = spark.range(0, 4000, 1, 4).select(F.col("id").alias("diff_id"), F.when(F.col("id") < 3999, F.lit("r" * 1000)).otherwise(F.raise_error(F.lit("boom"))).cast("string").alias("report"))
    with pytest.raises(Exception):
        reports.write(bad, at, append=True, max_bytes=1000)
    assert [tuple(r) for r in reports.read(spark, at).collect()] == [(1, "kept")]
    left = lambda: [n for _, _, names in os.walk(at) for n in names if not n.endswith(".crc")]
    for _ in range(60):  # tasks that still ran take theirs away
        if len(left()) == 3:
            break
        time.sleep(1)
    assert sorted(n.rsplit(".", 1)[1] for n in left()) == ["aborted", "parquet", "txt"]


def test_git_ranges(spark, tmp_path):
    def git(*args):
        subprocess.run(["git", "-c", "user.name=n", "-c", "user.email=e@example.org", *args], cwd=tmp_path, check=True, capture_output=True)

    git("init", "-q")
    for n in range(26):
        (tmp_path / "f.txt").write_text("".join(f"line {i}\n" for i in range(20)) + f"{n}\n")
        git("add", "f.txt")
        git("commit", "-qm", str(n))
    rows = [(n, str(tmp_path), f"HEAD~{n}", "HEAD") for n in range(1, 26)] + [(100 + n, str(tmp_path), f"HEAD~{n + 1}", f"HEAD~{n}") for n in range(25)]
    bad = [(200, str(tmp_path), "nowhere", "HEAD"), (201, str(tmp_path / "none"), "HEAD", "HEAD"), (202, None, "HEAD", "HEAD"), (203, str(tmp_path), "--output=x", "HEAD"), (204, str(tmp_path), "HEAD", None)]
    ranges = spark.createDataFrame(rows + bad, "diff_id bigint, repository string, base string, head string")
    made = files.git_ranges(ranges, tasks=8)
    assert made.rdd.getNumPartitions() == 8
    got = {r.diff_id: r for r in made.collect()}
    assert len(got) == 55 and all((got[n].status == "ok") == (n < 200) and (got[n].raw is None) == (n >= 200) for n in got)
    assert all(f"-{25 - n}\n" in got[n].raw and "+25\n" in got[n].raw for n in range(1, 26)) and "+24\n" in got[101].raw
    assert not (tmp_path / "x").exists()
    tight = files.git_ranges(ranges.where("diff_id = 1"), Config(large_diff_chars=10)).first()
    assert len(tight.raw) < len(got[1].raw) and got[1].raw == files.git_range(spark, "HEAD~1", str(tmp_path)).first().raw


def test_comments_over_a_stream(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))

    def batch(*rows):
        told = spark.createDataFrame([(*r[:-1], datetime.datetime(2026, 1, 1, 0, r[-1])) for r in rows], comments.EVENTS)
        told.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(comments.EVENTS).parquet(source)
        query = comments.upserts(stream).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
        query.awaitTermination(180)
        got = sorted((r.repo, r.pr, r.action, r.comment_id, r.body) for r in spark.read.schema(comments.ACTIONS).parquet(out).collect())
        new = collections.Counter(got) - collections.Counter(batch.seen)
        batch.seen = got
        return sorted(new.elements())

    batch.seen = []
    report = lambda repo, pr, body, at: (repo, pr, "report", None, body, at)
    assert batch(report("a", 1, "first", 1), report("a", 1, "first", 1), report("a", 2, "x", 1), report("b", 1, "old", 1), report("b", 1, "new", 2), ("c", 1, "posted", 77, None, 1)) == [("a", 1, "post", None, "first"), ("a", 2, "post", None, "x"), ("b", 1, "post", None, "new")]
    # After a restart: a repeat, a late one, the forge's answer with a newer report, a comment that was there before the first report.
    assert batch(report("a", 1, "first", 5), report("b", 1, "late", 1), ("a", 2, "posted", 9, None, 2), report("a", 2, "y", 3), report("c", 1, "z", 2), report(None, 1, "n", 1)) == [("a", 2, "patch", 9, "y"), ("c", 1, "patch", 77, "z")]
    assert batch(report("a", 2, "late again", 2), report("a", 1, "third", 6)) == [("a", 1, "patch", None, "third")]


def test_labelled_folders_are_partitions(spark, tmp_path, capsys):
    """The rows of diff_files, over folders label=...; a condition on the label is one on partitions. Spark skips empty files in both."""
    for label, name, raw in [("benign", "a", b"+x\n"), ("benign", "b", b"\xff"), ("malicious", "a", b"+y\n"), ("7", "c", b"+z\n"), ("7", "empty", b"")]:
        for folder in (tmp_path / "plain" / label, tmp_path / "parted" / f"label={label}"):
            folder.mkdir(parents=True, exist_ok=True)
            (folder / f"{name}.diff").write_bytes(raw)
            (folder / "notes.txt").write_bytes(b"no diff")
    every = files.labelled_files(spark, str(tmp_path / "parted"))
    assert sorted(every.collect()) == sorted(files.diff_files(spark, str(tmp_path / "plain")).collect()) and every.count() == 4
    some = every.where("label = 'benign'")
    assert {(r.name, r.raw) for r in some.collect()} == {("a", "+x\n"), ("b", "\ufffd")}
    some.explain("formatted")
    assert re.search(r"PartitionFilters: \[.*label#\d+ = benign", capsys.readouterr().out)
