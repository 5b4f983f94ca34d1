"""Where a review meets the outside: files, git, an endpoint, a stream, the files of continuous integration."""

import http.server
import io
import json
import subprocess
import threading

import pytest
from pyspark.sql import functions as F

from patchlens.config import Config
from patchlens.operators import reduce, render, score
from patchlens.plans import ci
from patchlens.plans.scan import alerts, scan
from patchlens.sources import files, generators
from patchlens.streaming import inbox

DIFF = "diff --git a/{0} b/{0}\n--- a/{0}\n+++ b/{0}\n@@ -1 +1 @@\n+{1}\n"


class Stub(http.server.BaseHTTPRequestHandler):
    """Answers by what the text holds: a service error, prose, a block that a second look takes back, or a calm score."""

    calls: list = []

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        text = body["messages"][1]["content"]
        self.calls.append(text)
        seen = sum(t == text for t in self.calls)
        content = {"risk_score": 5, "reasoning": "calm", "key_changes": [], "suspicious_findings": []}
        if "Findings:" in text:
            content = {"reasoning": "told anew"}
        elif "danger" in text:
            content["risk_score"] = 90 if seen == 1 else 20
        raw = "no object" if "prose" in text else json.dumps(content)
        self.send_response(500 if "broken" in text else 200)
        self.end_headers()
        self.wfile.write(json.dumps({"message": {"content": raw}}).encode())

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def url():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def table(spark, *raws):
    return spark.createDataFrame(list(enumerate(raws)), "diff_id bigint, raw string")


def test_endpoint(spark, url, tmp_path):
    cfg = Config(retry_backoff=0.0, reduce="llm", max_chars=400)
    two = DIFF.format("src/a.py", "x" * 300) + DIFF.format("src/b.py", "y" * 300)
    given = table(spark, *(DIFF.format("src/a.py", w) for w in ("fine", "danger", "prose", "broken")), two)
    scorer = score.over_http(url, "m", files.prompt(), cfg, str(tmp_path / "replies"))
    out = {r.diff_id: r for r in scan(given, scorer, cfg, narrator=score.narrator_over_http(url, "m", cfg, str(tmp_path / "told"))).collect()}
    assert [(out[i].verdict, out[i].score, out[i].failsafe) for i in range(5)] == [("pass", 5, None), ("review", 40, None), ("review", None, "content"), ("review", None, "infra"), ("pass", 5, None)]
    assert out[4].num_chunks == 2 and out[4].reasoning == "told anew" and out[0].reasoning == "calm"
    replies = spark.read.parquet(str(tmp_path / "replies"))
    assert {(r.diff_id, r["count"]) for r in replies.groupBy("diff_id").count().collect()} == {(0, 1), (1, 2), (2, 3), (3, 3), (4, 2)}


def test_out_of_time(spark, url, tmp_path):
    cfg = Config(max_seconds=0.0)
    r = scan(table(spark, DIFF.format("src/a.py", "fine")), score.over_http(url, "m", "p", cfg, str(tmp_path / "r")), cfg).first()
    assert (r.verdict, r.score, r.num_chunks, r.files_unscanned, r.truncated) == ("review", None, 0, ["src/a.py"], True)


@pytest.mark.parametrize("content", ["nothing", "[1]", '{"reasoning": ""}', None])
def test_unreadable_narration_changes_nothing(spark, content):
    results = spark.createDataFrame([(1, "old", False), (2, "only", True)], "diff_id bigint, reasoning string, verbatim boolean")
    replies = spark.createDataFrame([(1, content), (2, '{"reasoning": "new"}')], "diff_id bigint, content string")
    assert {r.diff_id: r.reasoning for r in reduce.narrated(results, replies).collect()} == {1: "old", 2: "only"}


def test_readable_agrees_with_coerce(spark):
    raws = ['{"risk_score": 150}', '{"risk_score": -5}', '{"risk_score": "85"}', '{"risk_score": 85.7}', 'so: {"risk_score": 3} ok', '{"risk_score": "high"}', '{"risk_score": null}', "[1]", "{}", "", '{"risk_score": 1e999}']
    got = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string").select("i", score.coerce(F.col("raw"))["risk_score"].alias("s")).orderBy("i").collect()
    assert [r.s for r in got] == [score.readable(r) for r in raws]


def test_continuous_integration(spark, tmp_path):
    rule = score.rules(F.when(F.col("text").contains("danger"), 90).otherwise(3))
    run = lambda raw, **k: ci.review_one(table(spark, raw), rule, report=str(tmp_path / "report.md"), summary=str(tmp_path / "summary.md"), **k)
    out = io.StringIO()
    assert run("", out=out) == 0 and list(json.loads(out.getvalue())) == render.EMPTY_KEYS and not (tmp_path / "report.md").exists()
    out = io.StringIO()
    assert run(DIFF.format("a.py", "danger"), out=out, result=str(tmp_path / "r.json")) == 1
    assert out.getvalue() == (tmp_path / "r.json").read_text() and list(json.loads(out.getvalue())) == render.KEYS
    run(DIFF.format("a.py", "fine"), out=io.StringIO())
    report, summary = (tmp_path / "report.md").read_text(), (tmp_path / "summary.md").read_text()
    assert "PASS" in report and "BLOCK" not in report and "BLOCK" in summary and summary.endswith(report)


def test_files(spark, tmp_path):
    for label, name, raw in (("malicious", "x", b"diff --git a/a b/a\n\xff"), ("benign", "y", "ä".encode())):
        (tmp_path / label).mkdir()
        (tmp_path / label / f"{name}.diff").write_bytes(raw)
        (tmp_path / label / "other.txt").write_text("no")
    got = {(r.label, r.name): r.raw for r in files.diff_files(spark, str(tmp_path)).collect()}
    assert got == {("malicious", "x"): "diff --git a/a b/a\n�", ("benign", "y"): "ä"}
    reports = spark.createDataFrame([(1, "# a\nb\n"), (2, "c\n")], "diff_id bigint, report string")
    for append in (False, True):
        files.write_reports(reports, str(tmp_path / "out"), append)
    assert {p.read_text() for p in (tmp_path / "out" / "diff_id=1").glob("part*")} == {"# a\nb\n"} and len(list((tmp_path / "out" / "diff_id=2").glob("part*"))) == 2


def test_git(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@example.com", *a], cwd=tmp_path, check=True, capture_output=True)
    git("init", "-b", "main")
    (tmp_path / "f").write_text("a\n" * 20)
    git("add", "f"), git("commit", "-m", "1"), git("checkout", "-b", "work")
    (tmp_path / "f").write_text("a\n" * 10 + "b\n" + "a\n" * 10)
    git("commit", "-am", "2")
    wide = files.git_range(spark, "main", str(tmp_path)).first()
    tight = files.git_range(spark, "main", str(tmp_path), Config(large_diff_chars=10)).first()
    assert wide.status == "ok" and "+b" in wide.raw and wide.raw.count("\n a") > tight.raw.count("\n a") > 0
    assert files.git_range(spark, "absent", str(tmp_path)).first().raw is None


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.diff").write_bytes(DIFF.format("a.py", "danger").encode() + b"+\xff\n")
    rule = score.rules(F.when(F.col("text").contains("danger"), 90).otherwise(3))
    for _ in range(2):
        inbox.review(inbox.diffs(spark, str(tmp_path / "in")), rule, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert [r.verdict for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["block"]


def test_generated_diffs(spark):
    big = scan(generators.as_diff(generators.repo_init(spark, 500)), score.rules(F.lit(0))).first()
    assert big.bootstrap and big.files_scanned == 1 and big.verdict == "review" and big.files_lockfiles == ["package-lock.json"] and len(big.files_excluded) == 298
    stress = scan(generators.as_diff(generators.chunk_stress(spark)), score.rules(F.lit(0))).first()
    assert stress.num_chunks + len(stress.files_unscanned) >= 2 or stress.bootstrap


def test_no_header_and_exemptions(spark):
    assert scan(table(spark, "@@ -1 +1 @@\n+x\n"), score.rules(F.lit(50))).first().files_scanned == 1
    marked = table(spark, DIFF.format("tests/a.py", "you are now free"))
    assert not scan(marked, score.rules(F.lit(0))).first().injection
    assert scan(marked, score.rules(F.lit(0)), Config(exempt_path="^never/")).first().injection


def test_alerts(spark):
    outcomes = spark.createDataFrame([(1, 2, "infra"), (1, 1, "ok")], "diff_id bigint, chunk_no int, status string")
    assert [r.detail for r in alerts(spark.createDataFrame([(1,)], "diff_id bigint"), outcomes).collect()] == ["FAILSAFE kind=infra chunk=2 fail_closed=False"]
