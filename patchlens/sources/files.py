"""Where diffs come from, and where results go."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Config
from ..functions import patterns as P
from ..operators import blocks, parse


@F.pandas_udf(T.StringType())
def _replaced(raw: pd.Series) -> pd.Series:
    return raw.map(lambda b: bytes(b).decode("utf-8", "replace"), na_action="ignore")


def decoded(content: Column) -> Column:
    """Bytes as text; those that aren't UTF-8 become U+FFFD, for which only texts that have some go to Python."""
    text = content.cast("string")
    return F.coalesce(_replaced(F.when(~F.is_valid_utf8(text), content)), text)


def diff_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """diff_id, name, label (the folder's name), raw: each file is one diff; bytes that aren't UTF-8 become U+FFFD. Spark skips empty files."""
    read = spark.read.option("pathGlobFilter", "*.diff").option("recursiveFileLookup", "true").format("binaryFile").load(paths)
    path = F.col("path")
    named = read.withColumn("raw", decoded(F.col("content"))).select(F.regexp_extract(path, r"([^/]+)\.diff$", 1).alias("name"), F.regexp_extract(path, r"([^/]+)/[^/]+$", 1).alias("label"), "raw")
    return named.select(F.xxhash64("label", "name").alias("diff_id"), "name", "label", "raw")


def labelled_files(spark: SparkSession, root: str) -> DataFrame:
    """diff_id, name, label, raw of the files `root/label=.../*.diff`, as diff_files has them. A condition on label leaves the other folders unread."""
    read = spark.read.option("pathGlobFilter", "*.diff").schema("path string, modificationTime timestamp, length bigint, content binary, label string").format("binaryFile").load(root)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.diff$", 1)
    named = read.select(name.alias("name"), "label", decoded(F.col("content")).alias("raw"))
    return named.select(F.xxhash64("label", "name").alias("diff_id"), "name", "label", "raw")


def diff_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The line table (diff_id, block, line_no, full, text) of diff files of any size, of which no task reads more than a split.

    A split of a file is a block. Lines end at every terminator that Unicode knows; line_no counts them from 0 in each file, by folding
    the numbers of lines of the blocks before. Bytes that aren't UTF-8 become U+FFFD, and texts are as parse.sanitize leaves them.
    """
    meta = ("_metadata.file_path", "_metadata.file_block_start", "_metadata.file_size")
    read = spark.read.option("pathGlobFilter", "*.diff").option("recursiveFileLookup", "true").option("lineSep", "\n").text(paths).select("value", *meta, F.monotonically_increasing_id().alias("row"))
    named = read.select(F.xxhash64("file_path").alias("diff_id"), F.col("file_block_start").alias("block"), "row", "file_size", F.octet_length("value").alias("bytes"), decoded(F.col("value").cast("binary")).alias("value"))
    clean = parse.sanitize(named, "value").drop("value")
    # A file's last line has a line feed if the bytes of all its lines and their line feeds are as many as the file's.
    sized = blocks.carry(clean, {"read": blocks.total(F.col("bytes") + 1)}, "row")
    ended = F.when((F.col("read") == F.col("read_all")) & (F.col("read_all") > F.col("file_size")), F.lit("")).otherwise(F.lit("\n"))
    whole = sized.select("diff_id", "block", "row", F.concat("clean", ended).alias("clean"))
    every = whole.select("diff_id", "block", "row", F.posexplode(F.regexp_extract_all("clean", F.lit(P.LINE), F.lit(0))).alias("at", "full"))
    own = every.withColumns({"text": F.regexp_replace("full", rf"[{P.LINE_ENDS}]+\z", ""), "order": F.struct("row", "at")})
    counted = blocks.carry(own, {"line_no": blocks.total(F.lit(1))}, "order")
    return counted.select("diff_id", F.floor(F.col("block")).alias("block"), (F.col("line_no") - 1).alias("line_no"), "full", "text")


def _git_diff(repository: str, base: str, head: str, large: int) -> tuple[str | None, str]:
    """The changes of head since it left base, and ok; or null and what git said. A large diff has less context."""

    def run(context: int) -> subprocess.CompletedProcess:
        return subprocess.run(["git", "diff", f"--unified={context}", f"{base}...{head}", "--"], capture_output=True, cwd=repository)

    try:
        first = run(3)
    except OSError as error:
        return None, f"git diff against {base} failed ({error})"
    if first.returncode:
        return None, f"git diff against {base} failed ({first.stderr.decode('utf-8', 'replace').strip()}); a shallow checkout needs fetch-depth: 0"
    raw = first.stdout.decode("utf-8", "replace")
    if len(raw) > large:
        tight = run(1)
        if tight.returncode == 0 and tight.stdout:
            raw = tight.stdout.decode("utf-8", "replace")
    return raw, "ok"


def git_range(spark: SparkSession, base: str = "origin/main", cwd: str = ".", cfg: Config = Config(), diff_id: int = 1) -> DataFrame:
    """One row: diff_id, raw, status. The changes of HEAD since it left base, made by the driver.

    A failure of git is a status, never an empty diff.
    """
    return spark.createDataFrame([(diff_id, *_git_diff(cwd, base, "HEAD", cfg.large_diff_chars))], "diff_id bigint, raw string, status string")


def git_ranges(ranges: DataFrame, cfg: Config = Config(), tasks: int | None = None) -> DataFrame:
    """ranges: diff_id, repository (a folder that executors see), base, head. diff_id, raw, status of each, as git_range has it.

    Executors run git, a range at a time, dealt out over `tasks` tasks (by default as many as a shuffle has). A range whose diff can't be made, or
    that lacks a name, is a row with a status.
    """
    large = cfg.large_diff_chars

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():  # a row at a time: a diff may be large
                named = all(isinstance(x, str) and x and not x.startswith("-") for x in (r.base, r.head)) and isinstance(r.repository, str)
                raw, status = _git_diff(r.repository, r.base, r.head, large) if named else (None, "the range has no repository, base or head")
                yield pd.DataFrame({"diff_id": [r.diff_id], "raw": [raw], "status": [status]})

    own = ranges.select("diff_id", "repository", "base", "head")
    dealt = own.repartition(tasks, "diff_id") if tasks else own.repartition("diff_id")
    return dealt.mapInPandas(run, "diff_id bigint, raw string, status string")


def base_ref(event: Column, pr_base_sha: Column, base_ref_: Column, before: Column) -> Column:
    """What an event's diff starts from."""
    pushed = F.when(before.rlike("^0*$"), F.lit(None)).otherwise(before)
    return F.when(event == "pull_request", F.coalesce(F.nullif(pr_base_sha, F.lit("")), F.concat(F.lit("origin/"), base_ref_))).otherwise(F.coalesce(F.when(event == "push", pushed), F.when(event == "push", F.lit("HEAD^")), F.lit("HEAD")))


#: The rubric that is shipped.
RUBRIC = str(Path(__file__).parent.parent / "prompts" / "rubric.md")


def prompt(path: str = RUBRIC) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def write_reports(reports: DataFrame, path: str, append: bool = False) -> None:
    """diff_id, report as text files, one folder diff_id=N for each diff; append: beside what is there."""
    text = F.regexp_replace("report", r"\n\z", "").alias("value")  # the writer ends each row with a line feed
    reports.select("diff_id", text).write.mode("append" if append else "overwrite").option("lineSep", "\n").partitionBy("diff_id").text(path)


def write_results(results: DataFrame, path: str) -> None:
    """diff_id, json as text files, one folder diff_id=N for each diff."""
    results.select("diff_id", "json").write.mode("overwrite").option("lineSep", "\n").partitionBy("diff_id").text(path)


def upsert_comments(existing: DataFrame, reports: DataFrame, marker: str) -> DataFrame:
    """existing: repo, pr, comment_id, body; reports: repo, pr, report. repo, pr, comment_id, action (patch, post or keep), body.

    The first comment of a pull request that starts with the marker is replaced; without one a new one is posted; where
    there is no report nothing changes.
    """
    ours = existing.where(F.col("body").startswith(marker)).groupBy("repo", "pr").agg(F.min_by(F.struct("comment_id", "body"), "comment_id").alias("c"))
    both = ours.join(reports, ["repo", "pr"], "full_outer")
    action = F.when(F.col("report").isNull(), "keep").when(F.col("c").isNull(), "post").otherwise("patch")
    return both.select("repo", "pr", "c.comment_id", action.alias("action"), F.coalesce("report", "c.body").alias("body"))
