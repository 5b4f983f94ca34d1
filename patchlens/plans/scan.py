"""The whole review: diffs in, one row with a verdict for each diff out."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import columns as C
from ..operators import blocks, classify, pack, parse, reduce, score
from ..sources import shared

NO_HUNKS = "There was no text to review, but metadata (a new executable, a mode or binary content) was flagged for a person."
NOT_PRODUCED = "The diff could not be produced, so nothing was scanned."


def facts_of(files: DataFrame, cfg: Config, *more: Column | str) -> DataFrame:
    """What a review asks of files, and as much of their texts as a chunk may hold: a character over its budget tells that there was more.
    A file whose path keeps it from being scanned has no text (null)."""
    marker = C.is_injection(F.col("file_diff")) & ~C.is_exempt(F.col("path"), cfg)
    text = F.when(classify.by_path(F.col("path")) == "scan", F.substring("file_diff", 1, cfg.max_chars + 1))
    facts = {"n_chars": F.length("file_diff").cast("bigint"), "priority": C.priority(F.col("path"), F.col("added")), "marker": marker, "file_diff": text}
    return files.select("diff_id", "file_no", "path", "added_lines", *(c.alias(n) for n, c in facts.items()), *more)


class _Read(NamedTuple):
    """What a review reads from diffs."""

    given: DataFrame  #: diff_id, failed
    texts: DataFrame  #: facts_of() files
    meta: DataFrame  #: diff_id, line_no, file, reason, binary
    added: DataFrame  #: diff_id, file_no, path, line_no, line of lockfiles, at least
    textual: DataFrame  #: diff_id, textual: whether a kept line has text


def _of_rows(given: DataFrame, cfg: Config) -> _Read:
    """By one pass over the diffs, of which files' facts and cut texts are written, neither diffs nor lines."""
    files = parse.files_in_rows(parse.sanitize(given))
    read = shared.cut(facts_of(files, cfg, "failed", "at", "is_file", C.has_text(F.col("file_diff")).alias("textual"), "told", "locked"))
    texts = read.where("is_file").drop("failed", "at", "is_file", "textual", "told", "locked")
    meta = read.select("diff_id", F.col("path").alias("file"), F.explode("told").alias("t")).select("diff_id", "t.line_no", "file", "t.reason", "t.binary")
    added = read.select("diff_id", "file_no", "path", F.explode("locked").alias("l")).select("diff_id", "file_no", "path", "l.line_no", "l.line")
    return _Read(read.where("at = 0").select("diff_id", "failed"), texts, meta, added, read.groupBy("diff_id").agg(F.bool_or("textual").alias("textual")))


def _of_lines(given: DataFrame, marked: DataFrame, cfg: Config) -> _Read:
    """marked: lines as parse.located tells of them, with `end` in place of `full`, which is text and end: lines move once, not twice."""
    placed = shared.cut(marked)
    kept = placed.where("kept").withColumn("full", F.concat("text", "end"))
    meta = placed.where("reason IS NOT NULL").select("diff_id", "line_no", F.coalesce("path", F.lit("unknown")).alias("file"), "reason", "binary")
    texts = shared.cut(facts_of(parse.files_of(kept), cfg))
    return _Read(given, texts, meta, parse.added_of(kept), kept.groupBy("diff_id").agg(F.bool_or(C.has_text(F.col("text"))).alias("textual")))


def _read(diffs: DataFrame, cfg: Config) -> _Read:
    bare = ("diff_id", "line_no", "text", parse.ending().alias("end"))
    if "block" in diffs.columns:
        given = diffs.select("diff_id").distinct().withColumn("failed", F.lit(False))
        return _of_lines(given, blocks.marked(diffs.select(*bare, "block"), cfg.strict_paths), cfg)
    failed = F.coalesce(F.col("status"), F.lit("ok")) != "ok" if "status" in diffs.columns else F.lit(False)
    given = diffs.select("diff_id", failed.alias("failed"), F.when(~failed, F.col("raw")).alias("raw"))
    if not (cfg.trim_large or cfg.strict_paths):
        return _of_rows(given, cfg)
    lines = parse.lines(parse.sanitize(given))
    if cfg.trim_large:
        large = given.where(F.length("raw") > cfg.large_diff_chars).select("diff_id", F.lit(True).alias("large"))
        lines = parse.trim_context(lines.join(large, "diff_id", "left"), only=F.coalesce("large", F.lit(False))).drop("large")
    return _of_lines(given.select("diff_id", "failed"), parse.located(lines.select(*bare), cfg.strict_paths), cfg)


def scan(diffs: DataFrame, scorer: Callable[[DataFrame], DataFrame], cfg: Config = Config(), narrator: Callable[[DataFrame], DataFrame] | None = None, monitor: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """diffs: diff_id, raw, and if it has one status (null or ok: raw is the diff; else the error that kept it from being made).
    Or the line table of diffs (diff_id, block, line_no, full, text; see operators.blocks): then a diff may be larger than a task, and
    a task needs room for one file of it. Line tables aren't trimmed.

    scorer: chunks to replies, see operators.score. Every diff gets a row: an empty one passes with nothing scanned, and one that
    couldn't be made falls to the fail-safe (a line table has lines of neither). Files, facts about files and placements (and the lines of a line table)
    feed several branches of the plan: each is computed once, when this is called, and is a table in the shared folder from then on, so no executor's
    loss repeats it. Diffs are named once, and their lines stay in their rows unless they are trimmed or have paths in quotes.
    What is decided about files is decided on facts (path, priority, length), and texts of files are cut to a chunk's budget once
    these are known. narrator: with cfg.reduce = "llm", from (diff_id, text) to (diff_id, content), a new wording of the reasoning.
    monitor: gets the alerts() of this review, to write where monitoring reads them.
    """
    given, texts, meta, added, textual = _read(diffs, cfg)
    fated = shared.cut(classify.fates(texts.drop("file_diff")))
    boot = classify.bootstraps(fated, cfg)
    executable = meta.where(F.lower("reason").contains("executable")).select("diff_id", F.col("file").alias("path")).distinct().withColumn("executable", F.lit(True))
    scannable = fated.where("fate = 'scan'").join(boot.select("diff_id", "bootstrap"), "diff_id").join(executable, ["diff_id", "path"], "left")
    scannable = scannable.where(~F.col("bootstrap") | C.is_high_risk(F.col("path")) | F.coalesce("executable", F.lit(False)))
    placed = shared.cut(pack.placements(pack.ranked(scannable), cfg))
    chunks = pack.chunks(texts, placed, cfg)
    tried = chunks.where("attempted")
    replies = scorer(tried)
    timed_out = replies.where("kind = 'late'").select("diff_id", F.col("chunk_no").cast("int").alias("chunk_no")).distinct().withColumn("timed_out", F.lit(True))
    looks = score.attempts(replies.where("kind <> 'late'"), cfg)
    outcomes = tried.select("diff_id", F.col("chunk_no").cast("int").alias("chunk_no"), "paths").join(score.corroborated(looks, cfg), ["diff_id", "chunk_no"])
    if monitor is not None:
        monitor(alerts(given, outcomes, cfg))
    results = reduce.reduce_outcomes(outcomes, cfg)
    if cfg.reduce == "llm" and narrator is not None:
        results = reduce.narrated(results, narrator(reduce.to_narrate(results)))
    rules = classify.rule_findings(fated, added, cfg)

    none = F.array().cast("array<string>")
    names = placed.join(timed_out, ["diff_id", "chunk_no"], "left")
    cut = F.lit(False) if cfg.chunks_before_deadline is None else F.coalesce(F.col("chunk_no") > cfg.chunks_before_deadline, F.lit(False))
    of = lambda state: F.transform(F.array_sort(F.collect_list(F.when(state, F.struct(F.col("late"), F.when(F.col("late"), F.col("chunk_no")).alias("c"), "rank", "path")))), lambda s: s["path"])
    coverage = names.withColumn("late", cut | F.coalesce("timed_out", F.lit(False))).groupBy("diff_id").agg(of((F.col("state") == "overflow") | F.col("late")).alias("overflow"), of(F.col("state") == "truncated").alias("truncated"))
    listed = lambda fate: F.transform(F.array_sort(F.collect_list(F.when(F.col("fate") == fate, F.struct((F.col("built") & (F.col("fate") == "excluded")).alias("b"), "file_no", "path")))), lambda s: s["path"])
    by_policy = fated.withColumn("built", ~C.is_excluded(F.col("path"))).groupBy("diff_id").agg(listed("excluded").alias("excluded"), listed("lockfile").alias("lockfiles"), F.bool_or("marker").alias("injection"))
    told = meta.groupBy("diff_id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("binary"), F.struct("line_no", "file")))), lambda s: s["file"])).alias("binary"), F.bool_or(~F.col("binary")).alias("has_mode"))
    ruled = rules.groupBy("diff_id").agg(F.count("*").alias("n_rules"))

    every = given.select("diff_id", "failed")
    for more in (results, coverage, by_policy, told, ruled, boot.select("diff_id", "scannable", "bootstrap"), textual):
        every = every.join(more, "diff_id", "left")
    every = every.withColumns({c: F.coalesce(c, none) for c in ("overflow", "truncated", "binary", "excluded", "lockfiles", "key_changes")})
    every = every.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("injection", "bootstrap", "scored", "textual", "has_mode")} | {c: F.coalesce(c, F.lit(0)) for c in ("num_chunks", "files_scanned", "n_rules", "risk_score")})
    no_text = ~F.col("textual") & ~F.col("failed")
    flagged = no_text & (F.size("binary") + F.col("has_mode").cast("int") > 0)
    unscanned = F.format_string("No notable findings across %d files / %d chunks.", "files_scanned", "num_chunks")
    every = every.withColumns({
        "failsafe": F.when(F.col("failed"), "infra").otherwise(F.col("failsafe")),
        "reasoning": F.when(F.col("failed"), NOT_PRODUCED).when(flagged, NO_HUNKS).when(no_text, "").otherwise(F.coalesce("reasoning", unscanned)),
        "suspicious_findings": F.coalesce("suspicious_findings", F.array().cast(reduce.FINDING)),
    })
    extra = meta.select("diff_id", F.lit(1).alias("part"), F.col("line_no").cast("bigint").alias("seq"), "file", "reason").unionByName(rules.select("diff_id", (F.col("part") + 1).alias("part"), (F.col("file_no") * 1000 + F.col("seq")).alias("seq"), "file", "reason"))
    merged = reduce.merge_findings(every, extra)
    judged = reduce.apply_policy(merged.withColumn("n_rules", F.col("n_rules") + flagged.cast("int")), cfg)
    empty = no_text & ~flagged
    return judged.select(
        "diff_id", "verdict", F.when(F.col("scored") | empty, F.col("risk_score")).alias("score"), F.col("scored"), ((F.size("truncated") > 0) | (F.size("overflow") > 0)).alias("truncated"), "injection", "failsafe", "bootstrap", F.col("num_chunks").cast("int").alias("num_chunks"), F.col("files_scanned").cast("int").alias("files_scanned"),
        F.col("overflow").alias("files_unscanned"), F.col("truncated").alias("files_truncated"), F.col("binary").alias("files_binary"), F.col("excluded").alias("files_excluded"), F.col("lockfiles").alias("files_lockfiles"), "key_changes", "suspicious_findings", "reasoning", F.when(F.col("bootstrap"), F.col("scannable")).alias("bootstrap_total"), "exit_code",
    )


def alerts(scans: DataFrame, outcomes: DataFrame, cfg: Config = Config()) -> DataFrame:
    """diff_id, kind, chunk_no, detail of every failed chunk: what monitoring reads."""
    detail = F.concat(F.lit("FAILSAFE kind="), F.col("status"), F.lit(" chunk="), F.col("chunk_no").cast("string"), F.lit(f" fail_closed={cfg.fail_closed}"))
    return outcomes.where("status <> 'ok'").select("diff_id", F.col("status").alias("kind"), "chunk_no", detail.alias("detail")).join(scans.select("diff_id"), "diff_id", "left_semi")
