"""Outcomes of chunks to one result for each diff, and the policy that turns it into a verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import columns as C
from ..functions import patterns as P
from .score import RESULT, with_note

TRIPWIRE = "Automated tripwire: text aimed at the reviewer was found in the diff, so the score was raised to the floor of %d from %d."
FINDING = "array<struct<file: string, reason: string>>"


def _distinct_findings(parts: DataFrame) -> DataFrame:
    """parts: diff_id, part, seq (sortable), file, reason. The first of each file and normalised reason, in order."""
    w = Window.partitionBy("diff_id", "file", C.finding_key(F.col("reason"))).orderBy("part", "seq")
    return parts.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def ordered(*fields: str, order: tuple[str, ...]) -> Column:
    shown = (lambda s: s[fields[0]]) if len(fields) == 1 else (lambda s: F.struct(*[s[f].alias(f) for f in fields]))
    return F.transform(F.array_sort(F.collect_list(F.struct(*order, *[f for f in fields if f not in order]))), shown)


def reduce_outcomes(outcomes: DataFrame, cfg: Config = Config()) -> DataFrame:
    """outcomes: diff_id, chunk_no, status, result, paths, of the attempted chunks. One row for each diff:

    num_chunks, files_scanned, scored, failsafe (infra before content), risk_score (the worst), key_changes and
    suspicious_findings (each once, the first), reasoning (of the notable chunks). The result of a diff's only chunk is used as it is.
    """
    r = F.col("result").cast(RESULT)
    base = outcomes.withColumns({"score": r["risk_score"], "notable": (F.col("status") == "ok") & ((F.size(r["suspicious_findings"]) > 0) | (r["risk_score"] >= cfg.review)) & (F.length(r["reasoning"]) > 0)})
    text = F.concat(F.lit("["), F.array_join("paths", ", "), F.lit("] "), r["reasoning"])
    notes = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("notable"), F.struct("chunk_no", text.alias("x"))))), lambda s: s["x"]), "\n\n")
    ok = F.col("status") == "ok"
    per = base.groupBy("diff_id").agg(F.count("*").alias("num_chunks"), F.sum(F.size("paths")).alias("files_scanned"), F.count_if(ok).alias("n_ok"), F.max("score").alias("worst"), F.when(F.bool_or(F.col("status") == "infra"), "infra").when(F.bool_or(F.col("status") == "content"), "content").alias("failsafe"), notes.alias("notes"), F.first(F.when(ok, r), ignorenulls=True).alias("only"))
    found = outcomes.where(ok).select("diff_id", F.col("chunk_no").alias("part"), F.posexplode(r["suspicious_findings"]).alias("seq", "f")).select("diff_id", "part", "seq", "f.file", "f.reason")
    findings = _distinct_findings(found).groupBy("diff_id").agg(ordered("file", "reason", order=("part", "seq")).alias("findings"))
    said = outcomes.where(ok).select("diff_id", F.col("chunk_no").alias("part"), F.posexplode(r["key_changes"]).alias("seq", "change")).withColumn("bare", C.strip(F.col("change"))).where("bare <> ''")
    first = Window.partitionBy("diff_id", "bare").orderBy("part", "seq")
    changes = said.withColumn("n", F.row_number().over(first)).where("n = 1").groupBy("diff_id").agg(ordered("change", order=("part", "seq")).alias("changes"))
    all_ = per.join(findings, "diff_id", "left").join(changes, "diff_id", "left")
    alone = (F.col("num_chunks") == 1) & (F.col("n_ok") == 1)
    pick = lambda field, merged: F.when(alone, F.col("only")[field]).otherwise(merged).alias(field)
    none = F.format_string("No notable findings across %d files / %d chunks.", "files_scanned", "num_chunks")
    return all_.select("diff_id", "num_chunks", "files_scanned", (F.col("n_ok") > 0).alias("scored"), "failsafe", pick("risk_score", F.coalesce("worst", F.lit(0))), pick("key_changes", F.coalesce("changes", F.array().cast("array<string>"))), pick("suspicious_findings", F.coalesce("findings", F.array().cast(FINDING))), pick("reasoning", F.when(F.col("notes") != "", F.col("notes")).otherwise(none)), alone.alias("verbatim"))


def to_narrate(results: DataFrame) -> DataFrame:
    """diff_id, text: findings and notes of each diff whose result isn't that of its only chunk."""
    listed = F.array_join(F.transform("suspicious_findings", lambda f: F.concat(F.lit("- "), f["file"], F.lit(": "), f["reason"])), "\n")
    text = F.concat(F.lit("Findings:\n"), F.coalesce(F.nullif(listed, F.lit("")), F.lit("(none)")), F.lit("\n\nNotes:\n"), F.col("reasoning"))
    return results.where(~F.col("verbatim")).select("diff_id", text.alias("text"))


def narrated(results: DataFrame, replies: DataFrame) -> DataFrame:
    """results with the reasoning of replies (diff_id, content: an object with a reasoning); one that can't be read changes nothing.

    Scores, findings and verdicts don't depend on it.
    """
    v = F.coalesce(F.try_parse_json("content"), F.try_parse_json(F.nullif(F.regexp_extract("content", P.JSON_OBJECT, 0), F.lit(""))))
    new = F.when(F.schema_of_variant(v).startswith("OBJECT"), F.nullif(C.strip(F.try_variant_get(v, "$.reasoning", "string")), F.lit("")))
    told = replies.select("diff_id", new.alias("told")).groupBy("diff_id").agg(F.max("told").alias("told"))
    joined = results.join(told, "diff_id", "left")
    return joined.withColumn("reasoning", F.when(F.col("verbatim"), F.col("reasoning")).otherwise(F.coalesce("told", "reasoning"))).drop("told")


def merge_findings(results: DataFrame, extra: DataFrame) -> DataFrame:
    """suspicious_findings with those of extra (diff_id, part >= 1, seq, file, reason) behind, unless said before."""
    own = results.select("diff_id", F.lit(0).alias("part"), F.posexplode("suspicious_findings").alias("seq", "f")).select("diff_id", "part", F.col("seq").cast("bigint").alias("seq"), "f.file", "f.reason", F.lit(True).alias("own"))
    every = own.unionByName(extra.select("diff_id", "part", F.col("seq").cast("bigint").alias("seq"), "file", "reason", F.lit(False).alias("own")))
    w = Window.partitionBy("diff_id", "file", C.finding_key(F.col("reason"))).orderBy("part", "seq")
    kept = every.withColumn("n", F.row_number().over(w)).where("own OR n = 1")
    merged = kept.groupBy("diff_id").agg(ordered("file", "reason", order=("part", "seq")).alias("merged"))
    return results.join(merged, "diff_id", "left").withColumn("suspicious_findings", F.coalesce("merged", F.array().cast(FINDING))).drop("merged")


def apply_policy(results: DataFrame, cfg: Config = Config()) -> DataFrame:
    """results: what reduce_outcomes() gives, injection, overflow, truncated, binary (arrays), n_rules, bootstrap.

    The score is raised to the injection floor, and the verdict escalated on the lattice; nothing lowers either.
    """
    low = F.col("injection") & (F.col("risk_score") < cfg.injection_floor)
    raised = results.withColumns({"reasoning": F.when(low, with_note(F.col("reasoning"), F.format_string(TRIPWIRE, F.lit(cfg.injection_floor), "risk_score"))).otherwise(F.col("reasoning")), "risk_score": F.when(low, cfg.injection_floor).otherwise(F.col("risk_score"))})
    at = lambda condition, rank: F.when(condition, rank).otherwise(0)
    closed = 2 if cfg.fail_closed else None
    rank = F.greatest(
        C.verdict_rank(F.col("risk_score"), cfg),
        at(F.col("failsafe") == "infra", closed or C.rank_of(cfg.fail_safe)),
        at(F.col("failsafe") == "content", closed or 1),
        at((F.size("overflow") > 0) | (F.size("truncated") > 0) | (F.size("binary") > 0) | (F.col("n_rules") > 0) | F.col("bootstrap"), 1),
        at(F.lit(cfg.floor_on_mode) & F.col("has_mode"), 1) if "has_mode" in results.columns else F.lit(0),
    )
    return raised.withColumn("verdict", C.verdict(rank)).withColumn("exit_code", F.when(F.col("verdict") == "block", 1).otherwise(0))
