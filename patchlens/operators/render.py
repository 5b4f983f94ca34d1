"""Reports of reviews, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import columns as C

MARKER = "<!-- patchlens-report -->"
# The fields of a result, in order.
KEYS = ("verdict score scored truncated injection failsafe bootstrap num_chunks files_scanned files_unscanned files_truncated files_binary files_excluded files_lockfiles key_changes suspicious_findings reasoning").split()


# The fields of a result when there was nothing to review, in order.
EMPTY_KEYS = "verdict score key_changes suspicious_findings reasoning".split()


def is_empty() -> Column:
    """Of a row of scans: nothing was there to be reviewed."""
    return ~F.col("scored") & F.col("score").isNotNull()


def json_of() -> Column:
    """A row of scans as JSON: the 17 fields, indented by two; on one line the 5 of an empty diff."""
    return F.when(is_empty(), F.to_json(F.struct(*EMPTY_KEYS))).otherwise(F.to_json(F.struct(*KEYS), {"pretty": "true", "ignoreNullFields": "false"}))


def as_json(scans: DataFrame) -> DataFrame:
    return scans.select("diff_id", json_of().alias("json"))


def report(cfg: Config = Config()) -> Column:
    """The Markdown report of a row of scans."""

    def part(condition: Column, *lines) -> Column:
        text = F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in lines])
        return F.when(condition, text)

    some = lambda c: F.size(c) > 0
    paths = lambda c: C.cap_paths(F.col(c))
    icon = F.when(F.col("verdict") == "pass", "✅").when(F.col("verdict") == "review", "⚠️").otherwise("⛔")
    covered = F.col("failsafe").isNull() | (F.col("num_chunks") > 0)
    rows = F.array_join(F.transform("suspicious_findings", lambda f: F.concat(F.lit("| `"), f["file"], F.lit("` | "), C.cell(f["reason"]), F.lit(" |"))), "\n")
    blocks = [
        F.concat(F.lit(f"{MARKER}\n## "), icon, F.lit(" Change review: "), F.upper("verdict")),
        part(F.col("bootstrap"), "> 📦 **Initial import of ", F.col("bootstrap_total").cast("string"), " files.** Only ", F.col("files_scanned").cast("string"), " CI and executable surfaces were scanned; the rest needs a person's sign-off."),
        part(F.col("failsafe") == "infra", "> ⚠️ **Scan incomplete (service error): manual review required.** The diff wasn't reviewed in full, so this isn't a clean pass; the verdict is `", F.col("verdict"), "`."),
        part(F.col("failsafe") == "content", "> 🛑 **The reviewer's reply couldn't be read, which counts as suspicious.** The verdict is `", F.col("verdict"), "`."),
        part(F.col("injection"), f"> 🛡️ **Text aimed at the reviewer was found in the diff.** The score is at least {cfg.injection_floor}."),
        part(covered, "_Scanned ", F.col("files_scanned").cast("string"), " files across ", F.col("num_chunks").cast("string"), " chunks._"),
        part(some("files_binary"), "> ⚠️ **Binary changes were NOT reviewed**; only their metadata was:\n>\n> - ", paths("files_binary")),
        part(some("files_unscanned") | some("files_truncated"), "> ⚠️ **Not fully scanned: the verdict is at least `review`.**", F.when(some("files_unscanned"), F.concat(F.lit("\n> - **Unscanned (out of budget):** "), paths("files_unscanned"))).otherwise(""), F.when(some("files_truncated"), F.concat(F.lit("\n> - **Truncated (larger than a chunk):** "), paths("files_truncated"))).otherwise("")),
        part(some("files_excluded"), "_Not scanned by policy, without effect on the verdict:_ ", paths("files_excluded")),
        part(some("files_lockfiles"), "_Lockfiles checked by rules:_ ", paths("files_lockfiles")),
        F.concat(F.lit("### Risk Score\n"), F.when(F.col("scored"), F.concat(F.lit("**"), F.col("score").cast("string"), F.lit(" / 100** — "), C.risk_band(F.col("score"), cfg))).otherwise("**n/a** — no chunk was scored.")),
        F.concat(F.lit("### Key Changes\n"), F.when(some("key_changes"), F.concat(F.lit("- "), F.array_join("key_changes", "\n- "))).otherwise("None identified.")),
        F.concat(F.lit("### Suspicious Findings\n"), F.when(some("suspicious_findings"), F.concat(F.lit("| File | Reason |\n|---|---|\n"), rows)).otherwise("None. ✅")),
        part(F.length("reasoning") > 0, "### Why this score\n\n", F.col("reasoning")),
    ]
    return F.concat(F.concat_ws("\n\n", *blocks), F.lit("\n"))


def reports(scans: DataFrame, cfg: Config = Config()) -> DataFrame:
    return scans.select("diff_id", report(cfg).alias("report"))
