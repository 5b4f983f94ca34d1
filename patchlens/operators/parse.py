"""Diffs to lines, hunks and files.

Everything is keyed by diff_id and ordered by an explicit number. Windows run within a diff, and all later steps of a
review group by diff_id too, so one exchange by diff_id serves them.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..functions import patterns as P
from ..sources import shared


@F.arrow_udf(T.StringType())
def _nfkc(texts: pa.Array) -> pa.Array:
    each = (t.as_py() for t in texts)  # one at a time; pandas, besides what it takes itself, holds a batch as strings twice
    return pa.array((None if t is None else unicodedata.normalize("NFKC", t) for t in each), pa.string(), size=len(texts))


def sanitize(diffs: DataFrame, column: str = "raw") -> DataFrame:
    """Adds `clean`: compatibility characters composed, zero-width ones deleted. Only texts with characters that this may change go to Python, a few MB at once."""
    text = F.col(column)
    beyond = F.when(text.rlike(P.UNSETTLED) & text.rlike(P.CHANGING), text)  # the first is quick, and tells of most texts
    return shared.small_batches(diffs).withColumn("clean", F.coalesce(F.translate(_nfkc(beyond), P.ZERO_WIDTH, ""), text))


def lines(diffs: DataFrame, column: str = "clean") -> DataFrame:
    """diff_id, line_no, full (with its terminator) and text (without), by every terminator that Unicode knows.

    A text whose only terminators are line feeds is split at these, which takes a tenth of the pattern's time.
    """
    other = other_ends(F.col(column))
    parts = F.when(other, F.regexp_extract_all(F.col(column), F.lit(P.LINE), F.lit(0))).otherwise(F.split(F.col(column), "\n"))
    cut = diffs.select("diff_id", parts.alias("parts"), other.alias("other"))
    each = cut.select("diff_id", "other", F.size("parts").alias("n"), F.posexplode_outer("parts").alias("line_no", "part"))  # outer, or the plan makes parts once more to look for empty ones
    last = F.col("line_no") == F.col("n") - 1
    each = each.where(F.col("part").isNotNull() & (F.col("other") | ~last | (F.col("part") != "")))
    full = F.when(F.col("other") | last, F.col("part")).otherwise(F.concat("part", F.lit("\n")))
    text = F.when(F.col("other"), F.regexp_replace("part", rf"[{P.LINE_ENDS}]+\z", "")).otherwise(F.col("part"))
    return each.select("diff_id", "line_no", full.alias("full"), text.alias("text"))


def other_ends(text: Column) -> Column:
    """Whether a text has terminators other than line feeds."""
    return reduce(lambda a, b: a | b, [text.contains(c) for c in P.OTHER_LINE_ENDS], text.rlike(P.OTHER_LINE_END))


def full_lines(text: Column, other: Column | None = None) -> Column:
    """The lines of a text with their terminators, as an array; an empty text may be behind the last. other: other_ends(), if it is known."""
    return F.when(other_ends(text) if other is None else other, F.regexp_extract_all(text, F.lit(P.LINE), F.lit(0))).otherwise(F.split(text, r"(?<=\n)"))


def _so_far(by: str = "diff_id"):
    return Window.partitionBy(by).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def needed(in_hunk: Column, text: Column | None = None) -> Column:
    """Whether a reviewer needs a line: file headers, hunk headers and what follows these up to the next file."""
    t = F.col("text") if text is None else text
    header = t.startswith("--- ") | t.startswith("+++ ")
    return t.startswith("diff --git") | header | t.startswith("@@") | (in_hunk & F.substring(t, 1, 1).isin("+", "-", " ", "\\"))


def _in_hunk() -> Column:
    t = F.col("text")
    state = F.last(F.when(t.startswith("diff --git"), False).when(t.startswith("@@"), True), ignorenulls=True).over(_so_far())
    return F.coalesce(state, F.lit(False))


def located(all_lines: DataFrame, strict: bool = False) -> DataFrame:
    """What hunk_lines(), file_lines() and metadata_findings() tell of each line, by one window: kept, file_no, path, reason and
    binary of the lines that are kept or have a reason. A file's header is always kept, so its number is the same among all lines.
    """
    head = is_header(F.col("text"), strict)
    path = F.last(F.when(head, path_of(F.col("text"), strict)), ignorenulls=True).over(_so_far())
    marked = all_lines.select("*", _in_hunk().alias("in_hunk"), F.sum(head.cast("int")).over(_so_far()).alias("file_no"), path.alias("path"), *metadata_reason())
    return marked.withColumn("kept", needed(F.col("in_hunk"))).where("kept OR reason IS NOT NULL").drop("in_hunk")


def hunk_lines(all_lines: DataFrame) -> DataFrame:
    """The lines that a reviewer needs: file headers, hunk headers and what follows these up to the next file."""
    return all_lines.withColumn("in_hunk", _in_hunk()).where(needed(F.col("in_hunk"))).drop("in_hunk")


def hunks(kept: DataFrame) -> DataFrame:
    """diff_id, hunks: the text of the kept lines."""
    return kept.groupBy("diff_id").agg(joined(F.col("full")).alias("hunks"))


def joined(text: Column, order: str = "line_no") -> Column:
    """Texts of a group in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), text.alias("x")))), lambda s: s["x"]), "")


def is_header(text: Column, strict: bool = False) -> Column:
    """Whether a line begins a file. strict: also if its paths are in quotes, as those of names beyond ASCII are; else such a file belongs to the one before."""
    return text.startswith("diff --git ") & text.rlike(P.QUOTED_HEADER if strict else P.HEADER)


def path_of(header: Column, strict: bool = False) -> Column:
    if strict:
        q = [F.regexp_extract(header, P.QUOTED_HEADER, i) for i in (1, 2, 3, 4)]
        a, b = (F.concat(C.unquoted(q[i]), q[i + 1]) for i in (0, 2))
    else:
        a, b = (F.regexp_extract(header, P.HEADER, i) for i in (1, 2))
    return F.coalesce(F.nullif(b, F.lit("")), F.nullif(a, F.lit("")), F.lit("unknown"))


def file_lines(kept: DataFrame, strict: bool = False) -> DataFrame:
    """Kept lines with file_no (from 1; 0 before the first header) and the file's path."""
    head = is_header(F.col("text"), strict)
    numbered = kept.withColumn("file_no", F.sum(head.cast("int")).over(_so_far()))
    return numbered.withColumn("path", F.last(F.when(head, path_of(F.col("text"), strict)), ignorenulls=True).over(_so_far()))


def files(kept: DataFrame, strict: bool = False) -> DataFrame:
    """diff_id, file_no, path, file_diff and added (its added lines, joined by line feeds).

    A diff with hunks but no header is one file named unknown.
    """
    return files_of(file_lines(kept, strict))


def files_of(numbered: DataFrame) -> DataFrame:
    """files() of what file_lines() gives. Where the lines know how many headers their diff has (n_files), no task sees a whole diff."""
    headless = (F.col("n_files") if "n_files" in numbered.columns else F.max("file_no").over(Window.partitionBy("diff_id"))) == 0
    own = numbered.withColumns({"path": F.when(headless, F.lit("unknown")).otherwise(F.col("path")), "headless": headless}).where("file_no > 0 OR headless")
    # A line is collected once: its text, and what ends it.
    own = own.select("diff_id", "file_no", "path", F.struct("line_no", "text", ending().alias("end")).alias("line"), C.is_added(F.col("text")).alias("is_added"))
    every = F.array_sort(F.collect_list("line"))
    text = F.array_join(F.transform(every, lambda s: F.concat(s["text"], s["end"])), "")
    added = F.array_join(F.transform(F.filter(every, lambda s: C.is_added(s["text"])), lambda s: s["text"]), "\n")
    return own.groupBy("diff_id", "file_no", "path").agg(text.alias("file_diff"), added.alias("added"), F.count_if("is_added").alias("added_lines"))


def _bare(line: Column) -> Column:
    """A line without its terminator."""
    return F.rtrim(line, F.lit(P.ENDS))


def files_in_rows(diffs: DataFrame, column: str = "clean") -> DataFrame:
    """What located() and files_of() tell of lines(), by functions of a diff's row: no row for a line, no window, and nothing moves.

    A row for each file, one for what is before the first, and at least one for a diff; other columns of diffs stay. at is 0 in the first
    row of a diff; is_file: whether files() has it; path, file_diff, added, added_lines: as there; told: line_no, reason, binary of its lines;
    locked: line_no, line of the added lines of a lockfile that a rule may be about. Paths in quotes begin no file.
    """
    rest = [c for c in diffs.columns if c not in ("diff_id", "raw", column)]
    split = diffs.select("diff_id", *rest, other_ends(F.col(column)).alias("other"), F.split(F.col(column), P.FILE_CUT).alias("parts"))
    headed = F.coalesce(F.col("parts")[0].rlike(rf"\A{P.FILE_START}"), F.lit(False))
    each = split.select("diff_id", *rest, "other", headed.alias("headed"), F.size("parts").alias("n"), F.posexplode_outer("parts").alias("at", "part"))
    each = each.withColumns({"at": F.coalesce("at", F.lit(0)), "file_no": (F.coalesce("at", F.lit(0)) + F.col("headed").cast("int")).cast("bigint")})
    path = F.when(F.col("file_no") > 0, path_of(F.regexp_extract("part", rf"^[^{P.LINE_ENDS}]*", 0))).otherwise("unknown")
    # A piece begins with a file's header or a hunk's, so all of it is in a hunk or none is.
    own = lambda piece: F.filter(full_lines(piece, F.col("other")), lambda x: needed(piece.startswith("@@"), x))
    each = each.withColumns({"path": path, "kept": F.flatten(F.transform(F.split("part", P.HUNK_CUT), own))})

    number = lambda i: F.col("at").cast("bigint") * F.lit(1 << 32) + i
    words = ("new file mode ", "new mode ", "Binary files ", "GIT binary patch")
    some = lambda found: reduce(lambda a, b: a | b, [found(w) for w in words])
    marked = F.filter(F.transform(full_lines(F.col("part"), F.col("other")), lambda x, i: F.struct(number(i).alias("line_no"), x.alias("x"))), lambda s: some(s["x"].startswith))
    reasons = F.filter(F.transform(marked, lambda s: F.struct(s["line_no"].alias("line_no"), *metadata_reason(_bare(s["x"])))), lambda s: s["reason"].isNotNull())
    told = F.when(some(F.col("part").contains), reasons)
    ruled = lambda s: C.is_added(s["line"]) & (s["line"].rlike(P.URL) | C.is_off_registry(s["line"]))
    numbered = F.filter(F.transform("kept", lambda x, i: F.struct(number(i).alias("line_no"), _bare(x).alias("line"))), ruled)
    locked = F.when(C.is_lockfile(F.col("path")), F.transform(numbered, lambda s: F.struct(s["line_no"].alias("line_no"), s["line"].substr(F.lit(2), F.length(s["line"])).alias("line"))))
    plus = F.filter("kept", C.is_added)
    is_file = (F.col("file_no") > 0) | (~F.col("headed") & (F.col("n") == 1) & (F.size("kept") > 0))
    return each.select(
        "diff_id", *rest, "at", "file_no", "path", F.coalesce(is_file, F.lit(False)).alias("is_file"), F.array_join("kept", "").alias("file_diff"),
        F.array_join(F.transform(plus, _bare), "\n").alias("added"), F.size(plus).cast("bigint").alias("added_lines"), told.alias("told"), locked.alias("locked"),
    )


def ending() -> Column:
    """What ends a line: full is its text and this."""
    return F.substring("full", F.length("text") + 1, F.length("full"))


def added_lines(kept: DataFrame, strict: bool = False) -> DataFrame:
    """diff_id, file_no, path, line_no, line: added text without its plus sign."""
    return added_of(file_lines(kept, strict))


def added_of(numbered: DataFrame) -> DataFrame:
    """added_lines() of what file_lines() gives."""
    return numbered.where(C.is_added(F.col("text"))).select("diff_id", "file_no", "path", "line_no", F.expr("substring(text, 2)").alias("line"))


NEW_EXECUTABLE = "New file is executable (mode 100755)."
MADE_EXECUTABLE = "File mode changed to executable (100755) without a change of content."
BINARY = "Binary content changed; its bytes can't be reviewed as text."


def metadata_reason(text: Column | None = None) -> tuple[Column, Column]:
    """What a line's text tells as metadata: reason (null: nothing) and binary."""
    t = F.col("text") if text is None else text
    end = F.regexp_replace(t, r"(?U)\s+\z", "")
    binary = t.startswith("Binary files ") | t.startswith("GIT binary patch")
    reason = F.when(t.startswith("new file mode ") & end.endswith("755"), NEW_EXECUTABLE).when(t.startswith("new mode ") & end.endswith("755"), MADE_EXECUTABLE).when(binary, BINARY)
    return reason.alias("reason"), binary.alias("binary")


def metadata_findings(all_lines: DataFrame, strict: bool = False) -> DataFrame:
    """diff_id, line_no, file, reason, binary: what mode and binary lines of the unfiltered diff tell."""
    path = F.last(F.when(is_header(F.col("text"), strict), path_of(F.col("text"), strict)), ignorenulls=True).over(_so_far())
    return all_lines.select("diff_id", "line_no", F.coalesce(path, F.lit("unknown")).alias("file"), *metadata_reason()).where("reason IS NOT NULL")


def trim_context(all_lines: DataFrame, context: int = 1, only: Column | None = None) -> DataFrame:
    """Without context lines that are more than so many lines away from a change: what a diff with less context has. only: which lines this is for."""
    near = Window.partitionBy("diff_id").orderBy("line_no").rowsBetween(-context, context)
    changed = F.col("text").startswith("+") | F.col("text").startswith("-")
    stays = F.col("near") | ~F.col("text").startswith(" ")
    return all_lines.withColumn("near", F.max(changed).over(near)).where(stays if only is None else stays | ~only).drop("near")
