"""Lines of diffs of any size: states of a whole diff without a task that sees a whole diff.

A line table has diff_id, block, line_no, full and text. A block is a stretch of neighbouring lines, and both numbers grow along
the diff. What a line's place in a diff means (inside a hunk, in which file) is a fold over all lines before it, whose steps are
associative: the last value that isn't null, or a sum. So each block folds its own lines, folds of blocks are folded over
stretches of blocks and those over the diff, and what came before is handed back down. A window never spans more than
a block's lines, FANOUT blocks, or a diff's stretches of FANOUT blocks; only the folds leave their block, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from . import parse

FANOUT = 4096
#: A state's fold and the value that a line adds to it.
State = tuple[str, Column]


def last(value: Column) -> State:
    """The last value so far that isn't null."""
    return "last", value


def total(value: Column) -> State:
    """The sum so far; lines that add nothing are null."""
    return "sum", value


def _over(kind: str, value: Column, window) -> Column:
    return (F.sum(value) if kind == "sum" else F.last(value, ignorenulls=True)).over(window)


def _folded(kind: str, value: Column, order: str) -> Column:
    """The fold of a group, the same in any order of its rows."""
    return F.sum(value) if kind == "sum" else F.max_by(F.when(value.isNotNull(), value), F.when(value.isNotNull(), F.col(order)))


def _after(kind: str, before: Column, own: Column) -> Column:
    return F.coalesce(before, F.lit(0)) + F.coalesce(own, F.lit(0)) if kind == "sum" else F.coalesce(own, before)


def carry(lines: DataFrame, states: dict[str, State], order: str = "line_no", by: str = "diff_id") -> DataFrame:
    """lines with a column for each state: its fold over all lines of the diff up to this one; a column `<name>_all` for each sum has that of the whole diff."""
    own = list(lines.columns)
    kinds = {name: kind for name, (kind, _) in states.items()}
    sums = [n for n, kind in kinds.items() if kind == "sum"]
    sofar = (Window.unboundedPreceding, 0)
    before = (Window.unboundedPreceding, -1)

    blocks = lines.groupBy(by, "block").agg(*(_folded(kind, value, order).alias(name) for name, (kind, value) in states.items()))
    blocks = blocks.withColumn("stretch", F.floor(F.col("block") / FANOUT))
    # Every stretch has its row above; a left join says nothing of the blocks' keys, so both branches fold the same lines, and do so once.
    stretches = blocks.groupBy(by, "stretch").agg(*(_folded(kind, F.col(n), "block").alias(n) for n, kind in kinds.items()))
    over_diff = Window.partitionBy(by).orderBy("stretch").rowsBetween(*before)
    above = stretches.select(by, "stretch", *(_over(kind, F.col(n), over_diff).alias(f"{n}_above") for n, kind in kinds.items()), *(F.sum(n).over(Window.partitionBy(by)).alias(f"{n}_all") for n in sums))
    over_stretch = Window.partitionBy(by, "stretch").orderBy("block").rowsBetween(*before)
    within = blocks.select(by, "stretch", "block", *(_over(kind, F.col(n), over_stretch).alias(n) for n, kind in kinds.items()))
    handed = within.join(above, [by, "stretch"], "left").select(by, "block", *(_after(kind, F.col(f"{n}_above"), F.col(n)).alias(f"{n}_before") for n, kind in kinds.items()), *(f"{n}_all" for n in sums))

    over_block = Window.partitionBy(by, "block").orderBy(order).rowsBetween(*sofar)
    local = lines.select("*", *(_over(kind, value, over_block).alias(f"{n}_own") for n, (kind, value) in states.items()))
    joined = local.join(handed, [by, "block"])
    return joined.select(*own, *(_after(kind, F.col(f"{n}_before"), F.col(f"{n}_own")).alias(n) for n, kind in kinds.items()), *(F.coalesce(f"{n}_all", F.lit(0)).alias(f"{n}_all") for n in sums))


def located(lines: DataFrame, strict: bool = False) -> DataFrame:
    """lines with in_hunk, file_no (from 1; 0 before the first header), path, and how many headers the diff has (n_files). strict: as parse.is_header."""
    t = F.col("text")
    starts, head, at = t.startswith("diff --git"), parse.is_header(t, strict), t.startswith("@@")
    states = {"in_hunk": last(F.when(starts, False).when(at, True)), "file_no": total(F.when(head, 1)), "path": last(F.when(head, parse.path_of(t, strict)))}
    return carry(lines, states).withColumnRenamed("file_no_all", "n_files")


def marked(lines: DataFrame, strict: bool = False) -> DataFrame:
    """What a review takes from lines, as parse.located has it, and n_files."""
    told = located(lines, strict).select("*", *parse.metadata_reason())
    return told.withColumn("kept", parse.needed(F.coalesce("in_hunk", F.lit(False)))).where("kept OR reason IS NOT NULL").drop("in_hunk")


def hunk_lines(placed: DataFrame) -> DataFrame:
    """The lines that a reviewer needs, of located() lines: as parse.hunk_lines."""
    return placed.where(parse.needed(F.coalesce("in_hunk", F.lit(False))))


def file_lines(kept: DataFrame) -> DataFrame:
    """Kept lines of files: those of a diff with hunks but no header are one file named unknown."""
    return kept.withColumn("path", F.when(F.col("n_files") == 0, F.lit("unknown")).otherwise(F.col("path"))).where("file_no > 0 OR n_files = 0")


def files(kept: DataFrame) -> DataFrame:
    """diff_id, file_no, path, file_diff, added, added_lines: as parse.files. A group is one file of a diff."""
    t, order = F.col("text"), F.struct("block", "line_no")
    listed = lambda value: F.transform(F.array_sort(F.collect_list(value)), lambda s: s["x"])
    text = F.array_join(listed(F.struct(order.alias("at"), F.col("full").alias("x"))), "")
    added = F.array_join(listed(F.when(C.is_added(t), F.struct(order.alias("at"), t.alias("x")))), "\n")
    return file_lines(kept).groupBy("diff_id", "file_no", "path").agg(text.alias("file_diff"), added.alias("added"), F.count_if(C.is_added(t)).alias("added_lines"))


def file_sizes(kept: DataFrame) -> DataFrame:
    """diff_id, file_no, path, n_lines, n_chars, added_lines: what ranks and packs files, without their texts, so a file may be larger than a task too."""
    return file_lines(kept).groupBy("diff_id", "file_no", "path").agg(F.count("*").alias("n_lines"), F.sum(F.length("full")).alias("n_chars"), F.count_if(C.is_added(F.col("text"))).alias("added_lines"))


def metadata_findings(placed: DataFrame) -> DataFrame:
    """diff_id, block, line_no, file, reason, binary: as parse.metadata_findings."""
    return placed.select("diff_id", "block", "line_no", F.coalesce("path", F.lit("unknown")).alias("file"), *parse.metadata_reason()).where("reason IS NOT NULL")
