"""Evaluation: confusion matrix, perturbations, and leakage of samples into a rubric."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import patterns as P
from ..sources import shared
from . import grams, parse


def confusion(judged: DataFrame) -> DataFrame:
    """judged: expected (boolean), verdict. One row: tp, fp, tn, fn, n, precision, recall, accuracy; a share of nothing is 0."""
    flagged = F.col("verdict") != "pass"
    n = lambda c, name: F.count_if(c).alias(name)
    m = judged.agg(n(F.col("expected") & flagged, "tp"), n(~F.col("expected") & flagged, "fp"), n(~F.col("expected") & ~flagged, "tn"), n(F.col("expected") & ~flagged, "fn"), F.count("*").alias("n"))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return m.select("*", share(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), share(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), share(F.col("tp") + F.col("tn"), F.col("n")).alias("accuracy"))


def common_identifier(lines: DataFrame) -> DataFrame:
    """lines: diff_id, line_no, line (added text). diff_id and identifier: the most frequent one that isn't a keyword, ties to the first met."""
    met = lines.select("diff_id", "line_no", F.posexplode(F.regexp_extract_all("line", F.lit(P.IDENTIFIER), F.lit(0))).alias("at", "identifier"))
    first = F.col("line_no").cast("bigint") * F.lit(1 << 32) + F.col("at")  # one number, or the groups are made by sorting all that is met
    counted = met.where(~F.lower("identifier").isin(P.KEYWORDS_OF_LANGUAGES)).groupBy("diff_id", "identifier").agg(F.count("*").alias("n"), F.min(first).alias("first"))
    best = F.row_number().over(Window.partitionBy("diff_id").orderBy(F.desc("n"), "first"))
    return counted.withColumn("r", best).where("r = 1").select("diff_id", "identifier", F.col("n").cast("bigint").alias("n"))


def _apart(diffs: DataFrame) -> DataFrame:
    """diffs with lines (each with its terminator) and marks: a character for each line, @ for a hunk's header, g for a file's. Lines stay in their diff's row."""
    split = diffs.withColumn("lines", parse.full_lines(F.col("raw")))
    return split.withColumn("marks", F.array_join(F.transform("lines", lambda x: F.when(x.startswith("@@"), "@").when(x.startswith("diff --git"), "g").otherwise(".")), ""))


def _named(diffs: DataFrame) -> DataFrame:
    """diffs with identifier, the most common one of added lines."""
    lines = parse.lines(diffs, "raw")
    added = lines.where(C.is_added(F.col("text"))).select("diff_id", "line_no", F.expr("substring(text, 2)").alias("line"))
    return diffs.join(common_identifier(added).select("diff_id", "identifier"), "diff_id", "left")


def _renamed() -> Column:
    word, new = F.concat(F.lit(r"(?U)\b\Q"), F.col("identifier"), F.lit(r"\E\b")), F.concat(F.col("identifier"), F.lit("_v2"))
    content = lambda x: F.substring(x, 1, 1).isin("+", "-", " ") & ~x.startswith("+++") & ~x.startswith("---")
    return F.array_join(F.transform("lines", lambda x: F.when(content(x) & F.contains(x, F.col("identifier")), F.regexp_replace(x, word, new)).otherwise(x)), "")


def _blank() -> Column:
    return F.array_join(F.transform("lines", lambda x: F.when(x.startswith("@@"), F.concat(x, F.lit("+\n"))).otherwise(x)), "")


def _reordered() -> Column:
    """The lines before the first hunk, the second hunk, the first, the rest, if no file begins between the two."""
    before, one, two = (F.length(F.regexp_extract("marks", "^([^@]*)(@[^@g]*)(@[^@g]*)", i)) for i in (1, 2, 3))
    moved = F.concat(F.slice("lines", F.lit(1), before), F.slice("lines", before + one + 1, two), F.slice("lines", before + 1, one), F.slice("lines", before + one + two + 1, F.size("lines")))
    return F.when(two > 0, F.array_join(moved, "")).otherwise(F.col("raw"))


def rename(diffs: DataFrame) -> DataFrame:
    """diff_id, raw with the most common added identifier renamed in content lines."""
    return _apart(_named(diffs.where("raw <> ''"))).select("diff_id", _renamed().alias("raw"))


def blank_lines(diffs: DataFrame) -> DataFrame:
    """diff_id, raw with a blank added line after each hunk header."""
    return _apart(diffs.where("raw <> ''")).select("diff_id", _blank().alias("raw"))


def reorder(diffs: DataFrame) -> DataFrame:
    """diff_id, raw with the first two hunks swapped if they are neighbours in one file."""
    return _apart(diffs.where("raw <> ''")).select("diff_id", _reordered().alias("raw"))


PERTURBATIONS = {"rename": rename, "blank-line": blank_lines, "reorder": reorder}


def robustness(diffs: DataFrame, judge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """diff_id, perturbation, before, after, changed, for each variant that differs from the diff.

    judge: diffs to (diff_id, verdict); it is called once, for the diffs and all variants together. Variants are made when it reads them
    and are written nowhere; whose they are is told by their ids, which are made again of the diffs' ids alone.
    """
    diffs = diffs.where("diff_id IS NOT NULL")  # a join says so of what it adds identifiers from; so both of its sides are one exchange
    made = {"": F.col("raw"), "rename": _renamed(), "blank-line": _blank(), "reorder": _reordered()}
    variants = F.explode(F.array(*(F.struct(F.lit(name).alias("perturbation"), raw.alias("raw")) for name, raw in made.items()))).alias("v")
    every = _apart(_named(diffs.select("diff_id", "raw"))).select(F.col("diff_id").alias("of"), F.col("raw").alias("old"), variants)
    every = every.where("v.perturbation = '' OR v.raw <> old").select("of", "v.perturbation", "v.raw")
    key = F.xxhash64("of", "perturbation").alias("diff_id")
    names = diffs.select(F.col("diff_id").alias("of"), F.explode(F.array(*map(F.lit, made))).alias("perturbation")).select(key, "of", "perturbation")
    judged = names.join(judge(every.select(key, "raw")), "diff_id")
    before = judged.where("perturbation = ''").select("of", F.col("verdict").alias("before"))
    out = judged.where("perturbation <> ''").join(before, "of")
    return out.select(F.col("of").alias("diff_id"), "perturbation", "before", F.col("verdict").alias("after"), (F.col("before") != F.col("verdict")).alias("changed"))


def change_rate(changes: DataFrame, diffs: DataFrame) -> DataFrame:
    """One row: diffs, changed, rate: the share of diffs of which any variant flips the verdict."""
    flipped = changes.groupBy("diff_id").agg(F.bool_or("changed").alias("changed"))
    return diffs.select("diff_id").join(flipped, "diff_id", "left").agg(F.count("*").alias("diffs"), F.count_if("changed").alias("changed")).withColumn("rate", F.coalesce(F.try_divide("changed", "diffs"), F.lit(0.0)))


def distinctive(text: Column) -> Column:
    return F.filter(C.tokens(text), lambda t: (F.length(t) >= P.MIN_TOKEN) & ~t.isin(P.GENERIC_TOKENS))


def contaminated_by(samples: DataFrame, prompt: DataFrame) -> DataFrame:
    """samples: id, name (of any length); prompt: part (a whole number), prompt: a text of any size in rows. As contaminated(), with each
    token looked up once in an index of the prompt, whatever the number of samples that have it. Distinct tokens are found when this is
    called, and are a table in the shared folder from then on.
    """
    own = samples.select("id", F.explode(distinctive(F.col("name"))).alias("t"))
    tokens = shared.cut(own.select("t").distinct())  # several joins read them
    hits = grams.contained(tokens, prompt, P.MIN_TOKEN, "part", "prompt")
    met = own.join(hits, "t").groupBy("id").agg(F.array_sort(F.collect_set("t")).alias("overlap"))
    joined = samples.select("id").join(met, "id", "left").withColumn("overlap", F.coalesce("overlap", F.array().cast("array<string>")))
    return joined.withColumn("contaminated", F.size("overlap") > 0)


def contaminated(samples: DataFrame, prompt: Column) -> DataFrame:
    """samples: name, and any column that prompt takes. name, overlap (sorted) and contaminated: distinctive tokens of the name that the prompt has."""
    own = distinctive(F.col("name"))
    plain = C.collapse(prompt)
    overlap = F.array_sort(F.filter(own, lambda t: F.contains(plain, t)))
    return samples.select("*", overlap.alias("overlap")).withColumn("contaminated", F.size("overlap") > 0)
