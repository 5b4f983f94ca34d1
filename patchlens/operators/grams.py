"""Which of many tokens occur in a text of any size: an index of the text's grams, and joins on equal grams.

The text comes in rows and a token may begin in one and end in another. So rows are placed on the whole text by folding the
lengths before them, and the text is cut anew into stretches that overlap by a gram less one character.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from . import blocks

GRAM = 8
STRETCH = 4096


def stretches(text: DataFrame, order: str = "part", column: str = "text") -> DataFrame:
    """start, plain: the collapsed text of all rows in order of a whole number, cut into stretches of STRETCH characters and the GRAM - 1 behind these."""
    rows = text.select(F.lit(0).alias("diff_id"), F.floor(F.col(order) / 1024).alias("block"), F.col(order).alias("part"), C.collapse(F.col(column)).alias("x"))
    placed = blocks.carry(rows.where("length(x) > 0"), {"end": blocks.total(F.length("x").cast("bigint"))}, "part")
    own = placed.withColumn("at", F.col("end") - F.length("x"))
    first, final = F.floor((F.greatest(F.col("at") - (GRAM - 1), F.lit(0))) / STRETCH), F.floor((F.col("end") - 1) / STRETCH)
    cut = own.select("at", "x", F.explode(F.sequence(first, final)).alias("n")).withColumn("start", F.col("n") * STRETCH)
    low = F.greatest(F.col("start"), F.col("at"))  # where the row's part of the stretch begins
    high = F.least(F.col("start") + STRETCH + GRAM - 1, F.col("at") + F.length("x"))
    piece = F.substring(F.col("x"), (low - F.col("at") + 1).cast("int"), (high - low).cast("int"))
    pieces = cut.select("start", low.alias("low"), piece.alias("piece")).where("length(piece) > 0")
    return pieces.groupBy("start").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("low", "piece"))), lambda s: s["piece"]), "").alias("plain"))


def postings(cut: DataFrame) -> DataFrame:
    """gram, at: what stands at each place of the text, GRAM characters or as many as are left."""
    places = F.sequence(F.lit(1), F.least(F.length("plain"), F.lit(STRETCH)))
    return cut.select("start", "plain", F.explode(places).alias("i")).select(F.expr(f"substring(plain, i, {GRAM})").alias("gram"), (F.col("start") + F.col("i") - 1).alias("at"))


def _grams(token: Column) -> Column:
    """Offsets (from 0) of grams that cover a token longer than a gram: each GRAM characters, and the last."""
    return F.array_distinct(F.concat(F.sequence(F.lit(0), F.length(token) - GRAM, F.lit(GRAM)), F.array(F.length(token) - GRAM)))


def contained(tokens: DataFrame, text: DataFrame, least: int, order: str = "part", column: str = "text") -> DataFrame:
    """Those of tokens (t: letters a-z and digits, at least `least` of them, each once) that the collapsed text of all rows contains.

    A token of up to GRAM characters is looked up among the beginnings of all grams. A longer one needs all its grams, and then all of them
    at one place; tokens of which a gram is nowhere in the text are gone before places are compared.
    """
    found = postings(stretches(text, order, column))
    known = found.select("gram").distinct()
    beginnings = known.select(F.explode(F.transform(F.sequence(F.lit(least), F.lit(GRAM)), lambda n: F.when(F.length("gram") >= n, F.substring(F.col("gram"), F.lit(1), n)))).alias("t")).where("t IS NOT NULL").distinct()
    short = tokens.where(F.length("t") <= GRAM).join(beginnings, "t", "left_semi")
    parts = tokens.where(F.length("t") > GRAM).select("t", F.explode(_grams(F.col("t"))).alias("offset")).select("t", "offset", F.expr(f"substring(t, offset + 1, {GRAM})").alias("gram"))
    needed = F.ceil(F.length("t") / GRAM)
    likely = parts.join(known, "gram", "left_semi").groupBy("t").agg(F.count("*").alias("n")).where(F.col("n") == needed)
    at = parts.join(likely.select("t"), "t", "left_semi").join(found, "gram").groupBy("t", (F.col("at") - F.col("offset")).alias("place")).agg(F.count("*").alias("n"))
    return short.unionByName(at.where(F.col("n") == needed).select("t").distinct())
