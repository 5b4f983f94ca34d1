"""Document fingerprints by consistent weighted sampling, in DataFrame functions alone.

For each hash function k and each term of weight w (a word's count in the text) there are r ~ Gamma(2, 1), c ~ Gamma(2, 1)
and b ~ Uniform(0, 1), all functions of (term, k). With t = floor(ln w / r + b), the term's race time is
a = c exp(-r (t - b + 1)); the sample of k is the (term, t) of the least a. Two texts have equal samples with a probability
that equals their generalised Jaccard similarity: the sum over terms of the lesser weight by that of the greater.

The variates are quantiles of their distributions at the midpoints of GRID equal steps, looked up by bits of one hash of
(term, k); all terms share the grid, so it bears on no choice between terms of equal weight. A sample is a 64-bit integer: 32
bits of ln a in fixed point, then 32 bits of (term, t), so that a minimum over plain longs finds it within a hash
aggregation. Words are hashed once to 64 bits.

The next document in descending doc_id is found inside blocks: ranges of (doc_id, hash of the text) between boundaries from a
bounded sample of these keys, so blocks have about equal numbers of rows however the ids lie, and rows with a null or a
repeated doc_id are dealt out as well. A document's rows stay in the block's partition from the exchange of its text on:
counting its words and sampling need no further shuffle.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

HASHES = 64
#: Hash functions that are evaluated for a row at once: more would make generated code too large to be compiled.
AT_ONCE = 4
#: Blocks for each shuffle partition (fewer, down to two, beyond MANY_BLOCKS of them), and keys (24 bytes each) that the driver
#: sees for each block to set the boundaries.
BLOCKS, MANY_BLOCKS, SAMPLED = 16, 20_000, 32
#: log2 of the steps of the gamma variates' grid.
GRID = 12
#: ln a lies within +-64 for all weights below 2^31; it is kept in steps of 2^-24.
_SHIFT, _STEPS = 64.0, float(1 << 24)
#: In which of a row's two texts a term has the weight.
BOTH, OWN, EDITED = range(3)


def _gamma_quantile(u: float) -> float:
    """Of Gamma(2, 1): the x with 1 - (1 + x) exp(-x) = u, by bisection."""
    low, high = 0.0, 64.0
    for _ in range(80):
        mid = (low + high) / 2
        if -math.expm1(-mid) - mid * math.exp(-mid) < u:
            low = mid
        else:
            high = mid
    return high


_GAMMA = [_gamma_quantile((i + 0.5) / (1 << GRID)) for i in range(1 << GRID)]


def _table(numbers: list[float]) -> Column:
    """A constant array: the optimizer folds it once."""
    return F.split(F.lit(",".join(map(repr, numbers))), ",").cast("array<double>")


def _row_key(doc_id: Column, text: Column) -> Column:
    """Ascending in descending doc_id, nulls last; ties by a hash of the text."""
    return F.struct(doc_id.isNull().alias("n"), F.coalesce(F.bitwise_not(doc_id), F.lit(0)).alias("k"), F.xxhash64(text).alias("h"))


_KEY = "struct<n: boolean, k: bigint, h: bigint>"


def _keys(keys: list[tuple]) -> Column:
    return F.from_json(F.lit(json.dumps([{"n": n, "k": k, "h": h} for n, k, h in keys])), f"array<{_KEY}>")


def boundaries(keyed: DataFrame, blocks: int) -> list[tuple]:
    """At most blocks - 1 keys, in order, between which about equal numbers of rows lie. keyed: key. The same on every run.

    About SAMPLED * blocks distinct keys are seen, those whose hash is below a share of its range.
    """
    share = min(1.0, SAMPLED * blocks / max(1, keyed.count()))
    chosen = F.pmod(F.xxhash64("n", "k", "h"), F.lit(1 << 40)) < int(share * (1 << 40))
    keys = sorted(map(tuple, keyed.select("key.*").where(chosen).distinct().collect()))
    return sorted({keys[i * len(keys) // blocks] for i in range(1, blocks)}) if keys else []


def _block(key: Column, bounds: list[tuple]) -> Column:
    """How many bounds are not above key, by bisection."""
    if not bounds:
        return F.lit(0)
    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length()))
    start = F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high"))

    def step(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        right = (acc["low"] < acc["high"]) & (F.get(_keys(bounds), mid) <= key)
        return F.struct(F.when(right, mid + 1).otherwise(acc["low"]).alias("low"), F.when(right | (acc["low"] >= acc["high"]), acc["high"]).otherwise(mid).alias("high"))

    return F.aggregate(steps, start, step, lambda acc: acc["low"])


def with_next(docs: DataFrame, blocks: int | None = None) -> DataFrame:
    """block, at, doc_id, text, next_id and next_text: the next document in descending doc_id; after the last comes the first.

    The rows are partitioned by block, within which at is unique. Rows with the same doc_id follow each other in the order
    of their texts' hashes, rows with a null doc_id come last, and the next of the last row of all is the first. Rows that
    are equal in both are of one block.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = blocks or parts * max(2, min(BLOCKS, MANY_BLOCKS // parts))
    text = F.coalesce(docs["text"], F.lit(""))
    own = docs.select(_row_key(docs["doc_id"].cast("bigint"), text).alias("key"), text.alias("text"))
    bounds = boundaries(own, blocks)
    dealt = own.select(F.coalesce(_block(F.col("key"), bounds), F.lit(0)).alias("block"), F.lit(False).alias("foreign"), "key", "text")
    # One row for each block, of which there are no more than boundaries: the key of its first row. The block before gets that row as well.
    heads = sorted((r["block"], tuple(r["head"])) for r in dealt.groupBy("block").agg(F.min("key").alias("head")).collect())
    following = [(b, *heads[(i + 1) % len(heads)][1]) for i, (b, _) in enumerate(heads)]
    after = spark.createDataFrame(following, "block int, n boolean, k bigint, h bigint").select("block", F.struct("n", "k", "h").alias("key"))
    first = own.join(F.broadcast(after), "key").groupBy("block", "key").agg(F.min("text").alias("text"))
    every = dealt.unionByName(first.select(F.coalesce("block", F.lit(0)).alias("block"), F.lit(True).alias("foreign"), "key", "text"))
    # Ranges of blocks are as even as blocks are; hashed ones aren't. Whatever is read of the result, the exchange is the same one:
    # the key holds the doc_id.
    order = Window.partitionBy("block").orderBy("foreign", "key", "text")
    inside = every.repartitionByRange("block").withColumns({"at": F.row_number().over(order), "next": F.lead("key").over(order), "next_text": F.lead("text").over(order)})
    id_of = lambda k: F.when(~k["n"], F.bitwise_not(k["k"]))
    return inside.where(~F.col("foreign")).select("block", "at", id_of(F.col("key")).alias("doc_id"), "text", id_of(F.col("next")).alias("next_id"), "next_text")


def _samples(each: DataFrame) -> DataFrame:
    """each: block, at, which, k, h, lw (the logarithm of a weight). Columns s0.. with the samples of hash functions k, k + 1, ... of the term h.

    Each step is a projection of its own, so that nothing is computed twice and no generated method is too large.
    """
    n, mask, keys = range(AT_ONCE), (1 << GRID) - 1, ["block", "at", "which", "k", "h"]
    r_of, i_of, c_of = _table(_GAMMA), _table([1 / x for x in _GAMMA]), _table([math.log(x) for x in _GAMMA])
    of = lambda letters: [F.col(f"{v}{i}") for v in letters for i in n]
    bits = each.select(*keys, "lw", F.xxhash64("h", "k").alias("hk")).select(*keys, "lw", *[F.xxhash64("hk", F.lit(i)).alias(f"x{i}") for i in n])

    def drawn(i: int) -> list[Column]:
        x = F.col(f"x{i}")
        c = c_of[F.shiftright(x, 48).bitwiseAND(F.lit(mask)).cast("int")]
        return [F.shiftright(x, 32).bitwiseAND(F.lit(mask)).cast("int").alias(f"j{i}"), c.alias(f"c{i}"), ((x.bitwiseAND(F.lit(0xFFFFFFFF)).cast("double") + 0.5) / F.lit(float(1 << 32))).alias(f"b{i}")]

    def packed(i: int) -> Column:
        a = F.col(f"c{i}") - r_of[F.col(f"j{i}")] * (F.col(f"t{i}") - F.col(f"b{i}") + 1)
        term = F.col("h").bitwiseXOR(F.col(f"t{i}") * 0x9E3779B1).bitwiseAND(F.lit(0xFFFFFFFF))
        return F.shiftleft(((a + _SHIFT) * _STEPS).cast("bigint"), 32).bitwiseOR(term)

    got = bits.select(*keys, "lw", *[c for i in n for c in drawn(i)])
    step = lambda i: F.when(F.col("lw") > 0, F.floor(F.col("lw") * i_of[F.col(f"j{i}")] + F.col(f"b{i}"))).otherwise(F.lit(0).cast("bigint"))
    got = got.select(*keys, *of("jcb"), *[step(i).alias(f"t{i}") for i in n])
    return got.select("block", "at", "which", "k", *[packed(i).alias(f"s{i}") for i in n])


def sampled(rows: DataFrame, hashes: int = HASHES) -> DataFrame:
    """rows: block, at, own, edited (texts), partitioned by block. block, at, f and g: arrays of the samples of both texts (0 without words).

    A term that weighs the same in both texts, as most do, is sampled once for both.
    """
    texts = rows.select("block", "at", F.explode(F.array(F.struct(F.col("own").alias("text"), F.lit(1).cast("bigint").alias("n")), F.struct(F.col("edited").alias("text"), F.lit(1 << 32).alias("n")))).alias("t"))
    words = texts.select("block", "at", "t.n", F.explode(F.split("t.text", "[\\x20\\x09-\\x0D]+")).alias("word")).where("word <> ''")
    # Both counts of a term in one long: that of the own text below 2^32, that of the edited one above.
    counts = words.select("block", "at", "n", F.xxhash64("word").alias("h")).groupBy("block", "at", "h").agg(F.sum("n").alias("n"))
    terms = counts.select("block", "at", "h", F.col("n").bitwiseAND(F.lit(0xFFFFFFFF)).alias("x"), F.shiftright("n", 32).alias("y"))
    use = lambda which, w: F.struct(F.lit(which).alias("which"), F.col(w).alias("w"))
    uses = F.when(F.col("x") == F.col("y"), F.array(use(BOTH, "x"))).when(F.col("y") == 0, F.array(use(OWN, "x"))).when(F.col("x") == 0, F.array(use(EDITED, "y"))).otherwise(F.array(use(OWN, "x"), use(EDITED, "y")))
    weighed = terms.select("block", "at", "h", F.explode(uses).alias("u")).select("block", "at", "h", "u.which", F.coalesce(F.ln("u.w"), F.lit(0.0)).alias("lw"))
    each = weighed.select("*", F.explode(F.array(*[F.lit(k) for k in range(0, hashes, AT_ONCE)])).alias("k"))
    least = _samples(each).groupBy("block", "at", "which", "k").agg(*[F.min(f"s{i}").alias(f"s{i}") for i in range(AT_ONCE)])
    parts = least.groupBy("block", "at", "k").agg(*[F.min(F.when(F.col("which") != other, F.col(f"s{i}"))).alias(f"{n}{i}") for n, other in (("f", EDITED), ("g", OWN)) for i in range(AT_ONCE)])
    ints = {n: F.array(*[F.coalesce(F.col(f"{n}{i}").bitwiseAND(F.lit(0xFFFFFFFF)), F.lit(0)) for i in range(AT_ONCE)]) for n in "fg"}
    gathered = parts.groupBy("block", "at").agg(F.array_sort(F.collect_list(F.struct("k", ints["f"].alias("f"), ints["g"].alias("g")))).alias("all"))
    return gathered.select("block", "at", F.flatten("all.f").alias("f"), F.flatten("all.g").alias("g"))


def likeness(a: Column, b: Column, hashes: int = HASHES) -> Column:
    """The share of equal samples."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.lit(float(hashes))


def fingerprints(docs: DataFrame, hashes: int = HASHES) -> DataFrame:
    """For each row of docs (doc_id, text): its fingerprint, that of its edited text, and their likeness; and the likeness to the next document's.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by the first as many, or all, of the
    next document in descending doc_id. A null text is empty. Texts without words have the fingerprint of zeros, so they
    are alike, and unlike all others. A row's own text is next where no row has a doc_id. An empty table gives no rows.
    """
    rows = with_next(docs)
    half = F.floor(F.length("text") / 2).cast("int")
    rows = rows.select("block", "at", "doc_id", "next_id", F.col("text").alias("own"), F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half)).alias("edited"))
    meta = rows.select("block", "at", "doc_id", "next_id", F.length("own").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    zeros = F.array_repeat(F.lit(0).cast("bigint"), hashes)
    both = common.cut(meta.join(sampled(rows, hashes), ["block", "at"], "left").withColumns({"f": F.coalesce("f", zeros), "g": F.coalesce("g", zeros)}))
    following = both.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min_by("f", "at").alias("fn")).withColumnRenamed("doc_id", "next_id")
    text = lambda x: F.array_join(F.transform(x, lambda v: F.lpad(F.lower(F.hex(v)), 8, "0")), "")
    joined = both.join(following, "next_id", "left")
    return joined.select("doc_id", "n_chars", "edited_sha256", text("f").alias("fingerprint"), text("g").alias("edited_fingerprint"), likeness(F.col("f"), F.col("g"), hashes).alias("near_edited"), likeness(F.col("f"), F.coalesce("fn", "f"), hashes).alias("near_next"))
