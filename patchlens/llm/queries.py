"""The registered queries of this subpackage: each applies its operator to a whole table and derives the digest columns."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, common, cws, html, licenses, lm, mixing, neardup, order, packing, pii, quality, runs, toxicity


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances are rounded: their sums depend on the order of rows in the last bits."""
    judged = quality.judge(common.documents(spark, sf_dir))
    return judged.withColumns({c: F.round(c, 9) for c in ("char_distance", "word_distance")})


#: Of crc32(doc_id as text) modulo HELD_OUT_OF: the remainder whose labels aren't learned from.
TOXIC_HELD_OUT_OF, LM_HELD_OUT_OF, HELD_OUT = 4, 7, 2


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    """Learned from the labels of documents that aren't held out."""
    return toxicity.train(docs, labels.where(common.bucket(F.col("doc_id"), TOXIC_HELD_OUT_OF) != HELD_OUT))


def op6_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    scored = toxicity.score(docs, toxicity_model(docs, _labels(spark, sf_dir)))
    return scored.select("doc_id", (common.bucket(F.col("doc_id"), TOXIC_HELD_OUT_OF) == HELD_OUT).alias("held_out"), "score", "predicted")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, toxicity_model(docs, _labels(spark, sf_dir)))


def pii_key(spark: SparkSession) -> str:
    """The secret of pseudonyms: the setting spark.patchlens.pii.key, or the public example key where it is unset."""
    return spark.conf.get("spark.patchlens.pii.key", pii.KEY)


def without_pii(docs: DataFrame) -> DataFrame:
    """n_chars is that of the new text: an IPv4 address may have become longer or shorter."""
    told = common.free_name(docs, "pii")
    done = pii.pseudonymize(docs, pii_key(docs.sparkSession), told).drop(told)
    return done.withColumn("n_chars", F.length("text").cast(done.schema["n_chars"].dataType)) if "n_chars" in done.columns else done


def in_mixed_order(docs: DataFrame) -> DataFrame:
    """docs in the order of the slots that their sources' weights give them."""
    column = common.free_name(docs, "mix")
    return mixing.ordered(mixing.mix(docs, column=column), column)


def packed(docs: DataFrame) -> DataFrame:
    pieces = packing.pack(docs, _vocabulary("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_id")


def packed_in_mixed_order(docs: DataFrame) -> DataFrame:
    """Packed along the slots: files that are read again come in no order, but the slots follow from the rows alone, so they are found again.

    A partition is a range of slots, and sequence_id grows with it; inside, pieces change places within a window of packing.
    """
    return packed(in_mixed_order(docs.select("doc_id", "text", "source")))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(common.documents(spark, sf_dir))


def op9_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(common.documents(spark, sf_dir))


def op2_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cws.fingerprints(common.documents(spark, sf_dir))


def op3_feistel_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text with pseudonyms, and how many values of each kind were replaced."""
    done = pii.pseudonymize(common.documents(spark, sf_dir), pii_key(spark))

    def of(kind: str):
        replaced = F.filter("pii", lambda p: (p["kind"] == kind) & p["pseudonym"].isNotNull())
        return F.when(F.size("pii") > 0, F.size(replaced)).otherwise(0).cast("bigint").alias(f"n_{kind}")

    counts = [of(kind) for kind in pii.KINDS]
    return done.select("doc_id", "text", *counts)


def op5_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(common.documents(spark, sf_dir), LM_HELD_OUT_OF, HELD_OUT)


def op7_licence_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(common.documents(spark, sf_dir))
    names = F.array_sort(F.array_distinct("licences.licence"))
    return found.select("doc_id", F.size("licences").cast("bigint").alias("n_spans"), F.array_join(names, ",").alias("licence_names"), F.coalesce(F.array_max("licences.dice"), F.lit(0.0)).alias("best_dice"))


def op8_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = order.shards(*order.placed(common.documents(spark, sf_dir), _vocabulary("word_bpe_49k.json"))).select("shard", "first_slot", "stride", F.posexplode("slots").alias("i", "s"))
    return slots.select((F.col("first_slot") + F.col("i")).alias("slot"), "shard", (F.col("i") * F.col("stride")).alias("byte_offset"), F.col("s.number").alias("sequence"), F.col("s.n_tokens").alias("n_tokens"), F.col("s.crc32").alias("ids_crc32"))


#: Documents in a block of the registered mix.
MIX_BLOCK_DOCS = 8


def target_weights(docs: DataFrame) -> DataFrame:
    """source, weight: 1 to 7 by the digest of the source's name, whatever the number of its documents."""
    digest = F.md5(F.coalesce(F.col("source"), F.lit(mixing.NO_SOURCE)).cast("binary"))
    weight = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % 7 + 1
    return docs.select("source").distinct().select("source", weight.alias("weight"))


def op10_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "source")
    mixed = mixing.mix(docs, target_weights(docs), MIX_BLOCK_DOCS)
    return mixed.select("doc_id", "source", "mix.*")


def op11_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.length("text").cast("bigint"))


#: Centroids, rounds, and what is put before the ids whose digests choose the first centroids.
CENTROIDS, ROUNDS, CENTROID_SEED = 40, 5, "2"


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), CENTROIDS, ROUNDS, CENTROID_SEED)


def repeating(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words, of which those of every tenth document, by the digest of its id, repeat themselves from one place on."""
    digest = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if digest % 10 or not words:
        return words
    n, g = len(words), digest // 10
    first = g % n
    period = 1 + (n - first) // (3 + g % 8)
    return words[:first] + (words[first : first + period] * ((n - first) // period + 1))[: n - first]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.scan(common.documents(spark, sf_dir), repeating)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    best = found.withColumn("best", longest).withColumns({"start": -F.col("best.start"), "length": F.col("best.length"), "period": -F.col("best.period")})
    told = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.col("n_runs") > 0, F.concat(told, F.lit("\n"))).otherwise("")
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return best.select("doc_id", "n_runs", "start", "length", "period", F.expr("1000 * length div period").alias("exponent_milli"), sha(lines).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"))


QUERIES = {
    "op1_quality_divergence": op1_quality_divergence,
    "op5_deleted_interpolation": op5_deleted_interpolation,
    "op6_toxicity_fm": op6_toxicity_fm,
    "op2_weighted_sampling": op2_weighted_sampling,
    "op3_feistel_pii": op3_feistel_pii,
    "op4_packing": op4_packing,
    "op7_licence_dice": op7_licence_dice,
    "op8_training_order": op8_training_order,
    "op9_minhash_neardup": op9_minhash_neardup,
    "op10_pfair_mixing": op10_pfair_mixing,
    "op11_site_templates": op11_site_templates,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_periodic_runs": op13_periodic_runs,
}

#: Near-duplicates on exact sets: all pairs that share a shingle, and what can be reached over links.
_OP9 = r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 4], ' ') END AS sh FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM w UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, m.c = w.doc_id AS kept FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m USING (doc_id)"""

_CLASSES = ("[a-z]", "[A-Z]", "[0-9]", " ", "\\n", r"[.,;:!?''-]", r"[()\[\]{}\"]", r"[#*$%&|<>@\\^_`~+=/]")
_LISTED = ", ".join(f"('{k}', {i}, '{w}')" for k, words in quality.COMMON_WORDS.items() for i, w in enumerate(words))
_JS = """sqrt(least(1, greatest(0, (list_sum(list_transform({p}, lambda x, i: CASE WHEN x > 0 THEN x * log2(2 * x / (x + {q}[i])) ELSE 0 END))
      + list_sum(list_transform({q}, lambda x, i: CASE WHEN x > 0 THEN x * log2(2 * x / (x + {p}[i])) ELSE 0 END))) / 2)))"""

#: Quality: counts from words, lines and windows of the text; histograms, mean histograms of each language, distances.
_OP1 = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, CASE WHEN lang IN ({", ".join(f"'{k}'" for k in quality.COMMON_WORDS)}) THEN lang ELSE 'other' END AS l FROM documents),
w AS (SELECT *, length(text) AS n_chars, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS place FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM win) WHERE n > 1) GROUP BY doc_id),
base AS (SELECT w.doc_id, l, n_chars, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars, n_chars - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
  [{", ".join(f"n_chars - length(regexp_replace(text, '{c}', '', 'g'))" for c in _CLASSES)}] AS classes, n_chars - length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) AS beyond
  FROM w LEFT JOIN rep USING (doc_id)),
hc AS (SELECT *, list_transform(classes || [n_chars - list_sum(classes) - beyond] || [beyond], lambda x: x / n_chars) AS p FROM base),
tok AS (SELECT doc_id, t, count(*) AS n FROM (SELECT doc_id, unnest(list_transform(ws, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS t FROM w) GROUP BY ALL),
listed AS (SELECT * FROM (VALUES {_LISTED}) v(k, i, word)),
hits AS (SELECT doc_id, k, i, sum(n) AS n FROM tok JOIN (SELECT k, i, unnest([word, word || ',', word || '.']) AS t FROM listed) USING (t) GROUP BY ALL),
hl AS (SELECT b.doc_id, c.k, any_value(b.n_words) AS n_words, list(coalesce(h.n, 0) ORDER BY c.i) AS x FROM base b CROSS JOIN listed c LEFT JOIN hits h ON h.doc_id = b.doc_id AND h.k = c.k AND h.i = c.i GROUP BY b.doc_id, c.k),
hw AS (SELECT doc_id, k, list_transform(x || [n_words - list_sum(x)], lambda y: y / n_words) AS p FROM hl),
good AS (SELECT hc.doc_id, l FROM hc JOIN (SELECT doc_id, count(*) AS n FROM tok GROUP BY doc_id) t USING (doc_id) WHERE n_chars >= {quality.MIN_CHARS} AND n_words >= {quality.MIN_COMMON_WORDS} AND n >= {quality.DISTINCT_PER_ROOT} * sqrt(n_words)),
rc AS (SELECT l, list(m ORDER BY i) AS q FROM (SELECT good.l, i, avg(x) AS m FROM good JOIN (SELECT doc_id, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM hc) USING (doc_id) GROUP BY ALL) GROUP BY l),
rw AS (SELECT l, list(m ORDER BY i) AS q FROM (SELECT good.l, i, avg(x) AS m FROM good JOIN (SELECT doc_id, k, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM hw) h ON h.doc_id = good.doc_id AND h.k = good.l GROUP BY ALL) GROUP BY l),
far AS (SELECT hc.doc_id, CASE WHEN n_chars >= {quality.MIN_CHARS} THEN {_JS.format(p="hc.p", q="rc.q")} END AS c, CASE WHEN n_words >= {quality.MIN_COMMON_WORDS} THEN {_JS.format(p="hw.p", q="rw.q")} END AS f
  FROM hc JOIN rc ON rc.l = hc.l OR hc.l = 'other' OR hc.l NOT IN (SELECT l FROM rc) LEFT JOIN rw ON rw.l = rc.l LEFT JOIN hw ON hw.doc_id = hc.doc_id AND hw.k = rc.l),
near AS (SELECT doc_id, c, f FROM far QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(c, 0) + coalesce(f, 0)) = 1),
told AS (SELECT b.*, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEATED_PERCENT} * n_words AS base_failed, c, f FROM base b LEFT JOIN near USING (doc_id))
SELECT doc_id, n_words, word_chars::bigint AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(c, 0) <= {quality.MAX_CHAR_DISTANCE} AND coalesce(f, 0) <= {quality.MAX_WORD_DISTANCE} AS kept,
  CASE WHEN NOT base_failed THEN round(c, 9) END AS char_distance, CASE WHEN NOT base_failed THEN round(f, 9) END AS word_distance FROM told"""

#: Pfair mixing: up to the horizon, a slot for each round of the recursion, which holds how many blocks of each source are done and picks the
#: released one with the earliest deadline; after it, blocks by deadline.
_OP10 = f"""WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(source, '{mixing.NO_SOURCE}') AS s, ('0x' || substr(md5('1 ' || coalesce(doc_id::varchar, '')), 1, 15))::bigint AS o FROM documents),
n AS MATERIALIZED (SELECT s, row_number() OVER (ORDER BY s) AS i, ('0x' || substr(md5(s), 1, 8))::bigint % 7 + 1 AS w, (count(*) + {MIX_BLOCK_DOCS - 1}) // {MIX_BLOCK_DOCS} AS blocks FROM d GROUP BY s),
t AS MATERIALIZED (SELECT list(w ORDER BY i) AS ws, sum(w)::bigint AS total FROM n),
h AS MATERIALIZED (SELECT min(blocks * total // w) AS horizon FROM n, t),
r AS (SELECT 0::bigint AS slot, list_transform(ws, lambda w: 0::bigint) AS done, list_min(list_transform(ws, lambda w, i: {{'deadline': (total + w - 1) // w, 'i': i}})).i AS pick FROM t
  UNION ALL SELECT slot, done, list_min(list_filter(list_transform(ws, lambda w, i: {{'deadline': ((done[i] + 1) * total + w - 1) // w, 'i': i, 'release': done[i] * total // w}}), lambda x: x.release <= slot)).i
    FROM (SELECT slot + 1 AS slot, list_transform(done, lambda x, i: x + (i = pick)::bigint) AS done FROM r), t, h WHERE slot < horizon),
b AS (SELECT s, i, k, k * total // w AS release, ((k + 1) * total + w - 1) // w AS deadline FROM (SELECT s, i, w, total, unnest(range(0, blocks)) AS k FROM n, t)),
x AS (SELECT b.*, r.slot, row_number() OVER (PARTITION BY r.slot IS NULL ORDER BY deadline, s) - 1 AS place FROM b LEFT JOIN r ON r.pick = b.i AND r.done[r.pick] = b.k),
p AS (SELECT d.*, row_number() OVER (PARTITION BY s ORDER BY (o >> 20) % (SELECT greatest(1, count(*) // {mixing.BUCKET_DOCS}) FROM d), o, doc_id) - 1 AS rank FROM d)
SELECT doc_id, source, x.k AS block, rank % {MIX_BLOCK_DOCS} AS position, coalesce(x.slot, horizon + place) AS slot, release, deadline, x.slot IS NOT NULL AS in_mix
FROM p JOIN x ON x.s = p.s AND x.k = p.rank // {MIX_BLOCK_DOCS}, h"""


#: Main texts of pages that have one well-formed article of paragraphs and a heading, and no other character references, as those of the tables.
_OP11 = r"""WITH b AS (SELECT page_id, url, list_transform(regexp_split_to_array(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '</?(?:p|h1)>'), lambda x: regexp_replace(replace(x, '<br>', ' '), '<[^>]*>', '', 'g')) AS blocks FROM pages),
d AS (SELECT page_id, url, list_transform(blocks, lambda x: trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS blocks FROM b)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM (SELECT page_id, url, coalesce(array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10)), '') AS text FROM d)"""


def _clustered(rounds: int) -> str:
    """Clustering: all distances to all centroids, round by round."""
    near = "SELECT r, any_value(x) AS x, min({{'d': d, 'j': j}}) AS b FROM (SELECT v.r, v.x, c.j, list_sum(list_transform(v.x, lambda e, i: (e - c.x[i]) * (e - c.x[i])))::BIGINT AS d FROM v, c{0} c) GROUP BY r"
    steps = [f"""a{k} AS MATERIALIZED ({near.format(k)}),
m{k} AS (SELECT j, list((s - ((s % n) + n) % n) // n ORDER BY i)::BIGINT[] AS x FROM (SELECT j, i, sum(e)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT b.j AS j, unnest(x) AS e, generate_subscripts(x, 1) AS i FROM a{k}) GROUP BY j, i) GROUP BY j),
c{k + 1} AS MATERIALIZED (SELECT j, coalesce(m{k}.x, c{k}.x) AS x FROM c{k} LEFT JOIN m{k} USING (j))""" for k in range(rounds)]
    return f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor({centroids.SCALE} * e::DOUBLE)::BIGINT) AS x FROM embeddings WHERE len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {centroids.DIMENSIONS} AND len(embedding) = {centroids.DIMENSIONS}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{CENTROID_SEED}:' || coalesce(vec_id::VARCHAR, '')), x) - 1 AS j, x FROM v QUALIFY j < {CENTROIDS}),
{", ".join(steps)},
last AS MATERIALIZED ({near.format(rounds)})
SELECT vec_id, b.j::INT AS cluster, b.d AS distance, (sum(b.d) OVER (PARTITION BY b.j))::BIGINT AS cluster_inertia, (sum(b.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM last JOIN v USING (r) JOIN c{rounds} c ON c.j = b.j"""


#: The others hash, learn, tokenize or schedule in ways that SQL lacks: see tests/llm.
ORACLES: dict[str, str] = {"op1_quality_divergence": _OP1, "op9_minhash_neardup": _OP9, "op10_pfair_mixing": _OP10, "op11_site_templates": _OP11, "op12_centroid_clustering": _clustered(ROUNDS)}
