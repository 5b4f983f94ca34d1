"""The registered queries of a review's operators over the driver's tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import columns as C
from ..functions import patterns as P
from ..operators import blocks, classify, evaluate, pack, parse, reduce, render, score
from ..sources import generators, shared, virtual
from . import scan as plans

CFG = Config(max_chars=6000, max_chunks=3)
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def _lines(spark, d, source=virtual.diffs):
    return parse.lines(parse.sanitize(source(spark, d)))


def _kept(spark, d):
    return parse.hunk_lines(_lines(spark, d))


def _files(spark, d):
    return parse.files(_kept(spark, d))


def _added(spark, d):
    return parse.added_lines(_kept(spark, d))


def _md5(c):
    return F.md5(F.encode(c, "UTF-8"))


# DuckDB: the steps of parsing as common table expressions.
_RX = {k: v.replace("(?iu)", "(?i)").replace("'", "''") for k, v in (("inj", P.INJECTION), ("exempt", P.EXEMPT_PATH), ("risk", P.HIGH_RISK_PATH), ("kw", P.KEYWORD), ("excluded", P.EXCLUDED_PATH), ("build", P.BUILD_PATH))}
_LOCKS = ", ".join(f"'{x}'" for x in P.MANIFESTS)
_MANIFEST_ROWS = ", ".join(f"('{a}', '{b}')" for a, b in P.MANIFESTS.items())
_W = "OVER (PARTITION BY diff_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)"
_HEAD = r"^diff --git a/(.*?) b/(.*?)\s*$"


def _cte(files: str = virtual.FILES) -> str:
    return f"""WITH diffs AS ({virtual.oracle_diffs(files)}),
cut AS (SELECT diff_id, string_split(raw, chr(10)) AS parts FROM diffs),
every AS (SELECT diff_id, unnest(range(0, len(parts))) AS line_no, unnest(parts) AS text, len(parts) AS n FROM cut),
lines AS (SELECT diff_id, line_no, text FROM every WHERE NOT (line_no = n - 1 AND text = '')),
flags AS (SELECT *, starts_with(text, 'diff --git') AS git, starts_with(text, '--- ') OR starts_with(text, '+++ ') AS head, starts_with(text, '@@') AS at_ FROM lines),
state AS (SELECT *, coalesce(last_value(CASE WHEN git THEN false WHEN at_ AND NOT head THEN true END IGNORE NULLS) {_W}, false) AS inside FROM flags),
kept AS (SELECT * FROM state WHERE git OR head OR at_ OR (inside AND substr(text, 1, 1) IN ('+', '-', ' ', chr(92)))),
numbered AS (SELECT *, sum(CAST(regexp_matches(text, '{_HEAD}') AS INT)) {_W} AS file_no FROM kept),
pathed AS (SELECT diff_id, line_no, text, CAST(file_no AS BIGINT) AS file_no, last_value(CASE WHEN regexp_matches(text, '{_HEAD}') THEN regexp_extract(text, '{_HEAD}', 2) END IGNORE NULLS) {_W} AS path, starts_with(text, '+') AND NOT starts_with(text, '+++') AS added FROM numbered),
files AS (SELECT diff_id, file_no, path, string_agg(text || chr(10), '' ORDER BY line_no) AS file_diff, coalesce(string_agg(text, chr(10) ORDER BY line_no) FILTER (added), '') AS added, count(*) FILTER (added) AS added_lines FROM pathed WHERE file_no > 0 GROUP BY ALL),
first AS (SELECT *, regexp_extract(path, '[^/]*$') AS base, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, CASE WHEN regexp_extract(path, '[^/]*$') IN ({_LOCKS}) THEN 'lockfile' WHEN regexp_matches(path, '{_RX["excluded"]}') THEN 'excluded' WHEN regexp_matches(path, '{_RX["build"]}') THEN 'build' ELSE 'scan' END AS f1 FROM files),
fates AS (SELECT * EXCLUDE (f1), CASE WHEN f1 <> 'build' THEN f1 WHEN bool_or(f1 = 'scan') OVER (PARTITION BY diff_id) THEN 'excluded' ELSE 'finding' END AS fate FROM first),
prio AS (SELECT *, CASE WHEN regexp_matches(path, '{_RX["risk"]}') THEN 100 ELSE 0 END + 10 * len(list_distinct(list_transform(regexp_extract_all(added, '{_RX["kw"]}'), lambda x: lower(x)))) AS priority FROM fates),
ranks AS (SELECT *, row_number() OVER (PARTITION BY diff_id ORDER BY priority DESC, file_no) AS rank FROM prio WHERE fate = 'scan'),
addl AS (SELECT diff_id, file_no, path, line_no, substr(text, 2) AS line FROM pathed WHERE added AND file_no > 0)
"""


@query("p1_sanitize", "SELECT doc_id, md5(regexp_replace(text, '[​‌‍⁠﻿]', '', 'g')) AS clean_md5 FROM documents")
def p1(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return parse.sanitize(docs, "text").select("doc_id", _md5(F.col("clean")).alias("clean_md5"))


@query("p2_hunks", _cte() + "SELECT diff_id, md5(string_agg(text || chr(10), '' ORDER BY line_no)) AS hunks_md5, count(*) AS n_lines FROM kept GROUP BY diff_id")
def p2(spark, d):
    kept = _kept(spark, d)
    return kept.groupBy("diff_id").agg(_md5(parse.joined(F.col("full"))).alias("hunks_md5"), F.count("*").alias("n_lines"))


@query("p3_files", _cte() + "SELECT diff_id, file_no, path, md5(file_diff) AS file_md5, CAST(length(file_diff) AS BIGINT) AS n_chars, added_lines FROM files")
def p3(spark, d):
    return _files(spark, d).select("diff_id", "file_no", "path", _md5(F.col("file_diff")).alias("file_md5"), F.length("file_diff").cast("bigint").alias("n_chars"), "added_lines")


_META = f"meta AS (SELECT diff_id, line_no, coalesce(last_value(CASE WHEN regexp_matches(text, '{_HEAD}') THEN regexp_extract(text, '{_HEAD}', 2) END IGNORE NULLS) {_W}, 'unknown') AS file, CASE WHEN starts_with(text, 'new file mode ') AND text LIKE '%755' THEN '{parse.NEW_EXECUTABLE}' WHEN starts_with(text, 'new mode ') AND text LIKE '%755' THEN '{parse.MADE_EXECUTABLE}' WHEN starts_with(text, 'Binary files ') OR starts_with(text, 'GIT binary patch') THEN '{parse.BINARY.replace(chr(39), chr(39) * 2)}' END AS reason FROM lines)"


@query("p4_metadata", _cte() + f", {_META} SELECT diff_id, CAST(line_no AS INT) AS line_no, file, reason FROM meta WHERE reason IS NOT NULL")
def p4(spark, d):
    return parse.metadata_findings(_lines(spark, d)).drop("binary")


# All documents as one diff: the same steps, with a window over all lines.
_ALL = "OVER (ORDER BY doc_id, i ROWS UNBOUNDED PRECEDING)"
_ONE = f"""WITH d AS ({virtual.ONE_DIFF}),
every AS (SELECT doc_id, unnest(range(0, len(parts))) AS i, unnest(parts) AS text, len(parts) AS n FROM (SELECT doc_id, string_split(body, chr(10)) AS parts FROM d)),
flags AS (SELECT doc_id, i, text, starts_with(text, 'diff --git') AS git, starts_with(text, '--- ') OR starts_with(text, '+++ ') AS head, starts_with(text, '@@') AS at_, regexp_matches(text, '{_HEAD}') AS named FROM every WHERE NOT (i = n - 1 AND text = '')),
placed AS (SELECT *, coalesce(last_value(CASE WHEN git THEN false WHEN at_ AND NOT head THEN true END IGNORE NULLS) {_ALL}, false) AS inside, CAST(sum(CAST(named AS INT)) {_ALL} AS BIGINT) AS file_no, last_value(CASE WHEN named THEN regexp_extract(text, '{_HEAD}', 2) END IGNORE NULLS) {_ALL} AS path FROM flags),
kept AS (SELECT * FROM placed WHERE git OR head OR at_ OR (inside AND substr(text, 1, 1) IN ('+', '-', ' ', chr(92))))
"""


@query("p2_one_diff", _ONE + "SELECT doc_id, md5(string_agg(text || chr(10), '' ORDER BY i)) AS hunks_md5, count(*) AS n_lines FROM kept GROUP BY doc_id")
def p2_one(spark, d):
    kept = blocks.hunk_lines(blocks.located(virtual.one_diff(spark, d)))
    return kept.groupBy("doc_id").agg(_md5(parse.joined(F.col("full"))).alias("hunks_md5"), F.count("*").alias("n_lines"))


@query("p3_one_diff", _ONE + "SELECT file_no, path, md5(string_agg(text || chr(10), '' ORDER BY doc_id, i)) AS file_md5, CAST(sum(length(text) + 1) AS BIGINT) AS n_chars, count(*) FILTER (starts_with(text, '+') AND NOT starts_with(text, '+++')) AS added_lines FROM kept WHERE file_no > 0 GROUP BY ALL")
def p3_one(spark, d):
    found = blocks.files(blocks.hunk_lines(blocks.located(virtual.one_diff(spark, d))))
    return found.select("file_no", "path", _md5(F.col("file_diff")).alias("file_md5"), F.length("file_diff").cast("bigint").alias("n_chars"), "added_lines")


@query("p4_one_diff", _ONE + f""", found AS (SELECT doc_id * 4294967296 + i AS line_no, coalesce(path, 'unknown') AS file, CASE WHEN starts_with(text, 'new file mode ') AND text LIKE '%755' THEN '{parse.NEW_EXECUTABLE}' WHEN starts_with(text, 'new mode ') AND text LIKE '%755' THEN '{parse.MADE_EXECUTABLE}' WHEN starts_with(text, 'Binary files ') OR starts_with(text, 'GIT binary patch') THEN '{parse.BINARY.replace(chr(39), chr(39) * 2)}' END AS reason FROM placed)
SELECT line_no, file, reason FROM found WHERE reason IS NOT NULL""")
def p4_one(spark, d):
    return blocks.metadata_findings(blocks.located(virtual.one_diff(spark, d))).select("line_no", "file", "reason")


@query("p5_added", _cte() + "SELECT diff_id, file_no, count(*) AS n, md5(string_agg(line, chr(10) ORDER BY line_no)) AS added_md5 FROM addl GROUP BY ALL")
def p5(spark, d):
    a = _added(spark, d)
    return a.groupBy("diff_id", "file_no").agg(F.count("*").alias("n"), _md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]), "\n")).alias("added_md5"))


@query("p6_tokens", "SELECT item_id, CAST(len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS BIGINT) AS n, md5(regexp_replace(lower(text), '[^a-z0-9]', '', 'g')) AS collapsed_md5 FROM benchmark")
def p6_p9(spark, d):
    b = spark.read.parquet(f"{d}/benchmark.parquet")
    return b.select("item_id", F.size(C.tokens(F.col("text"))).cast("bigint").alias("n"), _md5(C.collapse(F.col("text"))).alias("collapsed_md5"))


@query("p7_paths", _cte() + "SELECT diff_id, file_no, base, dir FROM first")
def p7(spark, d):
    return _files(spark, d).select("diff_id", "file_no", C.basename(F.col("path")).alias("base"), C.dirname(F.col("path")).alias("dir"))


@query("f_path_predicates", _cte() + f"SELECT diff_id, file_no, regexp_matches(path, '{_RX['exempt']}') AS exempt, regexp_matches(path, '{_RX['risk']}') AS high_risk, regexp_matches(path, '{_RX['excluded']}') AS excluded, regexp_matches(path, '{_RX['build']}') AS build, base IN ({_LOCKS}) AS lockfile FROM first")
def f2_f7(spark, d):
    p = F.col("path")
    return _files(spark, d).select("diff_id", "file_no", C.is_exempt(p).alias("exempt"), C.is_high_risk(p).alias("high_risk"), C.is_excluded(p).alias("excluded"), C.is_build_output(p).alias("build"), C.is_lockfile(p).alias("lockfile"))


@query("a1_injection", _cte(virtual.CHATS) + f"SELECT diff_id, bool_or(regexp_matches(file_diff, '{_RX['inj']}') AND NOT regexp_matches(path, '{_RX['exempt']}')) AS injection FROM files GROUP BY diff_id")
def a1(spark, d):
    return classify.injections(parse.files(parse.hunk_lines(_lines(spark, d, virtual.chats))))


@query("v9_fates", _cte() + "SELECT diff_id, file_no, path, fate FROM fates")
def v9(spark, d):
    return classify.fates(_files(spark, d)).select("diff_id", "file_no", "path", "fate")


@query("j1_lock_no_manifest", _cte() + f", m(base, manifest) AS (VALUES {_MANIFEST_ROWS}) SELECT f.diff_id, f.file_no, f.path, m.manifest FROM first f JOIN m USING (base) WHERE NOT EXISTS (SELECT 1 FROM first g WHERE g.diff_id = f.diff_id AND g.dir = f.dir AND g.base = m.manifest)")
def j1(spark, d):
    return classify.locks_without_manifest(_files(spark, d))


_HOST_OK = " OR ".join(f"lower(host) = '{h}' OR lower(host) LIKE '%.{h}'" for h in (*P.HOSTS, "example.com"))
_DEP = r"(?i)(git\+[a-z0-9.+\-]*://|(^|[^A-Za-z])(git|ssh)://|(^|[^A-Za-z0-9_])(file|link):[./~])"
_URLS = r"SELECT page_id, unnest(range(0, len(u))) AS at_, unnest(u) AS url FROM (SELECT page_id, regexp_extract_all(url, 'https?://[A-Za-z0-9._~\-]+') AS u FROM pages)"


@query("j2_hosts", f"SELECT page_id, scheme, host, ({_HOST_OK}) AS canonical FROM (SELECT page_id, regexp_extract(url, '^(https?)', 1) AS scheme, regexp_extract(url, '://(.*)$', 1) AS host FROM ({_URLS}))")
def j2(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet")
    u = pages.select("page_id", F.explode(F.regexp_extract_all("url", F.lit(P.URL), F.lit(0))).alias("u")).select("page_id", F.substring_index("u", "://", 1).alias("scheme"), F.substring_index("u", "://", -1).alias("host"))
    return u.withColumn("canonical", C.is_canonical(F.col("host"), ("example.com",)))


# An allowlist as a table: what hosts of every third page are below, without their first label.
_ALLOWED = "SELECT DISTINCT regexp_replace(lower(host), '^[^.]*[.]', '') AS domain FROM met WHERE page_id % 3 = 0"


@query("j2_allowlist", f"WITH met AS (SELECT page_id, regexp_extract(url, '://(.*)$', 1) AS host FROM ({_URLS})), allowed AS ({_ALLOWED}) SELECT page_id, host, EXISTS (SELECT 1 FROM allowed WHERE lower(host) = domain OR ends_with(lower(host), '.' || domain)) AS canonical FROM met")
def j2_any(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet")
    met = pages.select("page_id", F.explode(F.regexp_extract_all("url", F.lit(P.URL), F.lit(0))).alias("u")).select("page_id", F.substring_index("u", "://", -1).alias("host"))
    allowed = met.where("page_id % 3 = 0").select(F.regexp_replace(F.lower("host"), "^[^.]*[.]", "").alias("domain"))
    return met.join(classify.canonical_hosts(met, allowed), "host").select("page_id", "host", "canonical")


@query("a14_lock_findings", f"""WITH locks AS (SELECT cast(floor(page_id / 50) AS bigint) AS diff_id, 1::bigint AS file_no, page_id AS line_no, concat('"resolved": "', CASE WHEN page_id % 7 = 0 THEN concat('git+ssh://git@', url) ELSE url END, '"') AS line FROM pages),
u AS (SELECT *, regexp_extract_all(line, 'https?://[A-Za-z0-9._~\\-]+') AS urls FROM locks),
e AS (SELECT diff_id, file_no, line_no, i, unnest(urls) AS x FROM (SELECT *, range(0, len(urls)) AS i FROM u)),
parts AS (SELECT diff_id, file_no, line_no, unnest(range(0, len(urls))) AS i, regexp_extract(unnest(urls), '^(https?)', 1) AS scheme, regexp_extract(unnest(urls), '://(.*)$', 1) AS host FROM u),
ev AS (SELECT diff_id, file_no, line_no, 2 * i AS at_, 'http' AS kind, lower(host) AS key FROM parts WHERE scheme = 'http' UNION ALL SELECT diff_id, file_no, line_no, 2 * i + 1, 'host', lower(host) FROM parts WHERE NOT ({_HOST_OK}) UNION ALL SELECT diff_id, file_no, line_no, 1000, 'dep', substr(trim(line), 1, 80) FROM locks WHERE regexp_matches(line, '{_DEP}')),
once AS (SELECT *, row_number() OVER (PARTITION BY diff_id, kind, key ORDER BY line_no, at_) AS n FROM ev),
seqs AS (SELECT *, row_number() OVER (PARTITION BY diff_id ORDER BY line_no, at_) AS seq FROM once WHERE n = 1)
SELECT diff_id, file_no, CAST(seq AS INT) AS seq, kind, key FROM seqs WHERE seq <= {P.MAX_LOCK_FINDINGS}""".replace("e AS (SELECT diff_id, file_no, line_no, i, unnest(urls) AS x FROM (SELECT *, range(0, len(urls)) AS i FROM u)),\n", ""))
def a14(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet")
    url = F.when(F.col("page_id") % 7 == 0, F.concat(F.lit("git+ssh://git@"), "url")).otherwise(F.col("url"))
    lines = pages.select(F.floor(F.col("page_id") / 50).alias("diff_id"), F.lit(1).cast("bigint").alias("file_no"), F.lit("package-lock.json").alias("path"), F.col("page_id").alias("line_no"), F.concat(F.lit('"resolved": "'), url, F.lit('"')).alias("line"))
    return classify.lock_events(lines, Config(registries=("example.com",))).select("diff_id", "file_no", "seq", "kind", "key")


@query("a2_keywords", _cte() + f"SELECT diff_id, file_no, len(list_distinct(list_transform(regexp_extract_all(added, '{_RX['kw']}'), lambda x: lower(x))))::INT AS n FROM files")
def a2(spark, d):
    return _files(spark, d).select("diff_id", "file_no", F.size(C.keywords(F.col("added"))).alias("n"))


@query("a4_bootstrap", _cte() + "SELECT diff_id, count(*) AS scannable, CAST(sum(added_lines) AS BIGINT) AS added_lines, count(*) > 5 OR sum(added_lines) > 100 AS bootstrap FROM fates WHERE fate = 'scan' GROUP BY diff_id")
def a3_a4(spark, d):
    return classify.bootstraps(classify.fates(_files(spark, d)), Config(bootstrap_files=5, bootstrap_added_lines=100))


@query("r2_rank", _cte() + "SELECT diff_id, file_no, CAST(priority AS INT) AS priority, CAST(rank AS INT) AS rank FROM ranks")
def r1_r2(spark, d):
    return pack.ranked(classify.fates(_files(spark, d)).where("fate = 'scan'")).select("diff_id", "file_no", "priority", "rank")


def _pack_sql(items: str, budget: int, most: int, recursive: str) -> str:
    """First fit as a recursion over ranks, which carries the lengths in use."""
    return recursive + f"""items AS ({items}),
steps AS (
  SELECT g, 0::BIGINT AS rank, []::BIGINT[] AS used, NULL::BIGINT AS item, NULL::INT AS chunk_no, NULL::VARCHAR AS state FROM (SELECT DISTINCT g FROM items)
  UNION ALL
  SELECT g, rank, CASE WHEN fit > 0 THEN list_transform(used, lambda u, i: CASE WHEN i = fit THEN u + n ELSE u END) WHEN room THEN list_append(used, CASE WHEN n > {budget} THEN {budget} + 17 ELSE n END) ELSE used END, item,
    CASE WHEN fit > 0 THEN fit WHEN room THEN len(used) + 1 END::INT, CASE WHEN fit > 0 THEN 'packed' WHEN room AND n > {budget} THEN 'truncated' WHEN room THEN 'packed' ELSE 'overflow' END
  FROM (SELECT s.g, i.rank, s.used, i.item, i.n, len(s.used) < {most} AS room, CASE WHEN i.n > {budget} THEN 0 ELSE coalesce(list_position(list_transform(s.used, lambda u: u + i.n <= {budget}), true), 0) END AS fit FROM steps s JOIN items i ON i.g = s.g AND i.rank = s.rank + 1))
"""


@query("r3_pack", _pack_sql("SELECT l_orderkey AS g, row_number() OVER (PARTITION BY l_orderkey ORDER BY flag DESC, l_linenumber) AS rank, l_linenumber::BIGINT AS item, n FROM (SELECT l_orderkey, l_linenumber, max(l_returnflag) AS flag, CAST(sum(l_quantity) AS BIGINT) AS n FROM lineitem GROUP BY ALL)", 40, 3, "WITH RECURSIVE ") + "SELECT g AS l_orderkey, CAST(rank AS INT) AS rank, item AS l_linenumber, chunk_no, state FROM steps WHERE rank > 0")
def r3(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    one = li.groupBy("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber")).agg(F.max("l_returnflag").alias("flag"), F.sum("l_quantity").cast("bigint").alias("n"))
    ranks = one.select("l_orderkey", F.row_number().over(pack.Window.partitionBy("l_orderkey").orderBy(F.desc("flag"), "l_linenumber")).alias("rank"), "l_linenumber", "n")
    return pack.first_fit(ranks, "l_orderkey", 40, 3).drop("n")


_PLACED = _pack_sql("SELECT diff_id AS g, rank, file_no AS item, length(file_diff)::BIGINT AS n FROM ranks", CFG.max_chars, CFG.max_chunks, _cte().replace("WITH ", "WITH RECURSIVE ", 1) + ", ")


@query("r4_chunks", _PLACED + f"SELECT diff_id, s.chunk_no, md5(string_agg(CASE WHEN length(file_diff) > {CFG.max_chars} THEN substr(file_diff, 1, {CFG.max_chars}) || chr(10) || '[file truncated]' ELSE file_diff END, '' ORDER BY s.rank)) AS text_md5, string_agg(path, ',' ORDER BY s.rank) AS paths FROM steps s JOIN ranks r ON r.diff_id = s.g AND r.rank = s.rank WHERE s.chunk_no IS NOT NULL GROUP BY ALL")
def r4(spark, d):
    texts = shared.cut(plans.facts_of(_files(spark, d), CFG).select("diff_id", "file_no", "path", "n_chars", "priority", "file_diff"))  # for two branches
    ranked = pack.ranked(classify.fates(texts.drop("file_diff")).where("fate = 'scan'"))
    return pack.chunks(texts, pack.placements(ranked, CFG), CFG).select("diff_id", "chunk_no", _md5(F.col("text")).alias("text_md5"), F.array_join("paths", ",").alias("paths"))


#: Replies made of events: six events of a user are the three calls of the two looks at a chunk; a kind of event stands for a service error.
_REPLY_SQL = """SELECT user_id AS diff_id, CAST(1 + floor(n / 6) AS INT) AS chunk_no, CAST(1 + floor((n % 6) / 3) AS INT) AS look, CAST(1 + n % 3 AS INT) AS call_no, CASE WHEN event_type = 'error' THEN 'infra' ELSE 'ok' END AS kind,
 CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN concat('Here it is: {{"risk_score": ', cast(event_id % 140 - 20 AS {string}), ', "reasoning": " text ", "key_changes": ["a", " b "]}} done') WHEN 2 THEN 'no object' WHEN 3 THEN concat('{{"risk_score": "', cast(event_id % 100 AS {string}), '"}}') ELSE concat('{{"risk_score": ', cast(event_id % 100 AS {string}), '.7, "reasoning": "r"}}') END AS content
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events)"""


def _replies(spark, d):
    spark.read.parquet(f"{d}/events.parquet").createOrReplaceTempView("events")
    return spark.sql(_REPLY_SQL.format(string="string"))


_READ = f"""WITH replies AS ({_REPLY_SQL.format(string='varchar')}),
obj AS (SELECT *, CASE WHEN json_valid(content) THEN content ELSE nullif(regexp_extract(content, '(?s)\\{{.*\\}}'), '') END AS j FROM replies WHERE kind = 'ok'),
num AS (SELECT *, CASE WHEN j IS NOT NULL AND json_valid(j) AND json_type(j) = 'OBJECT' THEN CAST(trunc(try_cast(json_extract_string(j, '$.risk_score') AS DOUBLE)) AS INT) END AS s FROM obj),
coerced AS (SELECT r.*, CASE WHEN s IS NOT NULL THEN greatest(0, least(100, s)) END AS risk FROM replies r LEFT JOIN num USING (diff_id, chunk_no, look, call_no))
"""


@query("u2_coerce", _READ + "SELECT diff_id, chunk_no, look, call_no, CASE WHEN kind = 'ok' THEN CASE WHEN risk IS NOT NULL THEN risk END END AS risk_score FROM coerced")
def u2(spark, d):
    return _replies(spark, d).select("diff_id", "chunk_no", "look", "call_no", F.when(F.col("kind") == "ok", score.coerce(F.col("content"))["risk_score"]).alias("risk_score"))


_TRIED = _READ + ", tried AS (SELECT diff_id, chunk_no, look, arg_min(risk, call_no) FILTER (risk IS NOT NULL) AS risk, CASE WHEN count(risk) > 0 THEN 'ok' ELSE arg_max(CASE WHEN kind = 'ok' THEN 'content' ELSE 'infra' END, call_no) END AS status FROM coerced GROUP BY ALL)"


@query("u3_retry", _TRIED + " SELECT diff_id, chunk_no, look, status, risk AS risk_score FROM tried")
def u3(spark, d):
    return score.attempts(_replies(spark, d)).select("diff_id", "chunk_no", "look", "status", F.col("result.risk_score").alias("risk_score"))


_CORR = _TRIED + ", corr AS (SELECT a.diff_id, a.chunk_no, a.status, CASE WHEN a.risk >= 70 AND b.status = 'ok' AND b.risk < 70 THEN greatest(40, b.risk) ELSE a.risk END AS risk FROM tried a LEFT JOIN tried b ON b.diff_id = a.diff_id AND b.chunk_no = a.chunk_no AND b.look = 2 WHERE a.look = 1)"


@query("u4_corroborate", _CORR + " SELECT diff_id, chunk_no, status, risk AS risk_score FROM corr")
def u4(spark, d):
    return score.corroborated(score.attempts(_replies(spark, d))).select("diff_id", "chunk_no", "status", F.col("result.risk_score").alias("risk_score"))


def _outcomes(spark, d):
    return score.corroborated(score.attempts(_replies(spark, d))).withColumn("paths", F.array(F.concat(F.lit("f"), F.col("chunk_no").cast("string"))))


_FAIL = "CASE WHEN bool_or(status = 'infra') THEN 'infra' WHEN bool_or(status = 'content') THEN 'content' END"


@query("a5_reduce", _CORR + f" SELECT diff_id, count(*) AS num_chunks, count(risk) > 0 AS scored, {_FAIL} AS failsafe, coalesce(max(risk), 0) AS risk_score FROM corr GROUP BY diff_id")
def a5_a10(spark, d):
    return reduce.reduce_outcomes(_outcomes(spark, d)).select("diff_id", "num_chunks", "scored", "failsafe", "risk_score")


@query("a7_key_changes", _TRIED + ", j2 AS (SELECT t.diff_id, t.chunk_no, arg_min(j, n.call_no) AS j FROM tried t JOIN num n ON n.diff_id = t.diff_id AND n.chunk_no = t.chunk_no AND n.look = 1 AND n.s IS NOT NULL WHERE t.look = 1 AND t.status = 'ok' GROUP BY ALL), c AS (SELECT DISTINCT diff_id, trim(unnest(json_extract_string(j, '$.key_changes[*]'))) AS change FROM j2) SELECT diff_id, change FROM c WHERE change <> ''")
def a7(spark, d):
    r = reduce.reduce_outcomes(_outcomes(spark, d)).where("num_chunks > 0")
    return r.select("diff_id", F.explode("key_changes").alias("change")).select("diff_id", C.strip(F.col("change")).alias("change")).distinct()


#: One reply to each chunk, with findings and reasoning; every fifth event is the only chunk of a diff, of the others up to ten make one.
_TOLD = """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN -1 - event_id ELSE cast(floor(event_id / 10) AS bigint) END AS diff_id, CAST(event_id % 10 + 1 AS INT) AS chunk_no FROM events"""
_TOLD_CONTENT = """concat('{"risk_score": ', cast(event_id % 100 AS string), ', "reasoning": "r', cast(event_id % 7 AS string), '", "key_changes": ["c', cast(event_id % 3 AS string), '", " c', cast(event_id % 4 AS string), '"], "suspicious_findings": [',
 CASE WHEN event_id % 4 = 0 THEN '' ELSE concat('{"file": "f', cast(event_id % 2 AS string), '", "reason": " Reason ', cast(event_id % 3 AS string), '"}, {"file": "f1", "reason": "REASON ', cast(event_id % 3 AS string), '"}') END, ']}')"""


@query("a6_a8_merged", f"""WITH r AS ({_TOLD}), alone AS (SELECT diff_id, count(*) = 1 AS verbatim FROM r GROUP BY diff_id),
f AS (SELECT diff_id, chunk_no, 0 AS seq, 'f' || event_id % 2 AS file, ' Reason ' || event_id % 3 AS reason FROM r WHERE event_id % 4 <> 0 UNION ALL SELECT diff_id, chunk_no, 1, 'f1', 'REASON ' || event_id % 3 FROM r WHERE event_id % 4 <> 0),
fd AS (SELECT *, row_number() OVER (PARTITION BY diff_id, file, lower(trim(reason)) ORDER BY chunk_no, seq) AS n FROM f),
c AS (SELECT diff_id, chunk_no, 0 AS seq, 'c' || event_id % 3 AS change FROM r UNION ALL SELECT diff_id, chunk_no, 1, ' c' || event_id % 4 FROM r),
cd AS (SELECT *, row_number() OVER (PARTITION BY diff_id, trim(change) ORDER BY chunk_no, seq) AS n FROM c),
fs AS (SELECT diff_id, string_agg(file || ':' || reason, '|' ORDER BY chunk_no, seq) AS findings FROM fd JOIN alone USING (diff_id) WHERE n = 1 OR verbatim GROUP BY diff_id),
cs AS (SELECT diff_id, string_agg(change, '|' ORDER BY chunk_no, seq) AS changes FROM cd JOIN alone USING (diff_id) WHERE n = 1 OR verbatim GROUP BY diff_id),
ns AS (SELECT diff_id, string_agg('[f' || chunk_no || '] r' || event_id % 7, chr(10) || chr(10) ORDER BY chunk_no) AS notes FROM r WHERE event_id % 4 <> 0 OR event_id % 100 >= 40 GROUP BY diff_id),
per AS (SELECT diff_id, count(*) AS n, min(event_id) AS e FROM r GROUP BY diff_id)
SELECT diff_id, verbatim, coalesce(findings, '') AS findings, coalesce(changes, '') AS changes, CASE WHEN verbatim THEN 'r' || e % 7 ELSE coalesce(notes, 'No notable findings across ' || n || ' files / ' || n || ' chunks.') END AS reasoning
FROM alone JOIN per USING (diff_id) LEFT JOIN fs USING (diff_id) LEFT JOIN cs USING (diff_id) LEFT JOIN ns USING (diff_id)""")
def a6_a8(spark, d):
    spark.read.parquet(f"{d}/events.parquet").createOrReplaceTempView("events")
    told = spark.sql(f"SELECT diff_id, chunk_no, 1 AS look, 1 AS call_no, 'ok' AS kind, {_TOLD_CONTENT} AS content FROM ({_TOLD})")
    outcomes = score.corroborated(score.attempts(told)).withColumn("paths", F.array(F.concat(F.lit("f"), F.col("chunk_no").cast("string"))))
    found = F.array_join(F.transform("suspicious_findings", lambda f: F.concat(f["file"], F.lit(":"), f["reason"])), "|")
    return reduce.reduce_outcomes(outcomes).select("diff_id", "verbatim", found.alias("findings"), F.array_join("key_changes", "|").alias("changes"), "reasoning")


@query("k6_alerts", _CORR + " SELECT diff_id, status AS kind, chunk_no, 'FAILSAFE kind=' || status || ' chunk=' || chunk_no || ' fail_closed=False' AS detail FROM corr WHERE status <> 'ok'")
def k6(spark, d):
    outcomes = _outcomes(spark, d)
    return plans.alerts(outcomes.select("diff_id").distinct(), outcomes)


@query("v1_v7_policy", _CORR + f""", per AS (SELECT diff_id, {_FAIL} AS failsafe, coalesce(max(risk), 0) AS worst FROM corr GROUP BY diff_id), fl AS (SELECT *, CASE WHEN diff_id % 4 = 0 THEN greatest(worst, 55) ELSE worst END AS score FROM per)
SELECT diff_id, score AS risk_score, CASE greatest(CASE WHEN score >= 70 THEN 2 WHEN score >= 40 THEN 1 ELSE 0 END, CASE WHEN failsafe IS NOT NULL THEN 1 ELSE 0 END, CASE WHEN diff_id % 5 = 0 OR diff_id % 7 = 0 THEN 1 ELSE 0 END) WHEN 2 THEN 'block' WHEN 1 THEN 'review' ELSE 'pass' END AS verdict, CASE WHEN score >= 70 THEN 'high risk' WHEN score >= 40 THEN 'medium risk' ELSE 'low risk' END AS band, CASE WHEN score >= 70 THEN 1 ELSE 0 END AS exit_code FROM fl""")
def v1_v7(spark, d):
    none, k = F.array().cast("array<string>"), F.col("diff_id")
    r = reduce.reduce_outcomes(_outcomes(spark, d)).withColumns({"injection": k % 4 == 0, "overflow": F.when(k % 5 == 0, F.array(F.lit("x"))).otherwise(none), "truncated": none, "binary": none, "n_rules": F.when(k % 7 == 0, 1).otherwise(0), "bootstrap": F.lit(False)})
    return reduce.apply_policy(r).select("diff_id", "risk_score", "verdict", C.risk_band(F.col("risk_score")).alias("band"), "exit_code")


@query("s4_base_ref", "SELECT event_id, CASE WHEN event_type = 'view' THEN CASE WHEN event_id % 2 = 0 THEN concat('sha', cast(event_id AS varchar)) ELSE 'origin/main' END WHEN event_type = 'click' THEN CASE WHEN event_id % 3 = 0 THEN 'HEAD^' WHEN event_id % 3 = 1 THEN 'HEAD^' ELSE 'abc' END ELSE 'HEAD' END AS base FROM events")
def s4(spark, d):
    from ..sources import files

    e = spark.read.parquet(f"{d}/events.parquet")
    event = F.when(F.col("event_type") == "view", "pull_request").when(F.col("event_type") == "click", "push").otherwise("manual")
    sha = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("sha"), F.col("event_id").cast("string"))).otherwise("")
    before = F.when(F.col("event_id") % 3 == 0, "").when(F.col("event_id") % 3 == 1, "0" * 40).otherwise("abc")
    return e.select("event_id", files.base_ref(event, sha, F.lit("main"), before).alias("base"))


@query("k5_upsert", "WITH ours AS (SELECT 'r' || cast(conv_id % 5 AS varchar) AS repo, conv_id AS pr, min(turn) AS comment_id, arg_min(text, turn) AS body FROM conversations WHERE role = 'user' GROUP BY ALL), rep AS (SELECT 'r' || cast(doc_id % 5 AS varchar) AS repo, doc_id AS pr, lang AS report FROM documents) SELECT coalesce(o.repo, n.repo) AS repo, coalesce(o.pr, n.pr) AS pr, comment_id, CASE WHEN report IS NULL THEN 'keep' WHEN o.pr IS NULL THEN 'post' ELSE 'patch' END AS action, md5(coalesce(report, body)) AS body_md5 FROM ours o FULL JOIN rep n ON o.repo = n.repo AND o.pr = n.pr")
def k5(spark, d):
    from ..sources import files

    c, t = spark.read.parquet(f"{d}/conversations.parquet"), spark.read.parquet(f"{d}/documents.parquet")
    old = c.select(F.concat(F.lit("r"), (F.col("conv_id") % 5).cast("string")).alias("repo"), F.col("conv_id").alias("pr"), F.col("turn").alias("comment_id"), F.concat(F.col("role"), F.lit(">"), F.col("text")).alias("body"))
    new = t.select(F.concat(F.lit("r"), (F.col("doc_id") % 5).cast("string")).alias("repo"), F.col("doc_id").alias("pr"), F.col("lang").alias("report"))
    return files.upsert_comments(old, new, "user>").select("repo", "pr", "comment_id", "action", F.md5(F.encode(F.regexp_replace("body", "^user>", ""), "UTF-8")).alias("body_md5"))


@query("s8_repo_init", generators.repo_init_sql("cast(500 as bigint)").replace("AS string", "AS varchar") + " FROM (SELECT range AS i FROM range(500))")
def s8(spark, d):
    return generators.repo_init(spark, 500).withColumn("n_lines", F.col("n_lines").cast("bigint"))


@query("s9_chunk_stress", "SELECT range AS file_no, CASE WHEN range = 0 THEN '.github/workflows/release.yml' WHEN range <= 5 THEN 'src/part_' || cast(range - 1 AS varchar) || '.py' ELSE 'src/large.py' END AS path, CASE WHEN range = 0 THEN 8 WHEN range <= 5 THEN 385 ELSE 910 END::BIGINT AS n_lines FROM range(7)")
def s9(spark, d):
    return generators.chunk_stress(spark)


@query("a11_confusion", "WITH x AS (SELECT toxic = 1 AS e, doc_id % 3 <> 0 AS f FROM labels), m AS (SELECT count(*) FILTER (e AND f) AS tp, count(*) FILTER (NOT e AND f) AS fp, count(*) FILTER (NOT e AND NOT f) AS tn, count(*) FILTER (e AND NOT f) AS fn, count(*) AS n FROM x) SELECT *, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce((tp + tn) / nullif(n, 0), 0), 6) AS accuracy FROM m")
def a11(spark, d):
    l = spark.read.parquet(f"{d}/labels.parquet")
    m = evaluate.confusion(l.select((F.col("toxic") == 1).alias("expected"), F.when(F.col("doc_id") % 3 == 0, "pass").otherwise("review").alias("verdict")))
    return m.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "accuracy")})


@query("a13_identifier", _cte() + f", met AS (SELECT diff_id, line_no, unnest(range(0, len(x))) AS at_, unnest(x) AS identifier FROM (SELECT diff_id, line_no, regexp_extract_all(line, '[A-Za-z_][A-Za-z0-9_]{{2,}}') AS x FROM addl)), c AS (SELECT diff_id, identifier, count(*) AS n, min(struct_pack(l := line_no, a := at_)) AS f FROM met WHERE lower(identifier) NOT IN ({', '.join(repr(w) for w in P.KEYWORDS_OF_LANGUAGES)}) GROUP BY ALL) SELECT diff_id, identifier, n FROM c QUALIFY row_number() OVER (PARTITION BY diff_id ORDER BY n DESC, f) = 1")
def a13(spark, d):
    return evaluate.common_identifier(_added(spark, d))


# A diff's lines with what the perturbations need; \\b as Unicode has it, by the characters around a word, twice as they are shared.
_PERTURBED = f""", met AS (SELECT diff_id, line_no, unnest(range(0, len(x))) AS at_i, unnest(x) AS identifier FROM (SELECT diff_id, line_no, regexp_extract_all(substr(text, 2), '[A-Za-z_][A-Za-z0-9_]{{2,}}') AS x FROM lines WHERE starts_with(text, '+') AND NOT starts_with(text, '+++'))),
idn AS (SELECT diff_id, identifier, count(*) AS n, min(struct_pack(l := line_no, a := at_i)) AS f FROM met WHERE lower(identifier) NOT IN ({', '.join(repr(w) for w in P.KEYWORDS_OF_LANGUAGES)}) GROUP BY diff_id, identifier QUALIFY row_number() OVER (PARTITION BY diff_id ORDER BY n DESC, f) = 1),
word AS (SELECT diff_id, '(^|[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}])' || identifier || '($|[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}])' AS rx, '\\1' || identifier || '_v2\\2' AS new FROM idn),
renamed AS (SELECT l.diff_id, string_agg(CASE WHEN rx IS NOT NULL AND substr(text, 1, 1) IN ('+', '-', ' ') AND NOT starts_with(text, '+++') AND NOT starts_with(text, '---') THEN regexp_replace(regexp_replace(text, rx, new, 'g'), rx, new, 'g') ELSE text END || chr(10), '' ORDER BY line_no) AS raw FROM lines l LEFT JOIN word w USING (diff_id) GROUP BY l.diff_id),
blank AS (SELECT diff_id, string_agg(text || chr(10) || CASE WHEN at_ THEN '+' || chr(10) ELSE '' END, '' ORDER BY line_no) AS raw FROM flags GROUP BY diff_id),
hg AS (SELECT *, sum(at_::INT) {_W} AS h, sum(git::INT) {_W} AS g FROM flags),
hunk2 AS (SELECT diff_id, min(g) FILTER (h = 1) AS g1, min(g) FILTER (h = 2) AS g2 FROM hg GROUP BY diff_id),
swapped AS (SELECT diff_id, string_agg(text || chr(10), '' ORDER BY CASE WHEN g1 IS NULL OR g2 IS NULL OR g1 <> g2 THEN 0 WHEN h = 0 THEN 0 WHEN h = 1 THEN 2 WHEN h = 2 AND g = g2 THEN 1 ELSE 3 END, line_no) AS raw FROM hg JOIN hunk2 USING (diff_id) GROUP BY diff_id)
"""
_MD5_OF = " SELECT diff_id, md5(raw) AS raw_md5 FROM {}"


@query("e2a_rename", _cte() + _PERTURBED + _MD5_OF.format("renamed"))
def e2a(spark, d):
    return evaluate.rename(virtual.diffs(spark, d)).select("diff_id", _md5(F.col("raw")).alias("raw_md5"))


@query("e2b_blank", _cte() + "SELECT diff_id, md5(string_agg(text || chr(10) || CASE WHEN at_ THEN '+' || chr(10) ELSE '' END, '' ORDER BY line_no)) AS raw_md5 FROM flags GROUP BY diff_id")
def e2b(spark, d):
    return evaluate.blank_lines(virtual.diffs(spark, d)).select("diff_id", _md5(F.col("raw")).alias("raw_md5"))


@query("e2c_reorder", _cte() + _PERTURBED + _MD5_OF.format("swapped"))
def e2c(spark, d):
    return evaluate.reorder(virtual.diffs(spark, d)).select("diff_id", _md5(F.col("raw")).alias("raw_md5"))


_GENERIC = ", ".join(f"'{w}'" for w in P.GENERIC_TOKENS)


@query("e4_contamination", f"WITH p AS (SELECT regexp_replace(lower(string_agg(text, ' ' ORDER BY item_id)), '[^a-z0-9]', '', 'g') AS plain FROM benchmark), s AS (SELECT doc_id, text AS name FROM documents), t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(name), '[a-z0-9]+')) AS t FROM s), o AS (SELECT doc_id, t FROM t, p WHERE length(t) >= 4 AND t NOT IN ({_GENERIC}) AND contains(plain, t)) SELECT doc_id, coalesce(string_agg(t, ',' ORDER BY t), '') AS overlap, count(t) > 0 AS contaminated FROM s LEFT JOIN o USING (doc_id) GROUP BY doc_id")
def e4(spark, d):
    b, docs = spark.read.parquet(f"{d}/benchmark.parquet"), spark.read.parquet(f"{d}/documents.parquet")
    prompt = b.select(F.col("item_id").alias("part"), F.col("text").alias("prompt"))
    found = evaluate.contaminated_by(docs.select(F.col("doc_id").alias("id"), F.col("text").alias("name")), prompt)
    return found.select(F.col("id").alias("doc_id"), F.array_join("overlap", ",").alias("overlap"), "contaminated")


def _by_risk(spark, d, cfg=CFG, source=virtual.diffs):
    """A scorer without a model: ten points for each keyword of the chunk's text, and eighty with a workflow."""
    risk = F.least(F.lit(100), 10 * F.size(C.keywords(F.col("text"))) + F.when(F.exists("paths", lambda p: p.startswith(".github")), 35).otherwise(0))
    return plans.scan(source(spark, d), score.rules(risk), cfg)


def _scan_sql(placed: str, risk: str) -> str:
    return placed + f""", {_META},
ch AS (SELECT diff_id, s.chunk_no, least(100, 10 * len(list_distinct(list_transform(regexp_extract_all(string_agg(CASE WHEN length(file_diff) > {CFG.max_chars} THEN substr(file_diff, 1, {CFG.max_chars}) || chr(10) || '[file truncated]' ELSE file_diff END, '' ORDER BY s.rank), '{_RX["kw"]}'), lambda x: lower(x)))) {risk}) AS risk, count(*) AS n FROM steps s JOIN ranks r ON r.diff_id = s.g AND r.rank = s.rank WHERE s.chunk_no IS NOT NULL GROUP BY ALL),
res AS (SELECT diff_id, max(risk) AS risk, count(*) AS num_chunks, sum(n) AS files_scanned FROM ch GROUP BY diff_id),
cov AS (SELECT g AS diff_id, count(*) FILTER (state IN ('overflow', 'truncated')) AS partial FROM steps WHERE rank > 0 GROUP BY g),
bin AS (SELECT diff_id, count(*) AS n_bin FROM meta WHERE starts_with(reason, 'Binary') GROUP BY diff_id),
m(base, manifest) AS (VALUES {_MANIFEST_ROWS}),
lone AS (SELECT f.diff_id, count(*) AS n_lone FROM first f JOIN m USING (base) WHERE NOT EXISTS (SELECT 1 FROM first g WHERE g.diff_id = f.diff_id AND g.dir = f.dir AND g.base = m.manifest) GROUP BY f.diff_id),
built AS (SELECT diff_id, count(*) AS n_built FROM fates WHERE fate = 'finding' GROUP BY diff_id),
allr AS (SELECT d.diff_id, coalesce(risk, 0) AS score, risk IS NOT NULL AS scored, coalesce(num_chunks, 0) AS num_chunks, coalesce(files_scanned, 0) AS files_scanned, coalesce(partial, 0) + coalesce(n_bin, 0) + coalesce(n_lone, 0) + coalesce(n_built, 0) > 0 AS floored, coalesce(partial, 0) > 0 AS truncated FROM diffs d LEFT JOIN res USING (diff_id) LEFT JOIN cov USING (diff_id) LEFT JOIN bin USING (diff_id) LEFT JOIN lone USING (diff_id) LEFT JOIN built USING (diff_id))
SELECT diff_id, CASE WHEN score >= 70 THEN 'block' WHEN score >= 40 OR floored THEN 'review' ELSE 'pass' END AS verdict, CASE WHEN scored THEN CAST(score AS INT) END AS score, scored, truncated, CAST(num_chunks AS INT) AS num_chunks, CAST(files_scanned AS INT) AS files_scanned FROM allr"""


_SCAN = _scan_sql(_PLACED, "+ CASE WHEN bool_or(starts_with(path, '.github')) THEN 35 ELSE 0 END")


@query("scan_full", _SCAN)
def scan_full(spark, d):
    return _by_risk(spark, d).select("diff_id", "verdict", "score", "scored", "truncated", "num_chunks", "files_scanned")


@query("scan_blocks", _SCAN)
def scan_blocks(spark, d):
    """The same review of line tables, in blocks of 64 lines: no task sees a whole diff."""
    return _by_risk(spark, d, source=virtual.diffs_in_blocks).select("diff_id", "verdict", "score", "scored", "truncated", "num_chunks", "files_scanned")


@query("k1_m1_reports")
def reports(spark, d):
    scans = _by_risk(spark, d)
    return scans.select("diff_id", render.json_of().alias("json"), render.report(CFG).alias("report"))


# The diffs and their variants that differ, as diffs of their own, reviewed together.
_VARIANTS = f"SELECT diff_id * 4 + k AS diff_id, raw FROM (SELECT diff_id, 0 AS k, raw FROM diffs UNION ALL SELECT v.diff_id, k, v.raw FROM (SELECT diff_id, 1 AS k, raw FROM renamed UNION ALL SELECT diff_id, 2, raw FROM blank UNION ALL SELECT diff_id, 3, raw FROM swapped) v JOIN diffs d ON d.diff_id = v.diff_id AND d.raw <> v.raw)"
_A12 = _scan_sql(_PLACED.replace(virtual.oracle_diffs(), _cte() + _PERTURBED + _VARIANTS), "")


@query("a12_robustness", f"WITH judged AS ({_A12}), c AS (SELECT a.diff_id // 4 AS id, bool_or(b.verdict <> a.verdict) AS flip FROM judged a LEFT JOIN judged b ON b.diff_id // 4 = a.diff_id // 4 AND b.diff_id <> a.diff_id WHERE a.diff_id % 4 = 0 GROUP BY ALL) SELECT count(*) AS diffs, count(*) FILTER (flip) AS changed, count(*) FILTER (flip) / count(*) AS rate FROM c")
def a12(spark, d):
    diffs = virtual.diffs(spark, d)
    judge = lambda x: plans.scan(x, score.rules(F.least(F.lit(100), 10 * F.size(C.keywords(F.col("text"))))), CFG).select("diff_id", "verdict")
    return evaluate.change_rate(evaluate.robustness(diffs, judge), diffs)


_FLAGGED = f"WITH x AS (SELECT e.expected AS e, s.verdict <> 'pass' AS f FROM ({_SCAN}) s JOIN (SELECT cast(floor(doc_id / 10) AS bigint) AS diff_id, max(toxic) = 1 AS expected FROM labels GROUP BY ALL) e USING (diff_id)), m AS (SELECT count(*) FILTER (e AND f) AS tp, count(*) FILTER (NOT e AND f) AS fp, count(*) FILTER (NOT e AND NOT f) AS tn, count(*) FILTER (e AND NOT f) AS fn, count(*) AS n FROM x) SELECT *, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce((tp + tn) / nullif(n, 0), 0), 6) AS accuracy FROM m"


@query("e1_accuracy", _FLAGGED)
def e1(spark, d):
    """A labelled corpus (a diff is to be flagged if one of its documents is labelled toxic), reviewed and counted."""
    labels = spark.read.parquet(f"{d}/labels.parquet").groupBy(F.floor(F.col("doc_id") / 10).alias("diff_id")).agg((F.max("toxic") == 1).alias("expected"))
    m = evaluate.confusion(_by_risk(spark, d).join(labels, "diff_id"))
    return m.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "accuracy")})


@query("k8_empty", "SELECT doc_id AS diff_id, '{\"verdict\":\"pass\",\"score\":0,\"key_changes\":[],\"suspicious_findings\":[],\"reasoning\":\"\"}' AS json FROM documents")
def k8(spark, d):
    """Documents aren't diffs: nothing in them is to be reviewed."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("diff_id"), F.regexp_replace("text", "(?m)^(diff --git|--- |\\+\\+\\+ |@@)", "  $1").alias("raw"))
    return plans.scan(docs, score.rules(F.lit(0)), CFG).select("diff_id", render.json_of().alias("json"))


_SAID = f"""diffs d LEFT JOIN (SELECT diff_id, string_agg(path, ',' ORDER BY rank) FILTER (state = 'truncated') AS cut, string_agg(path, ',' ORDER BY rank) FILTER (state = 'overflow') AS over FROM (SELECT s.g AS diff_id, s.rank, s.state, r.path FROM steps s JOIN ranks r ON r.diff_id = s.g AND r.rank = s.rank) GROUP BY diff_id) USING (diff_id)
LEFT JOIN (SELECT diff_id, string_agg(path, ',' ORDER BY file_no) FILTER (fate = 'lockfile') AS locks, string_agg(path, ',' ORDER BY f_order, file_no) FILTER (fate = 'excluded') AS excluded FROM (SELECT *, CASE WHEN regexp_matches(path, '{_RX["excluded"]}') THEN 0 ELSE 1 END AS f_order FROM fates) GROUP BY diff_id) USING (diff_id)
LEFT JOIN (SELECT diff_id, string_agg(file, ',' ORDER BY l) AS bins FROM (SELECT diff_id, file, min(line_no) AS l FROM meta WHERE starts_with(reason, 'Binary') GROUP BY ALL) GROUP BY diff_id) USING (diff_id)
LEFT JOIN (SELECT diff_id, count(*) AS n_findings, string_agg(file || '>' || reason, '|' ORDER BY file, reason) AS said FROM (SELECT DISTINCT diff_id, file, reason FROM (SELECT diff_id, file, reason FROM meta WHERE reason IS NOT NULL UNION ALL SELECT diff_id, path, '{classify.HAND_EDITED}' FROM fates WHERE fate = 'finding' UNION ALL SELECT f.diff_id, f.path, replace('{classify.NO_MANIFEST}', '%s', m.manifest) FROM first f JOIN m USING (base) WHERE NOT EXISTS (SELECT 1 FROM first g WHERE g.diff_id = f.diff_id AND g.dir = f.dir AND g.base = m.manifest))) GROUP BY diff_id) USING (diff_id)"""


@query("scan_lists", _SCAN[: _SCAN.index("allr AS (")].rstrip().rstrip(",") + f" SELECT diff_id, coalesce(cut, '') AS cut, coalesce(over, '') AS over, coalesce(locks, '') AS locks, coalesce(excluded, '') AS excluded, coalesce(bins, '') AS bins, coalesce(n_findings, 0) AS n_findings, coalesce(said, '') AS said FROM {_SAID}")
def scan_lists(spark, d):
    """What a review lists: paths that were cut, left over, excluded, lockfiles and binary, in their order, and its findings."""
    s, joined = _by_risk(spark, d), lambda c: F.array_join(c, ",")
    said = F.array_join(F.transform(F.array_sort(F.col("suspicious_findings")), lambda f: F.concat(f["file"], F.lit(">"), f["reason"])), "|")
    return s.select("diff_id", joined("files_truncated").alias("cut"), joined("files_unscanned").alias("over"), joined("files_lockfiles").alias("locks"), joined("files_excluded").alias("excluded"), joined("files_binary").alias("bins"), F.size("suspicious_findings").cast("bigint").alias("n_findings"), said.alias("said"))


def top_files(spark: SparkSession, d: str) -> DataFrame:
    """What to review first: the flagship query."""
    files = classify.fates(_files(spark, d))
    ranked = pack.ranked(files.where("fate = 'scan'"))
    return ranked.join(classify.injections(files), "diff_id").select("diff_id", "path", "fate", "priority", "rank", "injection")


query("top_files", _cte() + f", inj AS (SELECT diff_id, bool_or(regexp_matches(file_diff, '{_RX['inj']}') AND NOT regexp_matches(path, '{_RX['exempt']}')) AS injection FROM files GROUP BY diff_id) SELECT diff_id, path, fate, CAST(priority AS INT) AS priority, CAST(rank AS INT) AS rank, injection FROM ranks JOIN inj USING (diff_id)")(top_files)
