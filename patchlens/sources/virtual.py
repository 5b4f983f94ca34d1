"""Diffs derived from the tables `documents` and `conversations`, by SQL that both engines read.

Ten documents make a diff; a document's place gives its path, mode lines and whether it is binary. In each template
{string} is the engine's string type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import parse

PATHS = (".github/workflows/ci.yml", "node_modules/pkg/index.js", "dist/bundle.js", "package-lock.json", "package.json", "scripts/run.sh", "src/module.py", "tests/test_module.py", "sub/yarn.lock", "vendor/lib.go", "src/app.min.js", "docs/guide.md", "src/api/client.ts")
_PATH = "CASE (doc_id * 7 + cast(floor(doc_id / 10) AS bigint)) % 13 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PATHS)) + " END"

#: doc_id, diff_id, file_no, path, body of each document.
FILES = f"""
SELECT doc_id, diff_id, file_no, path,
  concat('diff --git a/', path, ' b/', path, chr(10),
    CASE WHEN doc_id % 17 = 0 THEN concat('new file mode 100755', chr(10)) WHEN doc_id % 17 = 1 THEN concat('old mode 100644', chr(10), 'new mode 100755', chr(10)) ELSE '' END,
    'index 1..2', chr(10),
    CASE WHEN doc_id % 23 = 0 THEN concat('Binary files a/', path, ' and b/', path, ' differ', chr(10))
         ELSE concat('--- a/', path, chr(10), '+++ b/', path, chr(10), '@@ -1 +1 @@', chr(10), '+', replace(text, chr(10), concat(chr(10), '+')), chr(10)) END) AS body
FROM (SELECT doc_id, cast(floor(doc_id / 10) AS bigint) AS diff_id, doc_id % 10 AS file_no, {_PATH} AS path, coalesce(text, '') AS text FROM documents)
"""

#: The same for conversations: one file for each turn, of which the system's trip the wire.
CHATS = """
SELECT conv_id AS diff_id, turn AS file_no, path,
  concat('diff --git a/', path, ' b/', path, chr(10), '--- a/', path, chr(10), '+++ b/', path, chr(10), '@@ -1 +1 @@', chr(10), '+', role, ': ', replace(text, chr(10), concat(chr(10), '+')), chr(10)) AS body
FROM (SELECT conv_id, turn, role, text, CASE WHEN conv_id % 3 = 0 THEN concat('tests/chat_', cast(turn AS {string}), '.txt') ELSE concat('src/chat_', cast(turn AS {string}), '.txt') END AS path FROM conversations)
"""

#: All documents as stretches of one diff: a file for ten of them, so most have no header, hunk or mode line of their own.
ONE_DIFF = f"""
SELECT doc_id, concat(
    CASE WHEN doc_id % 10 = 0 THEN concat('diff --git a/', path, ' b/', path, chr(10), CASE WHEN doc_id % 20 = 0 THEN concat('new file mode 100755', chr(10)) ELSE '' END, '--- a/', path, chr(10), '+++ b/', path, chr(10),
      CASE WHEN doc_id % 30 = 10 THEN '' ELSE concat('@@ -1 +1 @@', chr(10)) END) ELSE '' END,
    CASE WHEN doc_id % 13 = 0 THEN concat('Binary files a/', path, ' and b/', path, ' differ', chr(10)) ELSE '' END,
    '+', replace(text, chr(10), concat(chr(10), '+')), chr(10), CASE WHEN doc_id % 7 = 0 THEN concat('no content', chr(10)) ELSE '' END) AS body
FROM (SELECT doc_id, {_PATH} AS path, coalesce(text, '') AS text FROM documents)
"""


def _view(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for n in names:
        spark.read.parquet(f"{sf_dir}/{n}.parquet").createOrReplaceTempView(n)


def _diffs(files: DataFrame) -> DataFrame:
    body = F.transform(F.array_sort(F.collect_list(F.struct("file_no", "body"))), lambda s: s["body"])
    return files.groupBy("diff_id").agg(F.array_join(body, "").alias("raw"))


def diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    _view(spark, sf_dir, "documents")
    return _diffs(spark.sql(FILES))


def diffs_in_blocks(spark: SparkSession, sf_dir: str, block_lines: int = 64) -> DataFrame:
    """The line table of diffs()."""
    lines = parse.lines(parse.sanitize(diffs(spark, sf_dir)))
    return lines.select("diff_id", F.floor(F.col("line_no") / block_lines).alias("block"), F.col("line_no").cast("bigint").alias("line_no"), "full", "text")


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    _view(spark, sf_dir, "conversations")
    return _diffs(spark.sql(CHATS.replace("{string}", "string")))


def one_diff(spark: SparkSession, sf_dir: str, block_lines: int = 64) -> DataFrame:
    """The line table of ONE_DIFF; a block has so many lines of a document at most, but for the sixteenth, which has the rest of these."""
    _view(spark, sf_dir, "documents")
    bodies = parse.sanitize(spark.sql(ONE_DIFF).withColumnRenamed("doc_id", "diff_id"), "body")
    lines = parse.lines(bodies).withColumnsRenamed({"diff_id": "doc_id", "line_no": "at"})
    block = F.col("doc_id") * 16 + F.least(F.floor(F.col("at") / block_lines), F.lit(15))
    return lines.select(F.lit(1).cast("bigint").alias("diff_id"), block.alias("block"), (F.col("doc_id") * F.lit(1 << 32) + F.col("at")).alias("line_no"), "doc_id", "full", "text")


def oracle_diffs(files: str = FILES) -> str:
    """DuckDB's SQL of the same diffs."""
    return f"SELECT diff_id, string_agg(body, '' ORDER BY file_no) AS raw FROM ({files.replace('{string}', 'varchar')}) GROUP BY diff_id"
