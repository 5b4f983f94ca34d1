"""Stress diffs of known shapes, made from a range."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def repo_init_sql(n: str) -> str:
    """SQL of both engines: file_no, path, n_lines of a first import of n files; sizes follow from n alone.

    One workflow, two fifths source modules, up to five minified bundles, one lockfile of five lines for each of 50 entries at
    least, and vendored files for the rest.
    """
    src = f"greatest(1, cast(floor({n} * 2 / 5) as bigint))"
    mini = f"least(5, greatest(0, {n} - 2 - {src}))"
    vendored = f"({n} - 2 - {src} - {mini})"
    return f"""SELECT i AS file_no,
      CASE WHEN i = 0 THEN '.github/workflows/ci.yml'
           WHEN i <= {src} THEN concat('src/module_', cast(i - 1 AS string), '.py')
           WHEN i <= {src} + {mini} THEN concat('assets/bundle_', cast(i - 1 - {src} AS string), '.min.js')
           WHEN i < {n} - 1 THEN concat('node_modules/pkg_', cast(i - 1 - {src} - {mini} AS string), '/index.js')
           ELSE 'package-lock.json' END AS path,
      CASE WHEN i = 0 THEN 8 WHEN i <= {src} THEN 7 WHEN i <= {src} + {mini} THEN 1 WHEN i < {n} - 1 THEN 3
           ELSE 5 * greatest(50, {vendored}) END AS n_lines"""


def repo_init(spark: SparkSession, n_files: int = 500) -> DataFrame:
    """file_no, path, n_lines."""
    n = max(4, n_files)
    sql = repo_init_sql(f"cast({n} as bigint)")
    return spark.sql(f"{sql} FROM (SELECT id AS i FROM range({n}))")


def chunk_stress(spark: SparkSession, modules: int = 5, functions: int = 55, large: int = 130) -> DataFrame:
    """file_no, path, n_lines: a workflow, modules of seven lines for each function, and a larger one."""
    n = F.when(F.col("id") == 0, 8).when(F.col("id") <= modules, 7 * functions).otherwise(7 * large).cast("bigint")
    path = F.when(F.col("id") == 0, F.lit(".github/workflows/release.yml")).when(F.col("id") <= modules, F.concat(F.lit("src/part_"), (F.col("id") - 1).cast("string"), F.lit(".py"))).otherwise("src/large.py")
    return spark.range(modules + 2).select(F.col("id").alias("file_no"), path.alias("path"), n.alias("n_lines"))


def as_diff(shape: DataFrame, diff_id: int = 1) -> DataFrame:
    """diff_id, raw: new files of the shape's paths and numbers of lines."""
    body = F.array_join(F.transform(F.sequence(F.lit(1), F.col("n_lines").cast("int")), lambda i: F.concat(F.lit("+value_"), i.cast("string"), F.lit(" = "), i.cast("string"), F.lit("\n"))), "")
    head = F.concat(F.lit("diff --git a/"), "path", F.lit(" b/"), "path", F.lit("\nnew file mode 100644\n--- /dev/null\n+++ b/"), "path", F.lit("\n@@ -0,0 +1,"), F.col("n_lines").cast("string"), F.lit(" @@\n"))
    one = shape.groupBy().agg(F.array_sort(F.collect_list(F.struct("file_no", F.concat(head, body).alias("x")))).alias("files"))
    return one.select(F.lit(diff_id).cast("bigint").alias("diff_id"), F.array_join(F.transform("files", lambda f: f["x"]), "").alias("raw"))
