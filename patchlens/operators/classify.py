"""What becomes of each file: scanned, excluded by policy, or judged by rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import columns as C
from ..functions import patterns as P

HAND_EDITED = "Build output changed without a change of source: a shipped artifact may have been edited by hand."
NO_MANIFEST = "Lockfile changed without a change of its manifest %s in the same directory."
PLAIN_HTTP = "Lockfile resolves a dependency over plain HTTP: http://%s"
FOREIGN_HOST = "Lockfile resolves a dependency from the non-canonical host `%s`."
OFF_REGISTRY = "Lockfile takes a dependency from a local path or a repository instead of a registry: %s"


def by_path(path: Column) -> Column:
    """What a path alone tells of a file's fate: lockfile, excluded, build (by the other files, excluded or finding) or scan."""
    return F.when(C.is_lockfile(path), "lockfile").when(C.is_excluded(path), "excluded").when(C.is_build_output(path), "build").otherwise("scan")


def fates(files: DataFrame) -> DataFrame:
    """Adds fate: lockfile, excluded, finding (build output that changed alone) or scan."""
    first = by_path(F.col("path"))
    scanned = F.max(F.col("first") == "scan").over(Window.partitionBy("diff_id"))
    return files.withColumn("first", first).withColumn("fate", F.when(F.col("first") != "build", F.col("first")).when(scanned, "excluded").otherwise("finding")).drop("first")


def canonical_hosts(hosts: DataFrame, domains: DataFrame) -> DataFrame:
    """host, canonical of each distinct host: whether it, or a domain that it is below, is one of domains (domain; of any number).

    A host is taken apart into the domains that it is below, so an allowlist is one more hash join and no comparison of
    each host with each domain.
    """
    own = hosts.select("host").distinct()
    labels = F.split(F.lower("host"), r"\.")
    below = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    listed = domains.select(F.lower("domain").alias("domain")).distinct()
    met = own.select("host", F.explode(below).alias("domain")).join(listed, "domain", "left_semi").select("host").distinct()
    return own.join(met.withColumn("canonical", F.lit(True)), "host", "left").withColumn("canonical", F.coalesce("canonical", F.lit(False)))


def lock_events(added: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Rule hits of added lockfile lines (diff_id, file_no, path, line_no, line) in order, each key once for a file, the first 25."""
    url = lambda u: F.struct(F.substring_index(u, "://", 1).alias("scheme"), F.substring_index(u, "://", -1).alias("host"))
    urls = F.transform(F.regexp_extract_all("line", F.lit(P.URL), F.lit(0)), url)
    event = lambda kind, key, shown, hit: F.struct(F.lit(kind).alias("kind"), key.alias("key"), shown.alias("shown"), hit.alias("hit"))
    of_url = lambda u: F.array(event("http", F.lower(u["host"]), u["host"], u["scheme"] == "http"), event("host", F.lower(u["host"]), u["host"], ~C.is_canonical(u["host"], cfg.registries)))
    bare = C.strip(F.col("line"))
    dep = F.array(event("dep", F.substring(bare, 1, 80), F.substring(bare, 1, 120), C.is_off_registry(F.col("line"))))
    some = F.filter(F.concat(F.flatten(F.transform(urls, of_url)), dep), lambda e: e["hit"])
    hits = added.where(C.is_lockfile(F.col("path"))).select("diff_id", "file_no", "path", "line_no", F.posexplode(some).alias("at", "e"))
    once = Window.partitionBy("diff_id", "file_no", "e.kind", "e.key").orderBy("line_no", "at")
    order = Window.partitionBy("diff_id", "file_no").orderBy("line_no", "at")
    first = hits.withColumn("n", F.row_number().over(once)).where("n = 1").withColumn("seq", F.row_number().over(order)).where(F.col("seq") <= P.MAX_LOCK_FINDINGS)
    reason = F.when(F.col("e.kind") == "http", F.format_string(PLAIN_HTTP, "e.shown")).when(F.col("e.kind") == "host", F.format_string(FOREIGN_HOST, "e.shown")).otherwise(F.format_string(OFF_REGISTRY, "e.shown"))
    return first.select("diff_id", "file_no", F.col("path").alias("file"), "seq", F.col("e.kind").alias("kind"), F.col("e.key").alias("key"), reason.alias("reason"))


def manifests(spark) -> DataFrame:
    named = F.create_map(*[F.lit(x) for kv in P.MANIFESTS.items() for x in kv])
    return spark.range(0, 1, 1, 1).select(F.explode(named).alias("base", "manifest"))  # no list, which Python's workers would read


def locks_without_manifest(files: DataFrame) -> DataFrame:
    """diff_id, file_no, path, manifest of lockfiles whose manifest didn't change in the same directory."""
    placed = files.select("diff_id", "file_no", "path", C.dirname(F.col("path")).alias("dir"), C.basename(F.col("path")).alias("base"))
    locks = placed.join(F.broadcast(manifests(files.sparkSession)), "base")  # ten rows
    changed = placed.select("diff_id", "dir", F.col("base").alias("manifest"))
    return locks.join(changed, ["diff_id", "dir", "manifest"], "left_anti").select("diff_id", "file_no", "path", "manifest")


def rule_findings(fated: DataFrame, added: DataFrame, cfg: Config = Config()) -> DataFrame:
    """diff_id, part, file_no, seq, file, reason: lockfile lines, then build output, then manifests, each in diff order."""
    locked = lock_events(added, cfg).select("diff_id", F.lit(1).alias("part"), "file_no", "seq", "file", "reason")
    built = fated.where("fate = 'finding'").select("diff_id", F.lit(2).alias("part"), "file_no", F.lit(1).alias("seq"), F.col("path").alias("file"), F.lit(HAND_EDITED).alias("reason"))
    alone = locks_without_manifest(fated).select("diff_id", F.lit(3).alias("part"), "file_no", F.lit(1).alias("seq"), F.col("path").alias("file"), F.format_string(NO_MANIFEST, "manifest").alias("reason"))
    return locked.unionByName(built).unionByName(alone)


def bootstraps(fated: DataFrame, cfg: Config = Config()) -> DataFrame:
    """diff_id, scannable, added_lines, bootstrap: whether what is to be scanned is as large as a first import."""
    sums = fated.where("fate = 'scan'").groupBy("diff_id").agg(F.count("*").alias("scannable"), F.sum("added_lines").alias("added_lines"))
    return sums.withColumn("bootstrap", (F.col("scannable") > cfg.bootstrap_files) | (F.col("added_lines") > cfg.bootstrap_added_lines))


def injections(files: DataFrame, cfg: Config = Config()) -> DataFrame:
    """diff_id, injection: whether a file outside exempt paths has a marker anywhere in its diff."""
    return files.groupBy("diff_id").agg(F.bool_or(C.is_injection(F.col("file_diff")) & ~C.is_exempt(F.col("path"), cfg)).alias("injection"))
