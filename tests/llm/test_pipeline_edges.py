"""The pipeline on odd tables: nulls, empty and long texts, repeated rows, clashing columns, no rows; and packing along the slots."""

import collections
import random
import zlib

import pytest

pytest.importorskip("patchlens.llm.queries")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from pyspark.sql import functions as F  # noqa: E402

from patchlens.llm import mixing, neardup, queries  # noqa: E402

R = random.Random(5)
WORDS = [f"v{i}" for i in range(400)]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, pii string, mix int, gone_id int, id_ int, row_ string, slot int, s string, b int, toxic int"
EXTRA = ("p", 1, 2, 3, "r", 4, "s", 5, 6)


def text(n=60):
    return " ".join(R.choices(WORDS, k=n))


@pytest.fixture
def sf_dir(spark, tmp_path):
    labels = [(i, 1, int(i % 5 == 0)) for i in range(60) if zlib.crc32(str(i).encode()) % 4 != 2]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def run(spark, rows, sf_dir):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.mode("overwrite").parquet(f"{sf_dir}/documents.parquet")
    docs, seen = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{sf_dir}/{len(rows)}{name}")
        docs = spark.read.parquet(f"{sf_dir}/{len(rows)}{name}")
        assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
        seen.append(docs.collect())
    return seen, corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()


def test_odd_rows(spark, sf_dir):
    same = text()
    rows = [(i, text() + (" vile crowd" if i % 5 == 0 else ""), "en", f"s{i % 2}", 0, *EXTRA) for i in range(60)]
    rows += [(100, None, None, None, None, *[None] * 9), (101, "", "en", "s0", 0, *EXTRA), (102, " \n\t", "en", "s0", 3, *EXTRA), (103, text(20_000), "xx", "s1", 9, *EXTRA), (None, text(), "en", "s0", 0, *EXTRA)]
    rows += [(104, same, "en", "s0", 0, *EXTRA), (104, same, "de", "s0", 0, *EXTRA), (104, text(), "en", "s0", 0, *EXTRA), (105, same + " 4962251213359604", "en", "s0", 0, *EXTRA)]
    seen, pieces = run(spark, rows, sf_dir)
    ids = [collections.Counter(r.doc_id for r in s) for s in seen]
    good = {i for i in range(60) if i % 5} | {100, 101, 102, 103, None}
    assert ids[0] == collections.Counter([*good, 104, 104, 104, 105]) and ids[1] == collections.Counter([*good, 104, 104]) and ids[1] == ids[2] == ids[3]
    assert {p.doc_id for p in pieces} == {*good, 104} and sum(p.length for p in pieces if p.doc_id == 100) == 1
    assert all(r[5:] == EXTRA for s in seen for r in s if r.doc_id != 100)
    kept = {r.lang for r in seen[1] if r.doc_id == 104 and r.text == same}
    assert len(kept) == 1 and kept == {r.lang for r in neardup.keep_one(spark.read.parquet(f"{sf_dir}/{len(rows)}toxicity").repartition(7)).where("doc_id = 104").collect() if r.text == same}


def test_no_rows(spark, sf_dir):
    seen, pieces = run(spark, [], sf_dir)
    assert not any(seen) and not pieces


def test_packing_follows_the_slots(spark, sf_dir):
    """Read back in any order, documents are packed by ranges of slots: the shares of the sources hold from the first sequences on."""
    rows = [(i, text(30), "en", "big" if i % 3 else "small", 0, *EXTRA) for i in range(3000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    slot = {r.doc_id: r.m.slot for r in mixing.mix(docs, column="m").select("doc_id", "m").collect()}
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")  # several partitions, few as the rows are
    try:
        pieces = queries.packed_in_mixed_order(docs.orderBy(F.desc("doc_id"))).collect()
    finally:
        spark.conf.unset(key)
    parts = collections.defaultdict(list)
    for p in pieces:
        parts[p.sequence_id >> 32].append(slot[p.doc_id])
    order = [parts[k] for k in sorted(parts)]
    assert len(order) > 1 and all(max(a) <= min(b) for a, b in zip(order, order[1:]))


def test_rows_move_once_to_be_ranked(spark):
    """Where slots are too many to be broadcast, they go to the rows' buckets; the rows don't move again to meet them."""
    rows = [(i, text(5), "en", f"s{i % 3}", 0, *EXTRA) for i in range(3000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = {r.doc_id: r.m for r in mixing.mix(docs, column="m").select("doc_id", "m").collect()}
    keys = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    for key in keys:
        spark.conf.set(key, "-1")
    try:
        mixed = mixing.mix(docs, column="m")
        plan = spark.sparkContext._jvm.PythonSQLUtils.explainString(mixed._jdf.queryExecution(), "formatted")
        got = {r.doc_id: r.m for r in mixed.select("doc_id", "m").collect()}
    finally:
        for key in keys:
            spark.conf.unset(key)
    nodes = [n for n in plan.split("\n\n") if " Exchange" in n.split("\n")[0]]
    assert sum("row#" in n or "text#" in n for n in nodes) == 1
    assert got == want
