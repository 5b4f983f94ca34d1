"""The pipeline on a small table: what each stage drops, keeps and changes."""

import zlib

import pytest

pytest.importorskip("patchlens.llm.queries")
corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    import random

    r = random.Random(5)
    words = [f"v{i}" for i in range(400)]
    text = lambda: " ".join(r.choices(words, k=60))
    rows = [(i, text() + (" vile crowd" if i % 5 == 0 else ""), "en", f"s{i % 2}", 0) for i in range(100)]
    rows += [(100, rows[1][1], "en", "s0", 0), (101, text() + " 4962251213359604", "en", None, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, int(i % 5 == 0)) for i in range(100) if zlib.crc32(str(i).encode()) % 4 != 2]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, ids = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        ids.append({x.doc_id for x in docs.select("doc_id").collect()})
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "pii":
            assert "4962251213359604" not in docs.where("doc_id = 101").first().text
    want = {i for i in range(102) if i >= 100 or i % 5}
    assert ids[0] == want and ids[1] == want - {100} and ids[2] == ids[3] == ids[4] == ids[1]
