"""What operators hold, store and start, apart from their results."""

import os
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("versicle.llm")
from versicle.llm import common, piece_codec, pii_surrogates, queries, shingle_join  # noqa: E402


def test_hashing_holds_little():
    texts = [" ".join(f"word{i % 5000}" for i in range(k, k + 100_000)) for k in range(8)]
    tracemalloc.start()
    try:
        assert sum(1 for _ in shingle_join.shingle_sets(iter(texts), 5)) == 8
        assert tracemalloc.get_traced_memory()[1] < 30 << 20
    finally:
        tracemalloc.stop()


def test_sketch_in_parts(spark, monkeypatch):
    rows = spark.createDataFrame([(f"a b c d {i % 7}",) for i in range(90)] + [(None,), ("",)], "text string")
    whole = shingle_join.sketch(rows, 4)
    assert whole.max() == shingle_join._magnitude(np.array([90]))[0]
    run = shingle_join.sketch.__globals__
    monkeypatch.setitem(run, "_COUNTED", 3)
    assert (shingle_join.sketch(rows, 4) == whole).all()


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_slices(kind):
    texts = ["x" * 40, None, "", "y" * 300, "é" * 50, None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, kind)], names=["text"])
    parts = list(common.slices(batch.slice(1), "text", 100))
    assert [t for p in parts for t in p.column("text").to_pylist()] == texts[1:] and len(parts) == 3
    assert list(common.slices(batch.slice(6), "text")) == []


def test_stored_leaves_no_shuffle_files(spark):
    dirs = [d.getPath() for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {f for d in dirs for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}
    rows, before = spark.range(5000).withColumn("k", F.col("id") % 9), files()
    out = common.stored(rows.groupBy("k").agg(F.sum("id").alias("s")).orderBy("s"))
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert out.count() == 9 and spark.conf.get(common.CLEANUP, None) is None


def test_surrogates_are_stored_in_few_files(spark, monkeypatch):
    parts = []
    monkeypatch.setattr(pii_surrogates, "cut", lambda df: parts.append(df.rdd.getNumPartitions()) or common.cut(df))
    conf = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        rows = spark.createDataFrame([(i, f"Write to a{i}@b.org or call Mr. Xu{chr(97 + i)}") for i in range(26)], "doc_id long, text string")
        got = pii_surrogates.query(rows).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len({r["text"] for r in got}) == 26 and all(r["n_entities"] == 2 for r in got)
    assert max(parts) <= 4


def test_frequent_words_stay_encoded(monkeypatch):
    monkeypatch.setattr(piece_codec, "CACHED_WORDS", 100)
    monkeypatch.setattr(piece_codec, "BLOCK_CHARS", 200)
    c = piece_codec.PieceCodec(queries.model_bytes())
    merged, merge = [], c.merge
    monkeypatch.setattr(c, "merge", lambda words: merged.extend(words) or merge(words))
    texts = [f"again and again rare{i} word{i * 7}" for i in range(300)]
    got = [x.tolist() for x in c.encode(texts)]
    assert merged.count(piece_codec.SPACE + "and") == 1 and len(c.index) <= 200
    assert got == [next(iter(piece_codec.PieceCodec(queries.model_bytes()).encode([t]))).tolist() for t in texts[:1]] + got[1:]
