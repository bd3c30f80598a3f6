from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from sparkrel.llm import blocks, shared


def test_folder_is_the_sessions():
    session = SimpleNamespace(conf={shared.KEY: "hdfs://name/dir/"})
    assert shared.folder(session) == "hdfs://name/dir"


def test_kept_tables(spark):
    kept = shared.keep(spark.range(5), "five")
    assert kept.count() == 5 and all(f"{shared.folder(spark)}/sparkrel-five-" in f for f in kept.inputFiles())
    since = len(shared.made) - 1
    more = shared.keep(spark.range(3), "three")
    shared.sweep(spark, since, more)
    exists = lambda df: [spark.sparkContext._jvm.java.io.File(f.removeprefix("file:")).exists() for f in df.inputFiles()]
    assert not any(exists(kept)) and all(exists(more)) and more.count() == 3


def test_a_cluster_needs_a_shared_folder():
    context = SimpleNamespace(getConf=lambda: {}, getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(ValueError):
        shared.folder(SimpleNamespace(conf={}, sparkContext=context))


def test_one_row_group_is_spread(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    spark.range(100).repartition(9).write.parquet(str(tmp_path / "many"))
    one, many = (spark.read.parquet(str(tmp_path / x)) for x in ("one", "many"))
    assert shared.spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and shared.spread(one).count() == 100
    assert shared.spread(many) is many


def test_batches_are_bounded(spark):
    spark.conf.set(shared.BATCH_KEY, "1048576")
    shared.bounded_batches(spark)
    assert int(spark.conf.get(shared.BATCH_KEY).rstrip("b")) == 1048576
    spark.conf.unset(shared.BATCH_KEY)
    shared.bounded_batches(spark)
    assert int(spark.conf.get(shared.BATCH_KEY).rstrip("b")) == shared.BATCH_BYTES


def test_blocks_cover_slices_and_nulls():
    texts = ["ab", None, "", "céd", "x" * 50]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(["pad", "pad", *texts])], names=["i", "i"]).slice(2)
    got = [(i, bytes(b.data[b.starts[k] : b.starts[k + 1]]).decode()) for b in blocks.blocks([batch], max_bytes=5) for k, i in enumerate(b.ids.to_pylist())]
    assert got == [(k + 2, t or "") for k, t in enumerate(texts)]
    assert list(blocks.blocks([batch.slice(0, 0)])) == []


def test_span_hashes_depend_on_content_alone():
    data = np.frombuffer(b"Word word xword WORD drow", np.uint8)
    h = blocks.prefix_hash(data)
    at = np.array([0, 5, 11, 16, 21])
    got = blocks.span_hash(h, at, at + 4)
    assert len(set(got[:4].tolist())) == 1 and got[4] != got[0]
