import sparkrel as s
from sparkrel import types as T
from sparkrel.streaming import parquet_stream

clicks = s.Table("clicks", {"user": T.bigint(), "kind": T.text()})


def test_select_runs_over_a_stream(spark, tmp_path):
    rows = [(1, "a"), (2, "b"), (1, "a"), (3, None)]
    spark.createDataFrame(rows, clicks.struct).write.parquet(f"{tmp_path}/in")
    db = s.Engine(spark, s.Frames({"clicks": parquet_stream(spark, f"{tmp_path}/in", clicks)}), [clicks])
    df = db.from_(clicks).select({"k": clicks.kind, "n": s.count("*")}).where(s.is_not_null(clicks.kind)).df
    assert df.isStreaming
    q = df.writeStream.format("memory").queryName("clicked").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("clicked").collect())) == [("a", 2), ("b", 1)]
