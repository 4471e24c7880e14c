"""Streams against the batch form of the same operator."""

from pyspark.sql import functions as F

from weftline.operators.collaboration import replayed
from weftline.streaming import pipelines, stateful


def _stream(spark, tmp_path, rows, schema, parts=3):
    path = str(tmp_path / "in")
    df = spark.createDataFrame(rows, schema)
    n = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * n : (i + 1) * n], schema).coalesce(1).write.mode("append").parquet(path)
    return df, spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def _run(stream, mode, tmp_path):
    spark = stream.sparkSession
    query = stream.writeStream.format("memory").queryName("out").outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table("out")


def test_limits_in_a_stream(spark, tmp_path):
    rows = [(i, "ab"[i % 2], i * 130) for i in range(60)]
    batch, stream = _stream(spark, tmp_path, rows, "seq bigint, key string, at_ms bigint")
    step = stateful.anchored_window(3, 1000)
    want = {(r["key"], r["seq"]): r["allowed"] for r in stateful.decided(batch, step).collect()}
    got = {(r["key"], r["seq"]): r["allowed"] for r in _run(stateful.decided_stream(stream, step), "append", tmp_path).collect()}
    assert got == want and set(want.values()) == {True, False}


def test_gap_limit_blocks():
    step, state, told = stateful.gap_limit(2, 100, 1000), None, []
    for at in (0, 50, 90, 500, 1089, 1090, 1095):
        state, ok = step(state, at)
        told.append(ok)
    assert told == [True, True, False, False, False, True, True]


def test_documents_in_a_stream(spark, tmp_path):
    rows = [(i, f"d{i % 3}", ("insert", "delete", "modify")[i % 3 if i > 5 else 0], i % 5, f"t{i}") for i in range(30)]
    batch, stream = _stream(spark, tmp_path, rows, "op_id bigint, document string, kind string, offset bigint, content string", parts=1)
    want = {r["document"]: (r["content"], r["operations"]) for r in replayed(batch, ["op_id"]).collect()}
    got = {r["document"]: (r["content"], r["operations"]) for r in _run(pipelines.replayed_stream(stream), "update", tmp_path).collect()}
    assert got == want


def test_windows_and_duplicates(spark, tmp_path):
    rows = [(i, "view", 1200 + i // 2 * 30) for i in range(40)]
    batch, stream = _stream(spark, tmp_path, rows, "seq bigint, op string, s bigint", parts=1)
    timed = lambda df: df.withColumn("ts", F.timestamp_seconds("s"))
    told = pipelines.run_to_table(pipelines.windowed_throughput(timed(stream), "60 seconds", late="0 seconds"), "t")
    assert {r["events"] for r in told.collect()} == {4} and told.count() == 9
    once = pipelines.run_to_table(pipelines.deduplicated(timed(stream), ["s"], "1 hour"), "d")
    assert once.count() == 20


def test_delivery(spark, tmp_path):
    _, stream = _stream(spark, tmp_path, [(1, "view"), (2, "error")], "seq bigint, kind string", parts=1)
    permissions = spark.createDataFrame([("admin", "view"), ("admin", "error"), ("guest", "view")], "role string, kind string")
    got = []
    query = pipelines.broadcast_events(stream, permissions, lambda df, n: got.extend((r["role"], r["seq"]) for r in df.collect()), str(tmp_path / "c"))
    query.processAllAvailable()
    query.stop()
    assert sorted(got) == [("admin", 1), ("admin", 2), ("guest", 1)]
