import hashlib

from pyspark.sql import functions as F

from cairn.streaming import apply_operations, deduplicated_parts, live_stats, maintain_stats, session_progress
from cairn.streaming.oplog import current, totals
from cairn.streaming.uploads import add_range


def test_add_range():
    starts, stops = [], []
    for a, b in [(5, 7), (0, 2), (2, 4), (9, 9), (-1, 3), (3, 6)]:
        starts, stops = add_range(starts, stops, a, b)
    assert (starts, stops) == ([0], [7])


def _stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_session_progress(spark, tmp_path):
    schema = "session string, start long, stop long, size long, ts timestamp, data binary, sha256 string"
    src = tmp_path / "parts"
    sha = hashlib.sha256(b"01234").hexdigest()
    batches = [
        [("a", 0, 5, 10, "2024-01-01 00:00:00", b"01234", sha), ("b", 0, 4, 8, "2024-01-01 00:00:00", None, None), ("b", 7, 9, 8, "2024-01-01 00:00:00", None, None)],
        [("a", 5, 10, 10, "2024-01-01 00:10:00", b"01234", sha.upper()), ("b", 6, 8, 8, "2024-01-01 00:10:00", None, None), ("c", 0, 5, 5, "2024-01-01 00:10:00", b"wrong", sha)],
        [("d", 0, 1, 2, "2024-01-01 09:00:00", None, None)],
        [("d", 0, 1, 2, "2024-01-01 09:00:00", None, None)],
    ]
    for k, rows in enumerate(batches):
        made = spark.createDataFrame(rows, "session string, start long, stop long, size long, t string, data binary, sha256 string").withColumn("ts", F.col("t").cast("timestamp")).drop("t")
        made.coalesce(1).write.parquet(str(src / f"n={k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
    for _ in range(2):  # a second run finds nothing new and gives the state back from the checkpoint
        q = session_progress(stream).writeStream.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}")).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(120) and q.exception() is None
    got = {(r.session, r.received, r.state) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {("a", 5, "open"), ("b", 4, "open"), ("a", 10, "complete"), ("b", 6, "open"), ("b", 6, "expired"), ("d", 1, "open")}


def test_retries_are_dropped(spark, tmp_path):
    src = tmp_path / "parts"
    rows = [("a", 0, 5, "2024-01-01 00:00:00"), ("a", 0, 5, "2024-01-01 00:01:00"), ("a", 5, 9, "2024-01-01 00:01:00")]
    spark.createDataFrame(rows, "session string, start long, stop long, t string").selectExpr("session", "start", "stop", "cast(t AS timestamp) AS ts").coalesce(1).write.parquet(str(src))
    out = deduplicated_parts(_stream(spark, src, "session string, start long, stop long, ts timestamp"))
    q = out.writeStream.format("memory").queryName("parts").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("parts").count() == 2


def test_operation_stream(spark, tmp_path):
    schema = "ns string, key string, op string, ts long, version long, size long"
    src = tmp_path / "ops"
    for rows in ([("a", "k", "put", 1, 1, 10), ("a", "j", "put", 1, 2, 5)], [("a", "k", "put", 2, 3, 7), ("a", "j", "delete", 2, 4, 0)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
    for start, name in ((apply_operations, "log"), (maintain_stats, "stats")):
        start(_stream(spark, src, schema), str(tmp_path / name), str(tmp_path / f"cp-{name}")).awaitTermination()
        start(_stream(spark, src, schema), str(tmp_path / name), str(tmp_path / f"cp-{name}")).awaitTermination()
    assert [(r.key, r["size"]) for r in current(spark, str(tmp_path / "log")).collect()] == [("k", 7)]
    assert tuple(live_stats(spark, str(tmp_path / "log")).first()) == ("a", 1, 7)
    assert tuple(totals(spark, str(tmp_path / "stats")).first()) == ("a", 3, 22)
