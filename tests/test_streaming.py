from sortament.streaming.ingest import append_stream, first_seen, load_line_stream, stream_table, windowed_counts
from tests.conftest import rows


def test_append_stream_writes_each_key_once(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k long, v string")
    df.coalesce(1).write.parquet(source)
    for _ in range(2):
        append_stream(stream_table(spark, source, df, files_per_batch=1), target, "k", state).awaitTermination()
        df.coalesce(1).write.mode("append").parquet(source)
    append_stream(stream_table(spark, source, df), target, "k", state).awaitTermination()
    assert rows(spark.read.parquet(target)) == [(1, "a"), (2, "b")]


def test_line_stream(spark, tmp_path):
    source, good, bad, state = (str(tmp_path / n) for n in ("in", "good", "bad", "state"))
    df = spark.createDataFrame([(1, "a;Труба;1;2;;"), (2, "x")], "line_id long, raw_line string")
    df.write.parquet(source)
    load_line_stream(stream_table(spark, source, df), "line_id", "raw_line", good, bad, state).awaitTermination()
    assert rows(spark.read.parquet(bad)) == [(2, "column_count")] and spark.read.parquet(good).count() == 1


def test_watermarked(spark, tmp_path):
    source = str(tmp_path / "in")
    df = spark.sql("SELECT timestamp'2025-01-01 10:00:00' AS ts, 'a' AS g, 1 AS k UNION ALL SELECT timestamp'2025-01-01 10:03:00', 'a', 1 UNION ALL SELECT timestamp'2025-01-01 12:00:00', 'b', 2")
    df.write.parquet(source)
    stream = stream_table(spark, source, df)
    for name, query in (("w", windowed_counts(stream, "ts", "g", width="10 minutes", slide="5 minutes", late="1 hour")), ("f", first_seen(stream, "k", "ts", "1 hour"))):
        run = query.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        run.awaitTermination()
    assert spark.table("f").count() == 2
    assert {(r.g, r.rows) for r in spark.table("w").collect()} <= {("a", 2), ("a", 1), ("b", 1)}
