import time
import uuid

from ramify.streaming.group_tuple import group_tuple_stream, windowed_counts


def run(df, mode="append"):
    name = "t" + uuid.uuid4().hex
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    return df.sparkSession.table(name).collect()


def run_until(df, rows):
    """With processing-time timeouts a query goes on while there is state; it is stopped once the rows are there."""
    name = "t" + uuid.uuid4().hex
    q = df.writeStream.format("memory").queryName(name).outputMode("append").start()
    end = time.time() + 60
    while time.time() < end and q.isActive and df.sparkSession.table(name).count() < rows:
        time.sleep(0.5)
    got = df.sparkSession.table(name).collect()
    q.stop()
    return got


def test_groups_are_emitted_when_full(spark, tmp_path):
    spark.createDataFrame([("a", i) for i in range(5)] + [("b", 9)], "k string, v long").repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, v long").parquet(str(tmp_path / "in"))
    rows = run_until(group_tuple_stream(stream, "k", "v", 2), 2)
    assert sorted((r["k"], sorted(r["values"]), r["complete"]) for r in rows if r["complete"])[0][0] == "a"
    assert sum(len(r["values"]) for r in rows) == 4 and all(r["complete"] for r in rows)


def test_windows(spark, sf):
    stream = spark.readStream.schema(spark.read.parquet(f"{sf}/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    rows = run(windowed_counts(stream.withColumn("ts", stream["ts"].cast("timestamp")), "ts", "event_type"), "complete")
    assert sum(r["count"] for r in rows) == 1000
