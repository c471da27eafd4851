"""Metrics that expire by age: late rows, expired slots, restarts."""

from datetime import datetime, timedelta

from formulake.streaming import expiry

NOON = datetime(2024, 5, 1, 12)
SCHEMA = "at timestamp, op string, seconds double"


def run(spark, tmp_path, n, *rows):
    """Adds a file of rows (minutes after noon, operation, seconds) and runs the stream."""
    spark.createDataFrame([(None if m is None else NOON + timedelta(minutes=m), op, s) for m, op, s in rows], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    events = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    query = expiry.follow_metrics(expiry.expiring_metrics(events, "at", "op", "seconds", 2, "10 minutes", shards=3), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    query.awaitTermination()
    assert query.exception() is None
    return {r["operation"]: (r["n"], r["mean"], r["least"], r["most"]) for r in expiry.newest(spark.read.parquet(f"{tmp_path}/out")).collect()}


def test_expiry(spark, tmp_path):
    assert run(spark, tmp_path, 0, (0, "a", 1.0), (0.5, "a", 3.0), (1, "b", 5.0), (30, "a", 2.0), (None, "a", 9.0), (3, None, 9.0), (3, "a", None)) == {"a": (3, 2.0, 1.0, 3.0), "b": (1, 5.0, 5.0, 5.0)}
    # A restart goes on with the state; a row that is late, but within the watermark's delay or the age, still counts.
    assert run(spark, tmp_path, 1, (60, "a", 6.0), (25, "b", 1.0)) == {"a": (4, 3.0, 1.0, 6.0), "b": (2, 3.0, 1.0, 5.0)}
    # At 14:15 the watermark is 14:05: what ended before 12:05 is gone.
    assert run(spark, tmp_path, 2, (135, "c", 7.0)) == {"a": (2, 4.0, 2.0, 6.0), "b": (1, 1.0, 1.0, 1.0), "c": (1, 7.0, 7.0, 7.0)}
    # Too late for its slot; nothing changes.
    assert run(spark, tmp_path, 3, (2, "a", 100.0))["a"] == (2, 4.0, 2.0, 6.0)
    # Operations without recent rows go.
    assert run(spark, tmp_path, 4, (600, "c", 1.0)) == {"c": (1, 1.0, 1.0, 1.0)}


def test_recent(spark):
    rows = spark.createDataFrame([(NOON + timedelta(hours=h), "a", float(h)) for h in range(10)], SCHEMA)
    assert [r["n"] for r in expiry.recent_metrics(rows, "at", "op", "seconds", 3).collect()] == [3]
    assert [r["n"] for r in expiry.recent_metrics(rows, "at", "op", "seconds", 3, NOON + timedelta(hours=5)).collect()] == [7]
    assert expiry.recent_metrics(rows.limit(0), "at", "op", "seconds", 3).collect() == []
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert "GreaterThan(ts," in expiry.recent(events, "ts", 5)._jdf.queryExecution().executedPlan().toString()


def test_many_slots_go_at_once(spark, tmp_path):
    """Two thousand slots expire with one step of the watermark: an operation is told anew once, not for each slot."""
    rows = [(m, "a", float(m)) for m in range(2000)]
    assert run(spark, tmp_path, 0, *rows)["a"][0] == 131  # newest 1999, watermark 1989: slots that end after 1869
    told = spark.read.parquet(f"{tmp_path}/out")
    assert told.count() == 6 and told.groupBy("shard").count().filter("count = 2").count() == 3
    assert run(spark, tmp_path, 1, (1995, "a", 5000.0), (1860, "a", 9000.0))["a"] == (132, (sum(range(1869, 2000)) + 5000.0) / 132, 1869.0, 5000.0)
