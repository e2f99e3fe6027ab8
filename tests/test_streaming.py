"""Streams give the rows that the batch operators give."""

from pyspark.sql import functions as F

from tickloom.operators.ledger import queue_replay, queue_step
from tickloom.streaming import replay


def test_queue_waterfall_by_hand():
    state = {"levels": {}, "shown": {}, "orders": {}}
    step = lambda *a: queue_step(state, *a)
    step("level", 1, 0, 50, 100.0)
    step("join", 2, 7, 50, 10.0)
    assert state["orders"][7]["ahead"] == 100
    step("level", 3, 0, 50, 40.0)  # the queue ahead can only shorten
    assert state["orders"][7]["ahead"] == 40
    step("trade", 500, 0, 50, 30.0)  # the book showed 60 gone less than 800 ms ago: the print is that
    assert state["orders"][7] | {"filled": 0.0, "ahead": 40.0} == state["orders"][7]
    step("trade", 5000, 0, 50, 45.0)  # the rest of the ledger is too old: 40 ahead, then 5 for us
    assert (state["orders"][7]["filled"], state["orders"][7]["ahead"], state["orders"][7]["state"]) == (5.0, 0.0, "live")
    step("cancel", 6000, 7, 0, 0.0)
    step("trade", 6500, 0, 50, 2.0)  # still exposed
    step("trade", 6900, 0, 50, 9.0)  # no longer
    assert (state["orders"][7]["filled"], state["orders"][7]["state"]) == (7.0, "cancelled")


def source(spark, tmp_path, rows):
    cols = "market_id bigint, ts_ms bigint, seq bigint, kind string, order_id bigint, tick bigint, size double, close_ms bigint"
    df = spark.createDataFrame(rows, cols)
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(cols).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    return df, stream.withColumn("ts", F.timestamp_millis("ts_ms"))


def test_queue_stream_equals_batch(spark, tmp_path):
    import random

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", replay.ROCKS)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    rng = random.Random(3)
    rows = []
    for m in (1, 2, 3):
        for i in range(80):
            kind = rng.choice(["level", "join", "trade", "trade", "cancel"])
            rows.append((m, 1000 + i * 300, i, kind, i if kind == "join" else rng.randrange(max(i, 1)), rng.randrange(3), float(rng.randrange(1, 40)), 40_000))
    rows.append((99, 10_000_000, 0, "level", 0, 0, 1.0, 20_000_000))  # moves the watermark past the closes
    df, stream = source(spark, tmp_path, rows)
    q = replay.queue_stream(stream).writeStream.format("memory").queryName("queue").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.market_id, r.order_id): (r.filled, r.ahead, r.state) for r in spark.sql("SELECT * FROM queue").collect()}
    want = {(r.market_id, r.order_id): (r.filled, r.ahead, r.state) for r in queue_replay(df.where("market_id < 99")).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == want


def test_panels(spark, tmp_path):
    rows = [(1, i * 1000, i, "trade", 0, 0, 1.0, 0) for i in range(100)] + [(1, 100_000_000, 0, "trade", 0, 0, 1.0, 0)]
    _, stream = source(spark, tmp_path, rows)
    q = replay.panel_stream(stream, "10 seconds").writeStream.format("memory").queryName("panel").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.n for r in spark.sql("SELECT * FROM panel").collect()) == [10] * 10
    q = replay.session_stream(stream, "30 seconds").writeStream.format("memory").queryName("session").outputMode("append").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r.n for r in spark.sql("SELECT * FROM session").collect()] == [100]
