from pyspark.sql import functions as F

from trajecta.operators import history
from trajecta.sources import adapters
from trajecta.streaming import episodes


DECISION = ["user_id", "episode", "t", "action", "key_before", "key_after", "mode", "focus"]


def parts(spark, data, path, n=3):
    """The events as files in the order of time, so that executions go on from one micro-batch to the next."""
    events = spark.read.parquet(f"{data}/events.parquet")
    ordered = events.orderBy("ts", "event_id").toPandas()
    size = len(ordered) // n + 1
    out = [spark.createDataFrame(ordered.iloc[k * size : (k + 1) * size], events.schema).coalesce(1) for k in range(n)]
    for k, part in enumerate(out):
        part.write.parquet(f"{path}/part{k}")
    return events, [spark.read.parquet(f"{path}/part{k}") for k in range(n)]


def run(spark, schema, path, name, until=None, **options):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    sink = episodes.decisions(stream, **options).writeStream.format("parquet").option("path", f"{path}/{name}").outputMode("append").option("checkpointLocation", f"{path}/cp-{name}")
    query = (sink if until else sink.trigger(availableNow=True)).start()
    if until:
        until()
        query.stop()
    else:
        query.awaitTermination()
    return spark.read.schema(episodes.OUTPUT).parquet(f"{path}/{name}")


def rows_of(df):
    return sorted((tuple(r) for r in df.select(DECISION).collect()), key=str)


def batch(events):
    rows = adapters.steps(events)
    rows = history.focus(rows).join(history.interaction(rows).select("task", "rep", "t", "mode"), ["task", "rep", "t"])
    return rows_of(rows.withColumn("user_id", F.col("rep") * 8 + F.col("task") % 8).withColumn("episode", F.floor(F.col("task") / 8)))


def test_a_stopped_and_restarted_stream_equals_batch(spark, data, tmp_path):
    events, files = parts(spark, data, tmp_path)
    for k, part in enumerate(files):  # the query ends and starts again between any two files
        part.write.mode("append").parquet(f"{tmp_path}/in")
        got = run(spark, events.schema, tmp_path, "out")
        if k == 0:
            assert got.count() == part.count()
    assert rows_of(got) == batch(events)
    ended = {(r["won"], r["ended"]) for r in got.where("done").collect()}
    assert ended <= {(True, "won"), (False, "cap")} and (True, "won") in ended


def test_a_stream_goes_on_from_a_batch(spark, data, tmp_path):
    events, files = parts(spark, data, tmp_path, 2)
    files[1].write.parquet(f"{tmp_path}/in")
    early = batch(files[0])
    got = run(spark, events.schema, tmp_path, "out", running=episodes.snapshot(files[0]))
    assert sorted(early + rows_of(got), key=str) == batch(events)


def test_an_idle_execution_ends(spark, data, tmp_path):
    import time

    events, files = parts(spark, data, tmp_path, 2)
    files[0].limit(30).coalesce(1).write.parquet(f"{tmp_path}/in")
    want = {r["user_id"]: r["t"] for r in episodes.snapshot(files[0].limit(30)).where("t > 0").collect()}

    def wait():
        for _ in range(120):
            time.sleep(1)
            try:
                if spark.read.schema(episodes.OUTPUT).parquet(f"{tmp_path}/out").where("ended = 'idle'").count() >= len(want):
                    return
            except Exception:  # the folder isn't there yet
                continue

    got = run(spark, events.schema, tmp_path, "out", until=wait, idle=500)
    assert {r["user_id"]: r["t"] for r in got.where("ended = 'idle'").collect()} == want and want


def test_windows(spark, data):
    events = spark.read.parquet(f"{data}/events.parquet")
    n = events.count()
    assert episodes.windowed_counts(events).agg(F.sum("n")).first()[0] == n
    assert episodes.windowed_counts(events, "1 hour", "30 minutes").agg(F.sum("n")).first()[0] == 2 * n
    assert episodes.sessions(events).agg(F.sum("n")).first()[0] == n
