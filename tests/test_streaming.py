"""The same windows from a stream as from a batch."""

from pyspark.sql import functions as F

from fedframe.streaming import events


def test_stream_equals_batch(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/events.parquet").repartition(4).write.parquet(f"{tmp_path}/events")
    stream = events.per_window(events.read(spark, f"{tmp_path}/events", stream=True))
    stream = stream.withColumn("start", F.col("start").cast("timestamp_ntz"))
    query = stream.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted(map(tuple, spark.table("windows").collect()))
    assert got == sorted(map(tuple, events.tumbling_counts(spark, sf).collect()))
