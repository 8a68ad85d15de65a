"""Streams over ``events``: the table is dealt into files, which arrive a few at a time."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import incremental as I
from . import folder, read

FILES, FILES_A_BATCH = 6, 2


def _arriving(spark, d):
    events = read(spark, d, "events")
    path = folder(spark, "arriving")
    events.repartition(FILES, "event_id").write.parquet(path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", FILES_A_BATCH).parquet(path)


def _run(stream, each):
    query = stream.writeStream.trigger(availableNow=True).foreachBatch(each).option("checkpointLocation", folder(stream.sparkSession, "stream")).start()
    query.awaitTermination()


def streamed_rates(spark, d):
    """Counters of a stream whose batches are each committed twice."""
    rows = _arriving(spark, d).select("event_type", F.lit(1).cast("long").alias("n"), F.round(F.col("value") * 10).cast("long").alias("total_ms"))
    counters = I.Counters(spark, folder(spark, "counters"), ["event_type"], ["n", "total_ms"])

    def each(batch, batch_id):
        counters.commit(batch, batch_id)
        counters.commit(batch, batch_id)  # a replay

    _run(rows, each)
    return counters.totals()


def streamed_first_seen(spark, d):
    """Users and event types, each once however the events arrive."""
    path = folder(spark, "seen")
    rows = _arriving(spark, d).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "3650 days")

    def each(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    _run(I.once(rows, ["user_id", "event_type"]), each)
    return spark.read.parquet(path).select("user_id", "event_type")


QUERIES = {f.__name__: f for f in (streamed_rates, streamed_first_seen)}
ORACLE = {
    "streamed_rates": "SELECT event_type, count(*) AS n, sum(round(value * 10)::BIGINT)::BIGINT AS total_ms FROM events GROUP BY event_type",
    "streamed_first_seen": "SELECT DISTINCT user_id, event_type FROM events",
}
