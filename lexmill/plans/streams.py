"""Streaming queries, run to completion over the recorded tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import scratch
from ..streaming import chat
from .catalog import query
from .dialogue import _follow


def _recorded(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """What a stream puts out until its input is read, with the number of the batch; a batch that is
    run again replaces its own rows."""
    folder = scratch.folder(spark, "stream")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/result/batch={number}")

    running = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{folder}/state").start()
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    return spark.read.schema(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in stream.schema.fields)}, batch bigint").parquet(f"{folder}/result")


@query(
    "stream_weekly_scores",
    """SELECT time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS week_start, user_id, event_type AS topic_id, round(sum(least(1, value / 100)), 6) AS earned, count(*) AS total FROM events GROUP BY ALL""",
)
def stream_weekly_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as points, summed by week; each micro-batch tells the sums that changed."""
    rows = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(f"{sf_dir}/events.parquet*")
    points = rows.select("user_id", F.col("event_type").alias("topic_id"), F.least(F.lit(1.0), F.col("value") / 100).alias("earned"), F.lit(1).alias("total"), F.col("ts").cast("timestamp").alias("ts"))
    told = _recorded(spark, chat.weak_area_stream(points), "update")
    keys = ["week_start", "user_id", "topic_id"]
    out = told.groupBy(*keys).agg(F.max_by(F.struct("earned", "total"), "batch").alias("x"))
    return out.select(F.col("week_start").cast("timestamp_ntz").alias("week_start"), "user_id", "topic_id", F.round("x.earned", 6).alias("earned"), F.col("x.total").cast("long").alias("total"))


@query(
    "stream_rewritten",
    f"""WITH w AS (SELECT *, last_value(CASE WHEN role = 'user' THEN trim(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM conversations)
SELECT conv_id::VARCHAR AS session_id, turn::BIGINT AS seq, CASE WHEN {_follow('trim(text)')} AND last IS NOT NULL THEN last || ' ' || trim(text) ELSE trim(text) END AS retrieval_query FROM w WHERE role = 'user'""",
)
def stream_rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Follow-ups of recorded conversations, rewritten as they come."""
    rows = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/conversations.parquet").schema).parquet(f"{sf_dir}/conversations.parquet*")
    messages = rows.select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").cast("long").alias("seq"), "role", F.col("text").alias("content"))
    return _recorded(spark, chat.rewritten_stream(messages, idle=None), "append").drop("batch")
