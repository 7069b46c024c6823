"""Usage of tools over event time. An extension: the reference keeps a log and reports over it in batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.contract import table


def by_window(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Calls and mean value of each type of event in each window; the same plan over a table and over a stream."""
    if events.isStreaming:
        events = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    g = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("calls"), F.round(F.avg("value"), 6).alias("mean_value"))
    return g.select(F.col("w.start").alias("start"), "event_type", "calls", "mean_value")


def stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    return by_window(spark.readStream.schema(schema).parquet(folder))


QUERIES = {"usage_by_day": lambda s, d: by_window(table(s, d, "events"))}
ORACLES = {"usage_by_day": "select date_trunc('day', ts)::timestamp as start, event_type, count(*) as calls, round(avg(value), 6) as mean_value from events group by all"}
