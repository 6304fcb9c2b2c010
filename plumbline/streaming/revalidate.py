"""Incremental re-validation: findings as records arrive, and trust carried between runs.

A static check reads a whole snapshot.  Here records come as a stream; each is checked
once, and a record whose name, size and time are those of a trusted one is not checked
again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ("path", "length", "modified")


def untrusted(now: DataFrame, trusted: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Records that no earlier run vouches for: none with their name, size and time."""
    return now.join(trusted.select(*key), list(key), "left_anti")


def _marked(events: DataFrame, time: str, watermark: str) -> DataFrame:
    """events with a watermark on their time, which may lack a time zone."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, watermark)


def late_findings(
    events: DataFrame, time: str, wrong: Column, watermark: str | None = "1 hour", window: str = "10 minutes", by: str = "event_type"
) -> DataFrame:
    """A stream's wrong records by event-time window and kind; a window closes when the watermark has passed it.

    watermark None: the events have one already.
    """
    marked = _marked(events, time, watermark) if watermark else events
    counts = marked.groupBy(F.window(time, window), by).agg(F.count_if(wrong).alias("n_wrong"), F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("window_start"), by, "n_wrong", "n")


def first_seen(events: DataFrame, time: str, key: list[str], watermark: str = "1 hour") -> DataFrame:
    """Each record once, however often the stream repeats it within the watermark."""
    return _marked(events, time, watermark).dropDuplicatesWithinWatermark(key)


def revalidate(stream: DataFrame, trusted_path: str, findings_path: str, check, checkpoint: str, key: tuple[str, ...] = KEY):
    """Start a query that checks what is not trusted yet: findings are appended, clean records become trusted.

    check: records -> findings with the key's columns.  Each micro-batch writes under its own
    number, so a batch that is run again replaces what it wrote.
    """
    spark = stream.sparkSession

    def batch(df: DataFrame, number: int) -> None:
        earlier = spark.read.option("mergeSchema", "false").parquet(trusted_path).where(F.col("batch") < number) if _exists(spark, trusted_path) else None
        fresh = df if earlier is None else untrusted(df, earlier, key)
        found = check(fresh)
        found.write.mode("overwrite").parquet(f"{findings_path}/batch={number}")
        clean = fresh.select(*key).join(found.select(*key), list(key), "left_anti")
        clean.write.mode("overwrite").parquet(f"{trusted_path}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(p) and any(s.isDirectory() and s.getPath().getName().startswith("batch=") for s in fs.listStatus(p))
