"""Incremental load as a stream: whatever arrived since the last run is appended, then the run ends.

The checkpoint records what has been read, so a run after a failure neither repeats nor skips rows.
Both it and the target lie in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.staging import new_path
from millrace.sources.tables import table


# A long backlog is loaded in batches of this many files, each committed on its own.
FILES_PER_BATCH = 1000


def load_new_files(source: DataFrame, target: str, checkpoint: str) -> None:
    """Append all available input of a streaming ``source`` to a Parquet folder, exactly once."""
    query = (
        source.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(target)
    )
    query.awaitTermination()


def stream_events(spark: SparkSession, folder: str) -> DataFrame:
    """The event table loaded by a stream in one run, read back from the target.

    The source matches the event file only; a second run finds nothing new and adds nothing.
    """
    schema = table(spark, folder, "events").schema
    base = new_path(spark, "stream")
    for _ in range(2):
        events = (
            spark.readStream.schema(schema)
            .option("pathGlobFilter", "events.parquet")
            .option("maxFilesPerTrigger", FILES_PER_BATCH)
            .parquet(folder)
            .select("event_id", "ts", "user_id", "event_type")
        )
        load_new_files(events, f"{base}/target", f"{base}/checkpoint")
    loaded = spark.read.schema("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string")
    return loaded.parquet(f"{base}/target").withColumn("day", F.to_date("ts"))
