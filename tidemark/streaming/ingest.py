"""Incremental raw ingestion with Structured Streaming.

New CSV files dropped into a folder are picked up by a file stream with the
fixed raw schema and appended to the raw parquet table through the file
sink, whose commit log makes each file land exactly once — a re-run after a
failure or an executor loss neither skips nor duplicates a file. With
``availableNow`` the query processes everything present and stops, which
turns the stream into an incremental batch load.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.csv import MULTILINE_TABLES
from ..sources.schemas import RAW_SCHEMAS


def csv_drop_stream(spark: SparkSession, table: str, drop_dir: str, target: str, checkpoint: str,
                    available_now: bool = True, max_files_per_trigger: int | None = None) -> StreamingQuery:
    reader = (spark.readStream.schema(RAW_SCHEMAS[table])
              .option("header", True)
              .option("multiLine", table in MULTILINE_TABLES)
              .option("escape", '"')
              .option("nullValue", "")
              .option("ignoreLeadingWhiteSpace", False)
              .option("ignoreTrailingWhiteSpace", False)
              .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
              .option("dateFormat", "yyyy-MM-dd"))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    writer = (reader.csv(drop_dir).writeStream.format("parquet")
              .option("checkpointLocation", checkpoint).outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start(target)


def ingest_drops(spark: SparkSession, table: str, drop_dir: str, target: str, checkpoint: str) -> int:
    """Load every not-yet-loaded file and wait; returns the table's row count."""
    q = csv_drop_stream(spark, table, drop_dir, target, checkpoint, available_now=True)
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return spark.read.parquet(target).count()
