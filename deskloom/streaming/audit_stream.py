"""The audit log as a stream: each closed log segment is parsed once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from deskloom.sources.audit_log import parse_audit_lines


def stream_audit_log(spark: SparkSession, folder: str) -> DataFrame:
    """Parsed rows of new files in ``folder``, with the batch reader's columns.

    The file source takes each file once, so the folder has to receive closed segments.
    """
    return parse_audit_lines(spark.readStream.text(folder))


def write_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append everything that is there now to ``path``; a later run goes on from ``checkpoint``."""
    return (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )
