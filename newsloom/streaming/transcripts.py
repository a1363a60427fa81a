"""Transcripts that arrive as files (an extension: every operator it uses works record by record)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from newsloom.operators.segments import to_segments
from newsloom.sources.jsonl import TRANSCRIPT


def read(spark: SparkSession, folder: str, schema: str = TRANSCRIPT + ", breaks array<bigint>", files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def segments(stream: DataFrame, min_words: int | None = None) -> DataFrame:
    """Stories of each transcript as it arrives; stateless, so no watermark is needed."""
    return to_segments(stream, min_words)


def write(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Each micro-batch to a sink that must be idempotent by batch id; ends when all files present are read."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
