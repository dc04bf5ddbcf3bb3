"""Streams as frames. Verbs without row order work as on tables: ``select``, ``mutate`` and
``filter_`` without aggregates, ``summarise`` over event-time windows behind a watermark,
joins with tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from verbena.frame import Frame, quoted
from verbena.frame import session as current


def read_stream(path: str, schema: str, format: str = "parquet", session: SparkSession | None = None, **options) -> Frame:
    """A folder as a stream."""
    return Frame((session or current()).readStream.format(format).schema(schema).options(**options).load(path))


def watermark(frame: Frame, column: str, delay: str) -> Frame:
    """How late rows may come."""
    return frame.with_(frame.df.withWatermark(column, delay))


def time_window(frame: Frame, column: str, size: str, slide: str | None = None, name: str = "window") -> Frame:
    """Group (also) by tumbling or sliding windows of event time."""
    made = F.window(quoted(column), size, slide) if slide else F.window(quoted(column), size)
    return frame.with_(frame.df.withColumn(name, made), groups=[*frame.groups, name])


def session_window(frame: Frame, column: str, gap: str, name: str = "window") -> Frame:
    """Group (also) by sessions with a gap."""
    return frame.with_(frame.df.withColumn(name, F.session_window(quoted(column), gap)), groups=[*frame.groups, name])


def distinct_within_watermark(frame: Frame, *columns: str) -> Frame:
    """Drop repeats that come within the watermark."""
    return frame.with_(frame.df.dropDuplicatesWithinWatermark(list(columns)))


def write_stream(frame: Frame, format: str = "parquet", path: str | None = None, checkpoint: str | None = None, mode: str = "append", name: str | None = None, available_now: bool = False, each_batch: Callable | None = None, **options) -> StreamingQuery:
    """Start a query. ``each_batch`` gets (frame, batch number) of every batch, where all verbs work."""
    df = frame.df.select(*map(quoted, frame.columns))
    writer = df.writeStream.outputMode(mode).options(**options)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    if available_now:
        writer = writer.trigger(availableNow=True)
    if each_batch is not None:
        return writer.foreachBatch(lambda batch, number: each_batch(Frame(batch), number)).start()
    return writer.format(format).start(path) if path else writer.format(format).start()
