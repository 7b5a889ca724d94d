"""Streams as tables of a session: a query over one is a streaming query.

The dialect has no words for event time, so a watermark is declared with the stream. Filters, projections, joins with tables and
aggregates are then what Structured Streaming makes of the same plan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from larkspur.catalog.model import Table, columns_of
from larkspur.session import Session


def add_stream(session: Session, name: str, frame: DataFrame, event_time: str | None = None, late: str = "10 minutes", window: str | None = None, slide: str | None = None) -> None:
    """frame becomes the table `name` of the session's database.

    event_time and late: rows later than this behind the latest are dropped from aggregates, and state is freed. window: a
    column `window` is added, the row's tumbling window of this length (or a row for each sliding one, with slide); a query that
    groups by it is a windowed aggregate.
    """
    if not frame.isStreaming:
        raise ValueError("not a stream")
    if event_time is not None:
        if frame.schema[event_time].dataType != T.TimestampType():
            frame = frame.withColumn(event_time, F.col(event_time).cast("timestamp"))
        frame = frame.withWatermark(event_time, late)
    if window is not None:
        if event_time is None:
            raise ValueError("a window needs an event time")
        frame = frame.withColumn("window", F.window(event_time, window, slide))
    table = Table(name, columns_of(frame.schema), [], [], session.database)
    session.registered[session.database.lower(), name.lower()] = session._register(f"stream_{session.database}_{name}", frame, table)
    session.streams[session.database.lower(), name.lower()] = table


def add_stateful(session: Session, name: str, frame: DataFrame, keys: list[str], function: Callable, output: T.StructType | str, state: T.StructType | str, event_time: str | None = None, late: str = "10 minutes") -> None:
    """A stream of what `function` makes of the rows of each key and what it remembers of them becomes the table `name`.

    function(key, batches, state) yields pandas frames, as Structured Streaming calls it; with an event time its state can end by the
    watermark, else it stays.
    """
    timeout = "NoTimeout"
    if event_time is not None:
        frame, timeout = frame.withWatermark(event_time, late), "EventTimeTimeout"
    add_stream(session, name, frame.groupBy(*keys).applyInPandasWithState(function, output, state, "append", timeout))


def start(session: Session, text: str, path: str, checkpoint: str, mode: str = "append", available_now: bool = True, format: str = "parquet", batch: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Runs a query over streams into files of a format (parquet, json, csv, orc), or into `batch`, which gets each micro-batch and its
    number and has to be able to get one again. checkpoint: a folder that all executors share; a query that is started again
    goes on from there. available_now ends it when all that is there has been read."""
    frame = session.sql(text)
    if not frame.isStreaming:
        raise ValueError("the query reads no stream")
    writer = frame.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    writer = writer.foreachBatch(batch) if batch is not None else writer.format(format).option("path", path)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
