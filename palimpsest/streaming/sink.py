"""Micro-batches appended to a versioned table, each once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..sources.table import VersionedTable


def append_batches(table: VersionedTable, writer: str, arrival: list[str] | None = None) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch``.  The log records the batch with its rows, so a batch that is sent again is
    skipped."""

    def write(rows: DataFrame, batch: int) -> None:
        table.refresh()
        table.append(rows, arrival=arrival, batch=(writer, batch))

    return write


def write_stream(rows: DataFrame, table: VersionedTable, checkpoint: str, writer: str = "stream", arrival: list[str] | None = None) -> DataStreamWriter:
    return rows.writeStream.foreachBatch(append_batches(table, writer, arrival)).option("checkpointLocation", checkpoint)
