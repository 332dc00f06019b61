"""Streams of relation rows.

Filters and projections of a relation keep no state, so a relation over a streaming DataFrame is itself one:
``Dependencies(spark.readStream.schema(SCHEMAS["dependencies"]).parquet(path)).is_third_party()``. ``watch`` evaluates
a rule on each batch of new rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def watch(refs: DataFrame, report: Callable[[int, DataFrame], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Hand each batch's violations, as a rule's evaluate() gives them on a stream, to report; empty batches are skipped."""

    def each(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            report(number, batch)

    writer = refs.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(each)
    return (writer.trigger(availableNow=True) if once else writer).start()
