"""Streaming form of the as-of join: decisions arrive as a stream, records as a table that may grow.

Beyond what batch parity needs.  Each micro-batch of decisions meets the records
known by then; late decisions beyond the watermark are dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from panelwright.operators.pit import asof_frame


def asof_batches(records: Callable[[], DataFrame], *, left_time: str, right_time: str, by: Sequence[str], sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: joins each micro-batch and hands it to ``sink``."""

    def each(batch: DataFrame, batch_id: int) -> None:
        sink(asof_frame(batch, records(), left_time=left_time, right_time=right_time, by=by), batch_id)

    return each
