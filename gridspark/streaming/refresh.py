"""The refresh loop: every micro-batch becomes a generation, and a failed one changes nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sinks.generations import publish


def refresh(stream: DataFrame, build: Callable[[DataFrame], DataFrame], root: str, checkpoint: str,
            every: str | None = "30 minutes") -> StreamingQuery:
    """Build and publish one generation per trigger; ``every=None`` works through what is there and ends.

    A batch that fails stops the query before the pointer moves, so readers keep the last good
    generation; a restart repeats the same batch under the same generation name.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        publish(build(batch), root, f"{batch_id:012d}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
