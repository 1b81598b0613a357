"""Features of images that arrive in a stream; an image is never split over batches, so no state is kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.features import Images


def stream_features(pixels: DataFrame, width: int, sink: Callable[[DataFrame, int], None], checkpoint: str, *, height: int | None = None, once: bool = False) -> StreamingQuery:
    """Hand the feature vectors of each micro-batch of ``pixels`` (a stream) to ``sink(features, batch_id)``.

    ``sink`` may see a batch again after a failure and should write by batch id.  What it
    gets can be read until it returns.
    """

    def take(batch: DataFrame, n: int) -> None:
        images = Images(batch, width, height)
        try:
            sink(images.features, n)
        finally:
            images.release()

    writer = pixels.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
