"""Scoring of a stream by a fitted pipeline: no state, so no watermark; each micro-batch is a projection."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def scored_stream(rows: DataFrame, model: PipelineModel, sink: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Writes predictions for a streaming ``rows`` to Parquet in ``sink``, exactly once by its checkpoint."""
    writer = model.transform(rows).drop("features").writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
