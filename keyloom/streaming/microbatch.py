"""Containers over Structured Streaming: each micro-batch is one more batch.

State is a chain of Parquet snapshots, one a micro-batch, under a folder that all executors share;
a batch that is retried writes the same snapshot again, so each one counts once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession


class StreamingState:
    """Applies ``step(container, batch) -> container`` to each micro-batch of a stream.

    ``field`` names the container's relation: ``state`` for keyed ones and bags, ``registers`` for
    cardinality sketches, ``table`` for Bloom filters.
    """

    def __init__(self, empty: Any, step: Callable[[Any, DataFrame], Any], folder: str, field: str = "state") -> None:
        self.empty, self.step, self.folder, self.field = empty, step, folder.rstrip("/"), field

    def _path(self, batch_id: int) -> str:
        return f"{self.folder}/batch={batch_id}"

    def at(self, spark: SparkSession, batch_id: int) -> Any:
        """The container after micro-batch ``batch_id``; empty before the first."""
        relation = getattr(self.empty, self.field)
        if batch_id < 0:
            return self.empty
        return replace(self.empty, **{self.field: spark.read.schema(relation.schema).parquet(self._path(batch_id))})

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        after = self.step(self.at(batch.sparkSession, batch_id - 1), batch)
        getattr(after, self.field).write.mode("overwrite").parquet(self._path(batch_id))

    def start(self, stream: DataFrame, checkpoint: str, **options: Any) -> Any:
        return stream.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint).options(**options).start()
