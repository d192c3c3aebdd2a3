"""Readers and writers: driver tables as batches, bitmap files, and snapshots of container state."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.operators import roaring


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def batch(df: DataFrame, order: str, key: str, value: str | None = None, stencil: str | None = None) -> DataFrame:
    """Columns of a table as a batch: ord, key and, if named, value and stencil."""
    named = {"ord": order, "key": key, "value": value, "stencil": stencil}
    return df.select(*[F.col(c).alias(n) for n, c in named.items() if c])


def read_bitmaps(spark: SparkSession, path: str, bits: int = 32) -> DataFrame:
    """Container tables of all portable bitmap files under ``path``, parsed where they are read: (path, ...containers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                found = {0: roaring.parse32(data)[0]} if bits == 32 else roaring.parse64(data)
                rows = [(name, *c.row(k)) for k, cs in found.items() for c in cs]
                types = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["path", "bucket", "hi", "kind", "card", "low", "words", "runs"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, f"path string, {roaring.SCHEMA}")


def save(state: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Snapshot a container's relation as Parquet."""
    state.write.mode(mode).parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
