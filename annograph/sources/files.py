"""Files: several read as one, sinks, and results that are computed once."""

from __future__ import annotations

import hashlib
import io
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def union_of(spark: SparkSession, *paths: str) -> DataFrame:
    """All Parquet files that the paths or globs name, as one table by column name.

    Columns that only some files have are null in the others.
    """
    return spark.read.option("mergeSchema", "true").parquet(*paths)


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite") -> str:
    """A sink: parquet, csv or tsv with a header, or feather (one file a partition)."""
    if kind == "parquet":
        df.write.mode(mode).parquet(path)
    elif kind in ("csv", "tsv"):
        df.write.mode(mode).csv(path, header=True, sep="," if kind == "csv" else "\t")
    elif kind == "feather":
        _feather_rows(df).write.mode(mode).parquet(path)
    else:
        raise ValueError(kind)
    return path


def _feather_rows(df: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([to_feather(pa.Table.from_batches([b]))], pa.binary())], ["content"])

    return df.mapInArrow(run, "content binary")


def to_feather(table: pa.Table) -> bytes:
    import pyarrow.feather as feather

    sink = io.BytesIO()
    feather.write_feather(table, sink, compression="uncompressed")
    return sink.getvalue()


def from_feather(contents: DataFrame, schema: str, column: str = "content") -> DataFrame:
    """Rows of feather files whose bytes are in a column; each is decoded in one task.

    ``spark.read.format("binaryFile")`` gives such a column for files of any store.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.feather as feather

        for b in batches:
            for raw in b.column(0):
                if raw.is_valid:
                    yield from feather.read_table(pa.BufferReader(raw.as_buffer())).to_batches()

    return contents.select(F.col(column)).mapInArrow(run, schema)


def read_feather(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return from_feather(spark.read.format("binaryFile").load(path).select("content"), schema)


def computed(spark: SparkSession, root: str, name: str, parameters: dict, compute: Callable[[], DataFrame]) -> DataFrame:
    """``compute()``, written once for its name and parameters and read from then on.

    The place depends on the parameters as well as on the name, so that other
    parameters never find an earlier result; a result counts only once its
    write was committed, so a job that broke off is computed anew.
    """
    key = hashlib.sha256(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()[:16]
    path = f"{root.rstrip('/')}/{name}-{key}"
    if not _committed(spark, path):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _committed(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place)
