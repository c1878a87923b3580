"""The compiled projection over streams: files in, rows out, no state. Lookups are stream-static joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.mapper import Mapper
from ..plans.schema import Schema
from ..sources.io import format_of


def read_stream(spark: SparkSession, path: str, schema: Schema, cls: str, format: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the files of a directory; files_per_trigger bounds a batch."""
    kind = format_of(path, format)
    reader = spark.readStream.schema(schema.struct_type(cls))
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if kind in ("csv", "tsv"):
        return reader.option("header", True).option("sep", "\t" if kind == "tsv" else ",").csv(path)
    return reader.parquet(path) if kind == "parquet" else reader.json(path)


def transform_stream(mapper: Mapper, stream: DataFrame, cls: str) -> DataFrame:
    """The mapping of a stream: the same plan as for a table."""
    return mapper.transform(stream, cls)


def run_available(out: DataFrame, path: str, checkpoint: str, format: str = "parquet") -> None:
    """Write what is there and stop."""
    query = out.writeStream.format(format).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
