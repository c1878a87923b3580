"""Mapping of Python objects: small inputs, tests, notebooks. Each call is a Spark job; use DataFrames for data."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from .plans.mapper import Mapper
from .plans.schema import Schema
from .plans.validate import Message, validate


def to_row(value, kind: T.DataType):
    """A Python object in the shape of a Spark type; fields that it lacks are null."""
    if value is None:
        return None
    if isinstance(kind, T.StructType):
        return tuple(to_row(value.get(f.name), f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return [to_row(x, kind.elementType) for x in (value if isinstance(value, (list, tuple)) else [value])]
    if isinstance(kind, T.MapType):
        return {str(k): to_row(v, kind.valueType) for k, v in value.items()}
    if isinstance(kind, T.DoubleType):
        return float(value)
    return str(value) if isinstance(kind, T.StringType) else value


def from_row(value):
    """A Row as nested dicts and lists."""
    if isinstance(value, T.Row):
        return {k: from_row(v) for k, v in value.asDict().items()}
    if isinstance(value, list):
        return [from_row(v) for v in value]
    if isinstance(value, dict):
        return {k: from_row(v) for k, v in value.items()}
    return value


class ObjectMapper:
    """A mapper for objects of declared classes."""

    def __init__(self, spark: SparkSession, spec, source_schema, target_schema=None, **options):
        self.spark, self.schema = spark, source_schema if isinstance(source_schema, Schema) else Schema(source_schema)
        self.mapper = Mapper(spec, self.schema, target_schema, **options)

    def _frame(self, objects: list[dict], cls: str):
        struct = T.StructType([T.StructField(f.name, f.dataType) for f in self.mapper.source.struct_type(cls).fields])
        return self.spark.createDataFrame([to_row(o, struct) for o in objects], struct)

    def register_join_table(self, name: str, rows: list[dict], key: str) -> ObjectMapper:
        """Rows of a class (or, for other names, rows of text and numbers) for lookups by key."""
        frame = self._frame(rows, name) if self.mapper.source.has_class(name) else self.spark.createDataFrame(rows)
        self.mapper.register_join_table(name, frame.coalesce(1), key)
        return self

    def transform_many(self, objects: list[dict], source_class: str | None = None) -> list[dict]:
        cls = self.mapper.source_class(source_class)
        return [from_row(r) for r in self.mapper.transform(self._frame(objects, cls), cls).collect()]

    def map_object(self, obj: dict, source_class: str | None = None) -> dict:
        return self.transform_many([obj], source_class)[0]

    def validate(self, strict: bool = False) -> list[Message]:
        return validate(self.mapper.spec, self.mapper.source, self.mapper.target, strict)
