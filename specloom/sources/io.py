"""Reading and writing tables: CSV, TSV, JSON, JSONL, YAML and Parquet, by a path's suffix.

Readers and Spark-native writers run on executors and take any path Spark can read. The single-document writers (a JSON
array, YAML, standard output) bring rows to the driver one partition at a time and are meant for small results.
"""

from __future__ import annotations

import json
import math
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SpecError
from ..plans.schema import FLOATS, INTEGERS, Schema

#: Suffix: format (fixed values).
FORMATS = {"csv": "csv", "tsv": "tsv", "tab": "tsv", "json": "json", "jsonl": "jsonl", "ndjson": "jsonl", "yaml": "yaml", "yml": "yaml", "parquet": "parquet"}


def format_of(path: str, given: str | None = None) -> str:
    """The format given, or that of the path's suffix."""
    name = (given or os.path.splitext(path)[1][1:]).lower()
    if name not in FORMATS:
        raise SpecError(f"unknown format {name!r} of {path}")
    return FORMATS[name]


def read(spark: SparkSession, path: str, schema: Schema | None = None, cls: str | None = None, format: str | None = None, raw: bool = False) -> DataFrame:
    """A table. With a schema and class, columns have declared types.

    CSV and TSV: missing cells are ""; cells of numeric columns that are no numbers are null (raw keeps them under
    <column>__raw). JSON: an array is many rows, an object one.
    """
    kind = format_of(path, format)
    struct = schema.struct_type(cls) if schema and cls else None
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind in ("csv", "tsv"):
        df = spark.read.option("header", True).option("mode", "PERMISSIVE").option("sep", "\t" if kind == "tsv" else ",").option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
        df = df.fillna("")
        return typed_cells(df, schema, cls, raw) if schema and cls else df
    if kind in ("json", "jsonl"):
        reader = spark.read.option("multiLine", kind == "json")
        return (reader.schema(struct) if struct else reader).json(path)
    return _yaml(spark, path, struct)


def typed_cells(df: DataFrame, schema: Schema, cls: str, raw: bool = False) -> DataFrame:
    """Text cells as numbers where the schema says so."""
    columns = {}
    for name, slot in schema.induced(cls).items():
        kind = (slot.range or "").lower()
        if name in df.columns and not slot.multivalued and kind in INTEGERS | FLOATS:
            cell = F.nullif(F.trim(F.col(name)), F.lit(""))
            columns[name] = cell.try_cast("long" if kind in INTEGERS else "double")
            if kind in FLOATS:
                columns[name] = F.when(~F.isnan(columns[name]) & (F.abs(columns[name]) < float("inf")), columns[name])
            if raw:
                columns[f"{name}__raw"] = F.when(columns[name].isNull(), F.col(name))
    return df.withColumns(columns) if columns else df


def _yaml(spark: SparkSession, path: str, struct: T.StructType | None) -> DataFrame:
    """A YAML document (a list of rows, or one); read as text by Spark, so any path works, then parsed on the driver."""
    import yaml

    loader = type("Plain", (yaml.SafeLoader,), {"yaml_implicit_resolvers": {k: [x for x in v if x[0] != "tag:yaml.org,2002:timestamp"] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}})
    text = spark.read.text(path, wholetext=True).first()
    rows = yaml.load(text[0], Loader=loader) if text else []  # noqa: S506  a safe loader without dates
    lines = [json.dumps(r) for r in (rows if isinstance(rows, list) else [rows])]
    one = spark.createDataFrame([(x,) for x in lines], "value string")
    if struct is None:
        schema = spark.range(1).select(F.schema_of_json(F.lit("[" + ",".join(lines) + "]"))).first()[0]
        struct = T._parse_datatype_string(schema).elementType
    return one.select(F.from_json("value", struct).alias("v")).select("v.*")


def read_directory(spark: SparkSession, path: str, schema: Schema, needed: dict[str, bool], also: set[str] = frozenset()) -> dict[str, DataFrame]:
    """{class: table} for files named after classes. needed: class -> whether it must exist; absent others are empty.
    also: classes that are read where they have a file (joins that a specification implies may need them)."""
    listing = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = listing.getFileSystem(spark._jsc.hadoopConfiguration())
    files = {os.path.splitext(s.getPath().getName())[0]: str(s.getPath()) for s in fs.listStatus(listing) if os.path.splitext(s.getPath().getName())[1][1:].lower() in FORMATS}
    out = {}
    for cls, required in [*needed.items(), *((c, False) for c in sorted(also) if c in files)]:
        if cls in files:
            out[cls] = read(spark, files[cls], schema, cls if schema.has_class(cls) else None)
        elif required:
            raise SpecError(f"{path} has no table {cls}")
        else:
            out[cls] = spark.createDataFrame([], schema.struct_type(cls))
    return out


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, null as ""."""
    nested = (T.ArrayType, T.StructType, T.MapType)
    return df.select(*[F.coalesce(F.to_json(F.col(f"`{f.name}`")) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`").cast("string"), F.lit("")).alias(f.name) for f in df.schema.fields])


def _holds_no_number(c, kind: T.DataType):
    """Whether a value holds a number that JSON cannot hold, at any depth; None for types without floats."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(False))
    if isinstance(kind, T.StructType):
        parts = [t for f in kind.fields if (t := _holds_no_number(c[f.name], f.dataType)) is not None]
        out = None
        for t in parts:
            out = t if out is None else out | t
        return out
    if isinstance(kind, T.ArrayType):
        inside = _holds_no_number(F.lit(None).cast(kind.elementType), kind.elementType)
        return None if inside is None else F.coalesce(F.exists(c, lambda x: _holds_no_number(x, kind.elementType)), F.lit(False))
    if isinstance(kind, T.MapType):
        return _holds_no_number(F.map_values(c), T.ArrayType(kind.valueType))
    return None


def finite(df: DataFrame) -> DataFrame:
    """Fails rows with a number, at any depth, that JSON cannot hold."""
    tests = {f.name: _holds_no_number(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields}
    failing = {n: F.when(t, F.raise_error(F.lit("a number is not finite")).cast(df.schema[n].dataType)).otherwise(F.col(f"`{n}`")) for n, t in tests.items() if t is not None}
    return df.withColumns(failing) if failing else df


def views(tables: dict[str, DataFrame]) -> None:
    """Temporary views of tables, for spark.sql."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def on_executors(path: str, format: str | None = None) -> bool:
    """Whether write leaves the writing to executors."""
    return path.startswith("table:") or (path != "-" and format_of(path, format) in ("parquet", "csv", "tsv", "jsonl"))


def write(df: DataFrame, path: str, format: str | None = None, mode: str = "error") -> None:
    """A table in the format of the path's suffix; "-" is standard output and needs a format; "table:NAME" is a table
    of the session's catalog."""
    if path.startswith("table:"):
        df.write.mode(mode).saveAsTable(path[6:])
        return None
    if path == "-":
        if not format:
            raise SpecError("standard output needs a format")
        return _print(df, format_of("", format))
    kind = format_of(path, format)
    if kind == "parquet":
        df.write.mode(mode).parquet(path)
    elif kind in ("csv", "tsv"):
        flat(df).write.mode(mode).option("header", True).option("sep", "\t" if kind == "tsv" else ",").option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)
    elif kind == "jsonl":
        finite(df).write.mode(mode).option("ignoreNullFields", False).json(path)
    else:
        with open(path, "w", encoding="utf-8") as f:
            _document(df, kind, f)
    return None


def _plain(value):
    if isinstance(value, T.Row):
        return {k: _plain(v) for k, v in value.asDict().items()}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, float) and not math.isfinite(value):
        raise ValueError("a number is not finite")
    return value if isinstance(value, (str, int, float, bool, type(None))) else str(value)


def _document(df: DataFrame, kind: str, f) -> None:
    rows = map(_plain, df.toLocalIterator())
    if kind == "json":
        first = True
        f.write("[\n")
        for r in rows:
            f.write(("" if first else ",\n") + json.dumps(r, indent=2, ensure_ascii=False))
            first = False
        f.write("\n]\n")
    else:
        import yaml

        items = list(rows)
        yaml.safe_dump(items[0] if len(items) == 1 else items, f, sort_keys=False, allow_unicode=True)


def _print(df: DataFrame, kind: str) -> None:
    try:
        if kind in ("json", "yaml"):
            _document(df, kind, sys.stdout)
        elif kind == "jsonl":
            for r in df.toLocalIterator():
                print(json.dumps(_plain(r), ensure_ascii=False))
        else:
            import csv

            out = csv.writer(sys.stdout, delimiter="\t" if kind == "tsv" else ",", lineterminator="\n")
            out.writerow(df.columns)
            for r in flat(df).toLocalIterator():
                out.writerow(list(r))
    except BrokenPipeError:
        pass
