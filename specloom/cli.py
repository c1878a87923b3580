"""Command line: map-data, derive-schema, validate (validate-spec)."""

from __future__ import annotations

import argparse
import os
import sys

from .plans.derive import derive_schema
from .plans.mapper import Mapper
from .plans.schema import Schema
from .plans.spec import load, normalise
from .plans.validate import validate
from .sources import io


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="specloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    m = sub.add_parser("map-data", help="map a file, or a directory of tables")
    m.add_argument("input")
    m.add_argument("-T", "--transformer-specification", required=True)
    m.add_argument("-s", "--schema", required=True)
    m.add_argument("--target-schema")
    m.add_argument("--source-type")
    m.add_argument("-o", "--output", default="-")
    m.add_argument("-f", "--output-format")
    m.add_argument("--unordered", action="store_true", help="do not keep the input order (faster)")
    m.add_argument("--extensions", action="store_true", help="expressions may call the additional functions")
    m.add_argument("--grouped", action="store_true", help="aggregates are taken over groups of equal other slots")
    m.add_argument("--on-bad-cast", choices=("null", "keep", "error"), default="null")
    m.add_argument("--continue-on-error", action="store_true", help="leave failing rows out, say how many, and exit with 1")
    d = sub.add_parser("derive-schema", help="the target schema that a specification implies")
    d.add_argument("-T", "--transformer-specification", required=True)
    d.add_argument("-s", "--schema", required=True)
    d.add_argument("-o", "--output", default="-")
    v = sub.add_parser("validate", aliases=["validate-spec"], help="check a specification")
    v.add_argument("specification", nargs="+")
    v.add_argument("-s", "--schema")
    v.add_argument("--target-schema")
    v.add_argument("--strict", action="store_true")
    return p


def _dump(value, path: str) -> None:
    import yaml

    text = yaml.safe_dump(value, sort_keys=False, allow_unicode=True)
    if path == "-":
        sys.stdout.write(text)
    else:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)


def main(argv: list[str] | None = None, spark=None) -> int:
    a = _parser().parse_args(argv)
    if a.command == "derive-schema":
        _dump(derive_schema(a.transformer_specification, load(a.schema)), a.output)
        return 0
    if a.command in ("validate", "validate-spec"):
        bad = 0
        for path in a.specification:
            for message in validate(path, load(a.schema) if a.schema else None, load(a.target_schema) if a.target_schema else None, a.strict):
                print(f"{path}: {message}")
                bad += message.severity == "error"
        return 1 if bad else 0
    from pyspark.sql import SparkSession

    spark = spark or SparkSession.builder.appName("specloom").getOrCreate()
    schema, spec = Schema(load(a.schema), load(a.transformer_specification).get("source_schema_patches")), normalise(a.transformer_specification)
    mapper = Mapper(spec, schema, load(a.target_schema) if a.target_schema else None, on_bad_cast=a.on_bad_cast, ordered=not a.unordered, extensions=a.extensions, grouped=a.grouped, on_error="collect" if a.continue_on_error else "fail")
    cls = a.source_type or (spec["class_derivations"][0].get("populated_from") or spec["class_derivations"][0]["name"])
    if os.path.isdir(a.input) and not a.input.endswith((".parquet", ".jsonl", ".csv")):
        others = {j.get("class_named") or k: False for c in spec["class_derivations"] for k, j in c["joins"].items()}
        tables = io.read_directory(spark, a.input, schema, {**others, cls: True}, {c for c in schema.classes if c not in others and c != cls})
    else:
        tables = {cls: io.read(spark, a.input, schema, cls)}
    io.write(mapper.transform(tables, cls), a.output, a.output_format, mode="overwrite")
    if cls not in mapper.rejected:
        return 0
    # what the driver writes row by row has no end that Spark observes, so those (small) rows are counted anew
    failed = mapper.observed[cls].get.get("rejected") if io.on_executors(a.output, a.output_format) else mapper.rejected[cls].count()
    if failed:
        print(f"{failed} rows of {cls} failed and were left out", file=sys.stderr)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
