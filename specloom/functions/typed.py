"""Columns with a known type, and the dynamic language's notions on them: truth, numbers, equality, text forms."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LONG, DOUBLE, STRING, BOOL, NULL = T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType(), T.NullType()
_INTS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


@dataclass(frozen=True)
class Typed:
    """A Column and its type; tuples (case arms) and unresolved values never reach a plan as such."""

    col: Column
    type: T.DataType

    @property
    def kind(self) -> str:
        t = self.type
        if isinstance(t, T.NullType):
            return "null"
        if isinstance(t, T.BooleanType):
            return "bool"
        if isinstance(t, _INTS):
            return "int"
        if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
            return "float"
        if isinstance(t, T.ArrayType):
            return "list"
        if isinstance(t, T.StructType):
            return "object"
        if isinstance(t, T.MapType):
            return "dict"
        return "text" if isinstance(t, T.StringType) else "other"

    @property
    def numeric(self) -> bool:
        return self.kind in ("int", "float", "bool")

    def element(self, col: Column) -> Typed:
        return Typed(col, self.type.elementType)


def null() -> Typed:
    return Typed(F.lit(None), NULL)


def literal(value) -> Typed:
    """A constant: scalars, lists (as arrays) and mappings (as structs)."""
    if value is None:
        return null()
    if isinstance(value, bool):
        return Typed(F.lit(value), BOOL)
    if isinstance(value, int):
        return Typed(F.lit(value).cast(LONG), LONG) if -(1 << 63) <= value < 1 << 63 else Typed(F.lit(float(value)), DOUBLE)
    if isinstance(value, float):
        return Typed(F.lit(value), DOUBLE)
    if isinstance(value, (list, tuple)):
        return array([literal(x) for x in value])
    if isinstance(value, dict):
        return struct({k: literal(v) for k, v in value.items()})
    return Typed(F.lit(str(value)), STRING)


def array(items: list[Typed]) -> Typed:
    if not items:
        return Typed(F.array().cast("array<string>"), T.ArrayType(STRING))
    kind = common([i.type for i in items])
    return Typed(F.array(*[cast(i, kind).col for i in items]), T.ArrayType(kind))


def struct(fields: dict[str, Typed]) -> Typed:
    kept = {k: (v if v.kind != "null" else Typed(v.col.cast(STRING), STRING)) for k, v in fields.items()}
    return Typed(F.struct(*[v.col.alias(k) for k, v in kept.items()]), T.StructType([T.StructField(k, v.type) for k, v in kept.items()]))


def common(types: list[T.DataType]) -> T.DataType:
    """The narrowest type that holds values of all types; text if nothing else does."""
    known = [t for t in types if not isinstance(t, T.NullType)]
    if not known:
        return STRING
    first = known[0]
    if all(t == first for t in known):
        return first
    kinds = {Typed(None, t).kind for t in known}
    if kinds <= {"int"}:
        return LONG
    if kinds <= {"int", "float"}:
        return DOUBLE
    if kinds == {"list"}:
        return T.ArrayType(common([t.elementType for t in known]))
    return STRING


def cast(v: Typed, to: T.DataType) -> Typed:
    """v as another type, where the language would see the same value; text by its key form."""
    if v.type == to:
        return v
    if isinstance(to, T.StringType) and v.kind not in ("null", "text"):
        return Typed(key_text(v), STRING)
    return Typed(v.col.cast(to), to)


def truthy(v: Typed) -> Column:
    """False for null, false, 0, "", [] and {}; never null."""
    tests = {"null": lambda: F.lit(False), "bool": lambda: v.col, "int": lambda: v.col != 0, "float": lambda: v.col != 0, "text": lambda: v.col != "", "list": lambda: F.size(v.col) > 0, "dict": lambda: F.size(v.col) > 0}
    return F.coalesce(tests.get(v.kind, lambda: v.col.isNotNull())(), F.lit(False))


def number(v: Typed) -> Typed:
    """v as a number; text is trimmed and parsed, null where it is none."""
    if v.kind == "bool":
        return Typed(v.col.cast(LONG), LONG)
    if v.kind in ("int", "float"):
        return Typed(v.col.cast(LONG if v.kind == "int" else DOUBLE), LONG if v.kind == "int" else DOUBLE)
    if v.kind == "text":
        return Typed(F.nullif(F.trim(v.col), F.lit("")).try_cast(DOUBLE), DOUBLE)
    return Typed(F.lit(None).cast(DOUBLE), DOUBLE)


def equal(a: Typed, b: Typed) -> Column:
    """Null equals null only; numbers of all kinds compare, also with numeric text; other mixtures differ."""
    if a.kind == "null" or b.kind == "null":
        return a.col.isNull() & b.col.isNull()
    if a.numeric and b.numeric:
        return number(a).col.eqNullSafe(number(b).col)
    if {a.kind, b.kind} <= {"int", "float", "bool", "text"} and a.kind != b.kind:
        x, y = number(a).col, number(b).col
        return F.when(a.col.isNull() | b.col.isNull(), a.col.isNull() & b.col.isNull()).otherwise(F.coalesce(x == y, F.lit(False)))
    return a.col.eqNullSafe(b.col) if a.type == b.type or a.kind == b.kind else (a.col.isNull() & b.col.isNull())


def _whole(col: Column) -> Column:
    return (col == F.floor(col)) & (F.abs(col) < 1e15)


def key_text(v: Typed) -> Column:
    """The form used for keys of maps, enums and string slots: true, 5 for 5.0, None."""
    if v.kind == "float":
        out = F.when(_whole(v.col), v.col.cast(LONG).cast(STRING)).otherwise(v.col.cast(STRING))
    elif v.kind in ("list", "object", "dict"):
        out = F.to_json(v.col)
    else:
        out = v.col.cast(STRING)
    return F.coalesce(out, F.lit("None"))


def show_text(v: Typed, nested: bool = False) -> Column:
    """The form that str() gives: True, 5.0, None, [1, 'a'], {'a': 1}."""
    if v.kind == "bool":
        out = F.when(v.col, "True").otherwise(F.when(~v.col, "False"))
    elif v.kind == "float":
        out = v.col.cast(DOUBLE).cast(STRING)
    elif v.kind == "text" and nested:
        out = F.concat(F.lit("'"), v.col, F.lit("'"))
    elif v.kind == "list":
        out = F.concat(F.lit("["), F.array_join(F.transform(v.col, lambda x: show_text(v.element(x), True)), ", "), F.lit("]"))
    elif v.kind == "object":
        parts = [F.concat(F.lit(f"'{f.name}': "), show_text(Typed(v.col[f.name], f.dataType), True)) for f in v.type.fields]
        out = F.when(v.col.isNotNull(), F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")))
    elif v.kind == "dict":
        pair = lambda e: F.concat(F.lit("'"), e["key"], F.lit("': "), show_text(Typed(e["value"], v.type.valueType), True))
        out = F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(v.col), pair), ", "), F.lit("}"))
    else:
        out = v.col.cast(STRING)
    return F.coalesce(out, F.lit("None"))


def json_text(v: Typed) -> Column:
    """JSON with ", " and ": " between parts."""
    if v.kind == "text":
        quoted = F.to_json(F.array(v.col))
        out = F.substring(quoted, F.lit(2), F.char_length(quoted) - 2)
    elif v.kind == "list":
        out = F.concat(F.lit("["), F.array_join(F.transform(v.col, lambda x: json_text(v.element(x))), ", "), F.lit("]"))
    elif v.kind == "object":
        parts = [F.concat(F.lit(json.dumps(f.name) + ": "), json_text(Typed(v.col[f.name], f.dataType))) for f in v.type.fields]
        out = F.when(v.col.isNotNull(), F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")))
    else:
        return F.when(v.col.isNull(), "null").otherwise(key_text(v))
    return F.coalesce(out, F.lit("null"))


def raise_if(bad: Column, message: str, value: Typed) -> Typed:
    """value, or a failing row where bad holds."""
    return Typed(F.when(bad, F.raise_error(F.lit(message)).cast(value.type)).otherwise(value.col), value.type)


def attempt(value: Column) -> Column:
    """value, or null where evaluating it fails. Catalyst's own try-expression, which no function of the public API gives
    for any value; the branch keeps equal parts of value from being evaluated ahead of it, outside the try."""
    from pyspark.sql import SparkSession

    jvm = SparkSession.active()._jvm
    convert, tried = jvm.org.apache.spark.sql.classic.ExpressionUtils, jvm.org.apache.spark.sql.catalyst.expressions.TryEval
    return F.when(F.spark_partition_id() >= 0, type(value)(convert.column(tried(convert.expression(value._jc)))))
