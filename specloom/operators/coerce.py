"""What happens to a copied value: cardinality, text forms, datatypes, list and mapping shapes, CURIEs, offsets."""

from __future__ import annotations

import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SpecError
from ..functions.typed import BOOL, DOUBLE, LONG, STRING, Typed, json_text, key_text, literal, number, raise_if
from ..plans.schema import Schema


def missing(v: Typed, sentinels: list) -> Typed:
    """Null in place of sentinels, which match by value or by key form."""
    keys = []
    for s in sentinels:
        keys.append("true" if s is True else "false" if s is False else "None" if s is None else str(int(s)) if isinstance(s, float) and s.is_integer() else str(s))
    return Typed(F.when(~key_text(v).isin(keys), v.col), v.type)


def value_map(v: Typed, table: dict, scope_value=None) -> Typed:
    """Exact lookup by key form; what is not in the table is null."""
    from ..functions.typed import cast, common

    made = {k: (scope_value(x) if scope_value else literal(x)) for k, x in table.items()}
    kind = common([x.type for x in made.values()])
    key, out = key_text(v), None
    for k, x in made.items():
        test, col = key == k, cast(x, kind).col
        out = F.when(test, col) if out is None else out.when(test, col)
    return Typed(F.when(v.col.isNotNull(), out), kind) if out is not None else Typed(F.lit(None).cast(kind), kind)


def to_single(v: Typed, stringify: dict | None) -> Typed:
    """A list as one value: joined text, or its only element; more than one is an error."""
    if v.kind != "list":
        return v
    if stringify:
        if stringify.get("syntax"):
            return Typed(F.when(v.col.isNotNull(), _written(v, stringify["syntax"].upper())), STRING)
        delimiter = stringify.get("delimiter", ",")
        return Typed(F.array_join(F.transform(v.col, lambda x: key_text(v.element(x))), delimiter), STRING)
    return raise_if(F.coalesce(F.size(v.col) > 1, F.lit(False)), "several values for a single-valued slot", Typed(F.try_element_at(v.col, F.lit(1)), v.type.elementType))


def _written(v: Typed, syntax: str):
    if syntax == "JSON":
        return json_text(v)
    if syntax == "YAML":
        plain = lambda x: key_text(v.element(x)) if v.element(x).kind != "null" else F.lit("null")
        return F.concat(F.lit("["), F.array_join(F.transform(v.col, lambda x: F.coalesce(F.when(x.isNotNull(), plain(x)), F.lit("null"))), ", "), F.lit("]"))
    raise SpecError(f"stringification syntax {syntax} is not supported")


def to_list(v: Typed, stringify: dict | None) -> Typed:
    """One value as a list of it; reversed stringification splits text, and empty text is an empty list."""
    if v.kind in ("list", "dict"):
        return v
    if stringify and stringify.get("reversed") and v.kind == "text":
        kind = T.ArrayType(STRING)
        empty = F.array().cast(kind)
        if stringify.get("syntax"):
            return Typed(F.when(v.col == "", empty).otherwise(F.from_json(v.col, kind)), kind)
        parts = F.split(v.col, re.escape(stringify.get("delimiter", ",")), -1)
        return Typed(F.when(v.col == "", empty).otherwise(parts), kind)
    if v.kind == "null":
        return v
    return Typed(F.when(v.col.isNotNull(), F.array(v.col)), T.ArrayType(v.type))


def datatype(v: Typed, name: str, on_bad_cast: str = "null") -> Typed:
    """v as integer, float, string or boolean; element by element in lists and mappings. Other names change nothing.

    on_bad_cast: null gives null for what cannot be parsed, keep leaves a text column as it is, error fails the row.
    """
    if v.kind == "list":
        inner = datatype(v.element(F.lit(None).cast(v.type.elementType)), name, on_bad_cast).type
        return Typed(F.transform(v.col, lambda x: datatype(v.element(x), name, on_bad_cast).col), T.ArrayType(inner))
    if v.kind == "dict" and not isinstance(v.type.valueType, T.StructType):
        inner = datatype(Typed(F.lit(None).cast(v.type.valueType), v.type.valueType), name, on_bad_cast).type
        return Typed(F.transform_values(v.col, lambda k, x: datatype(Typed(x, v.type.valueType), name, on_bad_cast).col), T.MapType(v.type.keyType, inner))
    n = name.lower()
    if v.kind in ("object", "dict", "null", "other"):
        return v
    if n in ("string", "str"):
        return Typed(F.when(v.col.isNotNull(), key_text(v)), STRING)
    if n in ("integer", "int"):
        out = number(v)
        if out.kind == "float":
            out = Typed(F.when(out.col >= 0, F.floor(out.col)).otherwise(F.ceil(out.col)).cast(LONG), LONG)
        if v.kind == "text":
            out = Typed(F.trim(v.col).try_cast(LONG), LONG)
    elif n in ("float", "double"):
        out = Typed(number(v).col.cast(DOUBLE), DOUBLE)
    elif n in ("boolean", "bool"):
        if v.kind == "float":
            return v
        out = Typed(F.when(v.col.isNotNull(), F.lower(F.trim(v.col)).isin("true", "yes", "1")), BOOL) if v.kind == "text" else Typed(v.col.cast(BOOL), BOOL)
    else:
        return v
    if v.kind == "text" and on_bad_cast == "keep":
        return Typed(F.when(out.col.isNotNull(), key_text(out)).otherwise(v.col), STRING)
    if on_bad_cast == "error":
        return raise_if(v.col.isNotNull() & out.col.isNull(), f"cannot read a value as {name}", out)
    return out


def reshape(v: Typed, cast_as: str | None, key: str | None) -> Typed:
    """A list of objects as a mapping by key (the last of equal keys stays), or a mapping as a list of objects."""
    if cast_as == "MultiValuedDict" and v.kind == "list" and isinstance(v.type.elementType, T.StructType) and key:
        fields = [f for f in v.type.elementType.fields if f.name != key]
        has = key in v.type.elementType.fieldNames()
        entry = lambda x: F.struct(F.coalesce(x[key].cast("string") if has else F.lit(None), F.lit("")).alias("key"), F.struct(*[x[f.name].alias(f.name) for f in fields]).alias("value"))
        entries = F.transform(F.filter(v.col, lambda x: x.isNotNull()), entry)
        # of equal keys the last value stays, at the place of the first; in order of (key, place) equal keys stand together
        order = F.array_sort(F.transform(entries, lambda e, i: F.struct(e["key"].alias("k"), i.alias("p"))))
        new = lambda s, i: (i == 0) | (F.get(s, F.greatest(i - 1, F.lit(0)))["k"] != F.get(s, i)["k"])
        ends = lambda s: F.filter(F.transform(s, lambda e, i: F.struct(e["p"].alias("p"), (F.coalesce(F.get(s, i + 1)["k"] != e["k"], F.lit(True))).alias("last"))), lambda e: e["last"])
        starts = lambda s: F.filter(F.transform(s, lambda e, i: F.struct(e["p"].alias("p"), new(s, i).alias("first"))), lambda e: e["first"])
        kept = F.array_sort(F.flatten(F.transform(F.array(order), lambda s: F.zip_with(starts(s), ends(s), lambda a, b: F.struct(a["p"].alias("at"), b["p"].alias("p"))))))
        return Typed(F.transform(F.array(entries), lambda es: F.map_from_entries(F.transform(kept, lambda x: F.get(es, x["p"]))))[0], T.MapType(STRING, T.StructType(fields)))
    if cast_as == "MultiValuedList" and v.kind == "dict":
        if not isinstance(v.type.valueType, T.StructType):
            return Typed(F.map_values(v.col), T.ArrayType(v.type.valueType))
        key = key or "id"
        fields = [f for f in v.type.valueType.fields if f.name != key]
        rows = F.transform(F.map_entries(v.col), lambda e: F.struct(e["key"].alias(key), *[e["value"][f.name].alias(f.name) for f in fields]))
        return Typed(rows, T.ArrayType(T.StructType([T.StructField(key, STRING), *fields])))
    return v


def curie(v: Typed, target: str | None, schema: Schema | None, prefixes: dict) -> Typed:
    """CURIEs expanded for uri and uriorcurie, URIs shortened for curie; unknown ones stay. Text and lists of it only."""
    if target not in ("uri", "uriorcurie", "curie"):
        return v
    if v.kind == "list" and isinstance(v.type.elementType, T.StringType):
        return Typed(F.transform(v.col, lambda x: curie(v.element(x), target, schema, prefixes).col), v.type)
    if v.kind != "text":
        return v
    known = Schema({"prefixes": {**prefixes, **(schema.prefixes if schema else {})}})
    out = v.col
    pairs = known.compress() if target == "curie" else known.expand()
    for start, to in reversed(pairs):
        absolute = F.contains(v.col, F.lit("://")) if target != "curie" else F.lit(False)
        out = F.when(F.startswith(v.col, F.lit(start)) & ~absolute, F.concat(F.lit(to), F.substring(v.col, F.lit(len(start) + 1), F.char_length(v.col)))).otherwise(out)
    return Typed(out, STRING)


def offset(v: Typed, rule: dict, field: Typed | None) -> Typed:
    """v plus or minus rule's value times another field; v unchanged where a part is not numeric."""
    if field is None:
        return v
    step = float(rule.get("offset_value", 0)) * (-1 if rule.get("offset_reverse") else 1)
    moved = number(v).col.cast(DOUBLE) + F.lit(step) * number(field).col.cast(DOUBLE)
    if v.numeric:
        return Typed(F.coalesce(moved, v.col.cast(DOUBLE)), DOUBLE)
    return Typed(F.coalesce(key_text(Typed(moved, DOUBLE)) if v.kind == "text" else moved, v.col), v.type)
