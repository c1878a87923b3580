"""Melt and unmelt: columns to (variable, value) records and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SpecError
from ..functions.typed import STRING, Typed, cast, common


def melt_record(names: dict[str, Typed], operation: dict, fallback: list[str] | None = None) -> Typed:
    """A row's columns as a list of records {ids.., variable, value}; nulls are left out."""
    ids = operation.get("id_slots") or []
    columns = [c for c in operation.get("source_slots") or fallback or list(names) if c in names and c not in ids]
    variable, value = operation.get("variable_slot", "variable"), operation.get("value_slot", "value")
    if not columns:
        raise SpecError("melt has no columns")
    kind = common([names[c].type for c in columns])
    records = [F.when(names[c].col.isNotNull(), F.struct(*[names[i].col.alias(i) for i in ids], F.lit(c).alias(variable), cast(names[c], kind).col.alias(value))) for c in columns]
    fields = [T.StructField(i, names[i].type) for i in ids] + [T.StructField(variable, STRING), T.StructField(value, kind)]
    return Typed(F.array_compact(F.array(*records)), T.ArrayType(T.StructType(fields)))


def melt(df: DataFrame, operation: dict) -> DataFrame:
    """One row per record."""
    names = {f.name: Typed(F.col(f.name), f.dataType) for f in df.schema.fields}
    record = melt_record(names, operation)
    return df.select(F.explode(record.col).alias("r")).select("r.*")


def slot_name(operation: dict, variable, unit=None):
    """The target slot of a variable, by the template."""
    template = operation.get("slot_name_template")
    if not template:
        return variable
    out = F.replace(F.lit(template), F.lit("{variable}"), variable)
    return F.replace(out, F.lit("{unit}"), unit if unit is not None else F.lit(""))


def unmelt_record(names: dict[str, Typed], operation: dict, targets: list[str]) -> dict[str, Typed]:
    """A record {variable: x, value: v} as {x: v} over the declared targets, with the ids."""
    ids = operation.get("id_slots") or []
    variable, value = names[operation.get("variable_slot", "variable")], names[operation.get("value_slot", "value")]
    unit = names.get(operation.get("unit_slot") or "")
    key = slot_name(operation, variable.col, unit.col.cast("string") if unit else None)
    return {i: names[i] for i in ids} | {t: Typed(F.when(key == t, value.col), value.type) for t in targets if t not in ids}


def unmelt(df: DataFrame, operation: dict, targets: list[str]) -> DataFrame:
    """One row per id over long records: declared targets as columns, the last of equal variables stays."""
    from .lookup import POSITION, positioned

    ids = operation.get("id_slots") or []
    names = {f.name: Typed(F.col(f.name), f.dataType) for f in df.schema.fields}
    wide = unmelt_record(names, operation, targets)
    rows = positioned(df)
    out = [F.max_by(F.when(v.col.isNotNull(), v.col), F.when(v.col.isNotNull(), F.col(POSITION))).alias(t) for t, v in wide.items() if t not in ids]
    return rows.groupBy(*ids).agg(*out)


def unmelt_collection(records: Typed, operation: dict, targets: list[str]) -> dict[str, Typed]:
    """A row's list of records as one wide object: ids of the first record, the last of equal variables."""
    kind = records.type.elementType
    if not isinstance(kind, T.StructType):
        raise SpecError("unmelt needs a list of records")
    fields = {f.name: f.dataType for f in kind.fields}
    variable, value, unit = operation.get("variable_slot", "variable"), operation.get("value_slot", "value"), operation.get("unit_slot")
    out = {i: Typed(F.get(records.col, 0)[i], fields[i]) for i in operation.get("id_slots") or []}
    for t in targets:
        if t not in out:
            hits = F.filter(records.col, lambda r: slot_name(operation, r[variable], r[unit].cast("string") if unit in fields else None) == t)  # noqa: B023
            out[t] = Typed(F.try_element_at(hits, F.lit(-1))[value], fields[value])
    return out
