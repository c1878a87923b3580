"""Lookups in other tables: the first matching row, or an aggregate over all of them. Rows are never multiplied."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.typed import Typed, key_text
from .aggregate import over_rows, over_values

#: The input order of a table; a name that no class of a schema has.
POSITION = "_specloom_pos"


def positioned(df: DataFrame) -> DataFrame:
    """df with its input order under POSITION (kept where it is there already)."""
    return df if POSITION in df.columns else df.withColumn(POSITION, F.monotonically_increasing_id())


def usable_key(df: DataFrame, key: str):
    """A key as text; keys are whole numbers or text, others never match."""
    kind = Typed(None, df.schema[key].dataType).kind
    return F.col(key).cast("string") if kind in ("int", "text") else F.lit(None).cast("string")


def first_match(df: DataFrame, source_key: str, table: DataFrame, key: str, alias: str, columns: list[str]) -> DataFrame:
    """df with the first row of table whose key equals source_key, as struct column _j_<alias>, a name that no column has (null without a match)."""
    rows = _firsts(table, key, alias, columns)
    return df.join(rows, usable_key(df, source_key) == F.col(f"_k_{alias}"), "left").drop(f"_k_{alias}")


def _firsts(table: DataFrame, key: str, alias: str, columns: list[str]) -> DataFrame:
    """The first row of each key, as _k_<alias> and struct _j_<alias>."""
    rows = positioned(table)
    rows = rows.select(usable_key(table, key).alias(f"_k_{alias}"), F.col(POSITION), F.struct(*[F.col(c) for c in columns]).alias(f"_j_{alias}")).where(F.col(f"_k_{alias}").isNotNull())
    order = Window.partitionBy(f"_k_{alias}").orderBy(POSITION)
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", POSITION)


def listed_matches(df: DataFrame, source_key: str, table: DataFrame, key: str, alias: str, columns: list[str]) -> DataFrame:
    """df with, for the list of keys in source_key, the list of their first rows in table as _j_<alias> (null where a key
    has none). Each different list is taken apart once and joined back by its value, so that no row needs a number."""
    at = f"_l_{alias}"
    lists = df.select(F.col(source_key).alias(at)).where(F.size(at) > 0).distinct()
    each = lists.select(at, F.posexplode(at).alias("_p", "_id"))
    kind = Typed(None, df.schema[source_key].dataType.elementType).kind
    of = F.col("_id").cast("string") if kind in ("int", "text") else F.lit(None).cast("string")
    found = each.join(_firsts(table, key, alias, columns), of == F.col(f"_k_{alias}"), "left")
    found = found.groupBy(at).agg(F.transform(F.sort_array(F.collect_list(F.struct("_p", f"_j_{alias}"))), lambda s: s[f"_j_{alias}"]).alias(f"_j_{alias}"))
    return df.join(found, F.col(source_key) == F.col(at), "left").drop(at)


def all_matches(df: DataFrame, source_key: str, table: DataFrame, key: str, alias: str, wanted: dict[str, tuple[str, dict]]) -> tuple[DataFrame, dict[str, Typed]]:
    """df with one column per wanted aggregate {column: (field, operation)} over all rows that match: one pass for all."""
    rows, made, aggregates, counted = positioned(table), {}, [], []
    at = f"_a_{alias}"
    for name, (field, operation) in wanted.items():
        v = Typed(F.col(field), table.schema[field].dataType)
        if operation["operator"].upper() in ("SET", "MODE"):
            counted.append((name, v, operation))
            continue
        column, *rest = over_rows(v, F.col(POSITION), operation)
        aggregates.append(column.alias(name))
        made[name] = rest
    keyed = rows.withColumn(at, usable_key(table, key)).where(F.col(at).isNotNull())
    groups = [keyed.groupBy(at).agg(*aggregates)] if aggregates else []
    for name, v, operation in counted:  # per (key, value) first, combined on the map side, then per key
        values = keyed.groupBy(at, key_text(v).alias("_v")).agg(F.min_by(F.struct(v.col.alias("v")), F.col(POSITION)).alias("x"), F.count(F.lit(1)).alias("n"), F.min(POSITION).alias("p"))
        column, *made[name] = over_values(v, operation)
        groups.append(values.groupBy(at).agg(column.alias(name)))
    out = df
    for k, grouped in enumerate(groups):
        out = out.join(grouped.withColumnRenamed(at, f"{at}{k}"), usable_key(df, source_key) == F.col(f"{at}{k}"), "left").drop(f"{at}{k}")
    values = {}
    for name in wanted:
        kind, empty = made[name]
        col = F.col(name) if empty is None else F.coalesce(F.col(name), empty)
        values[name] = Typed(F.when(F.col(source_key).isNotNull(), col), kind)
    return out, values


def keyed_map(collection: Typed, key: str) -> Typed | None:
    """A map from identifiers to objects of an inlined list or mapping of a container; the first of equal ids stays."""
    if collection.kind == "list" and isinstance(collection.type.elementType, T.StructType):
        kind = collection.type.elementType
        # in order of (id, place) the first of equal ids stands first; n log n
        sorted_ = F.array_sort(F.transform(F.filter(F.transform(collection.col, lambda x, i: F.struct(x[key].cast("string").alias("k"), i.alias("p"))), lambda e: e["k"].isNotNull()), lambda e: e))
        firsts = F.flatten(F.transform(F.array(sorted_), lambda s: F.filter(s, lambda e, i: (i == 0) | (F.get(s, F.greatest(i - 1, F.lit(0)))["k"] != e["k"]))))
        return Typed(F.map_from_arrays(F.transform(firsts, lambda e: e["k"]), F.transform(firsts, lambda e: F.get(collection.col, e["p"]))), T.MapType(T.StringType(), kind))
    if collection.kind == "dict" and isinstance(collection.type.valueType, T.StructType):
        fields = [f for f in collection.type.valueType.fields if f.name != key]
        kind = T.StructType([T.StructField(key, T.StringType()), *fields])
        return Typed(F.transform_values(collection.col, lambda k, x: F.struct(k.alias(key), *[x[f.name].alias(f.name) for f in fields])), T.MapType(T.StringType(), kind))
    return None
