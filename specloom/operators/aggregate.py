"""Reductions of a list in a row, and of all rows that a lookup matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SpecError
from ..functions.typed import DOUBLE, LONG, Typed, key_text, number

NUMERIC = {"SUM", "AVERAGE", "MEDIAN", "VARIANCE", "STD_DEV"}


def handling(operation: dict) -> str:
    return (operation.get("invalid_value_handling") or operation.get("null_handling") or "IGNORE").upper()


def _numbers(v: Typed, how: str) -> Typed:
    """v as a number under a rule for what is none: null, zero or an error."""
    n = number(v)
    if how == "TREAT_AS_ZERO":
        return Typed(F.coalesce(n.col, F.lit(0).cast(n.type)), n.type)
    if how == "ERROR_OUT":
        return Typed(F.when(n.col.isNull(), F.raise_error(F.lit("invalid value in an aggregate")).cast(n.type)).otherwise(n.col), n.type)
    return n


def _distinct(items: Column, inner: T.DataType, op: str, operation: dict) -> Typed:
    """SET or MODE of a list: entries in order of (key, position), so that equal keys stand together; n log n."""
    keyed = F.array_sort(F.transform(items, lambda x, i: F.struct(F.coalesce(key_text(Typed(x, inner)), F.lit("")).alias("k"), x.isNull().alias("none"), i.alias("p"))))
    same = lambda a, b: (a["k"] == b["k"]) & (a["none"] == b["none"])
    n = F.size(items)
    first = F.array_sort(F.transform(F.filter(F.array(keyed), lambda s: F.size(s) > 0), lambda s: s))  # the sorted entries once
    begins = F.flatten(F.transform(first, lambda s: F.filter(F.transform(s, lambda x, i: F.struct(i.alias("i"), x["p"].alias("p"), ((i == 0) | ~same(x, F.get(s, F.greatest(i - 1, F.lit(0))))).alias("new"))), lambda x: x["new"])))
    if op == "SET":
        return Typed(F.transform(F.array_sort(F.transform(begins, lambda x: x["p"])), lambda p: F.get(items, p)), T.ArrayType(inner))
    counted = F.transform(F.array(begins), lambda b: F.transform(b, lambda x, j: F.struct((F.coalesce(F.get(b, j + 1)["i"], n) - x["i"]).alias("n"), (-x["p"] if operation.get("mode_ties") == "first" else x["p"]).alias("o"), x["p"].alias("p"))))
    return Typed(F.get(items, F.array_max(F.flatten(counted))["p"]), inner)


def reduce_list(v: Typed, operation: dict) -> Typed:
    """A list in a row (or a scalar, as a list of one) reduced."""
    op = operation["operator"].upper()
    if op == "CUSTOM":
        raise SpecError("CUSTOM aggregates have no definition")
    if v.kind != "list":
        v = Typed(F.when(v.col.isNotNull(), F.array(v.col)), T.ArrayType(v.type))
    inner = v.type.elementType
    empty = F.array().cast(v.type)
    items = F.coalesce(v.col, empty)
    if op in ("LIST", "ARRAY"):
        return Typed(items, v.type)
    if op == "COUNT":
        return Typed(F.size(items).cast(LONG), LONG)
    if op in ("SET", "MODE"):
        return _distinct(items, inner, op, operation)
    how = handling(operation) if op in NUMERIC else "IGNORE"
    n = _numbers(Typed(F.lit(None).cast(inner), inner), how).type
    numbers = F.filter(F.transform(items, lambda x: _numbers(Typed(x, inner), how).col), lambda x: x.isNotNull())
    if op in ("MIN", "MAX"):
        sign = 1 if op == "MIN" else -1
        ranked = F.filter(F.transform(items, lambda x, i: F.struct((number(Typed(x, inner)).col * sign).alias("n"), i.alias("p"), x.alias("v"))), lambda x: x["n"].isNotNull())
        return Typed(F.array_min(ranked)["v"], inner)
    total = F.aggregate(numbers, F.lit(0).cast(n), lambda a, x: a + x)
    count = F.size(numbers)
    if op == "SUM":
        return Typed(total, n)
    mean = F.when(count > 0, total.cast(DOUBLE) / count)
    if op == "AVERAGE":
        return Typed(mean, DOUBLE)
    if op == "MEDIAN":
        s = F.sort_array(numbers)
        low, high = F.try_element_at(s, ((count + 1) / 2).cast("int")), F.try_element_at(s, (count / 2 + 1).cast("int"))
        return Typed(F.when(count > 0, (low.cast(DOUBLE) + high.cast(DOUBLE)) / 2), DOUBLE)
    spread = F.aggregate(numbers, F.struct(F.lit(0.0).alias("s"), mean.alias("m")), lambda a, x: F.struct((a["s"] + (x - a["m"]) * (x - a["m"])).alias("s"), a["m"].alias("m")))["s"]
    variance = F.when(count > 0, spread / count)
    return Typed(F.sqrt(variance) if op == "STD_DEV" else variance, DOUBLE)


def over_values(v: Typed, operation: dict) -> tuple[Column, T.DataType, Column | None]:
    """(aggregate, type, value for no rows) of SET or MODE over the distinct values of a group, of which the columns x
    (the value, in a struct), n (how often) and p (first position) are known: as large as the distinct values."""
    if operation["operator"].upper() == "SET":
        kind = T.ArrayType(v.type)
        return F.transform(F.sort_array(F.collect_list(F.struct("p", "x"))), lambda s: s["x"]["v"]), kind, F.array().cast(kind)
    order = F.struct("n", -F.col("p") if operation.get("mode_ties") == "first" else F.col("p"))
    return F.max_by("x", order)["v"], v.type, None


def over_rows(v: Typed, position: Column, operation: dict) -> tuple[Column, T.DataType, Column | None]:
    """(aggregate, type, value for no rows) for one value over a group of rows; SET and MODE see over_values."""
    op = operation["operator"].upper()
    if op == "CUSTOM":
        raise SpecError("CUSTOM aggregates have no definition")
    if op == "COUNT":
        return F.count(F.lit(1)), LONG, F.lit(0).cast(LONG)
    if op in ("LIST", "ARRAY"):
        ordered = F.sort_array(F.collect_list(F.struct(position.alias("p"), F.struct(v.col.alias("v")).alias("x"))))
        kind = T.ArrayType(v.type)
        return F.transform(ordered, lambda s: s["x"]["v"]), kind, F.array().cast(kind)
    if op in ("MIN", "MAX"):
        n = number(v).col
        if v.numeric:
            return (F.min if op == "MIN" else F.max)(v.col), v.type, None
        by = F.when(n.isNotNull(), F.struct(n if op == "MIN" else -n, position))
        return F.min_by(F.when(n.isNotNull(), v.col), by), v.type, None
    n = _numbers(v, handling(operation))
    if op == "SUM":
        return F.sum(n.col), n.type, F.lit(0).cast(n.type)
    f = {"AVERAGE": F.avg, "MEDIAN": F.median, "VARIANCE": F.var_pop, "STD_DEV": F.stddev_pop}[op]
    return f(n.col.cast(DOUBLE)), DOUBLE, None


def over_groups(rows: DataFrame, keys: list[str], wanted: dict[str, tuple[Typed, dict]], position: str) -> DataFrame:
    """One row per combination of keys (one row without keys), with each wanted {column: (value, operation)} over its
    rows, which are ordered by a position. SET and MODE are counted per value first and joined to the others."""
    plain, counted, empties = [], [], {}
    by = [F.col(f"`{k}`") for k in keys]
    for name, (v, operation) in wanted.items():
        if operation["operator"].upper() in ("SET", "MODE"):
            counted.append(name)
            continue
        column, _, empties[name] = over_rows(v, F.col(position), operation)
        plain.append(column.alias(name))
    made = [rows.groupBy(*by).agg(*plain)] if plain else []
    for name in counted:
        v, operation = wanted[name]
        values = rows.groupBy(*by, key_text(v).alias("_v")).agg(F.min_by(F.struct(v.col.alias("v")), F.col(position)).alias("x"), F.count(F.lit(1)).alias("n"), F.min(position).alias("p"))
        column, _, empties[name] = over_values(v, operation)
        made.append(values.groupBy(*by).agg(column.alias(name)))
    out = made[0]
    for k, more in enumerate(made[1:]):
        names = {n: f"_g{k}_{i}" for i, n in enumerate(keys)}
        more = more.select(*[F.col(f"`{n}`").alias(to) for n, to in names.items()], *[F.col(f"`{c}`") for c in more.columns if c not in keys])
        same = F.lit(True)
        for n, to in names.items():
            same = same & F.col(f"`{n}`").eqNullSafe(F.col(to))
        out = out.join(more, same).drop(*names.values())
    return out.select(*by, *[(F.col(f"`{n}`") if empties[n] is None else F.coalesce(F.col(f"`{n}`"), empties[n])).alias(n) for n in wanted])
