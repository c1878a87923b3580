"""The planner: a specification and a schema become DataFrame plans.

Everything about a specification is resolved here, on the driver: which derivation maps a class, what names mean, which
tables are looked up by which keys, and the type of every slot. What runs is one projection over left joins to tables
that hold one row per key, so rows are neither lost nor multiplied.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SpecError, UnitError
from ..functions import units
from ..functions.expression import FUNCTIONS, Scope, compile_expression, references
from ..functions.extensions import EXTENDED
from ..functions.typed import DOUBLE, STRING, Typed, array, attempt, key_text, literal, null, number, struct
from ..operators import aggregate, coerce, lookup, pivot
from . import joins as join_rules
from .schema import Schema
from .spec import derivation_for, inherited, normalise


class Mapper:
    """Maps tables by a specification.

    source_schema, target_schema: schema mappings (or Schema); without a source schema one is taken from the tables.
    strict: unknown names in expressions are errors. nested_row: merged lets nested objects on another table read the
    joined row first and then the parent row; parent reads the parent row only. on_bad_cast: null, keep or error.
    ordered: rows come in the order of the source table (a global sort); pivots and groups have no such order.
    extensions: expressions may call the functions of functions/extensions.py too. grouped: a derivation with aggregates
    gives one row per distinct combination of its other slots (constants left out), each aggregate taken over the rows
    of the group; a column of another table is that of the row's first match. Without it, an aggregate reduces a list
    of the row or all rows that a lookup matches. on_error: fail lets a failing row fail the job; collect leaves failing
    rows out and gives them, as they were read, under rejected[class], and their number, once what transform returned
    has been written, under observed[class]. Rows fail one by one in the projection: streams, pivots, groups and
    aggregates over joined rows fail as a whole.
    """

    def __init__(self, spec, source_schema=None, target_schema=None, strict: bool = False, nested_row: str = "merged", on_bad_cast: str = "null", ordered: bool = False, extensions: bool = False, grouped: bool = False, on_error: str = "fail"):
        if on_error not in ("fail", "collect"):
            raise SpecError(f"on_error is fail or collect, not {on_error!r}")
        self.spec = normalise(spec)
        given = source_schema if isinstance(source_schema, Schema) or source_schema is None else Schema(source_schema)
        patches = self.spec.get("source_schema_patches")
        self.source = Schema(given.definition, patches) if given is not None and patches else given
        self.target = target_schema if isinstance(target_schema, Schema) or target_schema is None else Schema(target_schema)
        self.strict, self.nested_row, self.on_bad_cast, self.ordered = strict, nested_row, on_bad_cast, ordered
        self.functions, self.grouped = EXTENDED if extensions else FUNCTIONS, grouped
        self.tables: dict[str, tuple[DataFrame, str | None]] = {}
        self.collects = on_error == "collect"
        self.rejected: dict[str, DataFrame] = {}
        self.observed: dict[str, Observation] = {}

    def register_join_table(self, name: str, table: DataFrame, key: str | None = None) -> Mapper:
        """A table for lookups; registering a name again replaces it."""
        self.tables[name] = (table, key)
        return self

    # -- entry points -------------------------------------------------------------------------------------------------
    def transform(self, source: DataFrame | dict[str, DataFrame], source_class: str | None = None):
        """A DataFrame for a DataFrame; {target class: DataFrame} for {class: DataFrame} (one if source_class is given)."""
        if isinstance(source, DataFrame):
            name = source_class or self.source_class(None)
            return self._rows(source, name, {name: source})
        if source_class:
            return self._rows(source[source_class], source_class, source)
        out = {}
        for d in self.spec["class_derivations"]:
            name = d.get("populated_from") or d["name"]
            if name in source:
                out[d["name"]] = self._rows(source[name], name, source)
        return out

    def source_class(self, given: str | None) -> str:
        """The class to map: as given, else the schema's root, its only class, or the first derivation's source."""
        if given:
            return given
        if self.source:
            root = self.source.tree_root()
            if root:
                return root
            if len(self.source.classes) == 1:
                return next(iter(self.source.classes))
        if not self.spec["class_derivations"]:
            raise SpecError("no class given, and none can be inferred")
        first = self.spec["class_derivations"][0]
        return first.get("populated_from") or first["name"]

    # -- rows ---------------------------------------------------------------------------------------------------------
    def _values(self, df: DataFrame, name: str) -> DataFrame:
        """A table of values of an enum or a type, in its one column: enum values mapped, others as they are."""
        if len(df.columns) != 1:
            raise SpecError(f"values of {name} stand in one column, not in {len(df.columns)}")
        if name in self.source.types:
            return df
        field = df.schema.fields[0]
        made = _Plan(self, self.source, {"joins": {}, "slot_derivations": {}}, name, {}, df).enum(Typed(F.col(f"`{field.name}`"), field.dataType), [name])
        return df.select(made.col.alias(field.name))

    def _rows(self, df: DataFrame, name: str, tables: dict[str, DataFrame]) -> DataFrame:
        if self.source and not self.source.has_class(name) and (name in self.source.enums or name in self.source.types):
            return self._values(df, name)
        derivation = derivation_for(self.spec, name)
        known = {t: d for t, (d, _) in self.tables.items()} | {t: d for t, d in tables.items() if t != name}
        schema = self.source or Schema.from_struct({t: d.schema for t, d in {**known, name: df}.items()})
        derivation = join_rules.synthesise(self.spec, derivation, schema, name, {t: d.columns for t, d in known.items()})
        operation = derivation.get("pivot_operation")
        plan = _Plan(self, schema, derivation, name, known, df)
        if operation and operation.get("direction", "").upper() == "MELT":
            fallback = list(self.target.induced(derivation["name"])) if self.target and self.target.has_class(derivation["name"]) else None
            return pivot.melt(df, {**operation, "source_slots": operation.get("source_slots") or fallback})
        df, scope = plan.joined(lookup.positioned(df) if self.ordered and not operation else df)
        if operation:
            targets = operation.get("unmelt_to_slots") or list(self.target.induced(derivation["name"]) if self.target else derivation["slot_derivations"])
            records = next((v for v in scope.values() if v.kind == "list" and isinstance(v.type.elementType, T.StructType) and operation.get("variable_slot", "variable") in v.type.elementType.fieldNames()), None)
            if records is None and operation.get("id_slots"):
                return pivot.unmelt(df, operation, targets)
            made = pivot.unmelt_collection(records, operation, targets) if records else pivot.unmelt_record(scope, operation, targets)
            return df.select(*[v.col.alias(k) for k, v in made.items()])
        if self.grouped and any(s.get("aggregation_operation") for s in derivation["slot_derivations"].values()):
            return plan.grouped(df, scope)
        if self.collects and not df.isStreaming:
            return self._split(plan, df, scope, name)
        if self.ordered:
            return plan.project(df, scope, (lookup.POSITION,)).orderBy(lookup.POSITION).drop(lookup.POSITION)
        return plan.project(df, scope)

    def _split(self, plan: _Plan, df: DataFrame, scope: dict[str, Typed], name: str) -> DataFrame:
        """The rows that can be mapped; those that cannot are kept in rejected and counted in observed."""
        source = F.struct(*[v.col.alias(k) for k, v in scope.items()]).alias("source")
        rows = plan.project(df, scope, (source, *([lookup.POSITION] if self.ordered else ())), tried="row")
        if self.ordered:
            rows = rows.orderBy(lookup.POSITION)
        self.rejected[name] = rows.filter(F.col("row").isNull()).select("source.*")
        self.observed[name] = Observation()
        return rows.observe(self.observed[name], F.count_if(F.col("row").isNull()).alias("rejected")).filter(F.col("row").isNotNull()).select("row.*")


class _Plan:
    """The mapping of one source table."""

    def __init__(self, mapper: Mapper, schema: Schema, derivation: dict, name: str, tables: dict[str, DataFrame], own: DataFrame):
        self.m, self.schema, self.derivation, self.name, self.tables, self.own = mapper, schema, derivation, name, tables, own
        self.base: dict[str, Typed] = {}
        self.foreign: dict[str, Typed] = {}
        self.aliases: dict[str, Typed] = {}
        self.aggregates: dict[tuple[str, str], Typed] = {}
        self.containers: dict[str, Typed] = {}

    # -- joins --------------------------------------------------------------------------------------------------------
    def joined(self, df: DataFrame) -> tuple[DataFrame, dict[str, Typed]]:
        base = {f.name: Typed(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields if f.name != lookup.POSITION}
        first, every = join_rules.uses(self.derivation, self.m.grouped)
        for alias, j in self.derivation["joins"].items():
            table = self.tables.get(j.get("class_named") or alias)
            source_key = j.get("source_key") or j.get("join_on")
            key = j.get("lookup_key") or j.get("join_on") or (self.m.tables.get(alias) or (None, None))[1]
            if table is None:
                self.aliases[alias] = null()
                continue
            if not source_key or not key:
                raise SpecError(f"join {alias} has no keys")
            wanted = {f"_agg_{alias}_{k}": (field, op) for k, (slot, field, op) in enumerate(every.get(alias, []))}
            for column, (field, _) in wanted.items():
                if field not in table.columns:
                    raise SpecError(f"{alias} has no column {field}")
            if wanted:
                df, values = lookup.all_matches(df, source_key, table, key, alias, wanted)
                for (slot, field, _), column in zip(every[alias], wanted):
                    self.aggregates[slot, f"{alias}.{field}"] = values[column]
            columns = [c for c in table.columns if c in first.get(alias, ())] or [key]
            if alias in first:
                df = lookup.first_match(df, source_key, table, key, alias, columns)
                self.aliases[alias] = Typed(F.col(f"`_j_{alias}`"), df.schema[f"_j_{alias}"].dataType)
        self._containers(base)
        self.base = base
        for column, read in join_rules.followed(self.derivation).items():
            df = self._foreign(df, column, read)
        return df, base

    def _foreign(self, df: DataFrame, column: str, read: set[str]) -> DataFrame:
        """df with the object, in a table of its class, that an identifier (or a list of them) refers to; a reference
        that leads nowhere is null. Objects of the same container are found without a join."""
        slot = self.schema.slot(self.name, column)
        if slot is None or column not in self.base or slot.inlined or slot.range not in self.schema.classes or slot.range in self.containers:
            return df
        key, table = self.schema.identifier(slot.range), self.own if slot.range == self.name else self.tables.get(slot.range)
        if key is None or table is None or key not in table.columns:
            return df
        v, alias = self.base[column], f"fk_{column}"
        several = v.kind == "list"
        if (v.element(v.col) if several else v).kind not in ("int", "text"):
            return df
        match = lookup.listed_matches if several else lookup.first_match
        df = match(df, column, table, key, alias, [c for c in table.columns if c in read or c == key])
        self.foreign[column] = Typed(F.col(f"`_j_{alias}`"), df.schema[f"_j_{alias}"].dataType)
        return df

    def _containers(self, base: dict[str, Typed]) -> None:
        """Maps by identifier of the inlined collections of this row, for references between objects of one container."""
        for slot in self.schema.induced(self.name).values() if self.schema.has_class(self.name) else ():
            if slot.range in self.schema.classes and slot.name in base and (slot.inlined or slot.multivalued):
                key = self.schema.identifier(slot.range)
                found = lookup.keyed_map(base[slot.name], key) if key else None
                if found is not None:
                    self.containers.setdefault(slot.range, found)

    # -- projection ---------------------------------------------------------------------------------------------------
    def grouped(self, df: DataFrame, base: dict[str, Typed]) -> DataFrame:
        """One row per combination of the slots that are no aggregates and no constants, aggregates over its rows."""
        slots = {n: s for n, s in self.derivation["slot_derivations"].items() if not s.get("hide")}
        aggregates = {n: s["aggregation_operation"] for n, s in slots.items() if s.get("aggregation_operation")}
        constants = {n: literal(s["value"]) for n, s in slots.items() if s.get("value") is not None and n not in aggregates}
        keys = [n for n in slots if n not in aggregates and n not in constants]
        inputs: dict[str, Typed] = {}
        for n in aggregates:
            v, _ = self.copied({**slots[n], "populated_from": slots[n].get("populated_from") or n}, base, self.name, {})
            inputs[n] = Typed(v.col.cast(STRING), STRING) if v.kind == "null" else v
        df = lookup.positioned(df)
        rows = self.project(df, base, (*[v.col.alias(f"_v_{n}") for n, v in inputs.items()], lookup.POSITION), {n for n in self.derivation["slot_derivations"] if n not in aggregates})
        made = aggregate.over_groups(rows, keys, {n: (Typed(F.col(f"`_v_{n}`"), v.type), aggregates[n]) for n, v in inputs.items()}, lookup.POSITION)
        return made.select(*[(constants[n].col if n in constants else F.col(f"`{n}`")).alias(n) for n in slots])

    def project(self, df: DataFrame, base: dict[str, Typed], kept: tuple = (), only: set[str] | None = None, tried: str | None = None) -> DataFrame:
        """One select, with the columns kept as they are; slots that others read through slot() are columns of their own
        first, so nothing is repeated. tried: all slots are one struct column of that name, null where one of them fails."""
        read = () if tried else join_rules.slots_read(self.derivation)
        made: dict[str, Typed] = {}
        for name, s in self.derivation["slot_derivations"].items():
            if only is not None and name not in only:
                continue
            v = self.slot(s, base, made, self.derivation, self.name, {})
            if name in read:
                column = f"_slot_{name}"
                v = Typed(v.col.cast("string"), STRING) if v.kind == "null" else v
                df = df.withColumn(column, v.col)
                v = Typed(F.col(f"`{column}`"), v.type)
            made[name] = v
        shown = {k: v for k, v in made.items() if not self.derivation["slot_derivations"][k].get("hide")}
        columns = [(v.col.cast(STRING) if v.kind == "null" else v.col).alias(k) for k, v in shown.items()]
        return df.select(*([attempt(F.struct(*columns)).alias(tried)] if tried else columns), *kept)

    def object(self, derivation: dict, source: dict[str, Typed], cls: str | None, extra: dict[str, Typed]) -> Typed:
        made: dict[str, Typed] = {}
        for name, s in derivation["slot_derivations"].items():
            made[name] = self.slot(s, source, made, derivation, cls, extra)
        shown = {k: v for k, v in made.items() if not derivation["slot_derivations"][k].get("hide")}
        if not shown:
            raise SpecError(f"class derivation {derivation['name']} has no slots")
        return struct(shown)

    def scope(self, source: dict[str, Typed], made: dict[str, Typed], cls: str | None, extra: dict[str, Typed], dotted: set[str]) -> Scope:
        names = {s: null() for s in (self.schema.induced(cls) if self.schema.has_class(cls) else ())}
        names |= source
        for name in dotted & set(names):
            names[name] = self.follow(names[name], cls, name)
        names |= {"_source_class": literal(cls or ""), **self.aliases, **extra}
        names["src"] = struct({k: v for k, v in source.items()}) if source else null()
        return Scope(names, made, self.m.strict, self.m.functions)

    def follow(self, v: Typed, cls: str | None, name: str) -> Typed:
        """An identifier (or list of them) as the object it refers to, of this container or of a table joined for it."""
        if name in self.foreign and self.base.get(name) is v:
            return self.foreign[name]
        slot = self.schema.slot(cls, name)
        index = self.containers.get(slot.range) if slot and slot.range in self.schema.classes else None
        if index is None or v.kind in ("object", "dict", "null"):
            return v
        kind = index.type.valueType
        if v.kind == "list":
            return v if isinstance(v.type.elementType, T.StructType) else Typed(F.transform(v.col, lambda x: F.try_element_at(index.col, x.cast("string"))), T.ArrayType(kind))
        return Typed(F.try_element_at(index.col, v.col.cast("string")), kind)

    def expression(self, source_text: str, source, made, cls, extra) -> Typed:
        _, pairs = references(source_text)
        return compile_expression(source_text, self.scope(source, made, cls, extra, {a for a, _ in pairs}))

    # -- one slot -----------------------------------------------------------------------------------------------------
    def slot(self, s: dict, source: dict[str, Typed], made: dict[str, Typed], derivation: dict, cls: str | None, extra: dict[str, Typed]) -> Typed:
        name, origin = s["name"], None
        try:
            if s.get("value") is not None:
                v = literal(s["value"])
            elif s.get("unit_conversion"):
                v = self.unit(s, source, cls)
            elif s.get("aggregation_operation"):
                v = self.aggregated(s, source, cls)
            elif s.get("expr") is not None:
                v = self.expression(str(s["expr"]), source, made, cls, extra)
            elif s.get("populated_from"):
                v, origin = self.copied(s, source, cls, extra)
                v = self.mapped(s, v, source, made, cls, extra)
            elif s.get("class_derivations"):
                v = self.nested(s, source, derivation, cls, extra)
            else:
                v, origin = source.get(name, null()), self.schema.slot(cls, name)
            if s.get("missing_values") and v.kind != "null":
                v = coerce.missing(v, s["missing_values"])
            if origin is not None and not s.get("hide"):
                v = self.coerced(s, v, origin, derivation, extra)
            elif s.get("stringification") and origin is None and s.get("expr") is None:
                v = coerce.to_list(v, s["stringification"]) if s["stringification"].get("reversed") else coerce.to_single(v, s["stringification"])
            v = coerce.curie(v, s.get("range"), self.schema, self.m.spec["prefixes"])
            if s.get("offset"):
                field = source.get(s["offset"].get("offset_field"))
                v = coerce.offset(v, s["offset"], field)
            return v
        except SpecError as e:
            if str(e).startswith("slot "):
                raise
            raise type(e)(f"slot {derivation['name']}.{name}: {e}") from e

    def copied(self, s: dict, source: dict[str, Typed], cls: str | None, extra: dict[str, Typed]):
        """(value, the schema's slot it came from) of a name or a dotted path."""
        path = s["populated_from"]
        if path == "_source_class":
            return literal(cls or ""), None
        root, *rest = path.split(".")
        if not rest:
            return source.get(path, null()), self.schema.slot(cls, path)
        if root in self.aliases or root in extra:
            v, at = self.aliases.get(root) or extra[root], (self.derivation["joins"].get(root) or {}).get("class_named") or root
        else:
            v = source.get(root, null())
            slot = self.schema.slot(cls, root)
            at = slot.range if slot else None
        origin = None
        for step in rest:
            if v.kind == "null":
                return v, None
            if v.kind == "list":
                raise SpecError(f"{path}: a list cannot be part of a path")
            if v.kind == "dict":
                v = Typed(F.try_element_at(v.col, F.lit(step)), v.type.valueType)
                continue
            if v.kind != "object":
                raise SpecError(f"{path}: {step} is read from a {v.kind} value")
            origin = self.schema.slot(at, step)
            at = origin.range if origin else None
            v = Typed(v.col[step], v.type[step].dataType) if step in v.type.fieldNames() else null()
        return v, origin

    def mapped(self, s: dict, v: Typed, source, made, cls, extra) -> Typed:
        values, expressions = s.get("value_mappings"), s.get("expression_mappings")
        if v.kind == "null" or not (values or expressions):
            return v
        table = {**{k: ("expr", x) for k, x in (expressions or {}).items()}, **{k: ("value", x) for k, x in (values or {}).items()}}
        make = lambda x: literal(x[1]) if x[0] == "value" else self.expression(str(x[1]), source, made, cls, extra)
        if v.kind == "list":
            inner = coerce.value_map(v.element(F.lit(None).cast(v.type.elementType)), table, make).type
            return Typed(F.transform(v.col, lambda x: coerce.value_map(v.element(x), table, make).col), T.ArrayType(inner))
        return coerce.value_map(v, table, make)

    def aggregated(self, s: dict, source: dict[str, Typed], cls: str | None) -> Typed:
        path = s.get("populated_from") or s["name"]
        if (s["name"], path) in self.aggregates:
            return self.aggregates[s["name"], path]
        root = path.split(".")[0]
        if root in self.derivation["joins"]:
            return null()
        v, _ = self.copied({**s, "populated_from": path}, source, cls, {})
        return aggregate.reduce_list(v, s["aggregation_operation"])

    # -- coercion -----------------------------------------------------------------------------------------------------
    def coerced(self, s: dict, v: Typed, origin, derivation: dict, extra) -> Typed:
        if v.kind == "null":
            return v
        wanted = self.m.target.slot(derivation["name"], s["name"]) if self.m.target else None
        rule = s.get("stringification")
        v = self.ranged(v, origin, extra)
        cast_as = s.get("cast_collection_as")
        if cast_as == "SingleValued" or (rule and not rule.get("reversed")) or (wanted and not wanted.multivalued and not cast_as):
            v = coerce.to_single(v, rule)
        elif cast_as == "MultiValued" or (rule and rule.get("reversed")) or (wanted and wanted.multivalued) or (origin.multivalued and not wanted):
            v = coerce.to_list(v, rule)
        if s.get("range"):
            v = coerce.datatype(v, s["range"], self.m.on_bad_cast)
        key = s.get("dictionary_key") or (self.schema.identifier(origin.range) if origin.range in self.schema.classes else None)
        return coerce.reshape(v, cast_as or ("MultiValuedDict" if s.get("dictionary_key") else None), key)

    def ranged(self, v: Typed, origin, extra) -> Typed:
        """Objects of a class mapped by its derivation, enum values by theirs."""
        if origin.range in self.schema.enums or origin.enums:
            enums = origin.enums or [origin.range]
            if v.kind == "list":
                inner = self.enum(v.element(F.lit(None).cast(v.type.elementType)), enums).type
                return Typed(F.transform(v.col, lambda x: self.enum(v.element(x), enums).col), T.ArrayType(inner))
            return self.enum(v, enums)
        if origin.range in self.schema.classes:
            return self.mapped_class(v, origin.range, extra)
        return v

    def mapped_class(self, v: Typed, cls: str, extra) -> Typed:
        if v.kind == "list" and isinstance(v.type.elementType, T.StructType):
            kind = self.mapped_class(v.element(F.lit(None).cast(v.type.elementType)), cls, extra).type
            return Typed(F.transform(v.col, lambda x: self.mapped_class(v.element(x), cls, extra).col), T.ArrayType(kind))
        if v.kind == "dict" and isinstance(v.type.valueType, T.StructType):
            kind = self.mapped_class(Typed(F.lit(None).cast(v.type.valueType), v.type.valueType), cls, extra).type
            return Typed(F.transform_values(v.col, lambda k, x: self.mapped_class(Typed(x, v.type.valueType), cls, extra).col), T.MapType(STRING, kind))
        if v.kind != "object":
            return v
        found = [c for c in self.m.spec["class_derivations"] if (c.get("populated_from") or c["name"]) == cls]
        if not found:
            raise SpecError(f"no class derivation for {cls}")
        source = {f.name: Typed(v.col[f.name], f.dataType) for f in v.type.fields}
        made = self.object(inherited(self.m.spec, found[0]), source, cls, extra)
        return Typed(F.when(v.col.isNotNull(), made.col), made.type)

    def enum(self, v: Typed, enums: list[str]) -> Typed:
        derivations = self.m.spec["enum_derivations"]
        if not derivations:
            return v
        out = None
        for name in enums:
            d = next((e for e in derivations.values() if (e.get("populated_from") or e["name"]) == name), None)
            if d is None:
                continue
            table: dict = {}
            for p in d["permissible_value_derivations"].values():
                origins = [*([p["populated_from"]] if isinstance(p.get("populated_from"), str) else p.get("populated_from") or []), *(p.get("sources") or [])] or [p["name"]]
                for o in origins:
                    table.setdefault(str(o), p["name"])
            parts = []
            if d.get("expr") is not None:
                parts.append(key_text(compile_expression(str(d["expr"]), Scope({"source": v, "value": v, "_source_class": literal(name)}, functions=self.m.functions))))
            if table:
                parts.append(coerce.value_map(v, table).col)
            if d.get("mirror_source"):
                parts.append(key_text(v))
            here = F.when(v.col.isNotNull(), F.coalesce(*parts)) if parts else F.lit(None).cast(STRING)
            out = here if out is None else F.coalesce(out, here)
        return Typed(out if out is not None else F.lit(None).cast(STRING), STRING)

    # -- nested objects -----------------------------------------------------------------------------------------------
    def nested(self, s: dict, source, derivation: dict, cls: str | None, extra) -> Typed:
        """Objects built from the same row, or from the row's match in another table (left out without a match)."""
        items, several = [], None
        wanted = self.m.target.slot(derivation["name"], s["name"]) if self.m.target else None
        several = wanted.multivalued if wanted else len(s["class_derivations"]) > 1
        for d in s["class_derivations"]:
            d = inherited(self.m.spec, d)
            table = d.get("populated_from")
            if table and table != cls and table in self.derivation["joins"]:
                row = self.aliases.get(table, null())
                if row.kind == "null":
                    continue
                merged = dict(source)
                if self.m.nested_row == "merged":
                    fields = {f.name: Typed(row.col[f.name], f.dataType) for f in row.type.fields}
                    merged |= fields
                made = self.object(d, merged, cls if self.m.nested_row == "parent" else table, {**extra, table: row})
                made = Typed(F.when(row.col.isNotNull(), made.col), made.type)
            else:
                made = self.object(d, source, cls, extra)
            items.append(made)
        if not items:
            return null()
        if several:
            out = array(items)
            return Typed(F.array_compact(out.col), out.type)
        return items[0]

    # -- units --------------------------------------------------------------------------------------------------------
    def unit(self, s: dict, source, cls: str | None) -> Typed:
        rule = s["unit_conversion"]
        path = s.get("populated_from") or s["name"]
        v, origin = self.copied({**s, "populated_from": path}, source, cls, {})
        if v.kind == "null":
            return Typed(F.lit(None).cast(DOUBLE), DOUBLE)
        target, scheme = rule.get("target_unit"), rule.get("source_unit_scheme")
        weight, valence = rule.get("molecular_weight"), rule.get("valence")
        declared, found_scheme = None, None
        for key in ("ucum_code", "iec61360code", "symbol", "abbreviation", "descriptive_name"):
            if origin and origin.unit.get(key):
                declared, found_scheme = origin.unit[key], key
                break
        scheme = rule.get("target_unit_scheme") or scheme or found_scheme
        given = rule.get("source_unit")
        if given and declared and given != declared:
            raise UnitError(f"unit {declared!r} of the schema is not {given!r} of the specification")
        unit = declared or given
        if rule.get("source_unit_slot") or v.kind == "object":
            mag, uslot = rule.get("source_magnitude_slot") or "magnitude", rule.get("source_unit_slot") or "unit"
            if mag not in v.type.fieldNames() or uslot not in v.type.fieldNames():
                raise UnitError(f"{path} has no {mag} or {uslot}")
            amount, token = Typed(v.col[mag], v.type[mag].dataType), v.col[uslot]
            out = F.raise_error(F.concat(F.lit("cannot convert unit "), F.coalesce(token, F.lit("None")), F.lit(f" to {target}"))).cast(DOUBLE)
            for name in [unit] if unit else [*units.known(scheme), *([target] if target else [])]:
                try:
                    a, b = units.conversion(name, target, scheme, None, weight, valence)
                except UnitError:
                    continue
                out = F.when(token == name, number(amount).col.cast(DOUBLE) * a + b).otherwise(out)
            if target is None:
                out = number(amount).col.cast(DOUBLE)
            result = Typed(F.when(v.col.isNotNull(), out), DOUBLE)
        else:
            if unit is None:
                raise UnitError(f"{path} has no unit")
            a, b = units.conversion(unit, target, scheme, None, weight, valence)
            moved = number(v).col.cast(DOUBLE) * a + b
            if v.kind == "text" and not rule.get("none_if_non_numeric"):
                result = Typed(F.coalesce(moved.cast(STRING), v.col), STRING)
            else:
                result = Typed(moved, DOUBLE)
        if rule.get("target_magnitude_slot"):
            fields = {rule["target_magnitude_slot"]: result}
            if rule.get("target_unit_slot"):
                fields[rule["target_unit_slot"]] = literal(target or unit)
            made = struct(fields)
            return Typed(F.when(v.col.isNotNull(), made.col), made.type)
        return result


__all__ = ["Mapper"]
