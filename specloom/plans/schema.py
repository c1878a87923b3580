"""Schemas: classes, slots, enums, types and prefixes, with inheritance resolved and a Spark type for every class.

A schema is a mapping in the usual YAML form; missing parts are empty. ``from_struct`` derives one from DataFrames.
"""

from __future__ import annotations

import copy
from dataclasses import dataclass, field

from pyspark.sql import types as T

from ..errors import SpecError
from ..functions.typed import BOOL, DOUBLE, LONG, STRING

INTEGERS = {"integer", "int", "nonnegativeinteger", "positiveinteger", "nonpositiveinteger", "negativeinteger"}
FLOATS = {"float", "double", "decimal"}
BOOLEANS = {"boolean", "bool"}
#: Unit keys in the order in which they name a unit (fixed values).
UNIT_SCHEMES = ("ucum_code", "iec61360code", "symbol", "abbreviation", "descriptive_name")


@dataclass
class Slot:
    name: str
    range: str | None = None
    multivalued: bool = False
    inlined: bool = False
    inlined_as_list: bool = False
    required: bool = False
    identifier: bool = False
    unit: dict = field(default_factory=dict)
    enums: list[str] = field(default_factory=list)


class Schema:
    def __init__(self, definition: dict | None = None, patches: dict | None = None):
        self.definition = patch(definition or {}, patches) if patches else copy.deepcopy(definition or {})
        part = lambda k: {n: (v or {}) for n, v in (self.definition.get(k) or {}).items()}
        self.classes, self.enums, self.types, self.slots = part("classes"), part("enums"), part("types"), part("slots")
        self.prefixes = {k: (v.get("prefix_reference") if isinstance(v, dict) else v) for k, v in (self.definition.get("prefixes") or {}).items()}
        self.prefixes.setdefault("linkml", "https://w3id.org/linkml/")

    @staticmethod
    def from_struct(tables: dict[str, T.StructType]) -> Schema:
        """One class per table, from its columns; nested structs become classes named table_column."""
        classes: dict = {}

        def attribute(kind: T.DataType, name: str) -> dict:
            if isinstance(kind, T.ArrayType):
                return {**attribute(kind.elementType, name), "multivalued": True, "inlined_as_list": isinstance(kind.elementType, T.StructType)}
            if isinstance(kind, T.StructType):
                classes[name] = {"attributes": {f.name: attribute(f.dataType, f"{name}_{f.name}") for f in kind.fields}}
                return {"range": name, "inlined": True}
            whole = isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
            real = isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType))
            return {"range": "integer" if whole else "float" if real else "boolean" if isinstance(kind, T.BooleanType) else "string"}

        for table, struct in tables.items():
            attribute(struct, table)
        return Schema({"classes": classes})

    def has_class(self, name: str | None) -> bool:
        return name in self.classes

    def ancestors(self, name: str) -> list[str]:
        """A class's parents, mixins before is_a, nearest last ones first to be overridden."""
        c = self.classes.get(name)
        if c is None:
            return []
        out = []
        for parent in [*([c["is_a"]] if c.get("is_a") else []), *(c.get("mixins") or [])]:
            out += [*self.ancestors(parent), parent]
        return out

    def induced(self, name: str) -> dict[str, Slot]:
        """All slots of a class with inheritance, slot usage and top-level slot definitions applied."""
        merged: dict[str, dict] = {}
        for c in [*self.ancestors(name), name]:
            d = self.classes.get(c, {})
            for s in d.get("slots") or []:
                merged[s] = {**self.slots.get(s, {}), **merged.get(s, {})}
            for s, a in (d.get("attributes") or {}).items():
                merged[s] = {**merged.get(s, {}), **(a or {})}
            for s, a in (d.get("slot_usage") or {}).items():
                merged[s] = {**merged.get(s, {}), **(a or {})}
        default = self.definition.get("default_range")
        out = {}
        for s, a in merged.items():
            enums = [x.get("range") for x in a.get("any_of") or [] if x.get("range") in self.enums]
            out[s] = Slot(s, a.get("range") or default, bool(a.get("multivalued")), bool(a.get("inlined") or a.get("inlined_as_list")), bool(a.get("inlined_as_list")), bool(a.get("required")), bool(a.get("identifier") or a.get("key")), a.get("unit") or {}, enums)
        return out

    def slot(self, cls: str | None, name: str) -> Slot | None:
        return self.induced(cls).get(name) if cls in self.classes else None

    def identifier(self, cls: str) -> str | None:
        return next((s.name for s in self.induced(cls).values() if s.identifier), None)

    def tree_root(self) -> str | None:
        return next((n for n, c in self.classes.items() if c.get("tree_root")), None)

    def struct_type(self, cls: str, path: tuple = (), without: str | None = None) -> T.StructType:
        """The Spark type of a class; a cycle of inlined classes ends as text."""
        fields = [T.StructField(s.name, self._type(s, (*path, cls)), not s.required, {"unit": s.unit} if s.unit else {}) for s in self.induced(cls).values() if s.name != without]
        return T.StructType(fields)

    def _type(self, s: Slot, path: tuple) -> T.DataType:
        if s.range in self.classes:
            key = self.identifier(s.range)
            if key and not s.inlined:
                one: T.DataType = self._scalar(self.slot(s.range, key).range)
            elif path.count(s.range) >= 2:
                one = STRING
            else:
                if s.multivalued and key and not s.inlined_as_list:
                    return T.MapType(STRING, self.struct_type(s.range, path, key))
                one = self.struct_type(s.range, path)
        else:
            one = self._scalar(s.range)
        return T.ArrayType(one) if s.multivalued else one

    @staticmethod
    def _scalar(name: str | None) -> T.DataType:
        n = (name or "string").lower()
        return LONG if n in INTEGERS else DOUBLE if n in FLOATS else BOOL if n in BOOLEANS else STRING

    def expand(self) -> list[tuple[str, str]]:
        return sorted(((p + ":", u) for p, u in self.prefixes.items() if u), key=lambda x: -len(x[0]))

    def compress(self) -> list[tuple[str, str]]:
        return sorted(((u, p + ":") for p, u in self.prefixes.items() if u), key=lambda x: -len(x[0]))


def patch(definition: dict, patches: dict) -> dict:
    """An additive merge: mappings merge, lists get what they lack, classes, slots, enums and prefixes are created."""
    out = copy.deepcopy(definition)

    def merge(into: dict, more: dict) -> None:
        for k, v in more.items():
            if isinstance(v, dict) and isinstance(into.get(k) or {}, dict):
                into[k] = into.get(k) or {}
                merge(into[k], v)
            elif isinstance(v, list) and isinstance(into.get(k), list):
                into[k] += [x for x in v if x not in into[k]]
            else:
                into[k] = copy.deepcopy(v)

    if not isinstance(patches, dict):
        raise SpecError("source_schema_patches must be a mapping")
    merge(out, patches)
    return out
