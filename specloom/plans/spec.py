"""Specifications: shortcuts expanded, references checked, classes inherited."""

from __future__ import annotations

import copy

from ..errors import SpecError

#: Keys that hold named parts, given as a mapping of names or as a list.
AGGREGATES = ("SUM", "COUNT", "AVERAGE", "MIN", "MAX", "MEDIAN", "VARIANCE", "STD_DEV", "MODE", "SET", "LIST", "ARRAY", "CUSTOM")


def load(source) -> dict:
    """A specification from a mapping, YAML text or a path of a YAML file."""
    if isinstance(source, dict):
        return source
    try:
        import yaml
    except ImportError as e:  # pragma: no cover
        raise SpecError("reading YAML needs the yaml package; pass a mapping instead") from e
    text = str(source)
    if "\n" not in text and text.endswith((".yaml", ".yml")):
        with open(text, encoding="utf-8") as f:
            text = f.read()
    return yaml.safe_load(text)


def _named(part, extra: str = "name") -> list[dict]:
    """A list of parts with names, from a mapping of names, a list of parts or a list of one-key mappings."""
    if not part:
        return []
    if isinstance(part, dict):
        return [{extra: k, **(v if isinstance(v, dict) else {} if v is None else {"value": v})} for k, v in part.items()]
    out = []
    for x in part:
        if isinstance(x, str):
            out.append({extra: x})
        elif extra not in x and len(x) == 1 and isinstance(next(iter(x.values())), (dict, type(None))):
            out += _named(x, extra)
        else:
            out.append(dict(x))
    return out


def normalise(spec) -> dict:
    """The specification with class_derivations as a list, slots and joins by name, and key-value shortcuts resolved."""
    spec = copy.deepcopy(load(spec))
    if not isinstance(spec, dict):
        raise SpecError("a specification is a mapping")
    spec["class_derivations"] = [_class(c) for c in _named(spec.get("class_derivations"))]
    enums = {}
    for e in _named(spec.get("enum_derivations")):
        e["permissible_value_derivations"] = {v["name"]: v for v in _named(e.get("permissible_value_derivations"))}
        enums[e["name"]] = e
    spec["enum_derivations"] = enums
    spec["prefixes"] = {k: (v.get("value") or v.get("prefix_reference") if isinstance(v, dict) else v) for k, v in (spec.get("prefixes") or {}).items()}
    return spec


def _class(c: dict) -> dict:
    if "name" not in c:
        raise SpecError("a class derivation needs a name")
    c["slot_derivations"] = {s["name"]: _slot(s) for s in _named(c.get("slot_derivations"))}
    c["joins"] = {j.get("alias", j.get("name")): {"alias": j.get("alias", j.get("name")), **j} for j in _named(c.get("joins"), "alias")}
    return c


def _slot(s: dict) -> dict:
    for k in ("value_mappings", "expression_mappings"):
        if s.get(k):
            table = s[k]
            if isinstance(table, list):
                table = {x["key"]: x.get("value") for x in table}
            s[k] = {_key(a): (b.get("value") if isinstance(b, dict) and "value" in b else b) for a, b in table.items()}
    if s.get("class_derivations"):
        s["class_derivations"] = [_class(c) for c in _named(s["class_derivations"])]
    operator = (s.get("aggregation_operation") or {}).get("operator")
    if operator and operator.upper() not in AGGREGATES:
        raise SpecError(f"unknown aggregate {operator}")
    return s


def _key(value) -> str:
    """The key form of a literal."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float) and value.is_integer():
        return str(int(value))
    return "None" if value is None else str(value)


def inherited(spec: dict, derivation: dict, path: tuple = ()) -> dict:
    """A class derivation with its mixins' and parent's slots and joins; own slots come first and win."""
    out = copy.deepcopy(derivation)
    for parent in [*(derivation.get("mixins") or []), *([derivation["is_a"]] if derivation.get("is_a") else [])]:
        if parent in path:
            raise SpecError(f"class derivations inherit in a circle: {parent}")
        found = [c for c in spec["class_derivations"] if c["name"] == parent]
        if len(found) != 1:
            raise SpecError(f"no class derivation {parent} to inherit from")
        base = inherited(spec, found[0], (*path, derivation["name"]))
        for part in ("slot_derivations", "joins"):
            for k, v in base[part].items():
                out[part].setdefault(k, v)
    return out


def derivation_for(spec: dict, source_class: str) -> dict:
    """The one derivation that maps a source class."""
    found = [c for c in spec["class_derivations"] if (c.get("populated_from") or c["name"]) == source_class]
    if len(found) != 1:
        raise SpecError(f"{'no' if not found else 'more than one'} class derivation for {source_class}")
    return inherited(spec, found[0])
