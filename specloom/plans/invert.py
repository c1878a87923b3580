"""The specification that maps back."""

from __future__ import annotations

import re

from ..errors import InversionError
from .spec import normalise


def invert(spec, strict: bool = True) -> dict:
    """Source and target swapped. Only copies and bare-name expressions have an inverse; others are errors, or left out
    if not strict."""
    spec = normalise(spec)
    classes = [_class(c, strict) for c in spec["class_derivations"]]
    enums = {e.get("populated_from") or e["name"]: _enum(e, strict) for e in spec["enum_derivations"].values()}
    out = {"class_derivations": classes, "enum_derivations": enums, "prefixes": spec["prefixes"]}
    for a, b in (("source_schema", "target_schema"), ("target_schema", "source_schema")):
        if spec.get(a) is not None:
            out[b] = spec[a]
    return out


def _class(c: dict, strict: bool) -> dict:
    slots = {}
    for s in c["slot_derivations"].values():
        back = _slot(s, c["name"], strict)
        if back:
            slots[back["name"]] = back
    out = {"name": c.get("populated_from") or c["name"], "populated_from": c["name"], "slot_derivations": slots}
    return out | {k: c[k] for k in ("is_a", "mixins") if c.get(k)}


def _slot(s: dict, cls: str, strict: bool) -> dict | None:
    origin = s.get("populated_from")
    if s.get("expr") is not None:
        origin = str(s["expr"]).strip().strip("{}") if re.fullmatch(r"\{?\s*[A-Za-z_]\w*\s*\}?", str(s["expr"]).strip()) else None
    elif not origin and not any(s.get(k) for k in ("value", "class_derivations", "aggregation_operation")):
        origin = s["name"]
    if not origin or "." in origin or any(s.get(k) for k in ("value", "aggregation_operation", "class_derivations", "expression_mappings", "offset", "missing_values", "hide")):
        if strict:
            raise InversionError(f"{cls}.{s['name']} has no inverse")
        return None
    out: dict = {"name": origin, "populated_from": s["name"]}
    if s.get("value_mappings"):
        back = {str(v): k for k, v in s["value_mappings"].items()}
        if strict and len(back) < len(s["value_mappings"]):
            raise InversionError(f"{cls}.{s['name']} maps several values to one")
        out["value_mappings"] = back
    if s.get("stringification"):
        out["stringification"] = {**s["stringification"], "reversed": not s["stringification"].get("reversed")}
    if s.get("unit_conversion"):
        u = dict(s["unit_conversion"])
        swap = {"source_unit": "target_unit", "target_unit": "source_unit", "source_unit_scheme": "target_unit_scheme", "target_unit_scheme": "source_unit_scheme", "source_unit_slot": "target_unit_slot", "target_unit_slot": "source_unit_slot", "source_magnitude_slot": "target_magnitude_slot", "target_magnitude_slot": "source_magnitude_slot"}
        out["unit_conversion"] = {swap.get(k, k): v for k, v in u.items()}
    if s.get("cast_collection_as") in ("MultiValuedDict", "MultiValuedList"):
        out["cast_collection_as"] = "MultiValuedList" if s["cast_collection_as"] == "MultiValuedDict" else "MultiValuedDict"
        if s.get("dictionary_key"):
            out["dictionary_key"] = s["dictionary_key"]
    return out


def _enum(e: dict, strict: bool) -> dict:
    if e.get("expr") is not None and strict:
        raise InversionError(f"enum {e['name']} is derived by an expression")
    values = {}
    for v in e["permissible_value_derivations"].values():
        origin = v.get("populated_from") or (v.get("sources") or [v["name"]])
        first = origin if isinstance(origin, str) else origin[0]
        values[first] = {"name": first, "populated_from": v["name"]}
    out = {"name": e.get("populated_from") or e["name"], "populated_from": e["name"], "permissible_value_derivations": values}
    return out | ({"mirror_source": True} if e.get("mirror_source") else {})
