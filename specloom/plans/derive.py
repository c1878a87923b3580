"""The target schema that a specification implies."""

from __future__ import annotations

import copy

from .schema import Schema
from .spec import normalise

#: Attribute facts that a copied slot keeps (fixed values).
KEPT = ("range", "multivalued", "inlined", "inlined_as_list", "required", "identifier", "key", "description", "pattern", "unit")


def derive_schema(spec, source=None) -> dict:
    """Classes, attributes and enums as the derivations name them, with ranges from the source where slots are copied."""
    spec = normalise(spec)
    source = source if isinstance(source, Schema) else Schema(source or {})
    renamed = {(c.get("populated_from") or c["name"]): c["name"] for c in spec["class_derivations"]}
    enums = {(e.get("populated_from") or e["name"]): e["name"] for e in spec["enum_derivations"].values()}
    classes: dict = {}

    def attributes(c: dict) -> dict:
        cls, out = c.get("populated_from") or c["name"], {}
        own = source.induced(cls) if source.has_class(cls) else {}
        for directive in [c.get("copy_directives") or {}, spec.get("copy_directives") or {}]:
            for d in directive.values() if all(isinstance(x, dict) for x in directive.values()) else [directive]:
                chosen = list(own) if d.get("copy_all") else [x for x in d.get("include") or [] if x in own]
                for name in [*chosen, *(d.get("add") or [])]:
                    if name not in (d.get("exclude") or []) and name not in (d.get("exclude_all") or []):
                        out[name] = _facts(own.get(name), renamed, enums)
        for s in c["slot_derivations"].values():
            if s.get("hide"):
                continue
            origin = s.get("populated_from") or (s["name"] if s.get("expr") is None and s.get("value") is None else None)
            facts = _facts(own.get(origin), renamed, enums) if origin else {}
            if s.get("range"):
                facts["range"] = s["range"]
            for d in s.get("class_derivations") or []:
                classes[d["name"]] = {"attributes": attributes(d)}
                facts |= {"range": d["name"], "inlined": True} | ({"multivalued": True, "inlined_as_list": True} if len(s["class_derivations"]) > 1 else {})
            cast_as = s.get("cast_collection_as")
            if cast_as == "SingleValued" or (s.get("stringification") and not s["stringification"].get("reversed")):
                facts.pop("multivalued", None)
            elif cast_as or (s.get("stringification") or {}).get("reversed"):
                facts |= {"multivalued": True} | ({"inlined_as_list": True} if cast_as == "MultiValuedList" else {})
                if cast_as == "MultiValuedDict":
                    facts.pop("inlined_as_list", None)
                    facts["inlined"] = True
            operator = (s.get("aggregation_operation") or {}).get("operator", "").upper()
            if operator:
                facts.pop("multivalued", None)
                if operator in ("SET", "LIST", "ARRAY"):
                    facts["multivalued"] = True
                elif operator == "COUNT":
                    facts["range"] = "integer"
                elif operator in ("AVERAGE", "MEDIAN", "VARIANCE", "STD_DEV"):
                    facts["range"] = "float"
            out[s["name"]] = facts
        return out

    for c in spec["class_derivations"]:
        found = {"attributes": attributes(c)}
        for k in ("is_a", "mixins"):
            if c.get(k):
                found[k] = copy.deepcopy(c[k])
        if source.classes.get(c.get("populated_from") or c["name"], {}).get("tree_root"):
            found["tree_root"] = True
        classes[c["name"]] = found
    made = {}
    for e in spec["enum_derivations"].values():
        values = {v: {} for v in e["permissible_value_derivations"]}
        if e.get("mirror_source"):
            origin = source.enums.get(e.get("populated_from") or e["name"], {}).get("permissible_values") or {}
            values = {**{v: copy.deepcopy(x or {}) for v, x in origin.items()}, **values}
        made[e["name"]] = {"permissible_values": values}
    name = spec.get("title") or spec.get("id") or "derived"
    return {"id": f"{name}-target" if not spec.get("target_schema") else str(spec["target_schema"]), "name": str(name), "prefixes": {**source.prefixes, **spec["prefixes"]}, "classes": classes, "enums": made}


def _facts(slot, renamed: dict, enums: dict) -> dict:
    if slot is None:
        return {}
    out = {k: v for k in KEPT if (v := getattr(slot, k, None))}
    if out.get("range"):
        out["range"] = renamed.get(out["range"], enums.get(out["range"], out["range"]))
    return out
