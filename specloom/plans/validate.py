"""Checks of a specification against its schemas, without data."""

from __future__ import annotations

from dataclasses import dataclass

from ..errors import SpecError
from ..functions.expression import references
from . import joins
from .schema import Schema
from .spec import derivation_for, inherited, normalise


@dataclass(frozen=True)
class Message:
    path: str
    severity: str  # error, warning or info
    text: str

    def __str__(self) -> str:
        return f"{self.path}: [{self.severity}] {self.text}"


def validate(spec, source=None, target=None, strict: bool = False) -> list[Message]:
    """What is wrong with a specification: names that do not exist, references that do not resolve, tables that cannot be
    joined, required slots without a derivation. strict turns warnings into errors."""
    out: list[Message] = []

    def say(path: str, severity: str, text: str) -> None:
        out.append(Message(path, "error" if strict and severity == "warning" else severity, text))

    try:
        spec = normalise(spec)
    except SpecError as e:
        return [Message("specification", "error", str(e))]
    source = source if isinstance(source, Schema) or source is None else Schema(source)
    target = target if isinstance(target, Schema) or target is None else Schema(target)
    names = {c["name"] for c in spec["class_derivations"]}
    for c in spec["class_derivations"]:
        at = f"class_derivations.{c['name']}"
        if target and not target.has_class(c["name"]):
            say(at, "error", f"class {c['name']} is not in the target schema")
        cls = c.get("populated_from") or c["name"]
        if source and not source.has_class(cls):
            say(at, "error", f"class {cls} is not in the source schema")
        for parent in [*(c.get("mixins") or []), *([c["is_a"]] if c.get("is_a") else [])]:
            if parent not in names:
                say(at, "error", f"no class derivation {parent} to inherit from")
        try:
            full = inherited(spec, c)
        except SpecError:
            full = c  # said above
        for alias, j in c["joins"].items():
            t = j.get("class_named") or alias
            if source and not source.has_class(t):
                say(f"{at}.joins.{alias}", "error", f"class {t} is not in the source schema")
            if not (j.get("join_on") or (j.get("source_key") and j.get("lookup_key"))):
                say(f"{at}.joins.{alias}", "warning", "no keys: source_key and lookup_key, or join_on")
        for s in c["slot_derivations"].values():
            _slot(spec, c, s, f"{at}.slot_derivations.{s['name']}", source, target, cls, say)
        if target and target.has_class(c["name"]):
            for slot in target.induced(c["name"]).values():
                if slot.required and slot.name not in full["slot_derivations"]:
                    say(at, "warning", f"required slot {slot.name} has no derivation")
        if source and source.has_class(cls):
            try:
                joins.synthesise(spec, derivation_for(spec, cls), source, cls, {k: list(source.induced(k)) for k in source.classes if k != cls})
            except SpecError as e:
                say(at, "error", str(e))
    for e in spec["enum_derivations"].values():
        at = f"enum_derivations.{e['name']}"
        if target and e["name"] not in target.enums:
            say(at, "error", f"enum {e['name']} is not in the target schema")
        if source and (e.get("populated_from") or e["name"]) not in source.enums:
            say(at, "error", f"enum {e.get('populated_from') or e['name']} is not in the source schema")
    if source and spec["enum_derivations"]:
        mapped = {e.get("populated_from") or e["name"] for e in spec["enum_derivations"].values()}
        for name in source.enums:
            if name not in mapped:
                say("enum_derivations", "info", f"enum {name} has no derivation: its values become null")
    return out


def _slot(spec, c, s, at, source, target, cls, say) -> None:
    if target and target.has_class(c["name"]) and s["name"] not in target.induced(c["name"]) and not s.get("hide"):
        say(at, "error", f"slot {s['name']} is not in target class {c['name']}")
    if not (source and source.has_class(cls)):
        return
    known = set(source.induced(cls)) | set(c["joins"]) | {"_source_class"}
    path = s.get("populated_from")
    if path and path.split(".")[0] not in known | (set(source.classes) if "." in path else set()):
        say(at, "error", f"populated_from {path} is not a slot of {cls}")
    for text in joins._expressions(s):
        try:
            found, pairs = references(text)
        except SpecError as e:
            say(at, "error", str(e))
            continue
        for name in sorted(found - known - set(spec.get("prefixes") or {})):
            say(at, "warning", f"{name} is not a slot of {cls}")
        for root, attribute in sorted(pairs):
            if root not in known and root not in source.classes:
                say(at, "error", f"{root}.{attribute}: no such source class, join, or slot")
            elif root in source.classes and root not in source.induced(cls) and attribute not in source.induced(root):
                say(at, "error", f"{root} has no slot {attribute}")
