"""Which other tables a derivation reads, by which keys: explicit joins, and those that follow from shared columns."""

from __future__ import annotations

import ast
import copy

from ..errors import JoinError
from ..functions.expression import parse, references
from .schema import Schema

#: A column that identifies subjects wherever it occurs and so is preferred as a key (fixed value).
SUBJECT = "dbGaP_Subject_ID"


class _Every:
    """A set of all columns."""

    def __contains__(self, item) -> bool:
        return True

    def add(self, item) -> None:
        pass


def _slots(derivation: dict):
    """All slot derivations, those of nested objects too, with the table their object reads."""
    for s in derivation["slot_derivations"].values():
        yield s, derivation
        for d in s.get("class_derivations") or []:
            yield from _slots(d)


def _expressions(s: dict) -> list[str]:
    return [str(x) for x in ([s["expr"]] if s.get("expr") is not None else []) + list((s.get("expression_mappings") or {}).values())]


def infer_key(left: list[str], right: list[str], identifiers: set[str], name: str, other: str) -> str:
    """The column by which two tables join."""
    common = [c for c in left if c in right]
    if SUBJECT in common:
        return SUBJECT
    plain = [c for c in common if c not in identifiers]
    if len(plain) == 1:
        return plain[0]
    keys = [c for c in common if c in identifiers]
    if not plain and len(keys) == 1:
        return keys[0]
    if not common:
        raise JoinError(f"{name} and {other} share no column to join by")
    raise JoinError(f"{name} and {other} share several columns: {', '.join(sorted(common))}; name the key in joins")


def synthesise(spec: dict, derivation: dict, schema: Schema, name: str, tables: dict[str, list[str]]) -> dict:
    """derivation with a join for each other table it refers to. tables: the columns of the tables there are."""
    for e in spec["enum_derivations"].values():
        for text in [e.get("expr"), *(p.get("expr") for p in e["permissible_value_derivations"].values())]:
            if text is not None and any(root in tables for root, _ in references(str(text))[1]):
                raise JoinError(f"enum derivation {e['name']} refers to another table")
    out = copy.deepcopy(derivation)
    own = schema.induced(name) if schema.has_class(name) else {}
    columns = lambda t: tables.get(t) or list(schema.induced(t))
    known = set(tables) | set(schema.classes)

    def need(root: str, must: bool) -> None:
        if root in out["joins"] or root in own or root not in known or root == name:
            return
        ids = {i for t in (name, root) if (i := schema.identifier(t) if schema.has_class(t) else None)}
        try:
            key = infer_key(list(own), columns(root), ids, name, root)
        except JoinError:
            if must:
                raise
            return
        out["joins"][root] = {"alias": root, "class_named": root, "source_key": key, "lookup_key": key}

    for s, d in _slots(out):
        for text in _expressions(s):
            for root, attribute in sorted(references(text)[1]):
                if root in known and root not in own and root not in out["joins"] and root != name and attribute not in columns(root):
                    raise JoinError(f"{root} has no column {attribute}")
                need(root, True)
        path = s.get("populated_from") or ""
        if "." in path:
            root = path.split(".")[0]
            need(root, True)
            if root not in out["joins"] and root not in own:
                raise JoinError(f"{path}: unknown table or slot {root}")
        if d is not out and d.get("populated_from"):
            need(d["populated_from"], False)
    return out


def followed(derivation: dict) -> dict[str, set[str]]:
    """Slots of which expressions read attributes -> those attributes."""
    out: dict[str, set[str]] = {}
    for s, _ in _slots(derivation):
        for text in _expressions(s):
            for root, attribute in references(text)[1]:
                if root not in derivation["joins"]:
                    out.setdefault(root, set()).add(attribute)
    return dict(sorted(out.items()))


def uses(derivation: dict, grouped: bool = False) -> tuple[dict, dict]:
    """(alias -> columns read from its first match, alias -> [(slot, column, aggregate)] over all its matches).
    Under grouping aggregates read the first match too."""
    first: dict = {}
    every: dict[str, list] = {}
    joins = derivation["joins"]
    for s, d in _slots(derivation):
        path = s.get("populated_from") or ""
        root, _, field = path.partition(".")
        if root in joins and field:
            if s.get("aggregation_operation") and not grouped:
                every.setdefault(root, []).append((s["name"], field, s["aggregation_operation"]))
            else:
                first.setdefault(root, set()).add(field.split(".")[0])
        for text in _expressions(s):
            names, pairs = references(text)
            for a, attribute in pairs:
                if a in joins:
                    first.setdefault(a, set()).add(attribute)
            for a in names & set(joins):
                first[a] = _Every()
        if d is not derivation and d.get("populated_from") in joins:
            first[d["populated_from"]] = _Every()
    return first, every


def slots_read(derivation: dict) -> set[str]:
    """Names that expressions read through slot()."""
    out = set()
    for s, _ in _slots(derivation):
        for text in _expressions(s):
            tree = parse(text)
            for part in tree if isinstance(tree, list) else [tree]:
                for n in ast.walk(part):
                    if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id == "slot" and n.args and isinstance(n.args[0], ast.Constant):
                        out.add(n.args[0].value)
    return out
