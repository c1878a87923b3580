"""The expression language: a checked subset of Python syntax, compiled to typed Columns.

The host's own parser supplies precedence and literals; what it yields is compiled node by node, and any node outside
the language is an error when the plan is built. ``{x}`` is another way to write the reference ``x``. Null spreads
through arithmetic and comparisons other than equality; ``and`` and ``or`` return operands.
"""

from __future__ import annotations

import ast
import re
import textwrap
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ExpressionError
from .typed import BOOL, DOUBLE, LONG, NULL, STRING, Typed, array, cast, common, equal, literal, null, number, raise_if, show_text, truthy

#: Digits by row that round tells apart; a double has no more than 17, and none is as great as 10 ** 18 by halves here.
MOST_DIGITS = 18
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


class Scope:
    """What names mean: a mapping of names to Typed values, earlier target slots, strictness, and the functions there are."""

    def __init__(self, names: dict[str, Typed], slots: dict[str, Typed] | None = None, strict: bool = False, functions: dict | None = None):
        self.names, self.slots, self.strict, self.functions = names, slots or {}, strict, functions or FUNCTIONS

    def with_names(self, names: dict[str, Typed]) -> Scope:
        return Scope({**self.names, **names}, self.slots, self.strict, self.functions)


def is_block(source: str) -> bool:
    """A newline, a semicolon, a leading if or a top-level assignment makes a block of statements."""
    if "\n" in source or ";" in source or re.match(r"\s*if\b", source):
        return True
    try:
        return isinstance(ast.parse(source.strip()).body[0], ast.Assign)
    except (SyntaxError, IndexError):
        return False


def parse(source: str):
    """An expression node, or a list of statements."""
    try:
        if source == "None":
            return ast.Constant(None)
        if is_block(source):
            return ast.parse(textwrap.dedent(source).strip()).body
        return ast.parse(source.strip(), mode="eval").body
    except SyntaxError as e:
        raise ExpressionError(f"cannot parse expression {source!r}: {e.msg}") from e


def references(source: str) -> tuple[set[str], set[tuple[str, str]]]:
    """(names read, (root, attribute) pairs read) of an expression; names bound inside it are left out."""
    tree = parse(source)
    nodes = [n for part in (tree if isinstance(tree, list) else [tree]) for n in ast.walk(part)]
    bound = {n.id for n in nodes if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store)}
    called = {id(n.func) for n in nodes if isinstance(n, ast.Call)}
    pairs = {(n.value.id, n.attr) for n in nodes if isinstance(n, ast.Attribute) and isinstance(n.value, ast.Name)}
    # {a}.b is an attribute of a braced reference
    pairs |= {(n.value.elts[0].id, n.attr) for n in nodes if isinstance(n, ast.Attribute) and isinstance(n.value, ast.Set) and len(n.value.elts) == 1 and isinstance(n.value.elts[0], ast.Name)}
    roots = {id(n.value) for n in nodes if isinstance(n, ast.Attribute)}
    names = {n.id for n in nodes if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Load) and id(n) not in called and id(n) not in roots}
    return names - bound - {"NULL", "src", "_source_class"}, {p for p in pairs if p[0] not in bound | {"src"}}


def compile_expression(source: str, scope: Scope) -> Typed:
    tree = parse(source)
    if isinstance(tree, list):
        return _Compiler(scope, block=True).block(tree)
    return _Compiler(scope).value(tree)


class _Compiler:
    def __init__(self, scope: Scope, block: bool = False):
        self.scope, self.in_block = scope, block

    # -- statements: each variable is a Column; an if merges what its body assigns --------------------------------
    def block(self, statements: list) -> Typed:
        env = self._run(statements, {})
        return env.get("target", null())

    def _run(self, statements: list, env: dict[str, Typed]) -> dict[str, Typed]:
        for s in statements:
            inner = _Compiler(self.scope.with_names(env), True)
            if isinstance(s, ast.Assign) and len(s.targets) == 1 and isinstance(s.targets[0], ast.Name):
                env = {**env, s.targets[0].id: inner.value(s.value)}
            elif isinstance(s, ast.If) and not s.orelse:
                test = inner.truth(s.test)
                after = self._run(s.body, env)
                for name, value in after.items():
                    if value is not env.get(name):
                        before = env.get(name) or self.scope.names.get(name) or null()
                        kind = common([value.type, before.type])
                        env = {**env, name: Typed(F.when(test, cast(value, kind).col).otherwise(cast(before, kind).col), kind)}
            elif isinstance(s, ast.Expr):
                inner.value(s.value)
            elif not isinstance(s, ast.Pass):
                raise ExpressionError(f"statement {type(s).__name__} is not part of the language")
        return env

    # -- expressions ----------------------------------------------------------------------------------------------
    def value(self, node) -> Typed:
        method = getattr(self, "_" + type(node).__name__.lower(), None)
        if method is None:
            raise ExpressionError(f"{type(node).__name__} is not part of the language")
        return method(node)

    def _constant(self, node) -> Typed:
        if isinstance(node.value, (bytes, complex)) or node.value is Ellipsis:
            raise ExpressionError(f"literal {node.value!r} is not part of the language")
        return literal(node.value)

    def _name(self, node) -> Typed:
        if node.id == "NULL":
            return null()
        if node.id in self.scope.names:
            return self.scope.names[node.id]
        if self.scope.strict:
            raise ExpressionError(f"unknown name {node.id!r}")
        return null()

    def _set(self, node) -> Typed:
        if len(node.elts) != 1 or not isinstance(node.elts[0], (ast.Name, ast.Attribute)):
            raise ExpressionError("braces hold exactly one reference")
        return self.value(node.elts[0])

    def _attribute(self, node) -> Typed:
        if node.attr.startswith("_"):
            raise ExpressionError(f"attribute {node.attr!r} is private")
        root = node.value.elts[0] if isinstance(node.value, ast.Set) and len(node.value.elts) == 1 else node.value
        if isinstance(root, ast.Name) and root.id not in self.scope.names and root.id not in ("NULL",):
            raise ExpressionError(f"{root.id!r} of '{root.id}.{node.attr}' names nothing here: it is no slot, joined table or class of the source")
        return self._get(self.value(node.value), node.attr)

    def _get(self, v: Typed, attr: str) -> Typed:
        if v.kind == "null":
            return null()
        if v.kind == "object":
            for f in v.type.fields:
                if f.name == attr:
                    return Typed(v.col[attr], f.dataType)
            if self.in_block:
                return null()
            raise ExpressionError(f"no attribute {attr!r}; there are {v.type.fieldNames()}")
        if v.kind == "list":
            inner = self._get(v.element(F.lit(None)), attr)
            return Typed(F.transform(v.col, lambda x: self._get(v.element(x), attr).col), T.ArrayType(inner.type))
        if v.kind == "dict":
            if isinstance(v.type.valueType, T.StructType) and attr in v.type.valueType.fieldNames():
                return self._get(Typed(F.map_values(v.col), T.ArrayType(v.type.valueType)), attr)
            return Typed(F.try_element_at(v.col, F.lit(attr)), v.type.valueType)
        raise ExpressionError(f"a {v.kind} value has no attribute {attr!r}")

    def _subscript(self, node) -> Typed:
        if isinstance(node.slice, ast.Slice):
            raise ExpressionError("slices are not part of the language")
        v, i = self.value(node.value), self.value(node.slice)
        if v.kind == "null" or i.kind == "null":
            return null()
        if v.kind == "dict":
            found = Typed(F.try_element_at(v.col, cast(i, STRING).col), v.type.valueType)
            return raise_if(v.col.isNotNull() & i.col.isNotNull() & ~F.map_contains_key(v.col, F.coalesce(cast(i, STRING).col, F.lit(""))), "key is missing", found)
        if v.kind == "object" and isinstance(node.slice, ast.Constant):
            return self._get(v, str(node.slice.value))
        if not i.numeric or v.kind not in ("list", "text"):
            raise ExpressionError(f"a {v.kind} value cannot be indexed by a {i.kind}")
        at = F.when(number(i).col >= 0, number(i).col + 1).otherwise(number(i).col).cast("int")
        size = F.size(v.col) if v.kind == "list" else F.char_length(v.col)
        outside = (at > size) | (at < -size) | (size == 0)
        if v.kind == "list":
            return raise_if(F.coalesce(outside, F.lit(False)), "index out of range", Typed(F.try_element_at(v.col, at), v.type.elementType))
        return raise_if(F.coalesce(outside, F.lit(False)), "index out of range", Typed(F.substring(v.col, at, F.lit(1)), STRING))

    def _list(self, node) -> Typed:
        return array([self.value(x) for x in node.elts])

    _tuple = _list

    def _listcomp(self, node) -> Typed:
        if len(node.generators) != 1 or not isinstance(node.generators[0].target, ast.Name):
            raise ExpressionError("a comprehension has one variable")
        g = node.generators[0]
        over = self.value(g.iter)
        if over.kind == "null":
            return array([])
        if over.kind == "dict":
            over = Typed(F.map_keys(over.col), T.ArrayType(over.type.keyType))
        if over.kind != "list":
            raise ExpressionError(f"cannot iterate over a {over.kind} value")
        inside = lambda x: _Compiler(self.scope.with_names({g.target.id: over.element(x)}), self.in_block)
        kept = over.col
        for test in g.ifs:
            kept = F.filter(kept, self._keeps(inside, test))
        kind = inside(F.lit(None)).value(node.elt).type
        out = F.transform(kept, lambda x: inside(x).value(node.elt).col)
        kind = T.ArrayType(STRING if isinstance(kind, T.NullType) else kind)
        return Typed(F.coalesce(out, F.array().cast(kind)), kind)

    @staticmethod
    def _keeps(inside: Callable, test) -> Callable[[Column], Column]:
        return lambda x: inside(x).truth(test)

    def truth(self, node) -> Column:
        """Whether a node's value counts as true, from its parts: operands of and / or may differ in type."""
        if isinstance(node, ast.BoolOp):
            out = self.truth(node.values[0])
            for x in node.values[1:]:
                out = out & self.truth(x) if isinstance(node.op, ast.And) else out | self.truth(x)
            return out
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
            return ~self.truth(node.operand)
        return truthy(self.value(node))

    def _boolop(self, node) -> Typed:
        values = [self.value(x) for x in node.values]
        kind, out = common([v.type for v in values]), values[-1]
        for v, x in reversed(list(zip(values[:-1], node.values))):
            test = self.truth(x) if isinstance(node.op, ast.And) else ~self.truth(x)
            out = Typed(F.when(test, cast(out, kind).col).otherwise(cast(v, kind).col), kind)
        return out

    def _unaryop(self, node) -> Typed:
        v = self.value(node.operand)
        if isinstance(node.op, ast.Not):
            return Typed(~self.truth(node.operand), BOOL)
        if v.kind == "null":
            return v
        if isinstance(node.op, ast.Invert):
            return Typed(F.bitwise_not(number(v).col), LONG) if v.kind in ("int", "bool") else null()
        if not v.numeric:
            raise ExpressionError(f"bad operand of a sign: {v.kind}")
        n = number(v)
        return Typed(-n.col, n.type) if isinstance(node.op, ast.USub) else n

    def _compare(self, node) -> Typed:
        parts = [self.value(node.left), *map(self.value, node.comparators)]
        out = None
        for a, b, op in reversed(list(zip(parts, parts[1:], node.ops))):
            here = self._relation(a, b, op)
            out = here if out is None else F.when(here & here.isNotNull(), out).otherwise(here)
        return Typed(out, BOOL)

    def _relation(self, a: Typed, b: Typed, op) -> Column:
        if isinstance(op, (ast.Eq, ast.Is)):
            return equal(a, b)
        if isinstance(op, (ast.NotEq, ast.IsNot)):
            return ~equal(a, b)
        if isinstance(op, (ast.In, ast.NotIn)):
            found = self._member(a, b)
            return found if isinstance(op, ast.In) else ~found
        if a.kind == "null" or b.kind == "null":
            return F.lit(None).cast(BOOL)
        if a.kind == b.kind == "text":
            x, y = a.col, b.col
        elif {a.kind, b.kind} <= {"int", "float", "bool", "text"}:
            x, y = number(a).col, number(b).col
            if "float" in (number(a).kind, number(b).kind):
                x, y = x.cast(DOUBLE), y.cast(DOUBLE)
                test = {ast.Lt: x < y, ast.LtE: x <= y, ast.Gt: x > y, ast.GtE: x >= y}[type(op)]
                return F.when(F.isnan(x) | F.isnan(y), False).otherwise(test)
        elif a.kind == b.kind == "list":
            x, y = a.col, b.col
        else:
            return F.lit(None).cast(BOOL)
        return {ast.Lt: x < y, ast.LtE: x <= y, ast.Gt: x > y, ast.GtE: x >= y}[type(op)]

    def _member(self, a: Typed, b: Typed) -> Column:
        if a.kind == "null" or b.kind == "null":
            return F.lit(None).cast(BOOL)
        known = a.col.isNotNull() & b.col.isNotNull()
        if b.kind == "text":
            return F.contains(b.col, cast(a, STRING).col)
        if b.kind == "list":
            return F.when(known, F.exists(b.col, lambda x: equal(b.element(x), a)))
        if b.kind == "dict":
            return F.when(known, F.map_contains_key(b.col, F.coalesce(cast(a, STRING).col, F.lit(""))))
        raise ExpressionError(f"'in' needs text, a list or a mapping, not {b.kind}")

    def _binop(self, node) -> Typed:
        whole = isinstance(node.op, ast.Pow) and isinstance(constant(node.right), int) and constant(node.right) >= 0
        return arithmetic(type(node.op).__name__, self.value(node.left), self.value(node.right), whole)

    def _call(self, node) -> Typed:
        if not isinstance(node.func, ast.Name):
            raise ExpressionError("method calls are not part of the language")
        name = node.func.id
        if node.keywords or name not in self.scope.functions:
            raise ExpressionError(f"unknown function {name!r}" if name not in self.scope.functions else "keyword arguments are not part of the language")
        if name == "case":
            return self._case(node.args)
        if name == "slot":
            return self._slot(node.args)
        if name == "round" and len(node.args) == 2:
            return self._round(node.args)
        args = [self.value(a) for a in node.args]
        f, spreads = self.scope.functions[name]
        if spreads and args and args[0].kind == "list":
            first, rest = args[0], args[1:]
            kind = f(first.element(F.lit(None)), *rest).type
            return Typed(F.transform(first.col, lambda x: f(first.element(x), *rest).col), T.ArrayType(kind))
        return f(*args)

    def _round(self, args: list) -> Typed:
        """round(x, digits): constant digits are folded from the syntax tree, others are taken row by row."""
        v, known = self.value(args[0]), constant(args[1])
        if isinstance(known, float):
            raise ExpressionError("round takes a whole number of digits")
        digits = known if known is not None else self.value(args[1])
        if v.kind == "list":
            return Typed(F.transform(v.col, lambda x: _round(v.element(x), digits).col), T.ArrayType(DOUBLE))
        return _round(v, digits)

    def _case(self, arms: list) -> Typed:
        pairs = []
        for arm in arms:
            if not isinstance(arm, (ast.Tuple, ast.List)) or len(arm.elts) != 2:
                raise ExpressionError("case takes (condition, value) pairs")
            pairs.append((self.truth(arm.elts[0]), self.value(arm.elts[1])))
        kind, out = common([v.type for _, v in pairs]), None
        for test, v in pairs:
            col = cast(v, kind).col
            out = F.when(test, col) if out is None else out.when(test, col)
        return Typed(out, kind) if out is not None else null()

    def _slot(self, args: list) -> Typed:
        if len(args) != 1 or not isinstance(args[0], ast.Constant) or not isinstance(args[0].value, str):
            raise ExpressionError("slot takes one name in quotes")
        found = self.scope.slots.get(args[0].value)
        if found is None and self.scope.strict:
            raise ExpressionError(f"no earlier slot {args[0].value!r}")
        return found or null()


def constant(node) -> int | float | None:
    """The value of a number or of signs and arithmetic over numbers; None of anything else."""
    if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)):
        return int(node.value) if isinstance(node.value, bool) else node.value
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
        v = constant(node.operand)
        return v if v is None or isinstance(node.op, ast.UAdd) else -v
    if isinstance(node, ast.BinOp) and isinstance(node.op, (ast.Add, ast.Sub, ast.Mult)):
        a, b = constant(node.left), constant(node.right)
        if a is None or b is None:
            return None
        return a + b if isinstance(node.op, ast.Add) else a - b if isinstance(node.op, ast.Sub) else a * b
    return None


def _guarded(v: Typed, other: Typed) -> Typed:
    """A number: numeric kinds as they are, numeric text parsed."""
    return number(v) if v.numeric or v.kind == "text" else Typed(F.lit(None).cast(DOUBLE), DOUBLE)


def _floor_div(a: Column, b: Column, whole: bool) -> Column:
    if not whole:
        return F.floor(F.try_divide(a, b)).cast(DOUBLE)
    quotient = F.when(b != 0, F.call_function("div", a, F.when(b != 0, b)))
    return quotient - F.when((b != 0) & ((a < 0) != (b < 0)) & (quotient * b != a), 1).otherwise(0)


def arithmetic(op: str, a: Typed, b: Typed, whole_power: bool = False) -> Typed:
    """a op b; null if either is, and where the operands do not fit.

    An integer power is an integer if its exponent is known not to be negative (whole_power); of two integers whose
    exponent differs by row it is one where the exponent is not negative, and such a column is of floats.
    """
    if a.kind == "null" or b.kind == "null":
        return null()
    if a.kind == b.kind == "text" and op == "Add":
        return Typed(F.concat(a.col, b.col), STRING)
    if op == "Add" and a.kind == b.kind == "list":
        kind = common([a.type, b.type])
        return Typed(F.concat(a.col.cast(kind), b.col.cast(kind)), kind)
    if op == "Mult" and {a.kind, b.kind} in ({"list", "int"}, {"list", "bool"}):
        items, times = (a, b) if a.kind == "list" else (b, a)
        return Typed(F.flatten(F.array_repeat(items.col, F.greatest(number(times).col, F.lit(0)).cast("int"))), items.type)
    if not {a.kind, b.kind} <= {"int", "float", "bool", "text"}:
        return null()
    x, y = _guarded(a, b), _guarded(b, a)
    whole = x.kind == y.kind == "int"
    p, q = (x.col, y.col) if whole else (x.col.cast(DOUBLE), y.col.cast(DOUBLE))
    kind = LONG if whole else DOUBLE
    if op in ("LShift", "RShift", "BitAnd", "BitOr", "BitXor"):
        if not whole:
            return null()
        if op in ("LShift", "RShift"):
            return Typed(F.call_function("shiftleft" if op == "LShift" else "shiftright", p, q.cast("int")), LONG)
        return Typed({"BitAnd": p.bitwiseAND, "BitOr": p.bitwiseOR, "BitXor": p.bitwiseXOR}[op](q), LONG)
    if op in ("Add", "Sub", "Mult"):
        return Typed({"Add": F.try_add, "Sub": F.try_subtract, "Mult": F.try_multiply}[op](p, q), kind)
    if op == "Div":
        return Typed(F.try_divide(p.cast(DOUBLE), q.cast(DOUBLE)), DOUBLE)
    if op == "FloorDiv":
        return Typed(_floor_div(p, q, whole), kind)
    if op == "Mod":
        return Typed(F.when(q != 0, p - q * _floor_div(p, q, whole)), kind)
    if op == "Pow":
        power = F.pow(p.cast(DOUBLE), q.cast(DOUBLE))
        if whole and whole_power:
            return Typed(_whole_power(p, q, power), LONG)
        return Typed(power, DOUBLE)
    raise ExpressionError(f"operator {op} is not part of the language")


def _whole_power(p: Column, q: Column, power: Column) -> Column:
    """p ** q in whole numbers, by squaring; null beyond 64 bits."""
    one, step = F.lit(1).cast(LONG), F.sequence(F.lit(0), F.lit(62))
    start = F.struct(one.alias("out"), p.cast(LONG).alias("base"))

    def fold(acc, i):
        used = F.call_function("getbit", q.cast(LONG), i) == 1
        more = F.call_function("shiftright", q.cast(LONG), (i + 1).cast("int")) > 0
        return F.struct(F.when(used, F.try_multiply(acc["out"], acc["base"])).otherwise(acc["out"]).alias("out"), F.when(more, F.try_multiply(acc["base"], acc["base"])).otherwise(acc["base"]).alias("base"))

    exact = F.aggregate(step, start, fold)["out"]
    return F.when(F.abs(power) < float(1 << 53), power.cast(LONG)).when(q >= 0, exact)


# -- functions --------------------------------------------------------------------------------------------------------
def _text(f: Callable[[Column], Column]) -> Callable[..., Typed]:
    return lambda v: Typed(F.when(v.col.isNotNull(), f(show_text(v))), STRING) if v.kind != "null" else null()


def _length(v: Typed) -> Typed:
    sizes = {"text": F.char_length, "list": F.size, "dict": F.size}
    if v.kind == "null":
        return null()
    if v.kind == "object":
        return Typed(F.when(v.col.isNotNull(), F.lit(len(v.type.fields))).cast(LONG), LONG)
    if v.kind not in sizes:
        raise ExpressionError(f"a {v.kind} value has no length")
    return Typed(F.when(v.col.isNotNull(), sizes[v.kind](v.col)).cast(LONG), LONG)


def _extreme(several: Callable, one: Callable) -> Callable[..., Typed]:
    def f(*args: Typed) -> Typed:
        if not args:
            raise ExpressionError("at least one argument is needed")
        if any(a.kind == "null" for a in args):
            return null()
        if len(args) == 1:
            v = args[0]
            if v.kind != "list":
                raise ExpressionError("one argument must be a list")
            bad = (F.size(v.col) == 0) | F.exists(v.col, lambda x: x.isNull())
            return raise_if(F.coalesce(bad, F.lit(False)), "empty list or null element", Typed(one(v.col), v.type.elementType))
        kind = common([number(a).type if a.kind == "bool" else a.type for a in args])
        cols = [a.col.cast(kind) for a in args]
        known = cols[0].isNotNull()
        for c in cols[1:]:
            known &= c.isNotNull()
        return Typed(F.when(known, several(*cols)), kind)

    return f


def _int(v: Typed) -> Typed:
    if v.kind in ("null",):
        return null()
    if v.kind in ("int", "bool"):
        return number(v)
    if v.kind == "float":
        return Typed(F.when(v.col >= 0, F.floor(v.col)).otherwise(F.ceil(v.col)).cast(LONG), LONG)
    out = Typed(F.btrim(v.col, F.lit(" \t\n\x0b\f\r")).try_cast(LONG), LONG)
    return raise_if(v.col.isNotNull() & (~F.rlike(v.col, F.lit(r"^\s*[+-]?\d+\s*$")) | out.col.isNull()), "int() needs an integer of 64 bits", out)


def _float(v: Typed) -> Typed:
    if v.kind == "null":
        return null()
    out = Typed(number(v).col.cast(DOUBLE), DOUBLE)
    return out if v.numeric else raise_if(v.col.isNotNull() & out.col.isNull(), "float() needs a number", out)


def _round(v: Typed, digits: Typed | int | None = None) -> Typed:
    if v.kind == "null":
        return null()
    n = number(v).col.cast(DOUBLE)
    if digits is None:
        return Typed(F.bround(n, 0).cast(LONG), LONG)
    if isinstance(digits, int):
        return Typed(F.bround(n, digits), DOUBLE)
    if digits.kind == "null":
        return null()
    if digits.kind not in ("int", "bool"):
        raise ExpressionError("round takes a whole number of digits")
    d = number(digits).col
    out = F.when(d > MOST_DIGITS, n).when(d < -MOST_DIGITS, F.lit(0.0))
    for k in range(-MOST_DIGITS, MOST_DIGITS + 1):
        out = out.when(d == k, F.bround(n, k))
    return Typed(out, DOUBLE)


def _uuid5(namespace: Typed, name: Typed) -> Typed:
    if namespace.kind == "null" or name.kind == "null":
        return null()

    def v5(space: Column, text: Column) -> Column:
        h = F.sha1(F.concat(space, F.encode(text, "UTF-8")))
        variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
        return F.concat(F.substring(h, 1, 12), F.lit("5"), F.substring(h, 14, 3), variant, F.substring(h, 18, 15))

    inner = v5(F.unhex(F.lit(URL_NAMESPACE)), show_text(namespace))
    h = v5(F.unhex(inner), show_text(name))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return Typed(F.when(namespace.col.isNotNull() & name.col.isNotNull(), F.concat_ws("-", *parts)), STRING)


def _title(c: Column) -> Column:
    runs = F.regexp_extract_all(c, F.lit(r"([^\p{L}]+|\p{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, F.lit(2), F.char_length(x))))), "")


def _slugify(c: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.btrim(F.regexp_replace(F.translate(c, upper, upper.lower()), "[^a-z0-9]+", "-"), F.lit("-"))


def _numeric(v: Typed) -> Typed:
    if v.kind == "text":
        return Typed(F.coalesce(number(v).col.isNotNull(), F.lit(False)), BOOL)
    return Typed(v.col.isNotNull() if v.kind in ("int", "float") else F.lit(False), BOOL)


def _abs(v: Typed) -> Typed:
    if v.kind == "null":
        return null()
    if not v.numeric:
        raise ExpressionError("abs needs a number")
    return Typed(F.abs(number(v).col), number(v).type)


#: name -> (function, whether it spreads over a list in its first argument)
FUNCTIONS: dict[str, tuple[Callable, bool]] = {
    "max": (_extreme(F.greatest, F.array_max), False),
    "min": (_extreme(F.least, F.array_min), False),
    "len": (_length, False),
    "str": (lambda v: Typed(show_text(v), STRING), True),
    "lower": (_text(F.lower), True),
    "upper": (_text(F.upper), True),
    "title": (_text(_title), True),
    "capitalize": (_text(lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, F.lit(2), F.char_length(c))))), True),
    "slugify": (_text(_slugify), True),
    "int": (_int, True),
    "float": (_float, True),
    "bool": (lambda v: Typed(truthy(v), BOOL), True),
    "abs": (_abs, True),
    "round": (_round, True),
    "strlen": (_length, True),
    "uuid5": (_uuid5, True),
    "is_numeric": (_numeric, False),
    "case": (None, False),
    "slot": (None, False),
}
