"""Functions beyond the closed table of the language, for specifications that ask for them (Mapper(extensions=True)).

Each gives null if an argument is null, unless stated otherwise. Functions of one value spread over a list in their
first argument; those of lists do not. Lists with a null element cannot be summed, sorted or joined: the row fails.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ExpressionError
from .expression import FUNCTIONS
from .typed import BOOL, LONG, STRING, Typed, cast, common, null, number, raise_if, show_text, truthy

#: White space as the language's strip and split see it, Unicode included.
_SPACE = r"[\s\x1c-\x1f]"


def _known(args: tuple[Typed, ...]) -> Column:
    out = F.lit(True)
    for a in args:
        out = out & a.col.isNotNull()
    return out


def _checked(f: Callable[..., Typed], *kinds: tuple[str, ...], least: int | None = None) -> Callable[..., Typed]:
    """f for arguments of these kinds (those after the first `least` may be left out); null if one is null."""
    def g(*args: Typed) -> Typed:
        if not (len(kinds) if least is None else least) <= len(args) <= len(kinds):
            raise ExpressionError(f"{len(args)} arguments are not what the function takes")
        if any(a.kind == "null" for a in args):
            return null()
        for a, allowed in zip(args, kinds):
            if a.kind not in allowed:
                raise ExpressionError(f"a {a.kind} value stands where {' or '.join(allowed)} is needed")
        out = f(*args)
        return Typed(F.when(_known(args), out.col), out.type)

    return g


_TEXT, _LIST, _NUMBER, _WHOLE = ("text",), ("list",), ("int", "float", "bool", "text"), ("int", "bool")


def _whole_list(v: Typed, out: Typed) -> Typed:
    return raise_if(F.coalesce(F.exists(v.col, lambda x: x.isNull()), F.lit(False)), "the list has a null element", out)


def _sum(v: Typed) -> Typed:
    inner = number(v.element(F.lit(None).cast(v.type.elementType)))
    return _whole_list(v, Typed(F.aggregate(v.col, F.lit(0).cast(inner.type), lambda a, x: F.try_add(a, number(v.element(x)).col)), inner.type))


def _rounded(f: Callable[[Column], Column]) -> Callable[[Typed], Typed]:
    return lambda v: Typed(f(number(v).col).cast(LONG), LONG)


def _substr(v: Typed, start: Typed, end: Typed | None = None) -> Typed:
    """Characters from start up to before end; negative places count from the end of the text."""
    size = F.char_length(v.col)
    place = lambda p: F.greatest(F.least(F.when(number(p).col < 0, number(p).col + size).otherwise(number(p).col), size), F.lit(0))
    first, last = place(start), place(end) if end else size
    return Typed(F.substring(v.col, (first + 1).cast("int"), F.greatest(last - first, F.lit(0)).cast("int")), STRING)


def _strip(left: bool, right: bool) -> Callable[..., Typed]:
    def f(v: Typed, chars: Typed | None = None) -> Typed:
        if chars is not None:
            trim = F.btrim if left and right else F.ltrim if left else F.rtrim
            return Typed(trim(v.col, chars.col), STRING)
        ends = [rf"\A{_SPACE}+"] * left + [rf"{_SPACE}+\z"] * right
        return Typed(F.regexp_replace(v.col, "(?U)" + "|".join(ends), ""), STRING)

    return f


def _split(v: Typed, mark: Typed | None = None) -> Typed:
    """Parts between marks; without a mark, the words between white space."""
    kind = T.ArrayType(STRING)
    if mark is None:
        return Typed(F.filter(F.split(v.col, f"(?U){_SPACE}+"), lambda x: x != ""), kind)
    quoted = F.concat(F.lit("\\Q"), F.replace(mark.col, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return raise_if(F.coalesce(mark.col == "", F.lit(False)), "split needs a mark", Typed(F.split(v.col, quoted), kind))


def _join(mark: Typed, v: Typed) -> Typed:
    return _whole_list(v, Typed(F.call_function("array_join", F.transform(v.col, lambda x: show_text(v.element(x))), mark.col), STRING))


def _snake(c: Column) -> Column:
    apart = F.regexp_replace(F.regexp_replace(c, r"([A-Z]+)([A-Z][a-z])", "$1_$2"), r"([a-z\d])([A-Z])", "$1_$2")
    return F.lower(F.translate(apart, "-", "_"))


def _pascal(c: Column) -> Column:
    return F.array_join(F.transform(F.split(c, "_"), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, F.lit(2), F.char_length(x)))), "")


def _camel(c: Column) -> Column:
    p = _pascal(c)
    return F.concat(F.lower(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.char_length(p)))


def _text(f: Callable[..., Column]) -> Callable[..., Typed]:
    return lambda *args: Typed(f(*[a.col for a in args]), STRING)


def _test(f: Callable[[Column, Column], Column]) -> Callable[..., Typed]:
    return lambda v, part: Typed(f(v.col, part.col), BOOL)


def _is(kind: str) -> Callable[[Typed], Typed]:
    """Whether a value is of a kind; false for null."""
    return lambda v: Typed(v.col.isNotNull() if v.kind == kind else F.lit(False), BOOL)


def _coalesce(*args: Typed) -> Typed:
    """The first argument that is not null."""
    given = [a for a in args if a.kind != "null"]
    if not given:
        return null()
    kind = common([a.type for a in given])
    return Typed(F.coalesce(*[F.when(a.col.isNotNull(), cast(a, kind).col) for a in given]), kind)


def _end(place: int) -> Callable[[Typed], Typed]:
    return lambda v: Typed(F.try_element_at(v.col, F.lit(place)), v.type.elementType)


#: name -> (function, whether it spreads over a list in its first argument)
EXTENSIONS: dict[str, tuple[Callable, bool]] = {
    "sum": (_checked(_sum, _LIST), False),
    "sorted": (_checked(lambda v: _whole_list(v, Typed(F.array_sort(v.col), v.type)), _LIST), False),
    "any": (_checked(lambda v: Typed(F.exists(v.col, lambda x: truthy(v.element(x))), BOOL), _LIST), False),
    "all": (_checked(lambda v: Typed(F.forall(v.col, lambda x: truthy(v.element(x))), BOOL), _LIST), False),
    "reversed": (_checked(lambda v: Typed(F.reverse(v.col), v.type), _LIST), False),
    "first": (_checked(_end(1), _LIST), False),
    "last": (_checked(_end(-1), _LIST), False),
    "floor": (_checked(_rounded(F.floor), _NUMBER), True),
    "ceil": (_checked(_rounded(F.ceil), _NUMBER), True),
    "substr": (_checked(_substr, _TEXT, _WHOLE, _WHOLE, least=2), True),
    "strip": (_checked(_strip(True, True), _TEXT, _TEXT, least=1), True),
    "lstrip": (_checked(_strip(True, False), _TEXT, _TEXT, least=1), True),
    "rstrip": (_checked(_strip(False, True), _TEXT, _TEXT, least=1), True),
    "replace": (_checked(_text(F.replace), _TEXT, _TEXT, _TEXT), True),
    "startswith": (_checked(_test(F.startswith), _TEXT, _TEXT), True),
    "endswith": (_checked(_test(F.endswith), _TEXT, _TEXT), True),
    "contains": (_checked(_test(F.contains), _TEXT, _TEXT), True),
    "split": (_checked(_split, _TEXT, _TEXT, least=1), True),
    "join": (_checked(_join, _TEXT, _LIST), False),
    "to_snake": (_checked(_text(_snake), _TEXT), True),
    "to_camel": (_checked(_text(_camel), _TEXT), True),
    "to_pascal": (_checked(_text(_pascal), _TEXT), True),
    "is_str": (_is("text"), False),
    "is_int": (_is("int"), False),
    "is_float": (_is("float"), False),
    "is_bool": (_is("bool"), False),
    "is_list": (_is("list"), False),
    "coalesce": (_coalesce, False),
}
EXTENDED = {**EXTENSIONS, **FUNCTIONS}
