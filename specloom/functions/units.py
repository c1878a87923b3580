"""Unit conversion as constants: every unit is base = value * factor + offset in one dimension, or a ratio of two.

The table is built from base units and decimal prefixes; spellings of one unit share an entry.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..errors import UnitError

#: Decimal prefixes (fixed values).
PREFIXES = {"": 1.0, "f": 1e-15, "p": 1e-12, "n": 1e-9, "u": 1e-6, "µ": 1e-6, "m": 1e-3, "c": 1e-2, "d": 0.1, "h": 100.0, "k": 1e3, "M": 1e6}
#: Dimension: {spelling of a unit that takes prefixes: factor} (fixed values).
PREFIXED = {
    "length": {"m": 1.0}, "mass": {"g": 1.0}, "volume": {"L": 1.0, "l": 1.0}, "pressure": {"Pa": 1.0, "bar": 1e5},
    "amount": {"mol": 1.0}, "activity": {"IU": 1.0}, "enzyme": {"U": 1.0, "kat": 6e7}, "equivalents": {"Eq": 1.0, "eq": 1.0}, "time": {"s": 1.0},
}
#: Dimension: {spelling: factor} for units without prefixes (fixed values).
PLAIN = {
    "length": {"meter": 1.0, "metre": 1.0, "micrometer": 1e-6, "in": 0.0254, "[in_i]": 0.0254, "inch": 0.0254, "ft": 0.3048, "[ft_i]": 0.3048, "foot": 0.3048},
    "mass": {"gram": 1.0, "mcg": 1e-6},
    "volume": {"liter": 1.0, "litre": 1.0},
    "time": {"sec": 1.0, "second": 1.0, "min": 60.0, "h": 3600.0, "hr": 3600.0, "hour": 3600.0, "d": 86400.0, "day": 86400.0, "wk": 604800.0, "week": 604800.0, "year": 31557600.0, "yr": 31557600.0, "annum": 31557600.0, "month": 2629800.0},
    "pressure": {"pascal": 1.0, "mmHg": 133.322387415, "cmH2O": 98.0665},
    "amount": {"mole": 1.0}, "activity": {"[IU]": 1.0, "iU": 1.0}, "enzyme": {"[U]": 1.0},
    "count": {"1": 1.0, "count": 1.0, "{cells}": 1.0, "{#}": 1.0, **{f"10{s}{k}": 10.0**k for s in "*^" for k in (3, 6, 9, 12)}},
}
#: Spellings that only the UCUM scheme knows (fixed values).
UCUM_ONLY = {"time": {"a": 31557600.0, "mo": 2629800.0}, "pressure": {"mm[Hg]": 133.322387415, "cm[H2O]": 98.0665}}
#: Temperatures: spelling: (factor, offset to kelvin, UCUM only) (fixed values).
TEMPERATURES = {"K": (1.0, 0.0, False), "kelvin": (1.0, 0.0, False), "degC": (1.0, 273.15, False), "celsius": (1.0, 273.15, False), "°C": (1.0, 273.15, False), "Cel": (1.0, 273.15, True), "degF": (5 / 9, 273.15 - 160 / 9, False), "fahrenheit": (5 / 9, 273.15 - 160 / 9, False), "°F": (5 / 9, 273.15 - 160 / 9, False)}


@dataclass(frozen=True)
class Unit:
    dimension: tuple  # (name,) or (numerator, denominator)
    factor: float
    offset: float = 0.0


def _table(ucum: bool) -> dict[str, Unit]:
    out = {p + u: Unit((d,), f * x) for d, us in PREFIXED.items() for u, f in us.items() for p, x in PREFIXES.items()}
    for group in (PLAIN, UCUM_ONLY) if ucum else (PLAIN,):
        out |= {u: Unit((d,), f) for d, us in group.items() for u, f in us.items()}
    return out | {u: Unit(("temperature",), f, o) for u, (f, o, only) in TEMPERATURES.items() if ucum or not only}


TABLES = {True: _table(True), False: _table(False)}


def find(token: str, scheme: str | None = None) -> Unit | None:
    """The unit of a token; ratios have one slash or, in UCUM, a factor with exponent -1. {annotations} are ignored."""
    ucum = scheme in (None, "ucum_code")
    table = TABLES[ucum]
    text = token.strip()
    if text in table:
        return table[text]
    text = re.sub(r"\{[^}]*\}", "", text)
    if "." in text and ucum:
        tops, bottoms = [], []
        for part in text.split("."):
            m = re.fullmatch(r"(.+?)(-1|1)?", part)
            (bottoms if m[2] == "-1" else tops).append(m[1])
        if len(tops) != 1 or len(bottoms) > 1:
            return None
        text = "/".join(tops + bottoms)
    if text.count("/") == 1:
        a, b = (table.get(x) for x in text.split("/"))
        if not a or not b or {"temperature", "pressure"} & {*a.dimension, *b.dimension}:
            return None
        return Unit((*a.dimension, *b.dimension), a.factor / b.factor)
    return table.get(text)


def bridge(source: tuple, target: tuple, weight: float | None, valence: float | None) -> float | None:
    """The factor from a base unit of source to one of target by way of a substance: grams, moles, equivalents."""
    if source[1:] != target[1:]:
        return None
    to_mole = {"amount": 1.0, "mass": 1 / weight if weight else None, "equivalents": 1 / valence if valence else None}
    a, b = to_mole.get(source[0]), to_mole.get(target[0])
    return a / b if a and b else None


def conversion(source: str, target: str | None, scheme: str | None = None, target_scheme: str | None = None, weight: float | None = None, valence: float | None = None) -> tuple[float, float]:
    """(a, b) so that a value v of source is a * v + b of target."""
    if target is None or source == target:
        return 1.0, 0.0
    x, y = find(source, scheme), find(target, target_scheme or scheme)
    for u, token in ((x, source), (y, target)):
        if u is None:
            raise UnitError(f"undefined unit {token!r}")
    if x.dimension == y.dimension:
        return x.factor / y.factor, (x.offset - y.offset) / y.factor
    factor = bridge(x.dimension, y.dimension, weight, valence)
    if factor is None:
        raise UnitError(f"cannot convert {source!r} to {target!r}: {'/'.join(x.dimension)} is not {'/'.join(y.dimension)}")
    return x.factor * factor / y.factor, 0.0


def known(scheme: str | None = None) -> dict[str, Unit]:
    return TABLES[scheme in (None, "ucum_code")]
