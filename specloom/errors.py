"""Errors of specifications; each is raised when a plan is built, before any row is read."""


class SpecError(ValueError):
    """A specification that cannot be planned."""


class ExpressionError(SpecError):
    """An expression that cannot be parsed or typed."""


class JoinError(SpecError):
    """A cross-table reference without a usable join."""


class UnitError(SpecError):
    """An unknown unit, or units of different dimensions."""


class InversionError(SpecError):
    """A derivation without an inverse."""
