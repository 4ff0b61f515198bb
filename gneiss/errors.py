class GneissError(Exception):
    """Base of all errors of this package."""


class NotFitted(GneissError):
    """A transform was asked for before a fit."""


class BadType(GneissError):
    """A column or table has a type that the operator cannot take."""
