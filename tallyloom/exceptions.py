"""Errors of this package."""


class StatementError(Exception):
    """Any error of a statement's content or handling."""


class FormatError(StatementError):
    """A file's format is unknown or not as it should be."""


class InputError(StatementError):
    """A path or file isn't allowed."""


class PayloadError(StatementError):
    """A model's answer or a stored result can't be used."""
