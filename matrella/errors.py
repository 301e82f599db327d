"""Errors of the engine."""


class MatrellaError(Exception):
    """Base of all errors that the engine raises on its own account."""


class DoesNotExistError(MatrellaError):
    """Nothing is stored at a place."""


class AlreadyExistsError(MatrellaError):
    """Something is stored at a place already."""


class NotCreateableError(MatrellaError):
    """A place can't take a new object."""


class FilterError(MatrellaError):
    """A value filter can't be parsed or doesn't fit the schema."""


class ConflictError(MatrellaError):
    """Another writer took the same log entry first."""
