"""Outcomes that a caller can tell apart: a bad request, an unavailable source, invalid data, a result over its cap."""


class RequestError(ValueError):
    """The request itself is malformed."""


class UnavailableError(RuntimeError):
    """A route, dataset or capability is missing."""


class DataError(RuntimeError):
    """Rows break a rule that a result depends on."""


class MappingError(DataError):
    """A code has no security, a security no code on a day, or two codes of one security collide."""


class ResultTooLargeError(RuntimeError):
    """A result has more rows than its cap; it is refused, not cut."""
