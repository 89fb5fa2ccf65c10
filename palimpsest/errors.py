"""Typed errors of versioned tables."""

from __future__ import annotations


class VersionedTableError(Exception):
    """Any error of this library; ``hint`` says what to do instead."""

    def __init__(self, message: str, hint: str = "") -> None:
        super().__init__(f"{message} ({hint})" if hint else message)
        self.hint = hint


class UnsupportedOperation(VersionedTableError):
    """The table is append-only: this operation does not exist."""


class ConfigurationError(VersionedTableError):
    """A table's settings or columns cannot be used together."""


class UnknownColumn(ConfigurationError):
    pass


class NullGroup(VersionedTableError):
    pass


class NullDelta(VersionedTableError):
    pass


class InvalidSequence(VersionedTableError):
    pass


class DuplicateSequence(InvalidSequence):
    pass


class CorruptChain(VersionedTableError):
    """A stored delta has no base, or cannot be read."""


class NotVersioned(VersionedTableError):
    """The path or name is no versioned table."""


class ConcurrentModification(VersionedTableError):
    """Another writer changed the same buckets; nothing was committed."""
