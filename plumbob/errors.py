"""Errors raised for arguments; row-level faults are returned as rows instead."""


class EngineError(Exception):
    """Base of all errors of this package."""


class ValidationError(EngineError, ValueError):
    """An argument is out of its bounds."""


class NotFound(EngineError, LookupError):
    """A named collection, snapshot or document doesn't exist."""


class AlreadyExists(EngineError):
    """A unique key is taken."""


class InvalidState(EngineError):
    """A transition or reference that the current state forbids."""


class QuotaExceeded(EngineError):
    """A tenant's quota doesn't allow it."""


class StorageError(EngineError, OSError):
    """Stored data is missing or doesn't agree with its manifest."""


class SerializationError(EngineError):
    """Data can't be written in the asked form."""


class DeserializationError(EngineError):
    """Stored data can't be read."""
