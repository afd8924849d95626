"""Errors of the store, by what a caller can do about them."""

from __future__ import annotations


class StoreError(Exception):
    """Base of all store errors."""


class NotFound(StoreError, KeyError):
    def __init__(self, kind: str, name: str) -> None:
        super().__init__(f"{kind} not found: {name}")
        self.kind, self.name = kind, name

    def __str__(self) -> str:
        return self.args[0]


class AlreadyExists(StoreError):
    def __init__(self, kind: str, name: str) -> None:
        super().__init__(f"{kind} already exists: {name}")
        self.kind, self.name = kind, name


class QuotaExceeded(StoreError):
    def __init__(self, ns: str, dimension: str, rejected: int = 1) -> None:
        super().__init__(f"namespace {ns} is over its {dimension} quota ({rejected} rejected)")
        self.ns, self.dimension, self.rejected = ns, dimension, rejected


class Corruption(StoreError):
    def __init__(self, detail: str) -> None:
        super().__init__(f"corrupt: {detail}")
        self.detail = detail


class InvalidKey(StoreError, ValueError):
    def __init__(self, reason: str) -> None:
        super().__init__(f"invalid key: {reason}")


class InvalidNamespace(StoreError, ValueError):
    def __init__(self, name: str) -> None:
        super().__init__(f"invalid namespace id: {name!r}")


class EmptyObject(StoreError, ValueError):
    def __init__(self) -> None:
        super().__init__("empty objects are not stored")


class Closed(StoreError):
    def __init__(self) -> None:
        super().__init__("the store is closed")


class UnsupportedFormat(StoreError):
    def __init__(self, found, known: int) -> None:
        super().__init__(f"the store has format {found}, this library reads {known}")


class Conflict(StoreError):
    """Another writer committed first; the change was built on an older version."""


HTTP_STATUS = {NotFound: 404, AlreadyExists: 409, QuotaExceeded: 507, InvalidKey: 400, InvalidNamespace: 400, EmptyObject: 400, Corruption: 500, Closed: 503, Conflict: 409}


def http_status(error: Exception) -> int:
    return next((s for kind, s in HTTP_STATUS.items() if isinstance(error, kind)), 500)
