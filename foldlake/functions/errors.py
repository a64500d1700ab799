"""What can be wrong with an archive, as a value that queries can group by."""

from __future__ import annotations


class ArchiveError(Exception):
    """code: Corrupted, ChecksumMismatch, UnsupportedMethod, PasswordRequired, LimitExceeded, Io or
    InvalidArgument. limit, allowed and requested are set where a limit is exceeded."""

    def __init__(self, code: str, message: str, limit: str | None = None, allowed: int | None = None, requested: int | None = None):
        super().__init__(code, message, limit, allowed, requested)
        self.code, self.message, self.limit, self.allowed, self.requested = code, message, limit, allowed, requested

    def __str__(self) -> str:
        return f"{self.code}: {self.message}"


def corrupted(message: str) -> ArchiveError:
    return ArchiveError("Corrupted", message)


def exceeded(limit: str, allowed: int, requested: int) -> ArchiveError:
    return ArchiveError("LimitExceeded", f"{limit}: {requested} is over {allowed}", limit, allowed, requested)
