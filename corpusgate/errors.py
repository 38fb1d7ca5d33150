"""The one error type of the package: code, message, remediation."""

from __future__ import annotations

# 1 means the caller's data or arguments are wrong, 2 means the
# environment is (missing or unreadable files).
USER_ERROR = 1
ENV_ERROR = 2


class CorpusError(Exception):
    def __init__(self, code: int, message: str, remediation: str = ""):
        super().__init__(message)
        self.code = code
        self.message = message
        self.remediation = remediation

    def as_dict(self) -> dict:
        return {"code": self.code, "message": self.message, "remediation": self.remediation}
