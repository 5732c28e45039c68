"""Error classes with stable codes."""

from __future__ import annotations


class EngineError(Exception):
    code, status = 0, 500


#: Name, code, HTTP status.
CODES = (
    ("DimensionMismatch", 1, 400),
    ("CollectionNotFound", 2, 404),
    ("VectorNotFound", 3, 404),
    ("CapacityExceeded", 4, 507),
    ("IndexNotBuilt", 5, 503),
    ("CorruptedFile", 6, 500),
    ("ConcurrentModification", 7, 409),
    ("DuplicateID", 8, 409),
    ("RateLimitExceeded", 9, 429),
    ("Unauthorized", 10, 401),
    ("IntegrityFailure", 11, 500),
    ("QuotaExceeded", 12, 402),
    ("TenantNotFound", 13, 404),
    ("LogTruncated", 14, 500),
)

_classes = {name: type(name, (EngineError,), {"code": code, "status": status}) for name, code, status in CODES}
DimensionMismatch = _classes["DimensionMismatch"]
CollectionNotFound = _classes["CollectionNotFound"]
VectorNotFound = _classes["VectorNotFound"]
CapacityExceeded = _classes["CapacityExceeded"]
IndexNotBuilt = _classes["IndexNotBuilt"]
CorruptedFile = _classes["CorruptedFile"]
ConcurrentModification = _classes["ConcurrentModification"]
DuplicateID = _classes["DuplicateID"]
RateLimitExceeded = _classes["RateLimitExceeded"]
Unauthorized = _classes["Unauthorized"]
IntegrityFailure = _classes["IntegrityFailure"]
QuotaExceeded = _classes["QuotaExceeded"]
TenantNotFound = _classes["TenantNotFound"]
LogTruncated = _classes["LogTruncated"]
