from taskgrid.functions.nullsafe import (
    differs, equals, is_in, not_in, pct, require_same_type, same,
)
from taskgrid.functions.keys import row_hash

__all__ = ["differs", "equals", "is_in", "not_in", "pct", "require_same_type", "same",
           "row_hash"]
