"""Column-expression helpers shared by all operators."""

from .classify import (bool_count, case_count, classify_energy, classify_moisture, is_alarm,
                       is_batch_lifecycle, is_quality_check, pct)
from .timefns import (as_of_col, bucket_start, latest_ts, since, trunc_like, ts_type)

__all__ = [
    "bool_count", "case_count", "classify_energy", "classify_moisture", "is_alarm",
    "is_batch_lifecycle", "is_quality_check", "pct", "as_of_col", "bucket_start",
    "latest_ts", "since", "trunc_like", "ts_type",
]
