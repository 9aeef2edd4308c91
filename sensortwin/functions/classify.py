"""Row-local classification expressions (silver flags and classes).

All of them are plain Catalyst expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def classify_moisture(col: str | Column = "moisture_pct",
                      in_spec: tuple[float, float] = C.MOISTURE_IN_SPEC,
                      marginal: tuple[float, float] = C.MOISTURE_MARGINAL) -> Column:
    """NULL -> NULL; [3.0, 5.0] -> IN_SPEC; else [2.5, 5.5] -> MARGINAL; else OUT_OF_SPEC."""
    m = _c(col)
    return (F.when(m.isNull(), F.lit(None).cast("string"))
            .when(m.between(F.lit(in_spec[0]), F.lit(in_spec[1])), F.lit("IN_SPEC"))
            .when(m.between(F.lit(marginal[0]), F.lit(marginal[1])), F.lit("MARGINAL"))
            .otherwise(F.lit("OUT_OF_SPEC")))


def classify_energy(col: str | Column = "energy_kwh",
                    low_below: float = C.ENERGY_LOW_BELOW,
                    medium: tuple[float, float] = C.ENERGY_MEDIUM) -> Column:
    """NULL -> NULL; < 50 -> LOW; [50, 200] -> MEDIUM; else HIGH."""
    e = _c(col)
    return (F.when(e.isNull(), F.lit(None).cast("string"))
            .when(e < F.lit(low_below), F.lit("LOW"))
            .when(e.between(F.lit(medium[0]), F.lit(medium[1])), F.lit("MEDIUM"))
            .otherwise(F.lit("HIGH")))


def is_alarm(col: str | Column = "event_type") -> Column:
    return _c(col) == F.lit("alarm")


def is_quality_check(col: str | Column = "event_type") -> Column:
    return _c(col) == F.lit("quality_check")


def is_batch_lifecycle(col: str | Column = "event_type") -> Column:
    return _c(col).isin(*C.LIFECYCLE_EVENT_TYPES)


def bool_count(col: str | Column) -> Column:
    """``SUM(CAST(flag AS INT))`` as BIGINT: NULL when every input is NULL."""
    return F.sum(_c(col).cast("int")).cast("long")


def case_count(cond: Column) -> Column:
    """``SUM(CASE WHEN cond THEN 1 ELSE 0 END)`` as BIGINT (0, never NULL, on a non-empty group)."""
    return F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0))).cast("long")


def pct(numerator: Column, denominator: Column, digits: int = 1) -> Column:
    """``ROUND(100 * n / NULLIF(d, 0), digits)`` in DOUBLE; NULL when d is 0 or NULL."""
    return F.round(F.lit(100.0) * numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0)),
                   digits)
