"""Time helpers: type-preserving truncation, buckets, ``as_of`` and recency filters."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def ts_type(df: DataFrame, name: str = "event_ts") -> T.DataType:
    return df.schema[name].dataType


def trunc_like(df: DataFrame, unit: str, name: str = "event_ts") -> Column:
    """``date_trunc(unit, ts)`` keeping the column's timestamp flavour.

    ``date_trunc`` always returns TIMESTAMP; for TIMESTAMP_NTZ input the result is cast
    back (exact under the pinned UTC session zone).
    """
    out = F.date_trunc(unit, F.col(name))
    if isinstance(ts_type(df, name), T.TimestampNTZType):
        out = out.cast(T.TimestampNTZType())
    return out


def bucket_start(col: str | Column, duration: str) -> Column:
    """Start of the tumbling, epoch-aligned bucket holding ``col``.

    Equal to ``TIMESTAMP_SECONDS(FLOOR(UNIX_SECONDS(ts) / n) * n)`` and, unlike
    ``unix_seconds``, also accepts TIMESTAMP_NTZ (type is preserved).
    """
    return F.window(_c(col), duration).start


def as_of_col(as_of=None) -> Column:
    """``as_of`` as a Column: None -> ``current_timestamp()``; datetime/str -> literal;
    a Column (for instance a scalar subquery ``latest_ts(df)``) is used as is."""
    if as_of is None:
        return F.current_timestamp()
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, str):
        return F.to_timestamp(F.lit(as_of))
    if isinstance(as_of, _dt.datetime):
        return F.lit(as_of)
    raise TypeError(f"unsupported as_of {as_of!r}")


def latest_ts(df: DataFrame, name: str = "event_ts", partitioned: bool = False,
              date_col: str = "event_date") -> Column:
    """``(SELECT MAX(ts) FROM df)`` as an uncorrelated scalar subquery.

    Planned as a one-row aggregate executed once; nothing is collected by user code.
    ``partitioned=True`` is for a stored table partitioned by ``date_col``: the maximum is
    taken inside the newest date only (``to_date`` is monotone), so one partition is read.
    """
    if partitioned:
        newest_day = df.select(F.max(date_col)).scalar()
        df = df.filter(F.col(date_col) == newest_day)
    return df.select(F.max(name)).scalar()


def interval_seconds(seconds) -> Column:
    return F.make_dt_interval(secs=F.lit(seconds).cast("decimal(18,6)"))


def interval_hours(hours) -> Column:
    return F.make_dt_interval(hours=F.lit(int(hours)))


def since(df: DataFrame, ts: str, as_of, *, seconds=None, hours=None,
          date_col: str | None = None) -> DataFrame:
    """Rows with ``ts >= as_of - interval`` (no upper bound, as in the application).

    When the frame carries the date column (``date_col``), an implied
    ``date_col >= to_date(as_of - interval)`` predicate is added: on a table partitioned
    by that column the scan then prunes whole date partitions (Spark does not derive it
    from the timestamp predicate); on a computed frame it is just a redundant filter.
    """
    span = interval_seconds(seconds) if seconds is not None else interval_hours(hours)
    lower = as_of_col(as_of) - span
    out = df.filter(F.col(ts) >= lower)
    if date_col and date_col in df.columns:
        out = out.filter(F.col(date_col) >= F.to_date(lower))
    return out
