"""Output presentation for served results.

The serving layer of the application hands rows out as display values: arrays as
text and doubles as numbers.  ``present`` does the same, deterministically:

* DOUBLE columns are snapped to 9 then rounded to 6 decimals, so results that are
  equal in exact arithmetic compare equal across engines whose float sums were
  added in a different order (raw measurements are handed out as they are: ``exact``);
* ARRAY columns become comma-joined strings (arrays are sorted by the producers);
* bookkeeping columns (``_computed_at``, ingest metadata) are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DROP = ("_computed_at", "_ingested_at", "_source_file", "_file_modified_at")
DISPLAY_DIGITS = 6
SNAP_DIGITS = 9


def present(df: DataFrame, exact: bool = False) -> DataFrame:
    """``exact``: doubles as they are, for events that were read and not computed."""
    cols = []
    for f in df.schema.fields:
        if f.name in DROP:
            continue
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType) and not exact:
            c = F.round(F.round(c, SNAP_DIGITS), DISPLAY_DIGITS)
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c, ",")
        cols.append(c.alias(f.name))
    return df.select(*cols)
