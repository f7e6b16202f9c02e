from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: how the transactions file writes a time.
TIMESTAMP_FORMAT = "yyyy/MM/dd HH:mm"


def parse_ts(col: Column | str, strict: bool = True) -> Column:
    """Zone-less timestamp of the file's text; null on bad text if not strict."""
    col = F.col(col) if isinstance(col, str) else col
    if strict:
        return F.to_timestamp_ntz(col, F.lit(TIMESTAMP_FORMAT))
    # Through the standard form, as a lenient parser with a format would pass through the session's zone.
    standard = F.regexp_replace(col, "^([0-9]{4})/([0-9]{2})/([0-9]{2} [0-9]{2}:[0-9]{2})$", "$1-$2-$3")
    return F.when(col.rlike("^[0-9]{4}/"), standard.try_cast("timestamp_ntz"))


def rate_date(col: Column | str) -> Column:
    """Day whose exchange rate applies."""
    return F.to_date(col)
