"""Reading instants that were written down in several spellings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ISO 8601 date, time, optional fraction and optional zone.
ISO = r"^(\d{4}-\d{2}-\d{2})[Tt ](\d{2}:\d{2}(?::\d{2}(?:[.,]\d{1,9})?)?)\s*([Zz]|[+-]\d{2}:?\d{2}|[+-]\d{2})?$"
DATE = r"^\d{4}-\d{2}-\d{2}$"
EPOCH = r"^[+-]?\d{1,19}(\.\d+)?$"


def instant_micros(text: Column) -> Column:
    """Microseconds since 1970 of a written instant; null where it cannot be read.

    Understood: ISO 8601 with T or blank, optional seconds and fraction, Z, an offset (+hh:mm, +hhmm, +hh) or no zone
    (UTC); a date alone (midnight UTC); seconds since 1970 as digits, with 13 or 16 digits milli- or microseconds.
    """
    t = F.trim(text)
    clock = F.regexp_replace(F.regexp_extract(t, ISO, 2), ",", ".")
    clock = F.when(F.length(clock) == 5, F.concat(clock, F.lit(":00"))).otherwise(clock)
    zone = F.upper(F.regexp_extract(t, ISO, 3))
    zone = F.when(zone.isin("", "Z"), F.lit("+00:00")).when(F.length(zone) == 3, F.concat(zone, F.lit(":00"))).when(F.length(zone) == 5, F.concat(F.substring(zone, 1, 3), F.lit(":"), F.substring(zone, 4, 2))).otherwise(zone)
    stamp = F.concat(F.regexp_extract(t, ISO, 1), F.lit(" "), clock, zone)
    number = F.regexp_extract(t, r"^([+-]?\d{1,19})", 1).try_cast("bigint")
    digits = F.length(F.regexp_replace(F.regexp_extract(t, r"^[+-]?(\d+)", 1), "^0+", ""))
    scale = F.when(digits <= 11, F.lit(1_000_000)).when(digits <= 14, F.lit(1_000)).otherwise(F.lit(1)).cast("bigint")
    fraction = F.when(digits <= 11, F.coalesce((F.regexp_extract(t, r"(\.\d+)$", 1).try_cast("double") * 1_000_000).cast("bigint"), F.lit(0).cast("bigint"))).otherwise(F.lit(0).cast("bigint"))
    return (
        F.when(t.rlike(ISO), F.unix_micros(stamp.try_cast("timestamp")))
        .when(t.rlike(DATE), F.unix_micros(F.concat(t, F.lit(" 00:00:00+00:00")).try_cast("timestamp")))
        .when(t.rlike(EPOCH), number * scale + fraction)
    )
