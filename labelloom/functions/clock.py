"""Time expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def wall_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without time zone.

    Built from calendar fields, so the session time zone plays no role.
    """
    days = F.unix_date(ts.cast("date")).cast("bigint")
    minutes = F.hour(ts) * 60 + F.minute(ts)
    micros = (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")
    return days * 86_400_000_000 + minutes.cast("bigint") * 60_000_000 + micros


def with_micros(df: DataFrame, ts: str = "ts", output: str = "us") -> DataFrame:
    """Add the time in microseconds for either kind of timestamp column."""
    zoneless = isinstance(df.schema[ts].dataType, T.TimestampNTZType)
    return df.withColumn(output, wall_micros(F.col(ts)) if zoneless else F.unix_micros(F.col(ts)))
