"""Sortable ids and normalised timestamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base-32 digits Spark's conv() writes and the digits of sortable ids, in order.
CONV_DIGITS = "ABCDEFGHIJKLMNOPQRSTUV"
ID_DIGITS = "ABCDEFGHJKMNPQRSTVWXYZ"


def _digits(number: Column, width: int, base: int = 10) -> Column:
    return F.lpad(F.translate(F.conv(number.cast("string"), base, 32), CONV_DIGITS, ID_DIGITS), width, "0")


def ulid(seconds: Column, key: list[Column] | None = None) -> Column:
    """A 26-character id: 48 bits of milliseconds, then 80 bits.

    With ``key`` the 80 bits are a digest of those columns, so a recomputed task gives the same ids; without it they
    are random and the result has to be written before it is used twice.
    """
    millis = F.floor(seconds * 1000).cast("long")
    if key is None:
        tail = [_digits(F.floor(F.rand() * (1 << 40)).cast("long"), 8) for _ in range(2)]
    else:
        digest = F.sha2(F.to_json(F.struct(*[c.alias(f"k{i}") for i, c in enumerate(key)])), 256)
        tail = [_digits(F.substring(digest, 1 + 10 * i, 10), 8, 16) for i in range(2)]
    return F.concat(_digits(millis, 10), *tail)


def with_ulid(df: DataFrame, ts: Column | None = None, key: list[Column] | None = None, name: str = "id") -> DataFrame:
    """Give each row an id where it has none yet."""
    seconds = F.unix_micros(F.current_timestamp()) / 1e6 if ts is None else ts
    made = ulid(seconds, key)
    return df.withColumn(name, F.coalesce(F.col(name), made) if name in df.columns else made)


def epoch_seconds(col: Column) -> Column:
    """Epoch seconds of a number or of an ISO date-time text."""
    text = col.cast("string")
    return F.coalesce(
        text.try_cast("double"),
        F.unix_micros(text.try_cast("timestamp")) / 1e6,
    )


def normalise_ts(df: DataFrame, name: str = "last_modified") -> DataFrame:
    """``last_modified`` as epoch seconds; a missing one becomes the time of the job, the same for all of its rows.

    Rows with equal times are told apart by their position or history id.
    """
    source = F.col(name)
    if dict(df.dtypes)[name].startswith("timestamp"):
        seconds = F.unix_micros(source.cast("timestamp")) / 1e6
    else:
        seconds = epoch_seconds(source)
    fresh = F.unix_micros(F.current_timestamp()) / 1e6
    return df.withColumn(name, F.when(source.isNull(), fresh).otherwise(seconds))
