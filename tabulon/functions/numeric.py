"""Scalar column helpers: type classes, safe coercion and rounding.

ANSI mode is on by default in Spark 4, so a plain cast of bad text or a
division by zero raises; every coercion here goes through ``try_*``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
INTEGRAL_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
#: The technical column that holds the order of the rows of a scan (`ordering.scan_order`); no statistic looks at it.
ROW_ID = "_row_id"
DATE_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def q(name: str) -> Column:
    """Column reference that survives dots, spaces and other odd characters."""
    return F.col("`" + name.replace("`", "``") + "`")


def data_columns(df: DataFrame) -> list[str]:
    """All columns but the row id."""
    return [c for c in df.columns if c != ROW_ID]


def numeric_columns(df: DataFrame) -> list[str]:
    """Numeric columns in table order (booleans excluded, like pandas ``number``)."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES) and f.name != ROW_ID]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


# Necessary (not sufficient) shapes of a parsable value.  Spark's try_* parsers
# fail through exceptions, which costs microseconds per value; testing the
# shape first keeps obvious text away from them.
NUMBER_SHAPE = r"^\s*[+-]?(\d|\.\d|(?i:inf|nan))"
INTEGER_SHAPE = r"^\s*[+-]?\d+\s*$"
# "12F" and "7D" are codes, not numbers, though Spark's cast reads them as Java literals.
LITERAL_SUFFIX = r"[0-9.][fFdD]\s*$"
DATE_SHAPE = r"^\s*[+-]?\d"


def fails_number(c: Column, to: str = "double") -> Column:
    """True for a non-null value that does not parse as ``to`` (long/double)."""
    shape = INTEGER_SHAPE if to in ("long", "int", "bigint") else NUMBER_SHAPE
    return c.isNotNull() & (~c.rlike(shape) | c.rlike(LITERAL_SUFFIX) | c.try_cast(to).isNull())


def fails_timestamp(c: Column, fmt: str | None = None) -> Column:
    """True for a non-null value that does not parse as a timestamp (or date with ``fmt``)."""
    parsed = F.try_to_date(c, fmt) if fmt else F.try_to_timestamp(c)
    return c.isNotNull() & (~c.rlike(DATE_SHAPE) | parsed.isNull())


def to_number(c: Column | str, kind: T.DataType | None = None) -> Column:
    """Coerce to double, unparsable text becomes null (pandas ``errors='coerce'``).

    ``kind``: the column's type; a number needs no look at its text.
    """
    c = q(c) if isinstance(c, str) else c
    if isinstance(kind, NUMERIC_TYPES):
        return c.cast("double")
    return F.when(~c.cast("string").rlike(LITERAL_SUFFIX), c.try_cast("double"))


def finite_or_null(c: Column | str) -> Column:
    """NaN and +-Inf become null."""
    c = q(c) if isinstance(c, str) else c
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None).cast("double")).otherwise(c)


def nan_to_null(df: DataFrame) -> DataFrame:
    """C12 over a whole frame: every float/double column gets :func:`finite_or_null`."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            cols.append(finite_or_null(f.name).cast(f.dataType).alias(f.name))
        else:
            cols.append(q(f.name))
    return df.select(*cols)
