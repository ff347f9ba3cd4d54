"""Money as doubles of dollars, rounded half up (towards +infinity) to cents, and falsy defaults."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def round2(x: Column) -> Column:
    """floor(100 x + 0.5) / 100."""
    return F.floor(x * 100 + 0.5) / 100


def truthy_or(x: Column, default: Column) -> Column:
    """``x`` unless it is null, NaN or 0."""
    return F.when(x.isNull() | F.isnan(x.cast("double")) | (x == 0), default).otherwise(x)


def dollars(cents: Column) -> Column:
    """Whole dollars without decimals, others with two."""
    n = F.floor(cents + 0.5)
    return F.concat(F.lit("$"), F.when(n % 100 == 0, (n / 100).cast("long").cast("string")).otherwise(F.format_string("%.2f", n / 100)))
