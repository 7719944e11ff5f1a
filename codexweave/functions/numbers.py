"""Numbers as they come in records: text, booleans, not-a-number and negatives among them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(value: Column) -> Column:
    """A text or number as a finite double, else null; the words true and false are no numbers."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)


def nonnegative_integer(value: Column) -> Column:
    """A text or number as a whole number of 0 or more, else null; 3.0 is 3, 3.5 is none."""
    number = finite(value)
    return F.when((number >= 0) & (number == F.floor(number)) & (number < 2.0**62), number.cast("long"))


def bounded(value: Column, low: float, high: float) -> Column:
    """A finite number moved into its bounds; null stays null."""
    number = finite(value)
    return F.when(number.isNotNull(), F.least(F.greatest(number, F.lit(float(low))), F.lit(float(high))))
