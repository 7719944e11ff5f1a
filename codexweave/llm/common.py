"""What the text operators share: job attributes, text columns, Arrow helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Unicode white space, with the four separators that Java's class leaves out.
BLANK = r"(?U)[\s\x1c-\x1f]+"


def job_value(job_status: DataFrame, column: str) -> DataFrame:
    """``job_key, column``: the job's non-null value, the least one if there were several."""
    return (
        job_status.where(F.col(column).isNotNull() & F.col("job_key").isNotNull())
        .groupBy("job_key")
        .agg(F.min(column).alias(column))
    )


def squeezed(text: Column) -> Column:
    """``text`` trimmed, with each run of Unicode white space made one space."""
    return F.trim(F.regexp_replace(text, BLANK, " "))


def lines_of(text: Column) -> Column:
    """The non-empty squeezed lines of a text, in order; an empty array for null."""
    lines = F.transform(F.split(text, "\n"), squeezed)
    return F.coalesce(F.filter(lines, lambda line: line != ""), F.array().cast("array<string>"))
