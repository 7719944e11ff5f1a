"""What kind of document a job's text layer makes it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexweave.functions import text as T

USABLE_CHARS, BROKEN_CHARS, GARBLED, SCANNED_EMPTY = 30, 20, 0.18, 20


def page_reports(pages: DataFrame, scanned: Column) -> DataFrame:
    """``page_id, job_key, page_number, text_chars, garble, likely_scanned, usable, is_contents`` of each page."""
    text = T.cleaned_layer_text(F.coalesce("text", F.lit("")))
    rows = pages.select("page_id", "job_key", "page_number", text.alias("_text"), F.coalesce(scanned, F.lit(False)).alias("likely_scanned"))
    rows = rows.withColumn("garble", T.garble_score(F.col("_text"))).withColumn("text_chars", F.length("_text"))
    usable = (F.col("text_chars") >= USABLE_CHARS) & (F.col("garble") < GARBLED)
    return rows.select("page_id", "job_key", "page_number", "text_chars", "garble", "likely_scanned", usable.alias("usable"), T.contents_like(F.col("_text")).alias("is_contents"))


def document_kinds(reports: DataFrame) -> DataFrame:
    """``job_key, n_pages, text_ratio, scanned_ratio, mean_garble, kind`` by the first rule that holds."""
    ratio = lambda test: F.round(F.count_if(test) / F.count("*"), 4)
    shares = reports.groupBy("job_key").agg(
        F.count("*").alias("n_pages"),
        ratio(F.col("usable")).alias("text_ratio"),
        ratio(F.col("likely_scanned")).alias("scanned_ratio"),
        ratio(F.col("likely_scanned") & (F.col("text_chars") < SCANNED_EMPTY)).alias("_empty"),
        ratio((F.col("text_chars") >= BROKEN_CHARS) & (F.col("garble") >= GARBLED)).alias("_broken"),
        F.max("is_contents").alias("_contents"),
        F.round(F.coalesce(F.avg(F.when(F.col("text_chars") > 0, F.col("garble"))), F.lit(1.0)), 4).alias("mean_garble"),
    )
    text, scanned = F.col("text_ratio"), F.col("scanned_ratio")
    kind = (
        F.when(F.col("_broken") >= 0.2, "broken_layer")
        .when((F.col("_empty") >= 0.8) & (text < 0.2), "image_only")
        .when((scanned >= 0.5) & (text >= 0.5), "searchable_scan")
        .when((scanned >= 0.2) & (text >= 0.2), "mixed")
        .when((text >= 0.8) & (scanned < 0.2), "born_digital")
        .when((text >= 0.6) & F.col("_contents"), "born_digital")
        .when((text < 0.2) & (scanned < 0.2), "empty")
        .otherwise("mixed")
    )
    return shares.select("job_key", "n_pages", "text_ratio", "scanned_ratio", "mean_garble", kind.alias("kind"))


def sample_positions(n_pages: Column, wanted: int, front: int = 3) -> Column:
    """Sorted page numbers of a sample: the first ones, even steps between, and the last."""
    n = F.greatest(n_pages, F.lit(0))
    ahead = F.when(n > 0, F.sequence(F.lit(1), F.least(n, F.lit(min(front, wanted)))))
    rest = max(1, wanted - front)
    steps = F.transform(F.sequence(F.lit(1), F.lit(rest)), lambda i: F.round(F.lit(1) + (n - 1) * i / rest).cast("int"))
    every = F.when(n > 0, F.sequence(F.lit(1), n))
    chosen = F.array_sort(F.array_distinct(F.concat(ahead, F.filter(steps, lambda p: p.between(1, n)))))
    return F.when(n == 0, F.array().cast("array<int>")).when(n <= wanted, every).otherwise(F.slice(chosen, 1, wanted))
