"""Which reading of a page stands: cached, from the text layer, or recognised; resumption and upgrades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexweave.functions import text as T
from codexweave.operators import classify, library
from codexweave.operators import pages as P

#: Sources of pages that come from a PDF's own text. Fixed values.
TEXT_LAYERS = ("pdf_text_layer", "existing_ocr_text_layer")
NO_TEXT = "文本层为空"


def direct_pages(layer: DataFrame) -> DataFrame:
    """Page records of a text layer (job_key, page_number, text): cleaned, sure if there is text, with a warning if not."""
    text = T.cleaned_layer_text(F.coalesce("text", F.lit("")))
    rows = layer.withColumn("text", text)
    empty = F.col("text") == ""
    return rows.select(
        "job_key", "page_number", "text", F.when(empty, 0.0).otherwise(1.0).alias("confidence"), F.lit("pdf_text_layer").alias("source"),
        F.when(empty, F.array(F.lit(NO_TEXT))).otherwise(F.array().cast("array<string>")).alias("warnings"),
    )


def wanted_direct_pages(direct: DataFrame, wanted: DataFrame) -> DataFrame:
    """The direct pages that are asked for (job_key, page_number) and have text."""
    return direct.join(wanted.select("job_key", "page_number").distinct(), ["job_key", "page_number"], "left_semi").where(T.stripped(F.col("text")) != "")


def resume_plan(pages: DataFrame, job_status: DataFrame) -> DataFrame:
    """``job_key, page_number, action``: what is still to be done for each page up to a job's target.

    ``cached``: the job has read it. ``direct``: another job of the same source has a usable,
    unscanned text layer for it. ``recognise``: neither. Pages are spread by job and page; of
    texts only the flag whether they are usable is shuffled.
    """
    jobs = library.latest_status(job_status).select("job_key", "source_pdf", "target_pages")
    wanted = jobs.where("target_pages > 0").select("job_key", "source_pdf", F.explode(F.sequence(F.lit(1), F.col("target_pages"))).alias("page_number"))
    read = pages.where(F.col("page_number").isNotNull()).select("job_key", "page_number").distinct().withColumn("cached", F.lit(True))
    text = T.cleaned_layer_text(F.coalesce("text", F.lit("")))
    reports = pages.select("job_key", "page_number", (F.coalesce(F.col("source").isin(*TEXT_LAYERS), F.lit(False)) & (F.length(text) >= classify.USABLE_CHARS)).alias("usable"))
    usable = reports.where("usable").select("job_key", "page_number").join(jobs.where("source_pdf IS NOT NULL").select("job_key", "source_pdf"), "job_key")
    direct = usable.select("source_pdf", "page_number").distinct().withColumn("direct", F.lit(True))
    rows = wanted.join(read, ["job_key", "page_number"], "left").join(direct, ["source_pdf", "page_number"], "left")
    return rows.select("job_key", "page_number", F.when(F.col("cached"), "cached").when(F.col("direct"), "direct").otherwise("recognise").alias("action"))


def page_evidence(pages: DataFrame, job_status: DataFrame) -> DataFrame:
    """``source_pdf, page_number, direct_chars, recognised_chars, chosen, n_readings``: what there is of each page.

    Over all jobs of a source; the text layer's reading is chosen where it has text, else the
    recognised one. Only lengths are shuffled.
    """
    sources = library.latest_status(job_status).where("source_pdf IS NOT NULL").select("job_key", "source_pdf")
    chars = F.length(T.stripped(F.coalesce("text", F.lit(""))))
    layer = F.coalesce(F.col("source").isin(*TEXT_LAYERS), F.lit(False))
    narrow = pages.where("page_id IS NOT NULL AND page_number IS NOT NULL").select("job_key", "page_id", "page_number", layer.alias("layer"), chars.alias("chars")).distinct()
    rows = narrow.join(sources, "job_key").groupBy("source_pdf", "page_number").agg(
        F.max(F.when(F.col("layer"), F.col("chars"))).alias("direct_chars"), F.max(F.when(~F.col("layer"), F.col("chars"))).alias("recognised_chars"), F.count("*").alias("n_readings")
    )
    chosen = F.when(F.col("direct_chars") > 0, "direct").when(F.col("recognised_chars") > 0, "recognised").otherwise("none")
    return rows.select("source_pdf", "page_number", "direct_chars", "recognised_chars", chosen.alias("chosen"), "n_readings")


def page_record(pages: DataFrame, job_key: str, page_number: int) -> DataFrame:
    """One page of a job without its blocks but with their number; no row where it was not read."""
    found = pages.where((F.col("job_key") == job_key) & (F.col("page_number") == page_number)).limit(1)
    return found.withColumn("n_blocks", F.coalesce(F.size("blocks"), F.lit(0))).drop("blocks")


def reviews(pages: DataFrame) -> DataFrame:
    """``page_id, needs_review, is_upgraded, needs_rotation`` of each page."""
    rows = P.known_pages(pages).select(
        "page_id",
        P.needs_review(F.col("confidence"), F.col("text"), F.col("source")).alias("needs_review"),
        P.already_upgraded(F.col("warnings")).alias("is_upgraded"),
        P.needs_rotation(F.col("confidence"), F.col("warnings")).alias("needs_rotation"),
    )
    return P.one_row_each(rows)


def reading(confidence: Column, text: Column) -> Column:
    return F.struct(F.coalesce(confidence, F.lit(0.0)).alias("confidence"), F.coalesce(text, F.lit("")).alias("text"))


def upgraded_pages(pages: DataFrame, job_status: DataFrame) -> DataFrame:
    """``source_pdf, page_number, n_readings, confidence, n_chars``: the best reading of pages that several jobs read.

    Readings are taken in order of job; a later one replaces an earlier one if it is surer or
    longer and loses no text (see ``best_reading``), so the order counts and the readings of
    one page meet: as many as there are jobs of its source.
    """
    sources = library.latest_status(job_status).where("source_pdf IS NOT NULL").select("job_key", "source_pdf")
    rows = P.distinct_pages(pages).where("page_number IS NOT NULL").select("job_key", "page_number", "page_id", reading(F.col("confidence"), F.col("text")).alias("r")).join(sources, "job_key")
    held = rows.groupBy("source_pdf", "page_number").agg(F.array_sort(F.collect_list(F.struct("job_key", "page_id", "r"))).alias("held")).where(F.size("held") > 1)
    best = P.best_reading(F.transform("held", lambda h: h["r"]))
    return held.select("source_pdf", "page_number", F.size("held").alias("n_readings"), best.alias("b")).select("source_pdf", "page_number", "n_readings", "b.confidence", F.length("b.text").alias("n_chars"))
