"""Writers: each task writes its own part; nothing is gathered in one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexweave.functions import text as T


#: What stands for a blank page and for one without text. Fixed values.
BLANK_PAGE, NO_TEXT = "[疑似空白页]", "[未提取到文本]"


def book_text(pages: DataFrame, source: str | None = None) -> DataFrame:
    """``book, page_number, value``: each page's heading and text, and as page 0 the book's title and source."""
    text = T.stripped(F.coalesce("text", F.lit("")))
    body = F.when(F.col("source") == "blank_page", BLANK_PAGE).when(text == "", NO_TEXT).otherwise(text)
    rows = pages.where("book IS NOT NULL").select("book", "page_number", F.concat(F.lit("## 第 "), F.col("page_number").cast("string"), F.lit(" 页\n\n"), body, F.lit("\n")).alias("value"))
    from_ = F.max(source) if source else F.lit(None).cast("string")
    heads = pages.where("book IS NOT NULL").groupBy("book").agg(from_.alias("s")).select("book", F.lit(0).alias("page_number"), F.concat(F.lit("# "), F.col("book"), F.coalesce(F.concat(F.lit("\n\n来源：`"), F.col("s"), F.lit("`")), F.lit("")), F.lit("\n")).alias("value"))
    return rows.unionByName(heads)


def write_book_text(pages: DataFrame, path: str) -> None:
    """Books as Markdown text, one folder each: a heading and the text of every page in order.

    Pages are spread by book and page range, so a book of any size takes many tasks; the part
    files of a book, by name, are its pages in order.
    """
    ranged = book_text(pages).repartitionByRange("book", "page_number").sortWithinPartitions("book", "page_number")
    ranged.select("book", "value").write.mode("overwrite").partitionBy("book").text(path)


def write_catalogue_csv(catalogue: DataFrame, path: str) -> None:
    """The catalogue as CSV with a header, empty for null, its first cell led by a byte-order mark."""
    first, *rest = catalogue.columns
    named = catalogue.select(F.col(first).alias("﻿" + first), *rest)
    named.write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="")


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunks as JSON lines, in folders by job; a job that is written again replaces its own folder alone."""
    rows = chunks.withColumn("job", F.coalesce("job_key", F.lit("none")))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("ignoreNullFields", "false").partitionBy("job").json(path)


def escaped(text: Column) -> Column:
    """``text`` safe within HTML."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


#: Labels of page sources in reports. Fixed values.
SOURCE_NAMES = {"pdf_text_layer": "PDF文本层", "existing_ocr_text_layer": "现有OCR文本层", "page_cache": "逐页缓存", "blank_page": "疑似空白页", "paddleocr": "飞桨OCR", "tesseract": "备用OCR"}


def audit_html(pages: DataFrame) -> DataFrame:
    """``page_id, html``: one escaped table row for each page: number, source, confidence, characters, warnings."""
    names = F.create_map(*[F.lit(x) for pair in SOURCE_NAMES.items() for x in pair])
    source = F.coalesce(F.try_element_at(names, F.col("source")), "source", F.lit(""))
    sure = F.format_string("%.3f", F.coalesce("confidence", F.lit(0.0)))
    told = F.array_join(F.coalesce("warnings", F.array().cast("array<string>")), "；")
    cells = (F.coalesce(F.col("page_number").cast("string"), F.lit("")), escaped(source), sure, F.coalesce(F.length("text"), F.lit(0)).cast("string"), escaped(told))
    return pages.select("page_id", F.concat(F.lit("<tr><td>"), F.concat_ws("</td><td>", *cells), F.lit("</td></tr>")).alias("html"))


def write_audit_html(pages: DataFrame, path: str, title: str) -> None:
    """An audit as HTML text: part files whose first is the head, then the rows in order of page, then the foot."""
    rows = audit_html(pages).join(pages.select("page_id", "page_number").distinct(), "page_id").select("page_number", F.col("html").alias("value"))
    head = f'<!doctype html><html lang="zh-CN"><head><meta charset="utf-8"><title>{title}</title></head><body><h1>{title}</h1><table><thead><tr><th>页码</th><th>来源</th><th>置信度</th><th>字数</th><th>警告</th></tr></thead><tbody>'
    frame = pages.sparkSession.createDataFrame([(-1, head), (2**31 - 1, "</tbody></table></body></html>")], "page_number int, value string")
    rows.unionByName(frame).repartitionByRange("page_number").sortWithinPartitions("page_number").select("value").write.mode("overwrite").text(path)


def write_entries(entries: DataFrame, path: str) -> DataFrame:
    """Entries as text, one folder each, and their index: ``book, title, name, first_page, last_page``.

    ``entries`` has book, entry_no, title, first_page, last_page and text. A title that comes
    again in its book gets its number among them behind an underscore.
    """
    order = Window.partitionBy("book", "title").orderBy("entry_no")
    named = entries.withColumn("_n", F.row_number().over(order))
    named = named.withColumn("name", F.concat(T.title_file_name(F.coalesce("title", F.lit("无题"))), F.when(F.col("_n") > 1, F.concat(F.lit("_"), F.col("_n").cast("string"))).otherwise("")))
    named.select(F.col("text").alias("value"), "book", "name").write.mode("overwrite").partitionBy("book", "name").text(path)
    return named.select("book", "title", "name", "first_page", "last_page")


def write_json(rows: DataFrame, path: str, append: bool = False) -> None:
    """Rows as JSON lines with nulls written out: reports, manifests, and histories, which are only appended to."""
    rows.write.mode("append" if append else "overwrite").option("ignoreNullFields", "false").json(path)


#: Columns of a shared history as Markdown, with their headings. Fixed values.
SHARED = {"recorded": "记录时间", "event": "事件", "source_pdf": "来源PDF", "status": "状态", "processed_pages": "已处理页数", "target_pages": "目标页数"}


def history_markdown(records: DataFrame) -> DataFrame:
    """``recorded, value``: a table row of each record, for Markdown; bars within values are escaped."""
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    return records.select("recorded", F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in SHARED]), F.lit(" |")).alias("value"))
