"""Readers of stored records: pages, chunks, statuses and histories, in either spelling."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stored names of page fields by column. Fixed values.
PAGE_NAMES = {
    "page_number": ("page_number", "页码"),
    "printed_page": ("printed_page", "书内页码"),
    "text": ("text", "文本"),
    "confidence": ("confidence", "置信度"),
    "source": ("source", "来源"),
    "warnings": ("warnings", "警告"),
    "blocks": ("blocks", "识别块"),
    "ocr_device": ("ocr_device", "识别设备"),
    "gpu_confirmed": ("gpu_confirmed", "图形处理器已确认"),
}
BLOCK = "array<struct<text:string,confidence:double,bbox:array<array<double>>>>"
PAGE_TYPES = {"page_number": "int", "printed_page": "string", "text": "string", "confidence": "double", "source": "string", "warnings": "array<string>", "blocks": BLOCK, "ocr_device": "string", "gpu_confirmed": "boolean"}
#: Labels of page sources and the values they stand for. Fixed values.
SOURCE_LABELS = {"PDF文本层": "pdf_text_layer", "现有OCR文本层": "existing_ocr_text_layer", "逐页缓存": "page_cache", "疑似空白页": "blank_page", "飞桨OCR": "paddleocr", "备用OCR": "tesseract"}
#: Folders a library listing leaves out. Fixed values.
SKIPPED_FOLDERS = (".git", ".pytest_cache", ".ruff_cache", ".venv", "__pycache__", "node_modules", "dist", "build")


def _either(names: tuple[str, ...], path: str = "") -> Column:
    return F.coalesce(*[F.col(f"{path}`{name}`") for name in names])


def read_pages(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Page records of JSON lines under ``path`` and the lines that are none, with their files.

    Fields may have their English or their Chinese names; missing ones are null. Only the
    known fields are read. Page numbers missing from a record come from the file's name.
    """
    fields = ", ".join(f"`{name}` {PAGE_TYPES[column]}" for column, names in PAGE_NAMES.items() for name in names)
    raw = spark.read.text(path, recursiveFileLookup=True).select("value", F.col("_metadata.file_path").alias("file_path"))
    lines = raw.where(F.trim("value") != "")
    parsed = lines.withColumn("r", F.from_json("value", f"{fields}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    bad = F.col("r").isNull() | F.col("r._corrupt_record").isNotNull() | ~F.trim("value").startswith("{")
    good = parsed.where(~bad)
    columns = [_either(names, "r.").alias(column) for column, names in PAGE_NAMES.items() if column not in ("page_number", "source")]
    number = F.coalesce(_either(PAGE_NAMES["page_number"], "r."), F.regexp_extract("file_path", r"(\d+)\.jsonl?$", 1).try_cast("int"))
    source = _either(PAGE_NAMES["source"], "r.")
    labels = F.create_map(*[F.lit(x) for pair in SOURCE_LABELS.items() for x in pair])
    pages = good.select("file_path", number.alias("page_number"), F.coalesce(F.try_element_at(labels, source), source).alias("source"), *columns)
    return pages, parsed.where(bad).select("file_path", "value")


def _objects(raw: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of ``schema`` with file_path, and the texts of ``value`` that are no object."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    parsed = raw.withColumn("r", F.from_json("value", f"{schema}, _corrupt_record string", options))
    bad = F.col("r").isNull() | F.col("r._corrupt_record").isNotNull() | ~F.coalesce(F.ltrim("value"), F.lit("")).startswith("{")
    return parsed.where(~bad).select("file_path", "r.*").drop("_corrupt_record"), parsed.where(bad).select("file_path", "value")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Objects of JSON lines under ``path`` with file_path, and the lines that are none.

    Empty lines are neither; a line that is cut off or holds a list or a number is bad.
    """
    raw = spark.read.text(path, recursiveFileLookup=True).select("value", F.col("_metadata.file_path").alias("file_path"))
    return _objects(raw.where(F.trim("value") != ""), schema)


def read_json_files(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """The one object of each JSON file under ``path`` with file_path, and the files that hold none."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select("value", F.col("_metadata.file_path").alias("file_path"))
    return _objects(raw, schema)


#: Stored names of status and quality fields by column. Fixed values.
STATUS_NAMES = {
    "status": ("状态", "status"), "source_pdf": ("来源PDF", "source_pdf"), "mode": ("模式", "mode"), "engine": ("引擎", "engine"), "target_pages": ("目标页数", "target_pages"),
    "processed_pages": ("已处理页数", "processed_pages"), "total_pages": ("PDF总页数", "total_pages"), "text_pages": ("有文本页数", "text_pages"), "blank_pages": ("空白页数", "blank_pages"),
    "failed_pages": ("失败页数", "failed_pages"), "low_confidence_pages": ("低置信页数", "low_confidence_pages"), "is_sample": ("是否抽样", "is_sample"), "updated_at": ("更新时间", "updated_at"),
}
HISTORY_NAMES = {"recorded_at": ("记录时间", "recorded_at"), "event": ("事件", "event"), "run_id": ("运行编号", "run_id"), "job_dir": ("任务目录", "job_dir")} | {
    k: STATUS_NAMES[k] for k in ("source_pdf", "status", "mode", "engine", "target_pages", "processed_pages", "text_pages", "blank_pages", "low_confidence_pages", "failed_pages")
} | {"quality_path": ("质量报告", "quality_path")}
_NUMBERS = ("target_pages", "processed_pages", "total_pages", "text_pages", "blank_pages", "failed_pages", "low_confidence_pages")


def _fields_of(names: dict[str, tuple[str, ...]]) -> str:
    kind = lambda c: "int" if c in _NUMBERS else "boolean" if c == "is_sample" else "string"
    return ", ".join(f"`{name}` {kind(column)}" for column, both in names.items() for name in both)


def _named(rows: DataFrame, names: dict[str, tuple[str, ...]]) -> DataFrame:
    return rows.select("file_path", *[F.coalesce(*[F.col(f"`{n}`") for n in both]).alias(column) for column, both in names.items()])


def read_statuses(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Status (or quality) files under ``path`` in either spelling, one row each, and the unreadable files."""
    rows, bad = read_json_files(spark, path, _fields_of(STATUS_NAMES))
    return _named(rows, STATUS_NAMES), bad


def read_histories(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Events of history files (JSON lines) under ``path`` in either spelling, and the unreadable lines."""
    rows, bad = read_json_lines(spark, path, _fields_of(HISTORY_NAMES))
    return _named(rows, HISTORY_NAMES), bad


def read_chunks(spark: SparkSession, root: str, name: str = "片段.jsonl", index_folder: str = "知识库") -> tuple[DataFrame, DataFrame]:
    """``file_path, text, source_path, source_page`` of chunk files under ``root``, the index's own left out."""
    schema = "`text` string, `文本` string, `source_path` string, `来源PDF` string, `source_page` int, `页码` int"
    raw = spark.read.text(root, recursiveFileLookup=True, pathGlobFilter=name).select("value", F.col("_metadata.file_path").alias("file_path"))
    rows, bad = _objects(raw.where((F.trim("value") != "") & ~F.col("file_path").contains(f"/{index_folder}/")), schema)
    either = lambda a, b, c: F.coalesce(F.col(f"`{a}`"), F.col(f"`{b}`")).alias(c)
    return rows.select("file_path", either("text", "文本", "text"), either("source_path", "来源PDF", "source_path"), either("source_page", "页码", "source_page")), bad


def library_listing(spark: SparkSession, root: str, skipped: tuple[str, ...] = SKIPPED_FOLDERS) -> DataFrame:
    """``path, file_name, size_bytes`` of the PDFs under ``root``; their content is not read.

    The suffix may be in either case; files in any skipped folder below ``root`` are left out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("size_bytes"))
    below = F.regexp_replace("path", f"^(?:file:)?/*{re.escape(re.sub('^file:/*|^/+', '', root).rstrip('/'))}/", "")
    parts = F.split(below, "/")
    kept = F.lower("path").endswith(".pdf") & ~F.arrays_overlap(parts, F.array(*[F.lit(s) for s in skipped]))
    return files.where(kept).select("path", F.element_at(parts, -1).alias("file_name"), "size_bytes")


Rules = list[tuple[int, str, list[str], list[tuple[str, str]]]]


def read_rules(path: str) -> tuple[Rules, str | None]:
    """Correction rules of a YAML file, and why there are none: a missing file is no error, an unreadable one is told."""
    try:
        import yaml

        with open(path, encoding="utf-8") as file:
            listed = (yaml.safe_load(file) or {}).get("rules") or []
        rules = [(i, str(r["name"]), list(r.get("keywords") or []), [(str(a), str(b)) for a, b in (r.get("replacements") or {}).items()]) for i, r in enumerate(listed, 1)]
        return rules, None
    except FileNotFoundError:
        return [], None
    except Exception as error:  # a broken file must not stop a run
        return [], f"{type(error).__name__}: {error}"


#: A line that heads a page in a merged book. Fixed value.
PAGE_HEADING = r"^## (?:第 )?(\d+)(?: 页)?\s*$"


def pages_of_books(books: DataFrame, heading: str = PAGE_HEADING) -> DataFrame:
    """``book, page_number, text`` of merged books, one row per book with its whole ``text``.

    A page goes from its heading to the next; of headings with one number the last holds.
    Text before the first heading is left out. The places of the headings are found once and
    each page is sliced out between two, within the row; then there is one row per page.
    """
    rows = books.select("book", F.split(F.coalesce("text", F.lit("")), r"\r\n|\n|\r").alias("lines"))
    rows = rows.withColumn("heads", F.filter(F.transform("lines", lambda x, i: F.when(x.rlike(heading), i)), lambda i: i.isNotNull()))

    def page(start: Column, k: Column) -> Column:
        stop = F.coalesce(F.get("heads", k + 1), F.size("lines"))
        number = F.regexp_extract(F.get("lines", start), heading, 1).try_cast("int")
        return F.struct(number.alias("n"), F.array_join(F.slice("lines", start + 2, stop - start - 1), "\n").alias("text"))

    parts = rows.select("book", F.posexplode(F.transform("heads", page)).alias("at", "page"))
    last = parts.groupBy("book", F.col("page.n").alias("page_number")).agg(F.max_by(F.col("page.text"), F.col("at")).alias("text"))
    return last.withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", ""))
