"""Sections and chunks of pages, and entries that run over pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexweave.functions import text as T

#: A line that opens an entry: a name and its foreign form in brackets. Fixed value.
ENTRY_HEADING = r"^\s*([\x{4E00}-\x{9FFF}][\x{4E00}-\x{9FFF}·-]{1,23})\s*[（(][A-Za-z][A-Za-z .,'-]{1,80}[）)]"
SENTENCE_GAP = r"\n{2,}|(?<=[。！？!?])\s+"


def section_array(pages: DataFrame, heading: str = ENTRY_HEADING) -> DataFrame:
    """``pages`` with ``parts``: title and text of each section of a page (see ``sections``).

    The places of the headings are found once and each section is sliced out between two.
    """
    rows = pages.withColumn("_lines", T.split_lines(F.coalesce("text", F.lit(""))))
    heads = F.filter(F.transform("_lines", lambda x, i: F.when(x.rlike(heading), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("_heads", heads)
    rows = rows.withColumn("_starts", F.when(F.get("_heads", F.lit(0)) == 0, F.col("_heads")).otherwise(F.concat(F.array(F.lit(0)), F.col("_heads"))))

    def part(start: Column, k: Column) -> Column:
        first = F.get("_lines", start)
        stop = F.coalesce(F.get("_starts", k + 1), F.size("_lines"))
        return F.struct(F.when(first.rlike(heading), F.regexp_extract(first, heading, 1)).alias("title"), F.array_join(F.slice("_lines", start + 1, stop - start), "\n").alias("text"))

    return rows.withColumn("parts", F.transform("_starts", part)).drop("_lines", "_heads", "_starts")


def sections(pages: DataFrame, heading: str = ENTRY_HEADING) -> DataFrame:
    """``page_id, section_no, title, text``: a page cut before each heading line.

    Lines before the first heading have a null title; blank sections are dropped but keep
    their number. Folded within the row, so nothing is shuffled.
    """
    rows = section_array(pages, heading).select("page_id", F.posexplode("parts").alias("at", "part"))
    found = rows.select("page_id", (F.col("at") + 1).alias("section_no"), "part.title", T.stripped(F.col("part.text")).alias("text"))
    return found.where("text <> ''")


def packed(text: Column, max_chars: int) -> Column:
    """A text as chunks of at most ``max_chars``: paragraphs packed greedily, long ones by lines.

    Paragraphs end at blank lines or after a sentence; chunks join them by blank lines. Lines
    longer than the limit are cut, and each cut piece is a paragraph of its own. A fold with the
    open chunk as its state.
    """
    def gather(parts: Column, glue: str, slack: int) -> Column:
        start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

        def add(acc: Column, part: Column) -> Column:
            fits = F.length(acc["open"]) + F.length(part) + slack <= max_chars
            flushed = F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"])))
            grown = F.when(acc["open"] == "", part).otherwise(F.concat(acc["open"], F.lit(glue), part))
            return F.struct(F.when(fits, acc["done"]).otherwise(flushed).alias("done"), F.when(fits, grown).otherwise(part).alias("open"))

        return F.aggregate(parts, start, add, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))

    def pieces(line: Column) -> Column:
        return F.regexp_extract_all(line, F.lit(f"(?s).{{1,{max_chars}}}"), F.lit(0))

    def runs(lines: Column) -> Column:
        """Lines that fit, packed, and the pieces of those that do not, each a paragraph of its own."""
        none = F.array().cast("array<string>")
        start = F.struct(none.alias("done"), F.lit("").alias("open"))
        flushed = lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"])))

        def add(acc: Column, line: Column) -> Column:
            long = F.length(line) > max_chars
            fits = F.length(acc["open"]) + F.length(line) + 1 <= max_chars
            grown = F.when(acc["open"] == "", line).otherwise(F.concat(acc["open"], F.lit("\n"), line))
            done = F.when(long, F.concat(flushed(acc), pieces(line))).when(fits, acc["done"]).otherwise(flushed(acc))
            return F.struct(done.alias("done"), F.when(long, F.lit("")).when(fits, grown).otherwise(line).alias("open"))

        return F.aggregate(lines, start, add, flushed)

    def by_lines(paragraph: Column) -> Column:
        return F.when(F.length(paragraph) <= max_chars, F.array(paragraph)).otherwise(runs(T.filled_lines(paragraph)))

    paragraphs = F.filter(F.transform(F.split(text, SENTENCE_GAP), T.stripped), lambda p: p != "")
    return gather(F.flatten(F.transform(paragraphs, by_lines)), "\n\n", 2)


def chunked(pages: DataFrame, max_chars: int = 900) -> DataFrame:
    """``page_id, chunk_no, title, text``: chunks of each page's sections, numbered through the page."""
    rows = section_array(pages).select("page_id", F.col("parts").alias("parts"))
    each = F.transform("parts", lambda p: F.transform(packed(T.stripped(p["text"]), max_chars), lambda c: F.struct(p["title"].alias("title"), c.alias("text"))))
    return rows.select("page_id", F.posexplode(F.flatten(each)).alias("at", "c")).select("page_id", (F.col("at") + 1).alias("chunk_no"), "c.title", "c.text")


def chunk_records(pages: DataFrame, max_chars: int = 900) -> DataFrame:
    """Chunks as records: ``chunk_id, job_key, book_title, chapter, page_start, page_end, text, confidence, source_page``.

    The id is the job's key, the page in four digits and the chunk in three; a chunk has its
    page's confidence. Nothing is shuffled but the page's own row.
    """
    made = chunked(pages, max_chars)
    head = pages.select("page_id", "job_key", "book", "page_number", "confidence")
    rows = made.join(head, "page_id")
    return rows.select(
        chunk_id(F.col("job_key"), F.col("page_number"), F.col("chunk_no")).alias("chunk_id"), "job_key", F.col("book").alias("book_title"), F.col("title").alias("chapter"),
        F.col("page_number").alias("page_start"), F.col("page_number").alias("page_end"), "text", "confidence", F.col("page_number").alias("source_page"),
    )


def chunk_id(stem: Column, page_number: Column, chunk_no: Column) -> Column:
    return F.format_string("%s-p%04d-%03d", stem, page_number, chunk_no)


def entry_ranges(starts: DataFrame, last_pages: DataFrame) -> DataFrame:
    """``book, title, first_page, last_page``: an entry runs to the page before the next one.

    The last entry of a book runs to its last page. Of entries that start on one page all but
    the last have an empty range (last_page below first_page).
    """
    order = Window.partitionBy("book").orderBy("first_page", "title")
    following = F.lead("first_page").over(order) - 1
    rows = starts.withColumn("last_page", following).join(last_pages, "book", "left")
    return rows.select("book", "title", "first_page", F.coalesce("last_page", "max_page").alias("last_page"))


def entry_texts(ranges: DataFrame, pages: DataFrame) -> DataFrame:
    """``book, title, first_page, last_page, n_pages, n_chars, text``: entries of whole pages, in order.

    ``ranges`` as from ``entry_ranges``; pages have book, page_number and text, one row each.
    Ranges are spread out to their pages and joined by book and page; empty ranges and pages
    that were not read give nothing.
    """
    spread = ranges.where("last_page >= first_page").select("book", "title", "first_page", "last_page", F.explode(F.sequence("first_page", "last_page")).alias("page_number"))
    met = spread.join(pages.select("book", "page_number", F.coalesce("text", F.lit("")).alias("text")), ["book", "page_number"])
    rows = met.groupBy("book", "title", "first_page", "last_page").agg(F.array_sort(F.collect_list(F.struct("page_number", "text"))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: x["text"]), "\n\n")
    return rows.select("book", "title", "first_page", "last_page", F.size("p").alias("n_pages"), F.length(text).alias("n_chars"), text.alias("text"))


#: A line with only a signature, which closes an entry, and a line that may open one. Fixed values.
SIGNATURE = r"^\s*[（(]([\x{4E00}-\x{9FFF}·]{2,6})[）)]\s*$"
ENTRY_TITLE = r"^\s*([\x{4E00}-\x{9FFF}][\x{4E00}-\x{9FFF}\w ]{1,30}?)(?:\(([a-zA-Z][a-zA-Z ._;,\-]+)\))?\s*$"


def signed_entries(pages: DataFrame, title: str = ENTRY_TITLE, signature: str = SIGNATURE) -> DataFrame:
    """``book, entry_no, title, author, first_page, last_page, text``: entries that end with a signature.

    Between two signatures the first title line opens the entry; lines before it are left
    out, and what follows the last signature is an entry without author. A page is cut at its
    signatures within its row; signatures are counted per page, so the running count of a book
    is over its pages, and an entry is put together from one part a page, never from lines.
    """
    lines = T.split_lines(F.coalesce("text", F.lit("")))
    rows = pages.where("book IS NOT NULL").select("book", "page_number", "page_id", lines.alias("lines"))
    ends = F.filter(F.transform("lines", lambda x, i: F.when(x.rlike(signature), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("ends", ends)
    before = Window.partitionBy("book").orderBy("page_number", "page_id").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.select("book", "page_number", "page_id", F.size("ends").alias("n"))
    offsets = counts.select("page_id", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def part(k: Column) -> Column:
        """The lines after signature ``k - 1`` up to and with signature ``k``, or the page's end."""
        begin = F.when(k == 0, 0).otherwise(F.get("ends", k - 1) + 1)
        stop = F.coalesce(F.get("ends", k) + 1, F.size("lines"))
        return F.struct(k.alias("inside"), F.slice("lines", begin + 1, stop - begin).alias("lines"), F.get("ends", k).isNotNull().alias("signed"))

    cut = rows.select("book", "page_number", "page_id", F.explode(F.transform(F.sequence(F.lit(0), F.size("ends")), part)).alias("p"))
    opens = F.array_position(F.transform("p.lines", lambda x: x.rlike(title) & ~x.rlike(signature)), True)
    parts = cut.where(F.size("p.lines") > 0).join(offsets, "page_id").select(
        "book", (F.col("base") + F.col("p.inside")).alias("entry_no"), "page_number", "page_id", opens.cast("int").alias("opens"), F.col("p.lines").alias("lines"),
        F.when(F.col("p.signed"), F.regexp_extract(F.element_at("p.lines", -1), signature, 1)).alias("author"),
    )
    whole = F.array_join("lines", "\n")
    opened = F.when(F.col("opens") > 0, F.array_join(F.slice("lines", F.col("opens"), F.size("lines")), "\n"))
    named = F.when(F.col("opens") > 0, F.regexp_extract(F.get("lines", F.col("opens") - 1), title, 1))
    held = parts.select("book", "entry_no", F.struct("page_number", "page_id", opened.alias("opened"), whole.alias("whole"), named.alias("title"), "author").alias("x"))
    entries = held.groupBy("book", "entry_no").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    first = F.array_position(F.transform("xs", lambda x: x["opened"].isNotNull()), True)
    entries = entries.withColumn("first", first.cast("int")).where("first > 0")
    entries = entries.withColumn("xs", F.slice("xs", F.col("first"), F.size("xs")))
    return entries.select(
        "book", "entry_no", F.get("xs", F.lit(0))["title"].alias("title"), F.element_at("xs", -1)["author"].alias("author"), F.get("xs", F.lit(0))["page_number"].alias("first_page"),
        F.element_at("xs", -1)["page_number"].alias("last_page"), T.stripped(F.array_join(F.transform("xs", lambda x, i: F.when(i == 0, x["opened"]).otherwise(x["whole"])), "\n")).alias("text"),
    )


#: Pages before this one are front matter in the older rule. Fixed value.
BODY_PAGE = 17


def entry_starts(pages: DataFrame, old: bool = True) -> DataFrame:
    """``book, page_number, at, title``: lines that open an entry, by the older rule or the newer.

    The older rule looks at pages from BODY_PAGE on and at the line after; both are tests
    within a page's row. Re-delivered pages give each line once.
    """
    lines = F.transform(T.split_lines(F.coalesce("text", F.lit(""))), T.stripped)
    title = (lambda x, i: T.old_entry_title(x, F.get(F.col("lines"), i + 1))) if old else (lambda x, i: T.entry_title(x))
    rows = pages.where("book IS NOT NULL" + (f" AND page_number >= {BODY_PAGE}" if old else "")).select("page_id", "book", "page_number", lines.alias("lines"))
    found = rows.select("page_id", "book", "page_number", F.posexplode(F.transform("lines", title)).alias("at", "title")).where("title IS NOT NULL")
    return found.dropDuplicates(["page_id", "at"]).select("book", "page_number", "at", "title")
