"""Repair of a book's first pages: volume titles, labels read one character a line, imprint slips, stamps.

All are column expressions of one row; ``book`` is the book's title, lines are separated by line feeds.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codexweave.functions import text as T

#: Series whose name stands before a volume's title, and how it is misread. Fixed values.
SERIES = "中国农业百科全书"
SERIES_MISREAD = ("中国农业科全书", "中国农业百全书", "中国农业百科书", "中国农业百科金书")
#: Signs around a volume's title, and dashes before its last part. Fixed values.
TITLE_ENDS, DASHES, FASCICLE = " -_：:", ("-", "－", "—", "–"), "分册"
#: Slips on imprint pages, wrong before right; the first only beside the right year and an imprint word. Fixed values.
YEAR_SLIP, YEAR, YEAR_WORDS = "1093年", "1993年", ("第1版", "印刷", "ISBN")
IMPRINT_SLIPS = (("16月开本", "16 开本"), ("第1法印到", "第1次印刷"), ("第1次印到", "第1次印刷"))
#: Labels read over two lines: first line, and how the second goes on ('$' where it is all of it). Fixed values.
SPLIT = (("前", "言$"), ("凡", "例$"), ("目", "录$"), ("委", "员"), ("主", "任"), ("秘", "书"), ("总", "主编"), ("编", "辑"), ("印", "制"))
#: What is told when a page is changed. Fixed values.
SERIES_NOTE, VOLUME_NOTE, REPEATED_NOTE, LABEL_NOTE, IMPRINT_NOTE = (
    "已按书名信息校正前置页常见OCR错字", "已按书名信息补正前置页卷册标题", "已合并重复卷册标题", "已合并前置页分裂标题或职务标签", "已校正版权页常见OCR错字",
)
#: Library stamps. Fixed values.
STAMPS = ("图书", "藏书")

_H = r"[\s&&[^\n]]*"
_NONE = "array<string>"


def _trimmed(text: Column, signs: str) -> Column:
    inner = "".join("\\" + c if c in "-[]^\\" else c for c in signs)
    return F.regexp_replace(text, f"^[{inner}]+|[{inner}]+$", "")


def _filled(text: Column) -> Column:
    return F.when(text != "", text)


def volume_title(book: Column) -> Column:
    """What stands after a title's last colon (the wide one first), else after the series' name; else null."""
    wide, plain = (T.stripped(F.substring_index(book, colon, -1)) for colon in ("：", ":"))
    rest = _trimmed(F.substring(book, len(SERIES) + 1, 1_000_000), TITLE_ENDS)
    return F.when(book.contains("："), _filled(wide)).when(book.contains(":"), _filled(plain)).when(book.startswith(SERIES), _filled(rest))


def volume_titles(book: Column) -> Column:
    """The volume's title and its last part after each kind of dash and after the fascicle, each once."""
    title = volume_title(book)
    parts = [F.when(title.contains(d), _filled(T.stripped(F.substring_index(title, d, -1)))) for d in DASHES]
    last = F.when(title.contains(FASCICLE), _filled(_trimmed(F.substring_index(title, FASCICLE, -1), TITLE_ENDS + "－—–")))
    return F.array_distinct(F.array_compact(F.array(title, *parts, last)))


def titled(text: Column, titles: Column) -> Column:
    """``text`` with volumes' titles put together, one after another, that were read in parts.

    A text that has a title is left as it is. Characters of the title that stand alone on
    lines become the title where the first stood, if they are all there. Two lines that make
    up the title, or all but its last 卷, become one; in titles of up to four characters a
    line of one or two of them becomes the title. The lines are folded once for each title;
    the state is what has been put out and the line to come.
    """
    none = F.array().cast(_NONE)

    def bare(lines: Column) -> Column:
        return F.transform(lines, T.stripped)

    def gathered(lines: Column, title: Column) -> Column:
        """The lines with single characters of the title made the title, where that is possible."""
        alone = lambda x: (F.length(x) == 1) & title.contains(x)
        first = F.array_position(F.transform(bare(lines), alone), True) - 1
        return F.transform(F.filter(lines, lambda x, i: ~alone(T.stripped(x)) | (i == first)), lambda x: F.when(alone(T.stripped(x)), title).otherwise(x))

    def folded(lines: Column, title: Column, whole: Column) -> Column:
        """``lines`` with the pairs and parts of the title made the title."""

        def step(acc: Column, line: Column) -> Column:
            before, now = T.stripped(acc["held"]), T.stripped(line)
            pair = acc["open"] & (now != "") & ((F.concat(before, now) == title) | (F.concat(before, now, F.lit("卷")) == title))
            part = ~whole & F.length(before).between(1, 2) & title.contains(before) & (F.length(title) <= 4)
            put = F.when(pair | part, title).otherwise(acc["held"])
            return F.struct(F.when(acc["open"], F.concat(acc["out"], F.array(put))).otherwise(acc["out"]).alias("out"), line.alias("held"), (~pair).alias("open"))

        start = F.struct(none.alias("out"), F.lit("").alias("held"), F.lit(False).alias("open"))
        return F.slice(F.aggregate(F.concat(lines, F.array(F.lit(""))), start, step, lambda acc: acc["out"]), 1, F.size(lines))

    def one(acc: Column, title: Column) -> Column:
        lines = acc["lines"]
        has = F.exists(lines, lambda x: x.contains(title))
        held = F.filter(bare(lines), lambda x: (F.length(x) == 1) & title.contains(x))
        whole = F.length(title).between(2, 6) & (F.size(F.array_except(F.split(title, ""), held)) == 0)
        start = F.struct(F.when(whole, gathered(lines, title)).otherwise(lines).alias("lines"), whole.alias("whole"))
        made = F.transform(F.array(start), lambda s: folded(s["lines"], title, s["whole"]))
        return F.struct(F.when(has, lines).otherwise(F.get(made, F.lit(0))).alias("lines"))

    done = F.aggregate(titles, F.struct(T.split_lines(text).alias("lines")), one, lambda acc: F.array_join(acc["lines"], "\n"))
    return F.when(F.coalesce(F.size(titles), F.lit(0)) > 0, F.when(F.exists(titles, lambda t: ~text.contains(t)), done).otherwise(text)).otherwise(text)


def without_repeated_titles(text: Column, titles: Column) -> Column:
    """``text`` with only the first of the lines that are one of the titles, each."""
    lines = T.split_lines(text)
    bare = F.transform(lines, T.stripped)
    kept = F.filter(lines, lambda x, i: ~F.array_contains(titles, F.get(bare, i)) | (F.array_position(bare, F.get(bare, i)) == i + 1))
    return F.when(F.size(titles) > 0, F.array_join(kept, "\n")).otherwise(text)


def merged_labels(text: Column) -> Column:
    """``text`` with labels that were read over two lines on one, whatever the page."""
    unified = F.array_join(T.split_lines(text), "\n")
    heads = "|".join(f"({head}){_H}\\n{_H}(?={tail.replace('$', _H + '$')})" for head, tail in SPLIT)
    joined = F.regexp_replace(unified, f"(?m)^{_H}(?:{heads})", "".join(f"${i}" for i in range(1, len(SPLIT) + 1)))
    return F.regexp_replace(joined, rf"(?m)^{_H}委{_H}$(?=\n{_H}\()", "委员")


def noise_lines(book: Column, page_number: Column, placed: Column) -> Column:
    """Texts of blocks on a first page that are specks, call numbers, stamps or accession numbers.

    ``placed`` are structs with text and confidence. A text within the volume's title is kept.
    """
    title = F.coalesce(volume_title(book), F.lit(""))

    def noise(b: Column) -> Column:
        line, n = b["text"], F.length(b["text"])
        speck = (F.coalesce(b["confidence"], F.lit(0.0)) < 0.55) & ((n <= 2) | line.rlike(r"^[^\x{4E00}-\x{9FFF}A-Za-z0-9]{1,3}$"))
        call = (page_number <= 3) & (n <= 16) & line.rlike(r"[A-Za-z0-9]") & line.rlike(r"^[+A-Za-z0-9./:-]+$") & ~F.upper(line).startswith("ISBN")
        stamp = (page_number <= 3) & (line.isin(*STAMPS) | ((n <= 8) & line.contains("图书馆")))
        accession = (page_number <= 2) & line.rlike(r"^\d{3,8}$")
        plain = (line != "") & ~line.contains("\n") & ~((title != "") & title.contains(line))
        return plain & (speck | call | stamp | accession)

    return F.transform(F.filter(placed, noise), lambda b: b["text"])


def without_lines(text: Column, drop: Column) -> Column:
    """``text`` without the lines that are in ``drop`` but for blanks around them; unchanged where that is empty."""
    kept = F.filter(T.split_lines(text), lambda x: ~F.array_contains(drop, T.stripped(x)))
    return F.when(F.size(drop) > 0, T.stripped(F.array_join(kept, "\n"))).otherwise(text)


def with_front_matter(pages, text: str = "text", book: str = "book", page_number: str = "page_number"):
    """``pages`` with front-matter pages' text repaired and ``front_notes``: what was changed, in order.

    The series' name, the volume's titles, repeated titles, split labels and imprint slips, one
    step after another. Other pages keep their text and have no notes; so have null and empty
    texts.
    """
    step = pages.withColumn("_source", F.coalesce(F.col(text), F.lit("")))
    step = step.withColumn("_gate", F.coalesce((F.col("_source") != "") & T.front_matter(F.col("_source"), F.col(page_number)), F.lit(False)))
    step = step.withColumn("_titles", F.when(F.col("_gate"), volume_titles(F.col(book))))
    series = F.regexp_replace("_source", "|".join(SERIES_MISREAD), SERIES)
    step = step.withColumn("_series", F.when(F.col("_gate") & F.coalesce(F.col(book).contains(SERIES), F.lit(False)), series).otherwise(F.col("_source")))
    context = F.col("_gate") & ((F.col(page_number) <= 4) | F.col("_series").contains(SERIES)) & F.coalesce(F.size("_titles") > 0, F.lit(False))
    step = step.withColumn("_titled", F.when(context, titled(F.col("_series"), F.col("_titles"))).otherwise(F.col("_series")))
    step = step.withColumn("_single", F.when(context, without_repeated_titles(F.col("_titled"), F.col("_titles"))).otherwise(F.col("_titled")))
    step = step.withColumn("_labels", F.when(F.col("_gate"), merged_labels(F.col("_single"))).otherwise(F.col("_single")))
    year = F.when(F.col("_labels").contains(YEAR) & F.col("_labels").rlike("|".join(YEAR_WORDS)), F.replace(F.col("_labels"), F.lit(YEAR_SLIP), F.lit(YEAR))).otherwise(F.col("_labels"))
    for wrong, right in IMPRINT_SLIPS:
        year = F.replace(year, F.lit(wrong), F.lit(right))
    step = step.withColumn("_imprint", F.when(F.col("_gate"), year).otherwise(F.col("_labels")))
    pairs = (("_source", "_series", SERIES_NOTE), ("_series", "_titled", VOLUME_NOTE), ("_titled", "_single", REPEATED_NOTE), ("_single", "_labels", LABEL_NOTE), ("_labels", "_imprint", IMPRINT_NOTE))
    notes = F.array_compact(F.array(*[F.when(F.col(a) != F.col(b), F.lit(note)) for a, b, note in pairs]))
    others = [c for c in pages.columns if c != text]
    return step.select(*others, F.when(F.col("_gate"), F.col("_imprint")).otherwise(F.col(text)).alias(text), notes.alias("front_notes"))
