"""Page records: one row per page, features, ordered warnings, and layout-based cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexweave.functions import front_matter as FM
from codexweave.functions import text as T
from codexweave.operators import rules as R

LOW_CONFIDENCE = 0.9
#: Short Latin smudges, index heads and photo captions. Fixed values.
SMUDGE = r"^[A-Za-z0-9 .,'-]+$"
INDEX_HEAD = r"^(?:[A-Za-z]{2,20}\s*[\x{4E00}-\x{9FFF}]|[\x{4E00}-\x{9FFF}]\s*[A-Za-z]{2,20}|[A-Z]\s*[a-z]|[a-z]\s*[A-Z]|[A-Z])$"
PHOTO_CAPTION, MARKED_CAPTION, LATIN_NOISE = r"^(?:[△▲]\s*)?\d+\s*\S+", "^[△▲]", r"^[A-Za-z0-9.,'-]{1,32}$"
#: Warnings of a page by cause, in the order they are given. Fixed values.
WARNINGS = ("low_confidence", "no_text", "short_text", "front_page", "dense_index", "diagram", "illustration")


def distinct_pages(pages: DataFrame) -> DataFrame:
    """One row per page_id: any of the re-delivered rows, which differ in ingested_at alone.

    What is derived from a page is best derived first, so that what is shuffled is narrow.
    """
    return known_pages(pages).dropDuplicates(["page_id"])


def known_pages(pages: DataFrame) -> DataFrame:
    return pages.where(F.col("page_id").isNotNull())


#: More partitions than any input has, so that a coalesce to so many moves nothing.
_ALL_PARTITIONS = 1 << 24


def one_row_each(derived: DataFrame, key: str = "page_id") -> DataFrame:
    """One row per key of columns derived from re-delivered rows, which are equal.

    The step between keeps the optimizer from writing the columns' expressions into the
    aggregation, where what they share would be worked out again for each of them.
    """
    return derived.coalesce(_ALL_PARTITIONS).dropDuplicates([key])


def with_features(pages: DataFrame) -> DataFrame:
    """Adds text_chars, n_lines and the shape tests of each page; null text counts as empty."""
    text = F.coalesce("text", F.lit(""))
    page = pages.withColumn("_lines", T.filled_lines(text))
    diagram = T.diagram_like(text, F.col("_lines"))
    return page.select(
        *pages.columns,
        F.length(T.stripped(text)).alias("text_chars"),
        F.size("_lines").alias("n_lines"),
        T.contents_like(text).alias("is_contents"),
        (T.dense_index_lines(F.col("_lines")) & ~diagram).alias("is_dense_index"),
        diagram.alias("is_diagram"),
        (T.illustration_mixed(F.col("_lines")) & ~diagram).alias("is_illustration"),
        F.size(F.filter("_lines", T.is_noise_line)).alias("n_noise_lines"),
        T.front_matter(text, F.col("page_number")).alias("is_front_matter"),
    )


def quality_warnings(featured: DataFrame) -> Column:
    """The causes in WARNINGS that hold for a page with features, in order; none for blank pages."""
    confidence = F.coalesce("confidence", F.lit(0.0))
    tests = (
        confidence < LOW_CONFIDENCE,
        F.col("text_chars") == 0,
        (F.col("text_chars") > 0) & (F.col("text_chars") < 8),
        (F.col("page_number") <= 5) & (F.col("text_chars") > 0) & (F.col("text_chars") < 80),
        F.col("is_dense_index"),
        F.col("is_diagram"),
        F.col("is_illustration"),
    )
    given = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in zip(WARNINGS, tests, strict=True)]))
    return F.when(F.coalesce(F.col("source") == "blank_page", F.lit(False)), F.array().cast("array<string>")).otherwise(given)


def refreshed(old: Column, new: Column, dynamic: Column) -> Column:
    """Old warnings without the dynamic ones that no longer hold, then the new ones, each once."""
    kept = F.filter(F.coalesce(old, F.array().cast("array<string>")), lambda w: ~F.array_contains(dynamic, w) | F.array_contains(new, w))
    return F.array_distinct(F.concat(kept, new))


def needs_review(confidence: Column, text: Column, source: Column) -> Column:
    """Whether a page that is not blank has low confidence or no text."""
    empty = T.stripped(F.coalesce(text, F.lit(""))) == ""
    return ~F.coalesce(source == "blank_page", F.lit(False)) & ((F.coalesce(confidence, F.lit(0.0)) < LOW_CONFIDENCE) | empty)


#: What a warning holds when a page was read again: at all, and without success. Fixed values.
REREAD, REREAD_IN_VAIN = "高分辨率重跑", ("高分辨率重跑未改善", "高分辨率重跑失败", "高分辨率重跑文字明显变少")
ROTATION_CONFIDENCE = 0.72


def already_upgraded(warnings: Column) -> Column:
    """Whether a page was read again at a higher resolution."""
    return F.exists(F.coalesce(warnings, F.array().cast("array<string>")), lambda w: w.contains(REREAD))


def needs_rotation(confidence: Column, warnings: Column) -> Column:
    """Whether a page of low confidence was read again in vain, so that it may stand on its side."""
    vain = F.exists(F.coalesce(warnings, F.array().cast("array<string>")), lambda w: w.rlike("|".join(REREAD_IN_VAIN)))
    return (F.coalesce(confidence, F.lit(0.0)) < ROTATION_CONFIDENCE) & vain


def lost_text(old: Column, new: Column) -> Column:
    """Whether an upgrade lost more than 15 % of a text of 120 characters or more."""
    a, b = F.length(T.stripped(old)), F.length(T.stripped(new))
    return (a >= 120) & (b < a * 0.85)


def better_page(old: Column, new: Column) -> Column:
    """The better of two readings, structs of (confidence, text): see ``best_reading``."""
    before, after = T.stripped(old["text"]), T.stripped(new["text"])
    gain = F.struct(new["confidence"], F.length(after)) > F.struct(old["confidence"], F.length(before))
    take = (after != "") & ((before == "") | (~lost_text(old["text"], new["text"]) & gain))
    return F.when(take, new).otherwise(old)


def best_reading(readings: Column) -> Column:
    """Folds a ladder of readings in order; a veto on lost text makes the order count."""
    return F.aggregate(F.slice(readings, 2, F.greatest(F.size(readings) - 1, F.lit(0))), F.get(readings, F.lit(0)), better_page)


def boxes(blocks: Column) -> Column:
    """Blocks as structs of text, confidence and left, top, right, bottom.

    Boxes come as four corner points or as one row of four numbers; others are left out.
    """

    def box(block: Column) -> Column:
        points = block["bbox"]
        flat = (F.size(points) == 1) & (F.size(F.get(points, F.lit(0))) == 4)
        corner = lambda i: F.get(F.get(points, F.lit(0)), F.lit(i))
        xs, ys = F.transform(points, lambda p: F.get(p, F.lit(0))), F.transform(points, lambda p: F.get(p, F.lit(1)))
        row = lambda i: F.get(F.get(points, F.lit(i)), F.lit(0))
        column = (F.size(points) == 4) & F.forall(points, lambda p: F.size(p) == 1)
        pick = lambda i, other: F.when(flat, corner(i)).when(column, row(i)).otherwise(other)
        return F.struct(
            T.stripped(F.coalesce(block["text"], F.lit(""))).alias("text"),
            F.coalesce(block["confidence"], F.lit(0.0)).alias("confidence"),
            pick(0, F.array_min(xs)).alias("left"),
            pick(1, F.array_min(ys)).alias("top"),
            pick(2, F.array_max(xs)).alias("right"),
            pick(3, F.array_max(ys)).alias("bottom"),
        )

    found = F.filter(F.transform(blocks, box), lambda b: b["left"].isNotNull() & b["bottom"].isNotNull())
    return F.coalesce(found, F.array().cast("array<struct<text:string,confidence:double,left:double,top:double,right:double,bottom:double>>"))


def upper_median(values: Column) -> Column:
    """The middle of sorted values, the upper one of two."""
    ranked = F.array_sort(values)
    return F.get(ranked, F.floor(F.size(ranked) / 2).cast("int"))


def noisy_margin_texts(placed: Column) -> Column:
    """Texts of blocks at a page's top that are smudges taken for letters."""
    bottom = F.array_max(F.transform(placed, lambda b: b["bottom"]))
    median = upper_median(F.filter(F.transform(placed, lambda b: b["bottom"] - b["top"]), lambda h: h > 0))

    def smudge(b: Column) -> Column:
        n = F.length(F.regexp_replace(b["text"], f"{T.BLANKS}+", ""))
        latin = n.between(2, 8) & b["text"].rlike(SMUDGE)
        wide = (b["right"] - b["left"]) / n >= median * F.when(latin, 1.4).otherwise(2.2)
        return (b["confidence"] < 0.65) & (n.between(1, 4) | latin) & (b["top"] <= bottom * 0.12) & (b["bottom"] - b["top"] >= median * 1.35) & wide

    return F.transform(F.filter(placed, lambda b: (b["text"] != "") & smudge(b)), lambda b: b["text"])


def header_texts(placed: Column) -> Column:
    """Texts of blocks at a page's top that are index letters or heads beside a romanisation."""
    bottom = F.array_max(F.transform(placed, lambda b: b["bottom"]))
    median = upper_median(F.filter(F.transform(placed, lambda b: b["bottom"] - b["top"]), lambda h: h > 0))
    def running(b: Column) -> Column:
        height = b["bottom"] - b["top"]
        letter = b["text"].rlike("^[A-Z]$") & (height >= median * 2.5) & (b["top"] <= bottom * 0.2)
        return b["text"].rlike(INDEX_HEAD) & (letter | ((b["top"] <= bottom * 0.12) & (height >= median * 1.3)))

    return F.transform(F.filter(placed, running), lambda b: b["text"])


def plate_noise_texts(placed: Column, lines: Column) -> Column:
    """Texts of unsure Latin fragments on a plate of photographs with numbered, marked captions."""
    captions = F.filter(lines, lambda x: x.rlike(PHOTO_CAPTION))
    marked = F.size(F.filter(captions, lambda x: x.rlike(MARKED_CAPTION)))
    compact = lambda b: F.regexp_replace(b["text"], f"{T.BLANKS}+", "")
    noise = F.filter(placed, lambda b: (b["confidence"] < 0.65) & compact(b).rlike(LATIN_NOISE))
    none = F.array().cast("array<string>")
    return F.when((F.size(captions) >= 3) & (marked >= 1), F.transform(noise, lambda b: b["text"])).otherwise(none)


def printed_number(placed: Column) -> Column:
    """The lowest sure number near a page's outer bottom corners, or null."""
    edge = lambda f, name: f(F.transform(placed, lambda b: b[name]))
    left, top, right, bottom = edge(F.array_min, "left"), edge(F.array_min, "top"), edge(F.array_max, "right"), edge(F.array_max, "bottom")
    width, height = F.greatest(right - left, F.lit(1.0)), F.greatest(bottom - top, F.lit(1.0))

    def numbered(b: Column) -> Column:
        x = ((b["left"] + b["right"]) / 2 - left) / width
        return b["text"].rlike(r"^\d{1,4}$") & (b["confidence"] >= 0.8) & (b["top"] >= bottom - height * 0.06) & ((x <= 0.2) | (x >= 0.8))

    found = F.transform(F.filter(placed, numbered), lambda b: F.struct(b["top"].alias("top"), b["text"].alias("text")))
    return F.array_max(found)["text"]


#: What a preparation step did to a page, in the order of the steps.
NOTES = ("reordered", "captions_marked", "printed_number_removed", "margin_noise_removed", "running_head_removed", "front_noise_removed", "front_matter_corrected", "terms_corrected", "labels_merged", "diagram_noise_removed", "plate_noise_removed")


def in_reading_order(pages: DataFrame) -> DataFrame:
    """``pages`` with the text of their blocks in reading order and ``_reordered``, where two columns are found.

    Only pages with enough blocks pass through Python; the others keep their text.
    """
    from codexweave.operators import layout

    enough = F.coalesce(F.size("blocks") >= layout.MIN_LINES, F.lit(False))
    ordered = pages.where(enough).mapInArrow(layout.reorder(pages.columns), f"{_ddl(pages)}, _reordered boolean")
    return pages.where(~enough).withColumn("_reordered", F.lit(False)).unionByName(ordered)


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)


def prepared(pages: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Pages with cleaned text, printed_page, warnings and ``notes``, by one chain of steps.

    Order: reading order, clean-up, caption marks, printed number, margin smudges, index
    heads, specks and stamps of first pages, front matter, ``rules``, split labels, diagram
    noise, plate noise, warnings. The layout steps need eight placed blocks and a page after
    the tenth. Without a column ``book`` titles count as unknown. ``notes`` tells which steps
    changed the page, in the order of NOTES. Running it again on its result changes nothing
    but blocks' own leftovers.
    """
    book = F.col("book") if "book" in pages.columns else F.lit(None).cast("string")
    step = in_reading_order(pages).withColumn("_placed", boxes(F.col("blocks"))).withColumn("_book", book)
    step = step.withColumn("_clean", T.cleaned_ocr_text(F.coalesce("text", F.lit(""))))
    step = step.withColumn("_marked", T.marked_captions(F.col("_clean")))
    inner = F.col("page_number") > 10
    placed = inner & (F.size("_placed") >= 8)
    number = F.when(inner & (F.size("_placed") > 0), printed_number(F.col("_placed")))
    step = step.withColumn("_number", number)
    once = F.size(F.filter(F.split("_marked", "\n"), lambda x: T.stripped(x) == F.col("_number"))) == 1
    step = step.withColumn("_number", F.when(once, F.col("_number")))
    none = F.array().cast("array<string>")
    step = step.withColumn("_unnumbered", FM.without_lines(F.col("_marked"), F.when(F.col("_number").isNotNull(), F.array("_number")).otherwise(none)))
    step = step.withColumn("_margin", FM.without_lines(F.col("_unnumbered"), F.when(placed, F.coalesce(noisy_margin_texts(F.col("_placed")), none)).otherwise(none)))
    step = step.withColumn("_headless", FM.without_lines(F.col("_margin"), F.when(placed, F.coalesce(header_texts(F.col("_placed")), none)).otherwise(none)))
    front = (F.size("_placed") > 0) & T.front_matter(F.col("_headless"), F.col("page_number"))
    step = step.withColumn("_speckless", FM.without_lines(F.col("_headless"), F.when(front, FM.noise_lines(F.col("_book"), F.col("page_number"), F.col("_placed"))).otherwise(none)))
    step = FM.with_front_matter(step.withColumn("_front", F.col("_speckless")), "_front", "_book")
    if rules is not None:
        ruled = R.apply_rules(step.drop("text").withColumnRenamed("_front", "text"), rules, "_book")
        step = ruled.withColumnRenamed("text", "_ruled").drop("n_changed").withColumn("_front", F.col("_ruled"))
    step = step.withColumn("_text", FM.merged_labels(F.col("_front")))
    lines = T.filled_lines(F.col("_text"))
    chart = F.col("_text").rlike(T.MAP_CAPTION)
    quiet = F.filter(F.split("_text", "\n"), lambda x: ~T.is_noise_line(x) & ~(chart & T.stripped(x).rlike(r"^\d{1,3}$")))
    step = step.withColumn("_plate", plate_noise_texts(F.col("_placed"), lines))
    step = step.withColumn("_quiet", F.when(T.diagram_like(F.col("_text"), lines), T.stripped(F.array_join(quiet, "\n"))).otherwise(F.col("_text")))
    step = step.withColumn("_final", FM.without_lines(F.col("_quiet"), F.col("_plate")))
    changed = lambda a, b: F.col(a) != F.col(b)
    tests = (
        F.col("_reordered"), changed("_clean", "_marked"), F.col("_number").isNotNull(), changed("_unnumbered", "_margin"), changed("_margin", "_headless"), changed("_headless", "_speckless"),
        F.size("front_notes") > 0, F.lit(False) if rules is None else changed("_ruled", "_speckless") & (F.size("front_notes") == 0), changed("_front", "_text"), changed("_text", "_quiet"), changed("_quiet", "_final"),
    )
    notes = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in zip(NOTES, tests, strict=True)]))
    out = step.select(
        *[c for c in pages.columns if c not in ("text", "printed_page", "warnings")],
        F.coalesce("_number", "printed_page").alias("printed_page"),
        F.col("_final").alias("text"),
        notes.alias("notes"),
        F.col("warnings").alias("_old"),
    )
    featured = with_features(out)
    new = quality_warnings(featured)
    dynamic = F.array(*[F.lit(w) for w in WARNINGS])
    return featured.select(*[c for c in out.columns if c != "_old"], refreshed(F.col("_old"), new, dynamic).alias("warnings"))


def mean_confidence(blocks: Column) -> Column:
    """Mean confidence of a page's blocks, rounded to four digits; 0 where there are none."""
    known = F.filter(F.coalesce(blocks, F.array().cast("array<struct<text:string,confidence:double,bbox:array<array<double>>>>")), lambda b: b["confidence"].isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda acc, b: acc + b["confidence"])
    return F.when(F.size(known) > 0, F.round(F.round(total / F.size(known), 9), 4)).otherwise(0.0)


def area_share(placed: Column) -> Column:
    """Share of the area around a page's boxes that they cover, at most 1; overlaps count twice, 0 without boxes."""
    edge = lambda f, name: f(F.transform(placed, lambda b: b[name]))
    width, height = edge(F.array_max, "right") - edge(F.array_min, "left"), edge(F.array_max, "bottom") - edge(F.array_min, "top")
    area = F.aggregate(placed, F.lit(0.0), lambda acc, b: acc + F.greatest(b["right"] - b["left"], F.lit(0.0)) * F.greatest(b["bottom"] - b["top"], F.lit(0.0)))
    return F.when(F.size(placed) > 0, F.round(F.least(F.lit(1.0), area / F.greatest(width * height, F.lit(1.0))), 4)).otherwise(0.0)
