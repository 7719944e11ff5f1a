"""Problem 6: cut items over their size limit into overlapping pieces at natural boundaries.

Everything is one regular expression per limit, evaluated in the JVM: ordered alternatives
with bounded quantifiers consume as much as fits and end at the strongest boundary in reach
(paragraph, line, sentence, clause, blank), else after any character. Each match is one
piece's own part; the overlap is read back from the stored text by offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexweave.llm.common import job_value

#: What may stand before a cut, strongest first. Fixed values.
BOUNDARIES = (
    r"(?<=\n\n|\r\n\r\n|\n　　)",
    r"(?<=[。！？!?…][”’」』）)\"']{0,2}\n)",
    r"(?<=\n)(?!\n)",
    r"(?<=[。！？…][”’」』）)]{0,2})(?![”’」』）)。！？…])",
    r"(?<=[.!?][”’)\"']{0,2}\s)",
    r"(?<=[，；：、,;:—]\s?)(?!\s)",
    r"(?<=\s)(?=\S)",
)
#: A boundary weaker than the last one counts once this share of the room is used.
FILL_PERCENT = 50
#: Distinct limits that are handled; each has an expression of its own.
MAX_LIMITS = 200
#: Never parted from what stands before it: combining marks, joiners, variation selectors.
WHOLE = r"(?![\p{M}\x{200D}\x{FE0E}\x{FE0F}]|(?<=\r)\n)(?<!\x{200D})"


def item_limits(kind: str, items: DataFrame, item_id: Column, job_status: DataFrame, split_limits: DataFrame) -> DataFrame:
    """``item_kind, item_id, text, max_chars, overlap_chars`` of the items with a limit.

    The limit is that of the item's kind and its job's non-null mode; items of jobs without
    a mode, of modes without a limit, or with a null id have none and are left out. The
    limits are joined to the jobs first, so an item row meets one narrow table only.
    """
    limits = (
        split_limits.where((F.col("item_kind") == kind) & (F.col("max_chars") > 0))
        .groupBy("mode")
        .agg(F.min(F.struct("max_chars", F.coalesce("overlap_chars", F.lit(0)).alias("overlap_chars"))).alias("limit"))
        .select("mode", "limit.max_chars", "limit.overlap_chars")
    )
    jobs = job_value(job_status, "mode").join(F.broadcast(limits), "mode").select("job_key", "max_chars", "overlap_chars")
    rows = items.select("job_key", item_id.alias("item_id"), "text").where(F.col("item_id").isNotNull())
    return rows.join(jobs, "job_key").select(F.lit(kind).alias("item_kind"), "item_id", "text", "max_chars", "overlap_chars")


def all_items(pages: DataFrame, chunks: DataFrame, job_status: DataFrame, split_limits: DataFrame) -> DataFrame:
    """Pages and chunks with their limits (see ``item_limits``); page ids as strings."""
    return item_limits("page", pages, F.col("page_id").cast("string"), job_status, split_limits).unionByName(
        item_limits("chunk", chunks, F.col("chunk_id"), job_status, split_limits)
    )


def piece_pattern(room: int) -> str:
    """The alternatives for parts of at most ``room`` characters, strongest boundary first."""
    room = max(1, room)
    least = max(1, room * FILL_PERCENT // 100)
    any_char = r"[\s\S]"
    ranked = [f"{any_char}{{{least},{room}}}{b}" for b in BOUNDARIES]
    return "|".join([rf"{any_char}{{1,{room}}}\z", *ranked, f"{any_char}{{1,{room}}}{WHOLE}", f"{any_char}{{1,{room}}}"])


def own_parts(items: DataFrame, limits: list[tuple[int, int]]) -> DataFrame:
    """``items`` with ``overlap`` and ``parts``: the matches of the limit's expression, which joined are the text.

    An item within its limit is one part; null and empty texts are left out.
    """
    pattern = F.lit(None).cast("string")
    overlap = F.least(F.greatest(F.col("overlap_chars"), F.lit(0)), F.col("max_chars") - 1)
    for most, shared in sorted(set(limits)):
        same = (F.col("max_chars") == most) & (F.col("overlap_chars") == shared)
        pattern = F.when(same, F.lit(piece_pattern(most - min(max(shared, 0), most - 1)))).otherwise(pattern)
    parts = F.when(F.length("text") <= F.col("max_chars"), F.array("text")).otherwise(F.regexp_extract_all("text", pattern, F.lit(0)))
    return items.where(F.length("text") > 0).withColumn("overlap", overlap).withColumn("parts", parts)


def pieces(items: DataFrame, limits: list[tuple[int, int]]) -> DataFrame:
    """``item_kind, item_id, piece_no, start_at, text``: each item as pieces within its limit.

    ``items`` as from ``all_items``; ``limits`` are the distinct (max_chars, overlap_chars).
    A piece after the first begins with the last ``overlap_chars`` characters of what comes
    before, which count towards the limit; an overlap that leaves no room is cut to
    ``max_chars - 1``. Without their overlaps the pieces joined are the text. Items within
    their limit come out as one piece, null and empty texts as none. piece_no counts from 1,
    start_at is the piece's offset in code points from 0.

    A piece is made of its own part and the end of the parts before it, never of the whole
    text, so the characters handled grow with the item's size and no faster.
    """
    cut = own_parts(items, limits)
    lengths = F.transform("parts", lambda part: F.length(part))
    ends = F.aggregate("lengths", F.array(F.lit(0)), lambda acc, n: F.array_append(acc, F.element_at(acc, -1) + n))
    cut = cut.select("item_kind", "item_id", "overlap", "parts", lengths.alias("lengths")).withColumn("ends", ends)

    def before(i: Column) -> Column:
        """The characters before part ``i`` that it shares: mostly the end of one part, else of several short ones."""
        near = F.right(F.get("parts", i - 1), F.col("overlap"))
        first = F.greatest(i - F.col("overlap"), F.lit(0))
        far = F.right(F.array_join(F.slice("parts", first + 1, i - first), ""), F.col("overlap"))
        return F.when((i == 0) | (F.col("overlap") <= 0), "").when(F.get("lengths", i - 1) >= F.col("overlap"), near).otherwise(far)

    texts = F.transform("parts", lambda part, i: F.struct(F.concat(before(i), part).alias("text"), F.get("ends", i).alias("begin")))
    told = cut.select("item_kind", "item_id", "overlap", F.posexplode(texts).alias("at", "piece"))
    start = F.when(F.col("at") == 0, 0).otherwise(F.greatest(F.col("piece.begin") - F.col("overlap"), F.lit(0)))
    return told.select("item_kind", "item_id", (F.col("at") + 1).alias("piece_no"), start.cast("int").alias("start_at"), F.col("piece.text").alias("text"))


def known_limits(split_limits: DataFrame) -> list[tuple[int, int]]:
    """The distinct (max_chars, overlap_chars), for each of which there is an expression."""
    rules = split_limits.where("max_chars > 0").select("max_chars", F.coalesce("overlap_chars", F.lit(0)).alias("overlap_chars")).distinct()
    rows = rules.limit(MAX_LIMITS + 1).collect()
    if len(rows) > MAX_LIMITS:
        raise ValueError(f"more than {MAX_LIMITS} limits")
    return [tuple(r) for r in rows]


def oversized(pages: DataFrame, chunks: DataFrame, job_status: DataFrame, split_limits: DataFrame) -> DataFrame:
    """``item_kind, item_id`` of items whose text has more code points than their limit.

    They are those that the splitter cuts into more than one part; the length is checked
    beside it. Text counts as stored; null text is never too long; repeated rows give one row.
    """
    cut = own_parts(all_items(pages, chunks, job_status, split_limits), known_limits(split_limits))
    long = (F.size("parts") > 1) & (F.length("text") > F.col("max_chars"))
    return cut.where(long).select("item_kind", "item_id").distinct()


def split_items(pages: DataFrame, chunks: DataFrame, job_status: DataFrame, split_limits: DataFrame) -> DataFrame:
    """The pieces of every page and chunk that has a limit; one set per distinct item row."""
    items = all_items(pages, chunks, job_status, split_limits).distinct()
    return pieces(items, known_limits(split_limits))
