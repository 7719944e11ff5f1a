"""Column functions on page text: lines, clean-up, shape tests, damage score. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, spelled out so that Java and RE2 agree. Fixed values.
BLANKS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: What ends a line. Fixed values.
LINE_END = r"\r\n|[\n\r\x{0B}\x{0C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"
#: Patterns of a table of contents; two kinds make one. Fixed values.
CONTENTS = (r"(?i)\bcontents\b", r"(?i)\btable\s+of\s+contents\b", r"(?i)\bchapter\b", r"\d+\s*[.．]\s*\S+", r"第\s*[一二三四五六七八九十百千万\d]+\s*[章节篇卷部]", r"目\s*录")
#: Leaders before a page number; three make a table of contents. Fixed value.
LEADERS = r"\S\s*[.·．。]{2,}\s*\d+"
#: Words that mark a diagram and the ends of its captions. Fixed values.
DIAGRAM_WORDS = ("箭头", "技术路线", "示意图", "流程图", "模式图", "灵敏度")
CAPTION_END = r"(?:发育图|结构图|组织图|示意图|流程图|模式图|分布图|地图)$"
MAP_CAPTION = r"图\s*\d+[^\n]*(示意图|分布图|地图)"
#: Glyphs that diagrams leave behind as lines of their own. Fixed value.
NOISE_GLYPHS = "0123456789OoCc口囗Ω○。"
#: Marks of front matter: labels read one character a line, and imprint words. Fixed values.
SPLIT_LABELS = ("\n前\n言\n", "\n凡\n例\n", "\n目\n录\n", "\n委\n员", "\n主\n任", "\n编\n辑", "\n印\n制")
IMPRINT_WORDS = ("ISBN", "定价", "出版", "发行", "印刷", "开本", "第1版", "第1次")


def stripped(text: Column) -> Column:
    """``text`` without white space at either end."""
    return F.regexp_replace(text, f"^{BLANKS}+|{BLANKS}+$", "")


def split_lines(text: Column) -> Column:
    return F.split(text, LINE_END)


def filled_lines(text: Column) -> Column:
    """The stripped lines that are not empty; an empty array for null."""
    lines = F.filter(F.transform(split_lines(text), stripped), lambda line: line != "")
    return F.coalesce(lines, F.array().cast("array<string>"))


def share(lines: Column, test) -> Column:
    """Share of ``lines`` that pass ``test``; 0 where there are none."""
    n = F.size(lines)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.size(F.filter(lines, test)) / n)


def cleaned_layer_text(text: Column) -> Column:
    """Text of a PDF's own layer: no NUL, each line and the whole stripped."""
    lines = F.transform(split_lines(F.replace(text, F.lit("\0"), F.lit(""))), stripped)
    return stripped(F.array_join(lines, "\n"))


def cleaned_ocr_text(text: Column) -> Column:
    """Recognised text: blanks collapsed, none between ideographs, no empty lines, broken Latin words joined."""

    def line(raw: Column) -> Column:
        one = stripped(F.regexp_replace(raw, f"{BLANKS}+", " "))
        return F.regexp_replace(one, r"(?<=[\x{4E00}-\x{9FFF}]) +(?=[\x{4E00}-\x{9FFF}])", "")

    lines = F.filter(F.transform(split_lines(F.replace(text, F.lit("\0"), F.lit(""))), line), lambda x: x != "")
    joined = F.regexp_replace(F.array_join(lines, "\n"), r"(?<=[A-Za-z])-\n(?=[a-z])", "")
    return stripped(F.replace(F.replace(joined, F.lit("0CR"), F.lit("OCR")), F.lit("ＯＣＲ"), F.lit("OCR")))


def marked_captions(text: Column) -> Column:
    """Caption numbers led by a misread triangle get the triangle back."""
    return F.regexp_replace(text, r"(?m)^[∇▽▼>√D](?=\s*\d{1,3}(?:\s*[\x{4E00}-\x{9FFF}]|$))", "△")


def garble_score(text: Column) -> Column:
    """How damaged a text layer is, 0 to 1; null for null, 0 for empty text.

    Weighted counts of character-id tokens, boxes, private-use and control characters, a
    penalty for too few letters and digits, and runs of nine or more equal characters.
    """
    total = F.length(text)
    signs = F.regexp_count(text, F.lit(r"\(cid:\d+\)")) * 5 + F.regexp_count(text, F.lit("[�□▯■]")) * 3
    signs = signs + F.regexp_count(text, F.lit(r"[\p{C}&&[^\n\r\t]]")) * 2
    shown = total - F.regexp_count(text, F.lit(BLANKS))
    meant = F.regexp_count(text, F.lit(r"[\p{L}\p{Nd}²³¹⁰⁴-⁹₀-₉①-⑨⑴-⑼⒈-⒐⓪⓵-⓽⓿❶-❾➀-➈➊-➒፩-፱]"))
    poor = F.when(shown > 0, F.greatest(F.lit(0.0), F.floor((F.lit(0.35) - meant / shown) * total))).otherwise(0.0)
    runs = F.aggregate(F.regexp_extract_all(text, F.lit(r"((.)\2{8,})"), F.lit(1)), F.lit(0), lambda n, run: n + F.length(run))
    score = F.least(F.lit(1.0), (signs + poor + runs) / F.greatest(total, F.lit(1)))
    return F.when(total == 0, F.lit(0.0)).when(total > 0, score)


def contents_like(text: Column) -> Column:
    """Whether a text reads like a table of contents."""
    compact = F.regexp_replace(text, f"{BLANKS}+", "")
    kinds = sum((F.when(text.rlike(p) | compact.rlike(p), 1).otherwise(0) for p in CONTENTS), F.lit(0))
    return (compact != "") & ((kinds >= 2) | (F.regexp_count(text, F.lit(LEADERS)) >= 3))


def dense_index_lines(lines: Column) -> Column:
    """Whether lines are those of an index or contents page: numbers at their ends, leaders."""
    tails = share(lines, lambda x: x.rlike(r"\d+\s*$"))
    leaders = share(lines, lambda x: x.contains("…") | x.rlike(r"\.{3,}"))
    return (F.size(lines) >= 20) & (tails >= 0.35) & ((leaders >= 0.2) | (F.size(lines) >= 50))


def is_noise_line(line: Column) -> Column:
    """One glyph that diagrams leave behind, or up to eight of the same."""
    compact = F.regexp_replace(line, f"{BLANKS}+", "")
    same = F.length(F.replace(compact, F.substring(compact, 1, 1), F.lit(""))) == 0
    return compact.rlike(f"^[{NOISE_GLYPHS}]{{1,8}}$") & same


def diagram_like(text: Column, lines: Column) -> Column:
    """Whether a page is mostly a diagram or a map by its line lengths and labels."""
    short, long = share(lines, lambda x: F.length(x) <= 8), share(lines, lambda x: F.length(x) >= 25)
    captions = F.regexp_count(text, F.lit(r"图\s*\d+"))
    noise = F.size(F.filter(lines, is_noise_line))
    words = F.lit(False)
    for word in DIAGRAM_WORDS:
        words = words | text.contains(word)
    scale = F.size(F.filter(lines, lambda x: x.rlike(r"^\d{1,3}$")))
    whole = (short >= 0.55) & (long <= 0.35) & (words | (captions >= 2) | (noise >= 4))
    mixed = (captions >= 2) & (noise >= 4) & (short >= 0.15) & (long <= 0.45)
    chart = text.rlike(MAP_CAPTION) & (scale >= 3)
    return (F.size(lines) >= 20) & ~dense_index_lines(lines) & (whole | mixed | chart)


def illustration_mixed(lines: Column) -> Column:
    """Whether running text stands beside an illustration's labels."""
    captions = F.size(F.filter(lines, lambda x: x.rlike(CAPTION_END)))
    noise = F.size(F.filter(lines, is_noise_line))
    short, long = share(lines, lambda x: F.length(x) <= 8), share(lines, lambda x: F.length(x) >= 25)
    return (F.size(lines) >= 20) & ~dense_index_lines(lines) & (captions >= 1) & (noise >= 4) & (short >= 0.35) & (long <= 0.45)


def front_matter(text: Column, page_number: Column) -> Column:
    """Whether an early page looks like front matter."""
    bare = stripped(text)
    bordered = F.concat(F.lit("\n"), bare, F.lit("\n"))
    labels, words = F.lit(False), F.lit(False)
    for label in SPLIT_LABELS:
        labels = labels | bordered.contains(label)
    for word in IMPRINT_WORDS:
        words = words | text.contains(word)
    return F.when(page_number > 20, False).when(labels, True).when(page_number > 10, False).when(F.length(bare) < 120, True).otherwise(words)


def duration_text(seconds: Column) -> Column:
    """Seconds as hours, minutes and seconds in words, 未知 for null; negatives count as 0."""
    s = F.greatest(F.bround(seconds), F.lit(0)).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60))
    minutes = F.when(m > 0, F.format_string("%d分%d秒", m, r)).otherwise(F.format_string("%d秒", r))
    return F.when(seconds.isNull(), F.lit("未知")).when(h > 0, F.format_string("%d小时%d分%d秒", h, m, r)).otherwise(minutes)


def safe_name(name: Column) -> Column:
    """A file name of letters, digits, dots and hyphens; other runs become one hyphen."""
    bare = F.regexp_replace(F.regexp_replace(name, r"(?U)[^\w\x{4E00}-\x{9FFF}.-]+", "-"), "^-+|-+$", "")
    return F.when(bare == "", F.lit("未命名书籍")).otherwise(bare)


def base_name(path: Column) -> Column:
    """The last part of a path written either way."""
    return F.element_at(F.split(path, r"[/\\]"), -1)


#: Signs a file name cannot hold, and how long a title may be as one. Fixed values.
FORBIDDEN, TITLE_CHARS = r'[\\/:*?"<>|]', 80
#: Folder and ending of a book's result. Fixed values.
RESULT_ENDING = "-rescue-result"


def title_file_name(title: Column) -> Column:
    """A title as a file name: forbidden signs become underscores, blanks one space, at most 80 characters."""
    return F.substring(stripped(F.regexp_replace(F.regexp_replace(title, FORBIDDEN, "_"), f"{BLANKS}+", " ")), 1, TITLE_CHARS)


def plain_component(value: Column, fallback: str) -> Column:
    """A path component of ASCII letters, digits, dots, hyphens and underscores, or the fallback."""
    bare = F.regexp_replace(F.regexp_replace(value, r"[^A-Za-z0-9._-]+", "-"), r"^[.-]+|[.-]+$", "")
    return F.coalesce(F.when(bare != "", bare), F.lit(fallback))


def stem(path: Column) -> Column:
    """The last part of a path without its last suffix."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def result_folder(path: Column, root: str, output: str) -> Column:
    """The folder of a book's result, at the same place below ``output`` as the book below ``root``."""
    parent = F.regexp_extract(path, r"^(.*)[/\\][^/\\]*$", 1)
    below = F.when(parent.startswith(root), F.regexp_replace(F.substring(parent, len(root) + 1, 1_000_000), "^/+", "")).otherwise("")
    return F.concat_ws("/", F.lit(output.rstrip("/")), F.when(below != "", below), F.concat(safe_name(stem(path)), F.lit(RESULT_ENDING)))


#: Words of modes and the resolution they ask for, in order. Fixed values.
RESOLUTIONS = ((("fast",), 180), (("quality", "forensic", "archival"), 300))
OTHER_RESOLUTION = 220


def resolution(mode: Column) -> Column:
    """Dots per inch a mode asks for; null for null."""
    plain = F.replace(F.lower(mode), F.lit("_"), F.lit("-"))
    out = F.lit(OTHER_RESOLUTION)
    for words, dpi in reversed(RESOLUTIONS):
        test = F.lit(False)
        for word in words:
            test = test | plain.contains(word)
        out = F.when(test, dpi).otherwise(out)
    return F.when(mode.isNotNull(), out)


def trimmed_body(text: Column) -> Column:
    """An entry's text: line ends trimmed, runs of empty lines made one, none at either end."""
    lines = F.array_join(F.transform(split_lines(text), lambda x: F.regexp_replace(x, f"{BLANKS}+$", "")), "\n")
    return F.regexp_replace(F.regexp_replace(lines, "\n{3,}", "\n\n"), "^\n+|\n+$", "")


#: Words of front matter that no entry's title of under 20 characters holds. Fixed values.
FRONT_WORDS = ("中国农业百科全书", "编辑出版领导小组", "总编辑委员会", "编辑委员会", "编写组主编", "前言", "凡例", "目录", "索引", "笔画索引", "外文索引", "内容索引", "条目分类目录")
TITLE_SIGNS = "，。、；：？！《》…—（）【】\""
#: A title with its foreign form, and titles, exclusions and foreign lines of the older rule. Fixed values.
ENTRY_LINE = r"^([\x{4E00}-\x{9FFF}][\x{4E00}-\x{9FFF}\w\s]{1,30}?)(?:\(([a-zA-Z][a-zA-Z\s\.,;_\-]+)\))?\s*$"
OLD_ENTRY_LINE = r"^([\x{4E00}-\x{9FFF}][\x{4E00}-\x{9FFF}A-Za-z0-9·（）()]{1,15})\s*$"
OLD_EXCLUDED = r"^(?:\d+$|第[一二三四五六七八九十百千]+[章节部卷编]|前言|目录|附录|索引|凡例|版权|书名|彩图)"


def entry_title(line: Column) -> Column:
    """The title a line gives an entry, or null: short, no punctuation around, no number, no front matter."""
    bare = stripped(line)
    front = F.lit(False)
    for word in FRONT_WORDS:
        front = front | bare.contains(word)
    signs = f"[{TITLE_SIGNS}]"
    fit = F.length(bare).between(1, 40) & ~bare.rlike(f"^(?:{signs}|·)") & ~bare.rlike(f"{signs}$") & ~bare.rlike(r"^[\d\s·\-.]+$") & ~bare.rlike("[，。、；：？！]{2,}") & ~(front & (F.length(bare) < 20))
    title = stripped(F.regexp_extract(bare, f"(?U){ENTRY_LINE}", 1))
    return F.when(fit & (F.length(title) >= 2), title)


def old_entry_title(line: Column, after: Column) -> Column:
    """The title by the older rule, or null: a compact line that is short or has a foreign one after it."""
    bare = stripped(line)
    title = F.regexp_extract(bare, OLD_ENTRY_LINE, 1)
    foreign = F.coalesce(stripped(after).rlike("^[A-Za-z]"), F.lit(False))
    return F.when((title != "") & ~bare.rlike(OLD_EXCLUDED) & (foreign | F.length(title).between(2, 8)), title)
