"""Problem 9: text statistics of each document, and whether it is prose, list, table or junk.

Each line becomes a distribution: half of it over classes of its characters (function words,
common and rare letters, digits, punctuation, symbols, blanks), half over forms of lines (what
its columns, bullets, leaders, references or unreadable characters make it look like, in the
company of the lines around it). It is put to the nearest of the structural profiles - prose
of each language, lists, tables, junk - by Jensen-Shannon divergence, and a document is of the
kind that has more than half of its characters. The profiles are fitted on all documents:
averages over the lines that have a form, with typed-in priors for kinds that the corpus has
few of. How common each character is comes from counting the whole corpus first (one row per
code point, so bounded). Texts are described once: what the profiles are fitted on and what is
put to them afterwards is kept in an intermediate table of counts.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexweave.llm.leakage import gram_hashes, span_hashes
from codexweave.sources.tables import materialised

#: Function words by language. Fixed values.
FUNCTION_WORDS = {
    "en": "the of and a to in is was it for on with as by at from that this which be are not or an his her its but had has have were their they he she who one all there been if more when will would so no out up into them then than some only".split(),
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat daß dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la ou avec son ses sa aux d l n qu s c si mais comme elle fut cette ces leur à y on était".split(),
}
FUNCTION_CHARS = frozenset("的了在是和与把被从又再先为以这那之其也不有于而所就都只个一上下中里后前到来去他她它们我你并很或及若则至向对于着过")
_WORDS = {word: lang for lang, words in FUNCTION_WORDS.items() for word in words}
#: Classes of characters and forms of lines, over which a line is distributed.
CLASSES = ("function", "common", "rare", "digit", "punctuation", "symbol", "blank")
FORMS = ("prose", "list", "table", "junk", "plain")
#: Prior shares of CLASSES in each profile, and the form its lines have. Fixed values.
PROFILES = {
    "prose-zh": ((0.16, 0.68, 0.01, 0.05, 0.09, 0.00, 0.01), "prose"),
    "prose-en": ((0.24, 0.54, 0.00, 0.02, 0.03, 0.00, 0.17), "prose"),
    "prose-de": ((0.20, 0.60, 0.00, 0.02, 0.04, 0.00, 0.14), "prose"),
    "prose-fr": ((0.22, 0.56, 0.00, 0.02, 0.04, 0.00, 0.16), "prose"),
    "list-words": ((0.06, 0.66, 0.00, 0.06, 0.12, 0.00, 0.10), "list"),
    "list-leaders": ((0.03, 0.34, 0.00, 0.10, 0.45, 0.00, 0.08), "list"),
    "table-numbers": ((0.01, 0.15, 0.00, 0.50, 0.08, 0.06, 0.20), "table"),
    "table-words": ((0.03, 0.60, 0.00, 0.14, 0.06, 0.05, 0.12), "table"),
    "junk-letters": ((0.00, 0.25, 0.50, 0.12, 0.05, 0.06, 0.02), "junk"),
    "junk-symbols": ((0.00, 0.05, 0.20, 0.10, 0.25, 0.30, 0.10), "junk"),
}
#: Characters a prior counts for.
PRIOR_CHARS = 3000.0
#: A line shorter than this is judged by the characters of all its document's plain lines.
SHORT_LINE = 40
#: Bits from which a character is rare, a gram's length and the repeated share of junk.
RARE_BITS, GRAM, REPEATED = 15.5, 12, 0.7
#: Share of a document's characters one kind must have.
MAJORITY = 0.5

_NUMBER = r"[\d０-９]+(?:[.,:/][\d０-９]+)*%?"
_CELL = re.compile(rf"^(?:[-+±]?{_NUMBER}|[—–\-.·/]*|同上|n/?a|do\.?|ditto|idem|id\.|dito|desgl\.?|″|〃)$", re.IGNORECASE)
_SEPARATOR = re.compile(r"[\s|│┃+\-=─━┼:_]*[-=─━_]{3,}[\s|│┃+\-=─━┼:_]*")
_LEADERS = re.compile(rf"(?:\.{{3,}}|…+|(?:[·.•] ?){{3,}}|\s{{2,}}|\t|[,，、:：])\s*(?:p\.|S\.|第)?\s*[\d０-９ivxlcIVXLC]{{1,6}}页?\s*$")
_REFERENCES = re.compile(rf"[^\d.。!?！？]{{1,60}}[\s,，、:：]+\d{{1,4}}(?:[-–—]\d{{1,4}})?(?:\s*[,，、;；]\s*\d{{1,4}}(?:[-–—]\d{{1,4}})?)*\s*$")
_MARK = re.compile(
    r"\s*(?:[-–—*•·●○◦▪■□◇◆※►▶‣⁃✓✔]\s*(?=\S)|[\(（\[［【〔]?\d{1,3}[\)）\]］】〕.、．:：]\s*(?=\D)|[\(（\[][A-Za-z一二三四五六七八九十]{1,3}[\)）\]]\s*|[①-⑳⑴-⒇]\s*"
    r"|第[\d一二三四五六七八九十百]+[章节卷回条部篇]\s|[一二三四五六七八九十]{1,3}、|(?:Chapter|Kapitel|Chapitre|Section|Nr\.|No\.|§)\s*\d+|[A-Za-z]\)\s)"
)
_GLOSS = re.compile(r"\s*[^\s：:，。,.;；“”\"]{1,24}(?: [^\s：:，。,.;；]{1,24}){0,3}\s*(?:[：:=→]|\s[—–-]{1,2}\s|——?)\s*[^。！？!?]{1,80}$")
_CITATION = re.compile(r"(?:\bpp?\.\s*\d|\b(?:1[5-9]|20)\d\d\b.*(?:\bpp?\.|vol\.|Bd\.|Aufl\.|ed\.|éd\.|hrsg)|《[^》]{1,40}》.*\d|\[[JMCDNR]\]|[:：]\s*[^:：]{2,30}[,，]\s*(?:1[5-9]|20)\d\d)", re.IGNORECASE)
_END = re.compile(r"[。！？!?.…][”’」』）)\"'\]]*\s*$")
_SENTENCE_END = re.compile(r"[。！？!?]|[.](?=\s|$)")
_WORD = re.compile(r"[^\W\d_]+")


def cells(line: str) -> list[str]:
    """The columns of a line by its strongest separator; the line itself if it has none."""
    for sep in (r"\s*[|│┃]\s*", r"\t+", r"\s{2,}|　+", r"\s*[;；]\s*", r","):
        parts = re.split(sep, line.strip().strip("|│┃"))
        if len(parts) >= 3:
            return [p.strip() for p in parts]
    parts = line.split()
    return parts if len(parts) >= 3 and sum(bool(_CELL.match(p)) for p in parts) * 4 >= len(parts) * 3 else [line]


_WORDLIKE = re.compile(r"^[\w .'’&/()（）%°:+\-]{0,40}$")
_WIDE_GAP = re.compile(r"\S(?:\s{2,}|\t)\S")
_RUNS = re.compile(r"(.)\1+")
_QUICK_CHARS = re.compile("[" + "".join(sorted(FUNCTION_CHARS)) + "]")
_QUICK_WORDS = re.compile(r"\b(?:" + "|".join(w for words in FUNCTION_WORDS.values() for w in words[:14]) + r")\b", re.IGNORECASE)
_IDEOGRAPH = re.compile("[\u3400-\u9fff]")


def plain_prose(line: str) -> bool:
    """Whether a line is running prose at first sight: long, unmarked, full of function words."""
    text = line.strip()
    if len(text) < 16 or "  " in text or "\u3000" in text or "\t" in text or "|" in text or "│" in text or _MARK.match(line):
        return False
    if text[-1] in "0123456789页ivxIVX" and _LEADERS.search(line):
        return False
    quick = _QUICK_CHARS if _IDEOGRAPH.search(text) else _QUICK_WORDS
    return len(quick.findall(text)) * 24 >= len(text)


_HEX = re.compile(r"\s*(?:(?:0x)?[0-9a-fA-F]{2,8}[\s:,]+){5,}(?:0x)?[0-9a-fA-F]{1,8}\s*")
_VOWEL = re.compile("[aeiouyàâäåæéèêëîïôöœùûü]", re.IGNORECASE)


def gibberish(line: str) -> bool:
    """Whether most words of a Latin line are none: digits or capitals inside, no vowel, hex bytes."""
    tokens = re.findall(r"[A-Za-z0-9À-ÿœ]+", line)
    if len(tokens) < 3 or not re.search("[A-Za-z]", line):
        return False
    if _HEX.fullmatch(line) and re.search(r"\d[a-fA-F]|[a-fA-F]\d", line):
        return True
    odd = 0
    for t in tokens:
        letters = re.sub(r"\d", "", t)
        mixed = bool(letters) and len(letters) < len(t)
        inner = len(t) > 2 and not t.isupper() and t[1:] != t[1:].lower()
        odd += mixed or inner or len(letters) > 3 and not _VOWEL.search(letters)
    return odd * 5 >= len(tokens) * 2


def unreadable(line: str, costs: np.ndarray) -> bool:
    """Whether a line is junk by its characters: symbols, rare letters, runs of one character."""
    bare = "".join(line.split())
    n = len(bare)
    if not n:
        return False
    text = line.strip()
    seen = sum(map(str.isalpha, bare))
    signs = n - seen - sum(map(str.isnumeric, bare))
    if signs > 0.6 * n and not _SEPARATOR.fullmatch(text) and not all(_WORDLIKE.match(c) or _CELL.match(c) for c in cells(line)):
        return True
    if seen >= 4 and not line.isascii() and sum(c >= "\u2e80" and costs[ord(c)] >= RARE_BITS for c in bare if c.isalpha()) > 0.4 * seen:
        return True
    if gibberish(line):
        return True
    return n >= 3 and len(_RUNS.sub(r"\1", bare)) * 2 <= n + 1 and not _SEPARATOR.fullmatch(text) and not bare.isdigit()


def shape(line: str) -> str:
    """What a line's shape says: table, columns (table in company), list, or nothing."""
    text = line.strip()
    if len(text) >= 3 and _SEPARATOR.fullmatch(text):
        return "columns"
    marked = _MARK.match(line)
    columns = cells(line)
    if len(columns) >= 3 and all(_WORDLIKE.match(c) or _CELL.match(c) for c in columns):
        numeric = sum(bool(_CELL.match(c)) for c in columns)
        pages = not re.search(r"[|│┃\t]|\s{2,}", text) and re.match(r"^[^\d,，]{1,40}[,， ]+\d+(?:[-–]\d+)?(?:[,，] \d+(?:[-–]\d+)?)*$", text)
        if pages and ("， " in text or ", " in text or " " in text.split(",")[0]):
            return "list"
        if sum(text.count(c) for c in "|│┃") >= 2 or numeric * 5 >= len(columns) * 2:
            return "table"
        if not _SENTENCE_END.search(text) and (_WIDE_GAP.search(text) or "," in text and ", " not in text or len(re.findall("[;；]", text)) >= 2):
            return "columns"
    pair = re.split(r"\s{2,}|\t", line.rstrip("\n"), maxsplit=2)
    if all(map(_CELL.match, pair)):
        return "table" if len(pair) == 2 else "columns"
    if len(text) <= 120 and _LEADERS.search(text) and (marked or re.search(r"\.{3,}|…|[·•] ?[·•]|\s{2,}\d+$|\t", text)):
        return "list"
    if marked and len(text) <= 400:
        return "list" if len(_SENTENCE_END.findall(text)) <= 1 or len(text) <= 60 else "marked"
    if len(text) <= 90 and _REFERENCES.fullmatch(text):
        return "list"
    if len(text) <= 200 and _CITATION.search(text):
        return "cited"
    if len(text) <= 110 and _GLOSS.fullmatch(text):
        return "gloss"
    return ""


def _kinds() -> np.ndarray:
    names = {"L": 1, "M": 1, "N": 3, "P": 4, "S": 5, "Z": 6, "C": 5}
    table = np.array([names[unicodedata.category(chr(c))[0]] for c in range(0x110000)], np.uint8)
    table[[9, 10, 13]] = 6
    return table


_KINDS = _kinds()
_LOWER = np.arange(0x110000, dtype=np.uint32)
for _point in range(0x41, 0x2000):
    if len(_low := chr(_point).lower()) == 1:
        _LOWER[_point] = ord(_low)


def _word_hashes(words: list[str]) -> np.ndarray:
    return np.sort(np.array([gram_hashes(np.array([ord(c) for c in w], np.uint32), len(w))[0] for w in words], np.uint64))


_FUNCTION_HASHES = _word_hashes(sorted(_WORDS))


def class_table(costs: np.ndarray) -> np.ndarray:
    """Class of every code point, as a place in CLASSES."""
    table = _KINDS.copy()
    points = np.arange(0x110000)
    table[(table == 1) & (points >= 0x2E80) & (costs >= RARE_BITS)] = 2
    table[[ord(c) for c in FUNCTION_CHARS]] = 0
    return table


def class_counts(lines: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each line: characters by class, words, and letters in words.

    A run of letters of an alphabet is a word, and so is each ideograph or kana by itself.
    """
    codes = np.frombuffer("\n".join([*lines, ""]).encode("utf-32-le", "replace"), np.uint32)
    cls = table[codes]
    breaks = codes == 10
    line = np.cumsum(breaks) - breaks
    n = len(lines)
    counts = np.bincount(line[~breaks] * 7 + cls[~breaks], minlength=7 * n).reshape(n, 7).astype(np.float64)
    letter = _KINDS[codes] == 1
    whole = letter & (codes >= 0x2E80)
    letter &= ~whole
    edge = np.diff(np.concatenate([[0], letter.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(starts):
        hashes = span_hashes(_LOWER[codes], starts, ends)
        at = np.minimum(np.searchsorted(_FUNCTION_HASHES, hashes), len(_FUNCTION_HASHES) - 1)
        known = _FUNCTION_HASHES[at] == hashes
        moved = np.bincount(line[starts[known]], (ends - starts)[known], minlength=n)
        counts[:, 0] += moved
        counts[:, 1] -= moved
    ideographs = np.bincount(line[whole], minlength=n)
    words = np.bincount(line[starts], minlength=n) + ideographs
    letters = np.bincount(line[starts], ends - starts, minlength=n) + ideographs
    return counts, words, letters


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence of distributions along the last axis, in bits."""
    m = (p + q) / 2
    logs = np.log2(np.maximum(m, 1e-12))
    own = p * (np.log2(np.maximum(p, 1e-12)) - logs)
    theirs = q * (np.log2(np.maximum(q, 1e-12)) - logs)
    return (own + theirs).sum(-1) / 2


_NAMES = tuple(PROFILES)
_KIND_OF = [name.partition("-")[0] for name in _NAMES]
_PROSE = [i for i, kind in enumerate(_KIND_OF) if kind == "prose"]


def repeated_share(text: str) -> float:
    """Share of a text's grams that it has held before."""
    codes = np.frombuffer("".join(text.split()).encode("utf-32-le", "replace"), np.uint32)
    hashes = gram_hashes(codes, GRAM)
    return 1 - len(np.unique(hashes)) / len(hashes) if len(hashes) >= 2 * GRAM else 0.0


def endless(text: str) -> float:
    """``repeated_share`` of a text where it is above REPEATED, else 0.

    The grams' hashes fall into buckets, of which there are no more than distinct grams: most
    texts have too many for that much repetition.
    """
    codes = np.frombuffer("".join(text.split()).encode("utf-32-le", "replace"), np.uint32)
    hashes = gram_hashes(codes, GRAM)
    if len(hashes) < 2 * GRAM:
        return 0.0
    size = 1 << (2 * len(hashes)).bit_length()
    seen = np.zeros(size, bool)
    seen[hashes & np.uint64(size - 1)] = True
    if 1 - np.count_nonzero(seen) / len(hashes) <= REPEATED:
        return 0.0
    again = 1 - len(np.unique(hashes)) / len(hashes)
    return again if again > REPEATED else 0.0


def _company(shapes: list[str]) -> list[str]:
    """Shapes that count only in company of their like, settled."""
    strong = {"columns": "table", "gloss": "list", "cited": "list", "marked": "list"}
    counts = {s: shapes.count(s) for s in strong}
    out = list(shapes)
    for i, s in enumerate(shapes):
        if s == "columns":
            beside = {shapes[j] for j in (i - 2, i - 1, i + 1, i + 2) if 0 <= j < len(shapes)}
            out[i] = "table" if "table" in beside or counts[s] >= 3 and "columns" in beside else ""
        elif s in strong:
            out[i] = strong[s] if counts[s] >= 3 and (s != "marked" or counts[s] >= 3) else ""
    for i in range(1, len(out) - 1):  # a heading or a wrapped entry within a list or table
        if not out[i] and out[i - 1] == out[i + 1] in ("list", "table") and len(shapes) > 4:
            out[i] = out[i - 1]
    return out


def lines_in(text: str) -> list[str]:
    return [line for line in re.split(r"\r\n|[\n\r\x85\u2028\u2029]", text) if line.strip()]


def forms_of(lines: list[str], costs: np.ndarray) -> list[int]:
    """The form of each line of a document, as a place in FORMS."""
    shapes = ["prose" if plain_prose(line) else "junk" if unreadable(line, costs) else shape(line) for line in lines]
    settled = _company(shapes)
    if len(lines) == 1 and settled[0] == "list":  # one line alone is no list
        settled = [""]
    return [_FORM_AT[s] if s else _FORM_AT["junk"] if _unbroken(line) else _FORM_AT["plain"] for line, s in zip(lines, settled, strict=True)]


_FORM_AT = {form: i for i, form in enumerate(FORMS)}


def vectors(counts: np.ndarray, forms: np.ndarray) -> np.ndarray:
    """The lines' distributions over CLASSES and FORMS."""
    shares = counts / np.maximum(1.0, counts.sum(1, keepdims=True))
    return np.concatenate([shares / 2, np.eye(len(FORMS))[forms] / 2], axis=1)


def prior_profiles() -> np.ndarray:
    classes = np.array([c for c, _ in PROFILES.values()])
    return vectors(classes / classes.sum(1, keepdims=True), np.array([_FORM_AT[f] for _, f in PROFILES.values()]))


def nearest(lines: np.ndarray, profiles: np.ndarray, among: list[int] | None = None) -> np.ndarray:
    """The place of the profile nearest to each line's distribution."""
    of = profiles if among is None else profiles[among]
    found = np.concatenate([divergence(lines[i : i + 8192, None, :], of[None]).argmin(1) for i in range(0, len(lines), 8192)] or [np.zeros(0, int)])
    return found if among is None else np.array(among)[found]


class Described(NamedTuple):
    """What is known of the lines of a batch of documents: each one's document, length, counts and form."""

    owner: np.ndarray
    sizes: np.ndarray
    counts: np.ndarray
    words: np.ndarray
    letters: np.ndarray
    ended: np.ndarray
    forms: np.ndarray


def described(texts: list[str | None], costs: np.ndarray, table: np.ndarray) -> Described:
    """The lines of a batch of documents; blank documents have none."""
    owner, lines, forms = [], [], []
    for d, text in enumerate(texts):
        if text and (mine := lines_in(text)):
            owner += [d] * len(mine)
            lines += mine
            forms += forms_of(mine, costs)
    counts, words, letters = class_counts(lines, table)
    sizes = np.array([len(line) for line in lines], int)
    ended = np.array([bool(_END.search(line)) for line in lines], bool)
    return Described(np.array(owner, int), sizes, counts, words, letters, ended, np.array(forms, int))


def form_sums(found: Described) -> np.ndarray:
    """Characters by class of the lines that have a form, each at the profile of that form whose prior is nearest."""
    sums, priors = np.zeros((len(PROFILES), len(CLASSES)), np.int64), prior_profiles()
    for form, name in enumerate(FORMS[:-1]):
        mine = np.flatnonzero(found.forms == form)
        among = [i for i, kind in enumerate(_KIND_OF) if kind == name]
        at = nearest(vectors(found.counts[mine], found.forms[mine]), priors, among)
        for i in among:
            sums[i] = found.counts[mine[at == i]].sum(0)
    return sums


def shares_of(formed: np.ndarray, owner: np.ndarray, plain: np.ndarray, again: np.ndarray, profiles: np.ndarray) -> np.ndarray:
    """Share of each document's characters in prose, list, table and junk.

    ``formed`` has the characters of each document's lines by form, ``owner`` and ``plain`` the
    documents and counts of the lines without one. A line that has a form needs no profile: it
    is at most half a bit from those of its form and at least half a bit from all others.
    """
    n, sizes = len(formed), plain.sum(1)
    block = np.zeros((n, len(CLASSES)))
    np.add.at(block, owner, plain)
    told = np.where((sizes < SHORT_LINE)[:, None], block[owner], plain)
    kinds = np.array([FORMS.index(k) for k in _KIND_OF])[nearest(vectors(told, np.full(len(plain), _FORM_AT["plain"])), profiles)]
    shares = formed + np.bincount(owner * 4 + kinds, sizes + 1.0, minlength=4 * n).reshape(-1, 4)
    shares /= np.maximum(1.0, shares.sum(1, keepdims=True))
    for d in np.flatnonzero(again).tolist():
        junk = max(again[d], shares[d, 3])
        shares[d] *= 1 - again[d]
        shares[d, 3] = junk
    return shares


def kinds_of(shares: np.ndarray) -> list[str | None]:
    """list, table or junk where one of them has more than half of a document; else None."""
    best = shares[:, 1:].argmax(1) + 1
    return [("prose", "list", "table", "junk")[k] if row[k] > MAJORITY else None for row, k in zip(shares, best.tolist(), strict=True)]


def _unbroken(line: str) -> bool:
    """One run of Latin letters and digits longer than any word."""
    longest = max((len(w) for w in line.split()), default=0)
    return longest > 60 and sum(c.isascii() for c in line) > 0.9 * len(line) and longest > 0.6 * len(line) and bool(re.search(r"[A-Za-z]\d|\d[A-Za-z]|[a-z][A-Z]|\W{3}", line))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(0x110000, np.int64)
    for batch in batches:
        texts = "".join(t for t in batch.column(0).to_pylist() if t)
        seen = np.bincount(np.frombuffer(texts.encode("utf-32-le", "replace"), np.uint32)) if texts else counts[:0]
        counts[: len(seen)] += seen
    points = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(points.astype(np.int32)), pa.array(counts[points])], ["point", "n"])


def char_bits(texts: DataFrame) -> np.ndarray:
    """Bits of each code point's rarity, over all rows of the one text column of ``texts``."""
    rows = texts.mapInArrow(_count, "point int, n long").groupBy("point").agg(F.sum("n").alias("n")).collect()
    bits, total = np.full(0x110000, 30.0, np.float32), sum(r.n for r in rows) or 1
    for r in rows:
        bits[r.point] = -np.log2(r.n / total)
    return bits


_FORMED = FORMS[:-1]
#: Of a document (no profile): characters by class and, a line break each included, by form; counts by class of the
#: lines without a form; what ``endless`` says; lines, words, letters and ended lines; ``repeated_share``. Of a profile
#: (no document): characters by class of the lines it is fitted on.
MEASURED = ", ".join(["doc_id long, profile int", *(f"`{c}` long" for c in (*CLASSES, *_FORMED)), "plain binary, again double, n_lines long, n_words long, n_letters long, n_ended long, repeated double"])
_MEASURED = pa.schema([("doc_id", pa.int64()), ("profile", pa.int32()), *((c, pa.int64()) for c in (*CLASSES, *_FORMED)), ("plain", pa.binary()), ("again", pa.float64()), *((c, pa.int64()) for c in ("n_lines", "n_words", "n_letters", "n_ended")), ("repeated", pa.float64())])


def measures(texts: list[str | None], found: Described, kinds_only: bool) -> dict:
    """MEASURED of a batch of documents, but for their ids."""
    n = len(texts)
    counts = np.zeros((n, len(CLASSES)))
    np.add.at(counts, found.owner, found.counts)
    sizes = found.sizes + 1.0
    chars = np.bincount(found.owner * len(FORMS) + found.forms, sizes, minlength=len(FORMS) * n).reshape(n, -1)
    ordered, again = chars[:, _FORM_AT["list"]] + chars[:, _FORM_AT["table"]], np.zeros(n)
    for d in np.flatnonzero(ordered < ORDERED * chars.sum(1)).tolist():  # lists and tables repeat themselves
        again[d] = endless(texts[d])
    bare = found.forms == _FORM_AT["plain"]
    plain = found.counts[bare].astype(np.int32)
    ends = np.cumsum(np.bincount(found.owner[bare], minlength=n)).tolist()
    lines = np.bincount(found.owner, minlength=n)
    words, letters, ended = (np.bincount(found.owner, of, minlength=n) for of in (found.words, found.letters, found.ended))
    return {
        **{c: counts[:, i].astype(np.int64) for i, c in enumerate(CLASSES)}, **{f: chars[:, i].astype(np.int64) for i, f in enumerate(_FORMED)},
        "plain": [plain[a:b].tobytes() for a, b in zip([0, *ends], ends)], "again": again,
        "n_lines": lines, "n_words": words.astype(np.int64), "n_letters": letters.astype(np.int64), "n_ended": ended.astype(np.int64),
        "repeated": None if kinds_only else [repeated_share(text) if some else None for text, some in zip(texts, lines.tolist(), strict=True)],
    }


def _rows(n: int, columns: dict) -> pa.RecordBatch:
    """``n`` rows of MEASURED; columns that are not given are null."""
    return pa.RecordBatch.from_arrays([pa.nulls(n, f.type) if (c := columns.get(f.name)) is None else pa.array(c, f.type) for f in _MEASURED], schema=_MEASURED)


def _measure(costs, kinds_only: bool) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = costs.value
        table, sums = class_table(bits), np.zeros((len(PROFILES), len(CLASSES)), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                ids, texts = batch.column("doc_id").slice(at, BATCH), batch.column("text").slice(at, BATCH).to_pylist()
                found = described(texts, bits, table)
                sums += form_sums(found)
                yield _rows(len(texts), {"doc_id": ids} | measures(texts, found, kinds_only))
        yield _rows(len(sums), {"profile": np.arange(len(sums)), **{c: sums[:, i] for i, c in enumerate(CLASSES)}})

    return run


def measured(documents: DataFrame, kinds_only: bool) -> DataFrame:
    """MEASURED of every document, and of every profile once for each partition, as an intermediate table."""
    costs = documents.sparkSession.sparkContext.broadcast(char_bits(documents.select("text")))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return materialised(rows.mapInArrow(_measure(costs, kinds_only), MEASURED), "text-measures")


def fitted_profiles(table: DataFrame) -> np.ndarray:
    """The profiles' classes as averages over the lines of all documents that have a form.

    Each such line goes to the profile of its form whose prior it is nearest to; a prior
    counts as PRIOR_CHARS characters, so a kind the corpus lacks keeps it.
    """
    sums = table.where(F.col("profile").isNotNull()).groupBy("profile").agg(*[F.sum(c).alias(c) for c in CLASSES]).collect()
    profiles = prior_profiles()
    for row in sums:
        chars = np.array(row[1:]) + PRIOR_CHARS * 2 * profiles[row[0], : len(CLASSES)]
        profiles[row[0], : len(CLASSES)] = chars / chars.sum() / 2
    return profiles


STATS = "kind string, n_words int, mean_word_length double, symbol_share double, digit_share double, ended_line_share double, function_word_share double, repeated_share double, nearest_language string"
_TYPES = [pa.string(), pa.int32(), *[pa.float64()] * 6, pa.string()]


def statistics(batch: pa.RecordBatch, kinds: list[str | None], profiles: np.ndarray) -> list[tuple]:
    """STATS of a batch of MEASURED documents whose kinds are given."""
    counts = _numbers(batch, CLASSES)
    shares = counts / np.maximum(1.0, counts.sum(1, keepdims=True))
    far = divergence(shares[:, None, :], 2 * profiles[_PROSE][None, :, : len(CLASSES)])
    out = []
    for d, (lines, words, letters, ended, again) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("n_lines", "n_words", "n_letters", "n_ended", "repeated")), strict=True)):
        if not lines:
            out.append((None, 0, None, None, None, None, None, None, None))
            continue
        mean = letters / words if words else None
        language = _NAMES[_PROSE[int(far[d].argmin())]].partition("-")[2]
        out.append((kinds[d] or "prose", words, mean, float(shares[d, 5]), float(shares[d, 3]), ended / lines, float(shares[d, 0]), again, language))
    return out


def _numbers(batch: pa.RecordBatch, columns: tuple[str, ...]) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy() for c in columns], axis=1).astype(np.float64)


def _describe(model, kinds_only: bool) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = model.value
        for batch in batches:
            packed = batch.column("plain").to_pylist()
            plain = np.frombuffer(b"".join(packed), np.int32).reshape(-1, len(CLASSES)).astype(np.float64)
            owner = np.repeat(np.arange(len(packed)), [len(p) // (4 * len(CLASSES)) for p in packed])
            kinds = kinds_of(shares_of(_numbers(batch, _FORMED), owner, plain, batch.column("again").to_numpy(), profiles))
            if kinds_only:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kinds, pa.string())], ["doc_id", "kind"])
                continue
            columns = list(zip(*statistics(batch, kinds, profiles), strict=True)) or [()] * len(_TYPES)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)]], ["doc_id", *(c.split()[0] for c in STATS.split(", "))])

    return run


#: Share of a document in lines with the form of a list or table from which repetition is no junk.
ORDERED = 0.7
#: Documents whose lines are described at once.
BATCH = 500


def _told(documents: DataFrame, kinds_only: bool) -> tuple[DataFrame, object]:
    """The measured documents, and what puts them to the profiles fitted on them."""
    table = measured(documents, kinds_only)
    model = documents.sparkSession.sparkContext.broadcast(fitted_profiles(table))
    return table.where(F.col("profile").isNull()), _describe(model, kinds_only)


def document_statistics(documents: DataFrame) -> DataFrame:
    """``doc_id`` and STATS of every row; empty and null texts have no kind and no shares.

    A word is a run of letters of an alphabet, or one ideograph or kana.
    """
    rows, describe = _told(documents, False)
    return rows.mapInArrow(describe, f"doc_id long, {STATS}")


def structured(documents: DataFrame) -> DataFrame:
    """``doc_id, kind`` of the documents more than half of whose characters are list, table or junk.

    Each doc_id once; prose of any kind and empty or null texts are left out.
    """
    rows, describe = _told(documents, True)
    rows = rows.where(F.col("doc_id").isNotNull()).select("doc_id", *_FORMED, "plain", "again")
    found = rows.mapInArrow(describe, "doc_id long, kind string").where(F.col("kind").isNotNull())
    return found.groupBy("doc_id").agg(F.min("kind").alias("kind"))
