"""Problem 4: one form for texts that look the same.

Two characters look the same if they differ in width, composition, kind of blank, or are
look-alike or compatibility forms of one letter; characters that do not show count for
nothing. A word's spellings that look the same are found by walking a trie of the corpus'
vocabulary with a weighted edit automaton in which those differences cost nothing, and the
commonest spelling of one script is the canonical one; words without one, ideographs and
everything else are normalised character by character through the table. The canonical form
depends on the look alone, so pages that look equal come out equal.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexweave.llm.key_files import KeyFiles, digest, halves, key_files
from codexweave.sources.tables import materialised

#: Letters of other alphabets and the Latin letters they look like. Fixed values.
LOOK_ALIKES = dict(
    zip(
        "аеорсухіѕјһԁԛԝӏАВЕКМНОРСТХІЅЈҮԌ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" "ονραιυγκ" "օսհոց" "ɑɡıⅼ",
        "aeopcyxisjhdqwlABEKMHOPCTXISJYG" "ABEZHIKMNOPTYX" "ovpaiuyk" "ouhng" "agil",
        strict=True,
    )
)
#: Kinds of compatibility forms that are told apart at sight, and those that are not.
SHOWN = ("<super>", "<sub>", "<circle>", "<fraction>", "<square>", "<vertical>", "<small>")
ALIKE = ("<wide>", "<narrow>", "<noBreak>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>")
#: Characters that do not show, besides those of category Cf. Fixed values.
INVISIBLE = frozenset([0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)])
#: Rows of the vocabulary that make one trie, but for the words of one look, which stay together.
TRIE_ROWS = 20_000
#: Least count of a spelling that may be canonical.
MIN_COUNT = 2


def look(char: str) -> str:
    """What a character looks like: its letters by the table, '' if it does not show."""
    point = ord(char)
    category = unicodedata.category(char)
    if category == "Cf" or point in INVISIBLE:
        return ""
    if category == "Zs" or char == "\t":
        return " "
    if char in "  \x85":
        return "\n"
    form = unicodedata.decomposition(char)
    if form.startswith("<"):
        kind = form.partition(" ")[0]
        if kind in SHOWN:
            return char
        plain = unicodedata.normalize("NFKC", char)
        if kind not in ALIKE and not plain.isalpha():
            return char
        char = plain
    parts = unicodedata.normalize("NFD", char)
    return unicodedata.normalize("NFC", "".join(LOOK_ALIKES.get(c, c) for c in parts))


class _Table(dict):
    def __missing__(self, point: int) -> str:
        self[point] = value = look(chr(point))
        return value


TABLE = _Table()


class Translation:
    """``str.translate`` by a table in which nearly all characters give one or none.

    Such texts are looked up as an array of code points; others are left to ``translate``.
    """

    UNKNOWN, MORE, NONE = 0xFFFFFFFF, 0xFFFFFFFE, 0xFFFFFFFD

    def __init__(self, table: dict) -> None:
        self.table = table
        self.points = np.full(0x110000, self.UNKNOWN, np.uint32)

    def __call__(self, text: str) -> str:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(codes):
            return text
        found = self.points[codes]
        top = found.max()
        if top == self.UNKNOWN:
            for point in np.unique(codes[found == self.UNKNOWN]).tolist():
                shape = self.table[point]
                self.points[point] = ord(shape) if len(shape) == 1 else self.MORE if shape else self.NONE
            found = self.points[codes]
            top = found.max()
        if top == self.MORE:
            return text.translate(self.table)
        if top == self.NONE:
            found = found[found != self.NONE]
        return found.tobytes().decode("utf-32-le", "surrogatepass")


_looks = Translation(TABLE)


def folded(text: str) -> str:
    """The look of a text: equal for two texts exactly if they look the same throughout."""
    return unicodedata.normalize("NFC", _looks(text.replace("\r\n", "\n")))


_IDEOGRAPHS = "⺀-⿿぀-ヿ㐀-鿿豈-﫿가-힣\U00020000-\U0003ffff"
#: Words of alphabetic scripts with what may stand within them unseen.
WORD = re.compile(rf"[^\W\d_{_IDEOGRAPHS}](?:[^\W\d_{_IDEOGRAPHS}]|[̀-ͯ­​-‍⁠﻿])*")


def script(char: str) -> str:
    return unicodedata.name(char, "?").partition(" ")[0]


def is_spelling(word: str) -> bool:
    """Whether a word could be canonical: composed, of one script, nothing unseen in it."""
    if word.isascii():
        return True
    if unicodedata.normalize("NFKC", word) != word or any(not look(c) for c in word):
        return False
    return len({script(c) for c in word if c.isalpha()}) == 1


class Trie:
    """Vocabulary as a trie, walked by a weighted edit automaton."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, word: str, count: int) -> None:
        node = self.root
        for c in word:
            node = node.setdefault(c, {})
        node[""] = node.get("", 0) + count

    def matches(self, look: str) -> list[tuple[int, str]]:
        """(count, spelling) of the words with a look: the automaton's paths of no cost.

        Look-alikes and characters that do not show cost nothing; whatever shows costs, and
        since a word that differs at sight is another word, nothing beyond 0 is accepted.
        """
        found, stack = [], [(self.root, 0, "")]
        while stack:
            node, at, spelling = stack.pop()
            for c, child in node.items():
                if c == "":
                    if at == len(look):
                        found.append((child, spelling))
                elif look.startswith(shape := TABLE[ord(c)], at):
                    stack.append((child, at + len(shape), spelling + c))
        return found


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = Counter()
        for text in batch.column(0).to_pylist():
            if text:
                counts.update(WORD.findall(text))
        rows = [(folded(w), w, n) for w, n in counts.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())],
            ["look", "word", "n"],
        )


def canonical(vocabulary: dict[str, Counter]) -> list[tuple[str, str]]:
    """(look, canonical spelling) where it is not the look itself, of some looks and their words' counts."""
    trie = Trie()
    for words in vocabulary.values():
        for word, n in words.items():
            if n >= MIN_COUNT and is_spelling(word):
                trie.add(word, n)
    out = []
    for shape, words in vocabulary.items():
        if shape and any(word != shape for word in words) and (found := trie.matches(shape)):
            best = max(found, key=lambda m: (m[0], m[1].isascii(), m[1]))[1]
            if best != shape:
                out.append((shape, best))
    return out


def _spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Canonical spellings from the vocabulary in order of look, one trie after another."""
    vocabulary, size = {}, 0
    for batch in batches:
        for shape, word, n in zip(*(batch.column(c).to_pylist() for c in ("look", "word", "n")), strict=True):
            if size >= TRIE_ROWS and shape not in vocabulary:
                yield _spelled(canonical(vocabulary))
                vocabulary, size = {}, 0
            vocabulary.setdefault(shape, Counter())[word] += n
            size += 1
    yield _spelled(canonical(vocabulary))


def _spelled(rows: list[tuple[str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*halves(r[0] for r in rows), pa.array([r[1] for r in rows], pa.string())], ["high", "low", "spelling"])


def spellings(pages: DataFrame) -> KeyFiles:
    """Canonical spellings by look, those that the table alone would not give.

    Words are counted within each batch before anything is shuffled; then the words of one
    look, which are few, meet. Neither the vocabulary nor the spellings are collected.
    """
    words = pages.select("text").mapInArrow(_words, "look string, word string, n long")
    ordered = words.repartition("look").sortWithinPartitions("look")
    return key_files(ordered.mapInArrow(_spell, "high long, low long, spelling string"), "spellings")


class Speller:
    """Canonical forms by the corpus' spellings; what has been asked is remembered."""

    def __init__(self, folder: str) -> None:
        self.files = KeyFiles(folder)
        self.plain: set[str] = set()
        self.known = lru_cache(maxsize=1 << 16)(self.files.text)

    def __call__(self, text: str) -> str:
        shape = folded(text)
        words = set(WORD.findall(shape)) - self.plain
        told = {w: s for w in words if (s := self.known(w))}
        if len(self.plain) > 1 << 18:
            self.plain.clear()
        self.plain |= words - told.keys()
        return WORD.sub(lambda m: told.get(m[0], m[0]), shape) if told else shape


def _forms(folder: str) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spell = Speller(folder)
        for batch in batches:
            forms = [None if t is None else spell(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("text"), pa.array(forms, pa.string())], ["page_id", "text", "form"])

    return run


def forms(pages: DataFrame) -> DataFrame:
    """``page_id, text, form`` of every stored row: its text and the canonical form of it.

    A null text has a null form, an empty one an empty form; rows without page_id are left
    out. White space keeps its place: each blank becomes one space, line ends stay.
    """
    rows = pages.where(F.col("page_id").isNotNull()).select(F.col("page_id").cast("long"), "text")
    return rows.mapInArrow(_forms(spellings(rows).folder), "page_id long, text string, form string")


def _digests(folder: str) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spell = Speller(folder)
        for batch in batches:
            ids, form, text = [], [], []
            for page, stored in zip(batch.column("page_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if stored and (shape := spell(stored)).strip():
                    ids.append(page)
                    form.append(digest(shape))
                    text.append(digest(stored))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(form, pa.binary()), pa.array(text, pa.binary())], ["page_id", "form", "stored"])

    return run


def classes(pages: DataFrame) -> DataFrame:
    """``page_id, form, stored``: 128-bit digests of the canonical and the stored text.

    Each page once; pages with null or blank text have none.
    """
    rows = pages.where(F.col("page_id").isNotNull()).select(F.col("page_id").cast("long"), "text")
    found = rows.mapInArrow(_digests(spellings(rows).folder), "page_id long, form binary, stored binary")
    return found.groupBy("page_id").agg(F.min(F.struct("form", "stored")).alias("d")).select("page_id", "d.form", "d.stored")


def look_classes(pages: DataFrame) -> DataFrame:
    """``page_id, class_id, n_pages, n_links``: each page's class of equal looks.

    ``n_links`` counts the pages of the class whose stored text differs from the page's own;
    copies are not paired. Pages with null or blank text are in no class.
    """
    found = classes(pages)
    variants = found.groupBy("form", "stored").agg(F.count("*").alias("same"))
    sizes = variants.groupBy("form").agg(F.sum("same").alias("n_pages"))
    told = variants.join(sizes, "form").select("form", "stored", "n_pages", (F.col("n_pages") - F.col("same")).alias("n_links"))
    return found.join(told, ["form", "stored"]).select("page_id", F.lower(F.hex("form")).alias("class_id"), "n_pages", "n_links")


def same_look(pages: DataFrame) -> DataFrame:
    """``page_id_a, page_id_b``: pages whose differing stored texts look the same throughout.

    Only digests are shuffled. First the differing texts of one look are paired, then the
    pages that store them, so the work is that of the pairs that come out; equal stored texts
    make no pair, however many copies there are.
    """
    found = materialised(classes(pages), "look-classes")
    variants = found.select("form", "stored").distinct()
    a = variants.select("form", F.col("stored").alias("stored_a"))
    b = variants.select("form", F.col("stored").alias("stored_b"))
    pairs = a.join(b, "form").where("stored_a < stored_b").select("stored_a", "stored_b")
    first = found.select(F.col("stored").alias("stored_a"), F.col("page_id").alias("x"))
    second = found.select(F.col("stored").alias("stored_b"), F.col("page_id").alias("y"))
    met = pairs.join(first, "stored_a").join(second, "stored_b")
    return met.select(F.least("x", "y").alias("page_id_a"), F.greatest("x", "y").alias("page_id_b"))
