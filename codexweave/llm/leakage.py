"""Problem 8: passages of held-out test items inside the corpus.

Winnowing: of each window of consecutive k-gram hashes of a text the least one is kept, so
any span of ``k + window - 1`` characters that a document shares with a passage leaves a
common fingerprint. The test items are few and fixed; their fingerprints go to every task in
blocks of bounded size (one pass over the corpus per block), and are joined there with each
document's as these are made, so nothing of the corpus is shuffled. Hits on nearly one
diagonal are extended: short grams beside them cover the passage, small gaps left by changed
words or characters are closed, and the longest two stretches are measured.

Texts are compared by their letters and digits alone, without case, marks, width or
look-alike forms, so punctuation, blanks and line breaks do not count.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexweave.llm.lookalikes import LOOK_ALIKES


class Grain(NamedTuple):
    """Sizes in characters: of winnowed grams and windows, of extending grams, closed gaps and stretches."""

    k: int
    window: int
    short: int
    gap: int
    stretch: int


#: Scripts written with ideographs say as much in fewer characters. A passage is searched by the
#: first grain a quarter of it is long enough for (half of it may stand in two stretches).
DENSE = (Grain(10, 4, 3, 9, 12), Grain(4, 2, 2, 4, 6), Grain(3, 1, 2, 2, 5))
SPARSE = (Grain(24, 8, 7, 18, 30), Grain(9, 2, 5, 9, 14), Grain(6, 1, 4, 4, 12))
#: Passages with fewer letters and digits are found where they stand as a whole.
WHOLE_DENSE, WHOLE_SPARSE = 8, 16
#: Share of a passage that makes a leak.
MIN_SHARE = 0.5
#: Drift of a diagonal within one stretch, and the share of a stretch that must match.
DRIFT, DENSITY = 24, 0.82
#: Characters of passages in one block of test items.
BLOCK_CHARS = 4_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _plain(char: str) -> str:
    parts = unicodedata.normalize("NFKD", char)
    return "".join(c for p in parts for c in LOOK_ALIKES.get(p, p).casefold() if c.isalnum())


class _Plain(dict):
    def __missing__(self, point: int) -> str:
        self[point] = value = _plain(chr(point))
        return value


_PLAIN = _Plain()


def plain_codes(text: str) -> np.ndarray:
    """Code points of a text's letters and digits in one form."""
    return np.frombuffer(text.translate(_PLAIN).encode("utf-32-le", "replace"), np.uint32)


def is_dense(codes: np.ndarray) -> np.ndarray:
    return ((codes >= 0x3040) & (codes < 0xAC00)) | (codes >= 0x20000)


_POWERS: dict[str, np.ndarray] = {}


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of code points, by differences of one running sum."""
    n = len(codes)
    if len(_POWERS.get("up", ())) <= n:
        size = 1 << (n + 1).bit_length()
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, base in (("up", _BASE), ("down", inverse)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _POWERS[name] = np.cumprod(table, dtype=np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _POWERS["up"][:n], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * _POWERS["down"][starts]
    hashes ^= hashes >> np.uint64(29)
    hashes *= np.uint64(0xBF58476D1CE4E5B9)
    return hashes ^ (hashes >> np.uint64(32))


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each gram of ``k`` code points."""
    n = len(codes)
    return span_hashes(codes, slice(0, n - k + 1), slice(k, n + 1)) if n >= k else np.zeros(0, np.uint64)


def winnowed(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions of the hashes that are least in some window of ``window`` in a row."""
    n = len(hashes)
    if n <= window:
        return np.flatnonzero(hashes == hashes.min()) if n else np.zeros(0, np.int64)
    least = hashes[: n - window + 1].copy()
    for o in range(1, window):
        np.minimum(least, hashes[o : n - window + 1 + o], out=least)
    kept = np.zeros(n, bool)
    for o in range(window):
        kept[o : n - window + 1 + o] |= hashes[o : n - window + 1 + o] == least
    return np.flatnonzero(kept)


def grain_of(codes: np.ndarray) -> Grain | None:
    """The grain a passage is searched by; None where it is too short for any."""
    dense = bool(len(codes)) and is_dense(codes).mean() > 0.3
    if len(codes) < (WHOLE_DENSE if dense else WHOLE_SPARSE):
        return None
    grains = DENSE if dense else SPARSE
    return next((g for g in grains if len(codes) >= 4 * (g.k + g.window - 1)), grains[-1])


def needed(size: int, grain: Grain) -> int:
    """How many of a passage's fingerprints a document must have to be a candidate.

    Half of ``size`` characters, verbatim in two stretches, holds one in each window of either;
    two thirds of these are asked for, so that changed words may cost the others, and one at least.
    """
    held = (size // 2 - 2 * (grain.k + grain.window - 2)) // grain.window
    return max(1, 2 * held // 3)


class Items:
    """The fingerprints of a block of test items, ready to be joined with documents'."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        self.ids = [r[0] for r in rows]
        self.codes = [plain_codes(r[1]) for r in rows]
        self.grain = [grain_of(c) for c in self.codes]
        self.needed = np.array([needed(len(c), g) if g else 1 for c, g in zip(self.codes, self.grain, strict=True)], np.int64)
        self.tables = {}
        self.whole: dict[int, dict[int, list[int]]] = {}
        for i, codes in enumerate(self.codes):
            if self.grain[i] is None and len(codes):
                self.whole.setdefault(len(codes), {}).setdefault(int(gram_hashes(codes, len(codes))[0]), []).append(i)
        for grain in {g for g in self.grain if g}:
            hashes, item, at = [], [], []
            for i, codes in enumerate(self.codes):
                if self.grain[i] is grain:
                    all_hashes = gram_hashes(codes, grain.k)
                    kept = winnowed(all_hashes, grain.window)
                    hashes.append(all_hashes[kept])
                    item.append(np.full(len(kept), i))
                    at.append(kept)
            if hashes:
                h, i, a = np.concatenate(hashes), np.concatenate(item), np.concatenate(at)
                order = np.argsort(h, kind="stable")
                known = np.zeros(1 << 20, bool)
                known[h & np.uint64((1 << 20) - 1)] = True
                self.tables[grain] = (h[order], i[order], a[order], known)

    def whole_in(self, codes: np.ndarray) -> Iterator[int]:
        """The items too short for fingerprints that stand in a document as a whole."""
        for size, table in self.whole.items():
            hashes = gram_hashes(codes, size)
            known = np.fromiter(table, np.uint64, len(table))
            for told in np.unique(hashes[np.isin(hashes, known)]).tolist():
                yield from table[told]

    def hits(self, codes: np.ndarray, grain: Grain) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, place in the passage, place in the document) of each shared fingerprint."""
        none = np.zeros(0, np.int64)
        if grain not in self.tables or len(codes) < grain.k:
            return none, none, none
        h, item, at, known = self.tables[grain]
        hashes = gram_hashes(codes, grain.k)
        kept = winnowed(hashes, grain.window)
        kept = kept[known[hashes[kept] & np.uint64((1 << 20) - 1)]]
        low = np.searchsorted(h, hashes[kept], "left")
        n = np.searchsorted(h, hashes[kept], "right") - low
        rows = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else none
        return item[rows], at[rows], np.repeat(kept, n)


def _clusters(diagonals: np.ndarray) -> list[np.ndarray]:
    """Groups of rows whose diagonals lie close together, largest first."""
    order = np.argsort(diagonals, kind="stable")
    cuts = np.flatnonzero(np.diff(diagonals[order]) > DRIFT) + 1
    return sorted(np.split(order, cuts), key=len, reverse=True)


def _stretches(passage: np.ndarray, codes: np.ndarray, low: int, high: int, grain: Grain) -> list[tuple[int, int]]:
    """Spans of the passage that the document repeats on diagonals ``low``..``high``."""
    q, m = grain.short, len(passage)
    begin, end = max(0, low), min(len(codes), high + m + 1)
    mine, theirs = gram_hashes(passage, q), gram_hashes(codes[begin:end], q)
    if not len(mine) or not len(theirs):
        return []
    order = np.argsort(theirs, kind="stable")
    ranked = theirs[order]
    first = np.searchsorted(ranked, mine, "left")
    n = np.searchsorted(ranked, mine, "right") - first
    at = np.repeat(np.arange(len(mine)), n)
    rows = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    place = order[rows] + begin - at
    covered = np.zeros(m + 1, np.int32)
    near = np.unique(at[(place >= low) & (place <= high)])
    np.add.at(covered, near, 1)
    np.add.at(covered, near + q, -1)
    on = np.flatnonzero(np.cumsum(covered[:m]) > 0)
    if not len(on):
        return []
    out = []
    for run in np.split(on, np.flatnonzero(np.diff(on) > grain.gap + 1) + 1):
        a, b = int(run[0]), int(run[-1]) + 1
        if b - a >= grain.stretch and len(run) >= DENSITY * (b - a):
            out.append((a, b))
    return out


def shared(passage: np.ndarray, codes: np.ndarray, diagonals: np.ndarray, grain: Grain) -> float:
    """Share of the passage that the document holds in at most two stretches."""
    spans = []
    for rows in _clusters(diagonals):
        low, high = int(diagonals[rows].min()) - DRIFT // 2, int(diagonals[rows].max()) + DRIFT // 2
        spans += _stretches(passage, codes, low, high, grain)
    best = 0
    spans = sorted(set(spans), key=lambda s: s[0] - s[1])
    for i, (a, b) in enumerate(spans):
        best = max(best, b - a, *[b - a + max(0, d - c - max(0, min(b, d) - max(a, c))) for c, d in spans[i + 1 :]], 0)
    return best / len(passage)


def leaks_in(text: str, items: Items) -> list[tuple[int, float]]:
    """(item_id, share) of the items enough of whose fingerprints a text has."""
    codes = plain_codes(text)
    out = [(items.ids[i], 1.0) for i in items.whole_in(codes)] if items.whole else []
    for grain in items.tables:
        item, at, place = items.hits(codes, grain)
        if len(item):
            held = np.bincount(np.unique(item.astype(np.int64) << 32 | at) >> 32, minlength=len(items.ids))
            for i in np.flatnonzero((held > 0) & (held >= items.needed)).tolist():
                rows = item == i
                out.append((items.ids[i], shared(items.codes[i], codes, (place - at)[rows], grain)))
    return out


def _search(items) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Items(items.value)
        for batch in batches:
            found = [(d, i, s) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) if t for i, s in leaks_in(t, index)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.float64())],
                ["doc_id", "item_id", "share"],
            )

    return run


def leak_shares(documents: DataFrame, eval_items: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, item_id, share``: candidates and the share of the passage each holds.

    A document with as many fingerprints as half of a passage must leave (see ``needed``) is a
    candidate, so half of a passage, verbatim in two stretches, is always found. Items with null or empty passages and documents with null
    or empty texts have none.
    Repeated rows of an item or a document give one row.
    """
    spark = documents.sparkSession
    items = eval_items.where(F.col("item_id").isNotNull() & (F.length("passage") > 0)).groupBy(F.col("item_id").cast("long").alias("item_id")).agg(F.min("passage").alias("passage"))
    total = items.agg(F.sum(F.length("passage"))).first()[0] or 0
    blocks = max(1, -(-total // block_chars))
    texts = documents.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for block in range(blocks):
        rows = [(r.item_id, r.passage) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()]
        found = texts.mapInArrow(_search(spark.sparkContext.broadcast(rows)), "doc_id long, item_id long, share double")
        out = found if out is None else out.unionByName(found)
    return out.groupBy("doc_id", "item_id").agg(F.max("share").alias("share"))


def leaks(documents: DataFrame, eval_items: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    """``doc_id, item_id``: documents that hold at least half of an item's passage."""
    return leak_shares(documents, eval_items).where(F.col("share") >= min_share).select("doc_id", "item_id")
