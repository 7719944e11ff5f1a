"""Problem 5: text decoded with a wrong character encoding, found and restored.

A state is a stretch of text; an edge encodes it with a codec it may wrongly have been
decoded with and decodes the bytes with another, or undoes an escape. Best-first search
with a visited set follows the states of least cost, every path of up to ``ALL_STEPS``
operations but where a lower bound shows that nothing cheaper lies behind; the cost of a text is the sum of its
characters' implausibility in bits, learned by counting the characters of the whole corpus
but for pages that look damaged by their structure alone. A page is damaged if its text
holds a decoder's replacement character, or if a cheaper text is reachable from any stretch
by more than ``MIN_GAIN`` bits. For a stretch of more than ``GOAL_CHARS`` characters a state
that is taken up as the cheapest and has hardly any implausible character is the goal.

The counts are one row per code point (at most 1,114,112 whatever the corpus), so they are
the only thing collected and broadcast. Pages are handled one by one in Arrow batches.
"""

from __future__ import annotations

import codecs
import heapq
import html
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexweave.llm.lookalikes import TABLE

#: Codecs text may have been decoded with, and codecs its bytes may have been written in.
WRONG = ("cp1252x", "latin-1", "mac_roman", "cp1251", "cp1250", "cp850", "cp437", "koi8_r", "gb18030", "big5hkscs", "cp950", "cp932", "cp949", "utf-8")
TRUE = ("utf-8", "gb18030", "cp1252x", "big5hkscs", "mac_roman", "cp850", "cp1251", "cp932")
#: Cost in bits of one operation, of a character that could not be read, of one never seen,
#: the least cost of a suspicious character, and the gain that proves damage.
STEP, LOST, UNSEEN, SUSPICIOUS, MIN_GAIN = 6.0, 26.0, 26.0, 15.0, 24.0
#: The gain that proves damage where all that comes out is plausible.
CLEAN_GAIN = 8.0
#: Gain per changed character that a proof by single-byte or double-byte tables alone needs.
TABLE_GAIN = 6.0
#: Operations of a path; those up to which every path is walked; and beyond these the states
#: that are followed further, of those that are no costlier than the text as it is.
MAX_STEPS, ALL_STEPS, MAX_STATES = 4, 2, 40
#: A text longer than this is restored where the first state taken up, the cheapest so far,
#: has plausible characters, all but one in so many; a shorter one could look so by chance, and
#: all is walked.
GOAL_CHARS, ODD_RARITY = 24, 30
REPLACEMENT = "�"
#: Stands for a replacement character that was written, and so lost, before the wrong decoding;
#: it costs little, since that explains what is read there now.
TOLD_LOSS, TOLD_COST = "\x1c", 8.0
_WRITTEN_LOSS = REPLACEMENT.encode()


def _charmap(base: str) -> tuple[str, dict]:
    table = "".join(bytes([b]).decode(base, "replace") for b in range(256))
    table = "".join(chr(b) if c == REPLACEMENT else c for b, c in enumerate(table))
    return table, codecs.charmap_build(table)


@lru_cache(maxsize=None)
def _tables(name: str) -> tuple[str, dict]:
    return _charmap("cp1252")


def to_bytes(text: str, codec: str) -> bytes:
    """Bytes of ``text``; what the codec lacks becomes one byte that no text holds."""
    text = text.replace("?", "\x01")
    if codec == "cp1252x":  # cp1252, its five holes read as the control characters there
        data = codecs.charmap_encode(text, "replace", _tables(codec)[1])[0]
    else:
        data = text.encode(codec, "replace")
    return data.replace(b"?", b"\x1a").replace(b"\x01", b"?")


def to_text(data: bytes, codec: str) -> str:
    """Text of ``data``; a replacement character that was written as such becomes ``TOLD_LOSS``."""
    if codec == "utf-8" and _WRITTEN_LOSS in data:
        data = data.replace(_WRITTEN_LOSS, TOLD_LOSS.encode())
    if codec == "cp1252x":
        return codecs.charmap_decode(data, "replace", _tables(codec)[0])[0]
    return data.decode(codec, "replace")


ESCAPES: tuple[tuple[re.Pattern, Callable[[str], str]], ...] = (
    (re.compile(r"&(?:#\d+|#x[0-9a-fA-F]+|[A-Za-z]{2,8});"), html.unescape),
    (re.compile(r"\\u[0-9a-fA-F]{4}"), lambda s: re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)), s)),
    (re.compile(r"(?:%[0-9A-F]{2}){2}"), lambda s: unquote(s, errors="replace")),
    (re.compile(r"(?:=[0-9A-F]{2}){2}"), lambda s: re.sub(r"(?:=[0-9A-F]{2})+", lambda m: bytes.fromhex(m[0].replace("=", "")).decode("utf-8", "replace"), s)),
)
#: Escapes in a row, and the signs one of which each holds.
ESCAPED = re.compile(r"(?:&(?:amp;)*(?:#\d+|#x[0-9a-fA-F]+|[A-Za-z]{2,8});)+|(?:\\u[0-9a-fA-F]{4})+|(?:%[0-9A-F]{2}){2,}|(?:=[0-9A-F]{2}){2,}")
ESCAPE_SIGNS = "&\\%="
#: Structure of damage: lost characters, controls, private use, UTF-8 read byte by byte, and
#: six or more Latin-1, Cyrillic or box characters in a row that are no word of one script.
STRUCTURE = re.compile(
    "[�\x80-\x84\x86-\x9f-]"
    "|[ÂÃÄÅ][\x80-\xbf€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]|[à-ï][\x80-\xbf€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]{2}"
    "|[ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖ×ØÙÚÛÜÝÞßàáâãäåæçèéêëìíîïðñòóôõö÷øùúûüýþÿ¡-¿]{4}"
    "|[Ѐ-ӿ][\x80-\xbf€‚ƒ„…†‡ˆ‰‹‘’“”•–—™›]|[ㄅ-ㄩ﹀-﹟]{2}|[√∏∑∫≤≥∂◊Ω≈∆]"
)


def _loss_marks() -> str:
    """What written replacement characters look like through each wrong codec, as alternatives."""
    marks = {(_WRITTEN_LOSS * 2).decode(c, "replace") for c in ("latin-1", "mac_roman", "cp1251", "cp850", "cp437", "koi8_r", "gb18030", "big5hkscs")}
    return "|".join(sorted(re.escape(m) for m in marks if REPLACEMENT not in m))


_DAMAGED = re.compile(f"{STRUCTURE.pattern}|{_loss_marks()}")
#: A character counts at most so often a page where it stands on less than such a share of all
#: pages: what is garbled all over one page does not become plausible by that.
PAGE_CAP, COMMON_SHARE = 3, 0.02


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, on = np.zeros(0x110000, np.int64), np.zeros(0x110000, np.int64)
    pages = 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text and not _DAMAGED.search(text):
                points, n = np.unique(np.frombuffer(text.encode("utf-32-le"), np.uint32), return_counts=True)
                counts[points] += n
                on[points] += 1
                pages += 1
    counts[0] = pages  # stands for no character
    points = np.union1d(np.flatnonzero(counts), [0])
    yield pa.RecordBatch.from_arrays([pa.array(points.astype(np.int32)), pa.array(counts[points]), pa.array(on[points])], ["point", "n", "pages"])


def char_costs(texts: DataFrame) -> np.ndarray:
    """Bits by which each code point is implausible, from the one text column of ``texts``.

    All rows are counted except structurally damaged ones; CJK compatibility forms and the
    like are as implausible as they are rare. White space and ASCII are never implausible.
    """
    rows = texts.mapInArrow(_count, "point int, n long, pages long").groupBy("point").agg(F.sum("n").alias("n"), F.sum("pages").alias("pages")).collect()
    return _costs_from([(r.point, r.n, r.pages) for r in rows])


def _costs_from(rows: list[tuple[int, int, int]]) -> np.ndarray:
    """Costs from (code point, occurrences, pages), code point 0 with the number of all pages."""
    costs = np.full(0x110000, UNSEEN, np.float32)
    all_pages = sum(n for point, n, _ in rows if not point)
    total = sum(n for point, n, _ in rows if point) or 1
    for point, n, pages in rows:
        if pages < COMMON_SHARE * all_pages:
            n = min(n, PAGE_CAP * pages)
        if point:
            costs[point] = min(UNSEEN, -np.log2((n + 0.01) / total))
    costs[0x20:0x7F] = np.minimum(costs[0x20:0x7F], 8.0)
    costs[[0x09, 0x0A, 0x0D]] = 4.0
    costs[0x1A] = costs[0xFFFD] = LOST
    costs[ord(TOLD_LOSS)] = TOLD_COST
    return costs


def seed_costs(costs: np.ndarray) -> np.ndarray:
    """Costs by which a character makes a stretch suspicious: those of its look, where that is one character.

    Width, compatibility and look-alike forms of plausible characters are no sign of a wrong
    encoding; the search itself takes the characters as they are.
    """
    seeds = costs.copy()
    for point in np.flatnonzero(costs[: 0x30000] >= SUSPICIOUS).tolist():
        if (costs[point] < UNSEEN or _FORMS.match(chr(point))) and len(shape := TABLE[point]) == 1:
            seeds[point] = min(seeds[point], costs[ord(shape)])
    return seeds


#: Where most compatibility and look-alike forms stand, seen in the corpus or not.
_FORMS = re.compile("[\u0370-\u052f\u2e80-\u2fdf\uf900-\ufaff\uff00-\uffef]")


def cost_of(text: str, costs: np.ndarray) -> float:
    return float(costs[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)].sum())


def costs_of(texts: list[str], costs: np.ndarray) -> list[float]:
    """The costs of several texts, none of them empty."""
    if not texts:
        return []
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32)
    return np.add.reduceat(costs[codes], np.cumsum([0, *map(len, texts[:-1])]), dtype=np.float64).tolist()


def stretches(text: str, costs: np.ndarray, seeds: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spans around suspicious characters: non-ASCII runs, joined over short gaps."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    bad = np.flatnonzero(((costs if seeds is None else seeds)[codes] >= SUSPICIOUS) & (codes > 0x7F))
    if not len(bad):
        return []
    spans: list[list[int]] = []
    for at in bad.tolist():
        if spans and at - spans[-1][1] <= 6 and "\n\n" not in text[spans[-1][1] : at]:
            spans[-1][1] = at + 1
        else:
            spans.append([at, at + 1])
    out = []
    for i, (a, b) in enumerate(spans):
        low = spans[i - 1][1] if i else 0
        high = spans[i + 1][0] if i + 1 < len(spans) else len(text)
        if b - a == 1 and 0x3400 <= codes[a] < 0xA000:  # one rare ideograph is no run
            out.append((a, b))
            continue
        while a > low and codes[a - 1] > 0x7F and spans[i][0] - a < 3 and costs[codes[a - 1]] > 9:
            a -= 1
        while b < high and codes[b] > 0x7F and b - spans[i][1] < 3 and costs[codes[b]] > 9:
            b += 1
        out.append((a, b))
    return out


def with_escapes(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans and those of escapes, in order, the ones that meet as one."""
    if not any(c in text for c in ESCAPE_SIGNS):
        return spans
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans + [m.span() for m in ESCAPED.finditer(text)]):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cheapest(text: str, costs: np.ndarray) -> tuple[str, float, tuple[str, ...]]:
    """The cheapest text reachable, its gain over ``text`` in bits, and the path to it.

    Of the many texts behind a state costlier than the one before it, some are cheaper by
    chance: there only gains of ``MIN_GAIN`` count, or of twice ``TABLE_GAIN`` a character
    where the path has no structure to tell.
    """
    _MODELS[id(costs)] = costs
    floor = _floor(id(costs))
    start = cost_of(text, costs)
    best = (start, text, ())
    queue, visited, known, taken = [(start, 0, text, (), 0.0)], {text}, {}, 0
    while queue:
        cost, steps, state, path, needed = heapq.heappop(queue)
        if steps >= ALL_STEPS:
            taken += 1
            if cost > start or taken > MAX_STATES:
                continue
        if steps and len(text) > GOAL_CHARS and start - cost >= needed and is_plausible(state, costs):
            break
        if least(state, steps, floor) >= min(best[0], start - needed):
            continue
        new = {after: name for after, name in neighbours(state, known) if after not in visited and not visited.add(after)}
        for (after, name), bits in zip(new.items(), costs_of(list(new), costs), strict=True):
            price = bits + STEP * (steps + 1)
            if price < best[0] and start - price >= (2 * TABLE_GAIN * len(text) if needed and not _structural((*path, name)) else needed):
                best = (price, after, (*path, name))
            if steps + 1 < MAX_STEPS and (steps + 1 < ALL_STEPS or price <= start):
                heapq.heappush(queue, (price, steps + 1, after, (*path, name), needed if price < cost else MIN_GAIN))
    return best[1], start - best[0], best[2]


def is_plausible(state: str, costs: np.ndarray) -> bool:
    """Whether at most one character in ``ODD_RARITY`` is suspicious or lost."""
    odd = costs[np.frombuffer(state.encode("utf-32-le", "replace"), np.uint32)] >= SUSPICIOUS
    return int(odd.sum()) * ODD_RARITY <= len(odd)


def least(state: str, steps: int, floor: float) -> float:
    """What any text behind a state costs at least.

    A character that a codec lacks stays lost, and four bytes at most become one character,
    so of the non-ASCII ones a quarter at least is left by each operation.
    """
    high = len(state) - len(state.encode("ascii", "ignore"))
    return STEP * (steps + 1) + LOST * state.count("\x1a") + floor * -(-high // 4 ** (MAX_STEPS - steps))


@lru_cache(maxsize=None)
def _floor(model: int) -> float:
    """The least cost of a non-ASCII character."""
    return float(_MODELS[model][0x80:].min())


#: Characters that no single-byte table gives.
_WIDE = re.compile("[\u3000-\ud7ff\ue000-\uf8fe\uf900-\ufaff\ufb03-\U0010ffff]")


def neighbours(state: str, known: dict[bytes, set[str]]) -> Iterator[tuple[str, str]]:
    """States one operation away, with the operation's name, but for bytes ``known`` to be decoded so before."""
    wide = _WIDE.search(state)
    for wrong in WRONG[8:] if wide else WRONG:
        data = to_bytes(state, wrong)
        if data.count(b"\x1a") * 4 > len(state) + 3:  # not what this codec gives
            continue
        done = known.setdefault(data, set())
        for true in TRUE:
            if true != wrong and true not in done:
                done.add(true)
                after = to_text(data, true)
                if after != state and after:
                    yield after, f"{wrong}>{true}"
    for pattern, undo in ESCAPES:
        if pattern.search(state):
            yield undo(state), "unescape"


def _structural(path: tuple[str, ...]) -> bool:
    return any(p.endswith(">utf-8") or p == "unescape" for p in path)


def _proven(piece: str, after: str, gain: float, path: tuple[str, ...], before: str, behind: str, costs: np.ndarray) -> bool:
    """Whether a gain proves damage: UTF-8 and escapes by structure, tables by more of it."""
    if not path or gain < CLEAN_GAIN:
        return False
    odd = sum(costs[ord(c)] >= SUSPICIOUS for c in after)
    if _structural(path):
        return not odd or gain >= MIN_GAIN and odd * 3 <= len(after)
    changed = sum(a != b for a, b in zip(piece, after, strict=False)) + abs(len(piece) - len(after))
    if gain < TABLE_GAIN * changed:
        return False
    if all(p.split(">")[0] in SINGLE and p.split(">")[1] in SINGLE for p in path):
        return not odd and (_latin(before) or _latin(behind))
    return changed >= 3 and gain >= 2 * MIN_GAIN


SINGLE = frozenset((*WRONG[:8], *TRUE)) - {"utf-8", "gb18030", "big5hkscs", "cp932"}


def _latin(c: str) -> bool:
    return c.isascii() and c.isalpha()


@lru_cache(maxsize=1)
def pair_tables() -> list[dict[str, str]]:
    """For each pair of single-byte tables, what each non-ASCII character would have been."""
    high = bytes(range(0x80, 0x100))
    pairs = [(w, t) for w in WRONG[:8] for t in ("cp1252x", "mac_roman", "cp850") if w != t]
    return [{a: b for a, b in zip(to_text(high, w), to_text(high, t), strict=True) if a != b and REPLACEMENT not in a + b} for w, t in pairs]


def one_table(text: str, costs: np.ndarray) -> tuple[str, float]:
    """``text`` read through the one pair of single-byte tables that gains most, char by char.

    Only characters beside Latin letters count, each where it gains clearly, and letters
    have to come out where letters went wrong.
    """
    chars = Counter("".join(re.findall(r"(?<=[A-Za-z])[^\x00-\x7f]+|[^\x00-\x7f]+(?=[A-Za-z])", text)))
    if not any(costs[ord(c)] >= SUSPICIOUS for c in chars):
        return text, 0.0
    best, table = 0.0, {}
    for pair in pair_tables():
        gain, letters, now = -STEP, 0.0, {}
        for c, n in chars.items():
            after = pair.get(c)
            if after and costs[ord(after)] < SUSPICIOUS and (won := float(costs[ord(c)] - costs[ord(after)])) >= TABLE_GAIN:
                gain, now[ord(c)] = gain + n * won, after
                letters += n * won * after.isalpha()
        if gain > best and letters * 3 >= gain:
            best, table = gain, now
    return (text.translate(table), best) if best >= MIN_GAIN else (text, 0.0)


@lru_cache(maxsize=1 << 16)
def _cheapest(piece: str, model: int) -> tuple[str, float, tuple[str, ...]]:
    return cheapest(piece, _MODELS[model])


_MODELS: dict[int, np.ndarray] = {}


def along(piece: str, path: tuple[str, ...]) -> str:
    """A text taken along a path of operations."""
    for name in path:
        if name == "unescape":
            for pattern, undo in ESCAPES:
                piece = undo(piece) if pattern.search(piece) else piece
        else:
            wrong, true = name.split(">")
            piece = to_text(to_bytes(piece, wrong), true)
    return piece


def losses(text: str) -> int:
    return text.count(REPLACEMENT) + text.count("\x1a")


def widened(text: str, a: int, b: int, low: int, after: str, path: tuple[str, ...]) -> tuple[int, int, str]:
    """The stretch with plausible characters beside it that belong to it: fewer are lost then."""
    best = (losses(after), 0, a, b, after)
    for left in range(4):
        for right in range(4):
            if a - left < low or b + right > len(text) or text[a - left : a].isascii() and left or text[b : b + right].isascii() and right:
                continue
            more = along(text[a - left : b + right], path)
            best = min(best, (losses(more), left + right, a - left, b + right, more))
    return best[2:]


def repair(text: str, costs: np.ndarray, seeds: np.ndarray | None = None) -> tuple[str, float, bool]:
    """``(text as far as restored, bits gained, whether any loss is left)`` of one page."""
    spans = with_escapes(text, stretches(text, costs, seeds))
    if not spans:
        return text, 0.0, REPLACEMENT in text
    _MODELS[id(costs)] = costs
    out, at, total = [], 0, 0.0
    for a, b in spans:
        a = max(a, at)
        piece = text[a:b]
        if not piece:
            continue
        after, gain, path = _cheapest(piece, id(costs)) if b - a <= 24 else cheapest(piece, costs)
        if _proven(piece, after, gain, path, text[a - 1 : a], text[b : b + 1], costs):
            if losses(after):
                a, b, after = widened(text, a, b, at, after, path)
            out += [text[at:a], after]
            at, total = b, total + gain
    fixed, more = one_table("".join([*out, text[at:]]), costs)
    fixed = fixed.replace(TOLD_LOSS, REPLACEMENT)
    return fixed, total + more, REPLACEMENT in fixed or "\x1a" in fixed


def _repairer(costs) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seeds = costs.value
        for batch in batches:
            texts, gains, lost, found = [], [], [], []
            for text in batch.column("text").to_pylist():
                fixed, gain, loss = repair(text, table, seeds) if text and not text.isascii() else (text, 0.0, False)
                if text and text.isascii() and any(p.search(text) for p, _ in ESCAPES):
                    after, gain, path = cheapest(text, table)
                    fixed, gain = (after, gain) if path and gain >= CLEAN_GAIN else (text, 0.0)
                texts.append(fixed)
                gains.append(gain)
                lost.append(loss)
                found.append(gain > 0 or bool(text) and REPLACEMENT in text)
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), pa.array(texts, pa.string()), pa.array(gains, pa.float64()), pa.array(lost, pa.bool_()), pa.array(found, pa.bool_())],
                ["page_id", "text", "gain", "lossy", "found"],
            )

    return run


def repaired(pages: DataFrame) -> DataFrame:
    """``page_id, text, gain, lossy, found`` of every row: the text as far as it can be restored.

    ``found``: at least one stretch was decoded with a wrong encoding. ``lossy``: characters
    are lost and stay so. Null and empty texts stay as they are and are never found.
    """
    spark = pages.sparkSession
    found = char_costs(pages.select("text"))
    costs = spark.sparkContext.broadcast((found, seed_costs(found)))
    columns = pages.where(F.col("page_id").isNotNull()).select("page_id", "text")
    return columns.mapInArrow(_repairer(costs), "page_id long, text string, gain double, lossy boolean, found boolean")


def wrongly_decoded(pages: DataFrame) -> DataFrame:
    """``page_id`` of the pages with at least one wrongly decoded stretch, each once."""
    return repaired(pages).where("found").select("page_id").distinct()
