"""Problem 3: noise of scanned pages, found line by line and repaired.

An averaged perceptron edits characters: for each place where an edit is conceivable (a
character or word that is easily misread, a sign that stands alone, a word cut at a line's
end) it decides between keeping, replacing, deleting, and joining lines with or without a
blank put in. Its features compare how often the text as it is and as it would be occurs in
the corpus. The counts cover all pages and are exact: they lie sorted by digest in files of the
shared folder, which are mapped into memory where they are asked, so nothing of them is
collected or broadcast. It is trained on a bounded sample of pages that is damaged on purpose,
so that the right answers are known.

Running heads and page numbers are told by their place on the page and by agreement within
the job: a number must fit the job's offset from the page number, and a name the book's title
or a chapter's name that goes on over pages. Those are small aggregates per job and name.
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codexweave.llm.key_files import KeyFiles, halves, key_files
from codexweave.llm.lookalikes import TABLE, Translation
from codexweave.sources.tables import materialised

#: Characters easily misread for each other, wrong before right. Fixed values.
CONFUSED = (
    "曰日 日曰 日目 目日 入人 人入 八人 己已 已己 巳已 右石 石右 卬印 印卬 荼茶 茶荼 末未 未末 本木 木本 较校 校较 纰纸 纸纰 刁刀 刀刁 力刀 提堤 堤提 太大 大太 犬大 "
    "轶铁 铁轶 士土 土士 夭天 天夭 千干 干千 于干 干于 白自 自白 田由 由田 甲由 申甲 王玉 玉王 主王 万方 方万 几凡 凡几 九丸 丸九 问间 间问 侯候 候侯 晴睛 睛晴 "
    "拔拨 拨拔 徒徙 徙徒 崇祟 戌戍 折拆 拆折 贷货 货贷 沽沾 沾沽 炙灸 壳売 鸟乌 乌鸟 兔免 免兔 今令 令今 体休 休体 住往 往住 代伐 伐代 仑仓 仓仑 竞竟 竟竞 "
    "采釆 乎平 平乎 牛午 午牛 失矢 矢失 夫失 朱未 来未 录晷 短长 小少 少小 丁了 了丁 子孑 亨享 享亨 哀衰 衰哀 密蜜 蜜密 幕墓 墓幕 慕幕 摸模 模摸 载栽 栽载 "
    "妙纱 纱妙 妙抄 抄妙 抄纱 纱抄 渡镀 洒酒 酒洒 汗汙 泊油 油泊 治冶 冶治 淮准 准淮 冼洗 冶治 冰水 水氷 永水 木禾 禾木 米来 未米 来米"
).split()
#: Letters easily misread in Latin words, wrong before right. Fixed values.
MISREAD = (
    "rn>m m>rn li>h ii>u vv>w cl>d ri>n in>m iii>m ni>m nn>m c>e e>c o>a a>o f>t t>f l>i i>l h>b b>h u>n n>u ll>u ti>h lc>k l<>k ,>' s>5 5>s 1>l l>1 0>o o>0 "
    "1>i 9>g 6>b 8>b 3>e 2>z 4>a 7>t 6>é 6>e 5>S 0>O 1>I 8>B I>l l>I B>8 g>q q>g y>v v>y j>i r>t fi>h d>cl w>vv h>li u>ii n>ri d>d $>s é>e ß>B B>ß"
).replace("<>k", "<>k").split()
#: Signs that stand for nothing where they stand alone in running text. Fixed values.
STRAY = "|~^_`'□丨¦\\{}<>*•°¬=+#@¤■◆♦※┃"
#: Pages and damage of the training sample.
SAMPLE_PAGES, DAMAGE, EPOCHS, MARGIN = 3000, 0.03, 6, 3.0
#: How common errors are in the corpus, as shares of the right reading. Damage done on purpose
#: is new to the corpus, but a page that is read has been counted with its errors.
RECURRENCE = (0.003, 0.01, 0.02, 0.04)
#: Places of a line looked at to learn where blanks stand.
CUTS = 4
#: How often another reading has to stand in the corpus to be conceivable.
MIN_SUPPORT = 3
#: (line, place, kind, wrong, right, features, score) and (right, features, score).
Edit = tuple[int, int, str, str, str, tuple[str, ...], float]
Reading = tuple[str, tuple[str, ...], float]
_CONFUSED: dict[str, list[str]] = defaultdict(list)
for _pair in CONFUSED:
    _CONFUSED[_pair[0]].append(_pair[1])
_MISREAD = [tuple(rule.split(">")) for rule in MISREAD if rule.count(">") == 1]
_CJK = "㐀-鿿"
_ZH = re.compile(f"[{_CJK}]")
_WORD = re.compile(r"[^\W\d_㐀-鿿]+(?:[’'][^\W\d_㐀-鿿]+)?")
_TOKEN = re.compile(r"[A-Za-zÀ-ɏ\d'’|$<>]+")
_BREAK = re.compile(r"([^\W\d_㐀-鿿]+)[-‐­¬]\s*$")
_COMPOUND = re.compile(r"([^\W\d_㐀-鿿]+)[-‐]([^\W\d_㐀-鿿]+)")
_SIGNS = frozenset("-\u2010\xad\xac")
_STRAY = re.compile(f"[{re.escape(STRAY)}]")


class _Lines(dict):
    """The table of looks, but for what would end a line within a line."""

    def __missing__(self, point: int) -> str:
        self[point] = value = TABLE[point] if point == 10 or TABLE[point] != "\n" else " "
        return value


_lines = Translation(_Lines())


def page_lines(text: str) -> list[str]:
    """A page's lines in one form of characters; a soft hyphen at a line's end stays a hyphen."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", _lines(re.sub("\xad(?=\\s*\\n|\\s*$)", "\u2010", text) if "\xad" in text else text))
    return [line.rstrip() for line in text.split("\n")]


def line_form(line: str) -> str:
    return page_lines(line.replace("\n", " "))[0]


_GARBLED = re.compile(
    "[\x80-\x9f\u00a1-\u00a6\u00a8\u00aa\u00ae\u00af\u00b4-\u00b6\u00b8-\u00ba\u00bc-\u00bf\ue000-\uf8ff\u3105-\u3129].*[\x80-\x9f\u00a1-\u00a6\u00a8\u00aa\u00ae\u00af\u00b4-\u00b6\u00b8-\u00ba\u00bc-\u00bf\ue000-\uf8ff\u3105-\u3129]"
    "|\ufffd|[\u00c0-\u00ff\u0152\u0153\u0160\u0161\u017d\u017e\u0192\u201a-\u201e\u2026\u2020\u2021\u02c6\u2030\u2039\u203a\u20ac]{3}|锟|鈥|銆|﹛|ã€"
)


def garbled(line: str) -> bool:
    """Whether a line is rather a matter of wrong encodings."""
    return not line.isascii() and bool(_GARBLED.search(line))


def clean_lines(lines: list[str]) -> list[str]:
    """The lines that are not garbled; one search tells for most pages."""
    return [line for line in lines if not garbled(line)] if garbled("\n".join(lines)) else lines


class Counts:
    """Exact counts of words and of windows around confusable ideographs, in memory."""

    def __init__(self) -> None:
        self.table = Counter()

    def add(self, counter: Counter) -> None:
        self.table.update(counter)

    def __getitem__(self, text: str) -> int:
        return self.table[text]


def windows(text: str, at: int, char: str) -> tuple[str, ...]:
    """The n-grams around a place with ``char`` put there."""
    l2, l1, r1, r2 = text[max(0, at - 2) : max(0, at - 1)], text[max(0, at - 1) : at], text[at + 1 : at + 2], text[at + 2 : at + 3]
    return l1 + char + "<", char + r1 + ">", l1 + char + r1, l2 + l1 + char + "<", char + r1 + r2 + ">"


def _digitless(text: str) -> str:
    return re.sub(r"\d", "0", text)


def joined_ideographs(lines: list[str]) -> tuple[str, list[int], list[int]]:
    """The lines run together without blanks, the line of each character, and where each line begins."""
    bare = ["".join(line.split()) for line in lines]
    owner = [k for k, line in enumerate(bare) for _ in line]
    starts = [0, *accumulate(map(len, bare))]
    return _digitless("".join(bare)), owner, starts


def _column(line: str, at: int) -> int:
    """Place in a line of its character number ``at`` that is no blank."""
    if at < len(line) and not any(map(str.isspace, line[: at + 1])):
        return at
    return next(islice((k for k, c in enumerate(line) if not c.isspace()), at, None))


_WANTED = set(_CONFUSED) | {r for rights in _CONFUSED.values() for r in rights}
_WANTED_RE = re.compile("[" + "".join(sorted(_WANTED)) + "]")


def count_page(lines: list[str], words: Counter, contexts: Counter) -> None:
    """Adds a page's words and compounds, and the contexts of its confusable ideographs."""
    zh = [line for line in lines if _ZH.search(line)]
    if zh:
        text = joined_ideographs(zh)[0]
        contexts.update([(text[max(0, at - 2) : at + 3], min(2, at)) for at in (m.start() for m in _WANTED_RE.finditer(text))])
        if len(zh) == len(lines):
            return
    found: list[str] = []
    for line in lines:
        if line and not _ZH.search(line):
            folded = line.casefold()
            mine = _WORD.findall(folded)[1:]
            if mine and line[-1] in _SIGNS:
                mine.pop()
            found += mine
            if "-" in folded or "\u2010" in folded:
                found += [f"{a}-{b}" for a, b in _COMPOUND.findall(folded)]
    words.update(found)


def expanded(words: Counter, contexts: Counter) -> Counter:
    """Counts of words and of the n-grams of all contexts."""
    out = Counter(words)
    for (context, at), n in contexts.items():
        for window in windows(context, at, context[at]):
            out[window] += n
    return out


def corpus_counts(read: DataFrame) -> KeyFiles:
    """Exact counts over all pages, from ``read_pages``; no count reaches the driver."""
    return key_files(read.where("n IS NOT NULL").groupBy("high", "low").agg(F.sum("n").alias("n")), "counts")


def _told(token: str) -> str:
    """The word of a token that may be misread: of two letters at least, and no number."""
    word = token.strip("'’|<>$")
    if len(word) < 2 or word.isdigit():
        return ""
    if not word.isalpha() and (sum(map(str.isalpha, word)) < 2 or _MIXED_NUMBER.fullmatch(word)):
        return ""
    return word


def _bin(n: float) -> int:
    return int(min(10, np.log2(n + 1)))


def _ratio(new: int, old: int) -> int:
    return int(max(-8, min(8, round(np.log2((new + 0.5) / (old + 0.5))))))


class Editor:
    """Averaged perceptron over the conceivable edits of a page.

    An edit is (line, place in it, kind, wrong, right, features, score); kinds are replace,
    word (a replacement within a Latin word) and delete; ``joins`` and ``blank_between``
    decide on joining lines and on inserting a blank. Where the score is not above zero the
    text is kept.
    """

    def __init__(self, counts: Counts, weights: dict[str, float] | None = None, recurrence: float = 0.0) -> None:
        self.counts = counts
        self.weights = weights or {}
        self._plain_tokens: set[str] = set()
        self._recurrence = recurrence  # errors are taken to stand in the corpus, as such a share of the right reading
        self._words = lru_cache(maxsize=1 << 16)(self._word)
        self._windows = lru_cache(maxsize=1 << 18)(counts.__getitem__)
        self._readings = lru_cache(maxsize=1 << 17)(self._reading)
        self._blanks = lru_cache(maxsize=1 << 14)(lambda left, right: self.score(_blank_features(left, right)) > 0)

    def _set(self, weights: dict[str, float]) -> None:
        """Takes new weights; what was scored with others is forgotten."""
        self.weights = weights
        for cache in (self._words, self._readings, self._blanks):
            cache.cache_clear()

    def score(self, features: tuple[str, ...]) -> float:
        return sum(self.weights.get(f, 0.0) for f in features)

    def blank_between(self, line: str, after: str) -> bool:
        """Whether a blank has to be put in where two lines are joined."""
        return self._blanks(line[-1:], after[:1])

    def _word(self, word: str) -> Reading | None:
        """The likeliest other reading of a Latin word, with its features."""
        plain = word.casefold()
        own = self.counts[plain]
        if self._recurrence:
            own = max(own, 1)
        best = None
        for wrong, right in _MISREAD:
            at = word.find(wrong)
            while at >= 0:
                other = word[:at] + right + word[at + len(wrong) :]
                n = self.counts[other.casefold()]
                if n > own and (best is None or n > best[0]):
                    best = (n, other, wrong, right)
                at = word.find(wrong, at + 1)
        if best is None or best[0] < MIN_SUPPORT:
            return None
        n, other, wrong, right = best
        own = max(own, round(self._recurrence * n))
        d = _ratio(n, own)
        features = ("w", f"w:r{d}", f"w:o{_bin(own)}", f"w:n{_bin(n)}", f"w:o{_bin(own)}n{_bin(n)}", f"w:{wrong}>{right}", f"w:l{min(8, len(word))}", f"w:r{d}l{min(5, len(word))}")
        return other, features, self.score(features)

    def _reading(self, context: str, at: int) -> tuple[Reading, ...]:
        """The conceivable other readings of the ideograph at ``at`` of a short context."""
        c, out = context[at], []
        old = [self._windows(w) for w in windows(context, at, c)]
        for right in _CONFUSED[c]:
            grams = windows(context, at, right)
            a, b = self._windows(grams[0]), self._windows(grams[1])
            if 2 * (a + b) + min(a, b) <= sum(old):  # longer grams are no commoner than these
                continue
            new = [a, b, *(self._windows(w) for w in grams[2:])]
            if max(new) >= MIN_SUPPORT and sum(new) > sum(old):
                seen = [max(o, 1, round(self._recurrence * n)) for n, o in zip(new, old, strict=True)] if self._recurrence else old
                d = [_ratio(n, o) for n, o in zip(new, seen, strict=True)]
                features = ("z", *(f"z:{i}r{r}" for i, r in enumerate(d)), f"z:m{min(d)}", f"z:x{max(d)}", f"z:s{d[0]}{d[1]}", f"z:t{d[2]}{min(d[3], d[4])}", f"z:o{_bin(seen[2])}n{_bin(new[2])}", f"z:{c}{right}", f"z:{c}{right}{d[2]}")
                out.append((right, features, self.score(features)))
        return tuple(out)

    def edits(self, lines: list[str]) -> Iterator[Edit]:
        """The conceivable edits of a page's lines, each with its place in the line."""
        page = "\n".join(lines)
        bad, stray = garbled(page), _STRAY.search(page)
        clean = [i for i, line in enumerate(lines) if line and not (bad and garbled(line))]
        zh = [i for i in clean if _ZH.search(lines[i])]
        if zh:
            text, owner, starts = joined_ideographs([lines[i] for i in zh])
            readings = self._readings
            for m in _CONFUSED_RE.finditer(text):
                at = m.start()
                found = readings(text[at - 2 : at + 3], 2) if at > 1 else readings(text[: at + 3], at)
                for right, features, score in found:
                    k = owner[at]
                    yield zh[k], _column(lines[zh[k]], at - starts[k]), "replace", m[0], right, features, score
        if stray:
            for i in clean:
                for m in _STRAY.finditer(lines[i]):
                    features = _stray_features(lines[i], m.start())
                    yield i, m.start(), "delete", m[0], "", features, self.score(features)
        if _MIXED.search(page):
            for i in clean:
                for m in _MIXED_NUMBER.finditer(lines[i]):
                    features = _number_features(m[0], lines[i])
                    yield i, m.start(), "word", m[0], m[0].translate(_DIGITS), features, self.score(features)
        if len(zh) == len(clean):
            return
        dense = set(zh)
        latin = [i for i in clean if i not in dense and not (len(lines[i]) < 12 and numbers_of(lines[i]))]
        odd = self._odd(set(_TOKEN.findall("\n".join([lines[i] for i in latin]))))
        for i in latin:
            line = lines[i]
            after = i > 0 and lines[i - 1][-1:] in _SIGNS and _BREAK.search(lines[i - 1])
            before = line[-1] in _SIGNS and _BREAK.search(line)
            if not (after or before or odd):
                continue
            tokens = list(_TOKEN.finditer(line))
            for k, m in enumerate(tokens):
                first, last = after and k == 0, before and k == len(tokens) - 1
                if not (first or last or m[0] in odd):
                    continue
                word = _told(m[0])
                if not word:
                    continue
                found = self._half(word, lines, i, bool(last)) if first or last else self._words(word)
                if found:
                    yield i, m.start() + m[0].index(word), "word", word, *found

    def _odd(self, tokens: set[str]) -> set[str]:
        """The tokens of which another reading is conceivable."""
        tokens -= self._plain_tokens
        odd = {t for t in tokens if (word := _told(t)) and self._words(word)}
        if len(self._plain_tokens) > 1 << 18:
            self._plain_tokens.clear()
        self._plain_tokens |= tokens - odd
        return odd

    def chosen(self, lines: list[str]) -> list[Edit]:
        """The edits to be made, none of which meet, from right to left in each line."""
        best = sorted((e for e in self.edits(lines) if e[-1] > 0), key=lambda e: -e[-1])
        out: list[Edit] = []
        taken: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for edit in best:
            i, at, end = edit[0], edit[1], edit[1] + len(edit[3])
            if all(end <= a or b <= at for a, b in taken[i]):
                taken[i].append((at, end))
                out.append(edit)
        return sorted(out, key=lambda e: (e[0], -e[1]))

    def _half(self, half: str, lines: list[str], i: int, is_left: bool) -> Reading | None:
        """Another reading of half a word that is broken over two lines."""
        j = i + 1 if is_left else i - 1
        other = _TOKEN.findall(lines[j]) if 0 <= j < len(lines) else []
        if not other:
            return None
        whole = half + other[0] if is_left else other[-1] + half
        found = self._words(whole)
        if not found:
            return None
        same = other[0] if is_left else other[-1]
        kept = found[0].endswith(same) if is_left else found[0].startswith(same)
        mine = found[0][: len(found[0]) - len(same)] if is_left else found[0][len(same) :]
        return (mine, *found[1:]) if kept and mine != half else None

    def joins(self, lines: list[str], skip: frozenset[int] = frozenset()) -> Iterator[tuple[int, str, tuple[str, ...]]]:
        """(line, whole word, features) of each line that ends within a word, hyphen last."""
        for i, line in enumerate(lines):
            if line[-1:] not in _SIGNS or not (m := _BREAK.search(line)) or garbled(line):
                continue
            after = next((lines[j].lstrip() for j in range(i + 1, len(lines)) if j not in skip and lines[j].strip()), "")
            n = re.match(r"[^\W\d_㐀-鿿]+", after)
            left, right = m[1], n[0] if n else ""
            whole, compound = self.counts[(left + right).casefold()], self.counts[f"{left}-{right}".casefold()]
            parts = min(self.counts[left.casefold()], self.counts[right.casefold()]) if right else self.counts[left.casefold()]
            features = (
                "j", f"j:c{_bin(compound)}", f"j:w{_bin(whole)}", f"j:r{_ratio(whole, compound)}", f"j:p{_bin(parts)}w{min(1, whole)}c{min(1, compound)}",
                f"j:low{right[:1].islower()}", f"j:none{not right}", f"j:sign{line.rstrip()[-1:]}",
            )
            yield i, left + right, features

    def train(self, pages: list[list[str]], seed: int = 7) -> None:
        """Fits the weights to pages damaged on purpose; what was not touched is to be kept."""
        rng = random.Random(seed)
        recurring = [Editor(self.counts, recurrence=share) for share in RECURRENCE]
        cases = []
        for lines in pages:
            damaged, touched = damage(lines, rng)
            for i, at, _, wrong, right, features, _ in self.edits(damaged):
                key = (i, at, wrong, right)
                if key in touched or not glaring(features):
                    cases.append((features, key in touched))
            hit = {mark[0] for mark in touched}
            again = rng.choice(recurring).edits([line if i in hit else "" for i, line in enumerate(damaged)])
            cases += [(features, True) for i, at, _, wrong, right, features, _ in again if (i, at, wrong, right) in touched]
            intact, breaks = break_words(lines, rng)
            for i, _, features in self.joins(intact):
                if i in breaks:
                    cases.append((features, breaks[i]))
            cases += [(_blank_features(left, right), wanted) for left, right, wanted in cut_lines(lines, rng)]
        self._set(fitted(cases, rng))
        # noise the sample held before was labelled as to be kept: what the first fit takes for noise is left out
        sure = [(features, wanted) for features, wanted in cases if wanted or self.score(features) <= 0]
        self._set(fitted(sure, rng))


def glaring(features: tuple[str, ...]) -> bool:
    """Whether the corpus speaks so much for another reading that it is no example of text to be kept."""
    told = [int(f.partition("r")[2]) for f in features if re.fullmatch(r"z:[0-4]r-?\d+|w:r-?\d+", f)]
    return bool(told) and min(told) >= (3 if len(told) > 1 else 6)


def fitted(cases: list[tuple[tuple[str, ...], bool]], rng: random.Random) -> dict[str, float]:
    """Averaged weights of a perceptron with a margin."""
    weights: dict[str, float] = defaultdict(float)
    total: dict[str, float] = defaultdict(float)
    cases, step = list(cases), 1
    for _ in range(EPOCHS):
        rng.shuffle(cases)
        for features, wanted in cases:
            sign = 1.0 if wanted else -1.0
            if sign * sum(weights[f] for f in features) < MARGIN:
                for f in features:
                    weights[f] += sign
                    total[f] += sign * step
            step += 1
    return {f: w - total[f] / step for f, w in weights.items()}


_DIGITS = str.maketrans("OolISBZ", "0011582")
_LETTERS_FOR = {"0": "Oo", "1": "lI", "5": "S", "8": "B", "2": "Z"}
_MIXED = re.compile(r"\d[OolISBZ]|[OolISBZ]\d")
_MIXED_NUMBER = re.compile(r"(?<![^\W_㐀-鿿])(?=[OolISBZ]*\d)(?=\d*[OolISBZ])[\dOolISBZ]{2,6}(?![^\W_㐀-鿿])")


def _number_features(token: str, line: str) -> tuple[str, ...]:
    letters = "".join(c for c in token if not c.isdigit())
    return "d", f"d:{letters[:2]}", f"d:l{len(token)}", f"d:n{len(letters)}", f"d:alone{len(line.split()) < 4}"
_CONFUSED_RE = re.compile("[" + "".join(sorted(_CONFUSED)) + "]")


def _class(c: str) -> str:
    return "none" if not c else "blank" if c.isspace() else "zh" if _ZH.match(c) else "digit" if c.isdigit() else "word" if c.isalpha() else "sign"


def _stray_features(line: str, at: int) -> tuple[str, ...]:
    c, l, r = line[at], _class(line[at - 1 : at] if at else ""), _class(line[at + 1 : at + 2])
    again = line.count(c)
    bare = len(line.strip()) <= 3 or not re.search(r"\w", line)
    return "s", f"s:{c}", f"s:{l}{r}", f"s:{c}{l}{r}", f"s:again{min(3, again)}", f"s:{c}again{min(3, again)}", f"s:bare{bare}"


def damage(lines: list[str], rng: random.Random) -> tuple[list[str], set[tuple[int, int, str, str]]]:
    """Lines with misread characters, words and stray signs, and the edits that mend them."""
    out, touched = [], set()
    for i, line in enumerate(lines):
        marks: list[list] = []

        def put(line: str, at: int, end: int, bad: str, right: str, place: int, wrong: str) -> str:
            """The line with ``bad`` put in, and the mark of the edit that undoes it."""
            for mark in marks:
                if mark[0] >= end:
                    mark[0] += len(bad) - (end - at)
            marks.append([place, wrong, right])
            return line[:at] + bad + line[end:]

        if len(line.strip()) > 8 and not garbled(line):
            for at, c in enumerate(line):
                if c in _REVERSE and rng.random() < DAMAGE:
                    bad = rng.choice(_REVERSE[c])
                    line = put(line, at, at + 1, bad, c, at, bad)
            if not _ZH.search(line):
                for m in list(_TOKEN.finditer(line))[::-1]:
                    word = m[0]
                    if len(word) > 2 and word.isalpha() and rng.random() < DAMAGE:
                        rules = [(w, r) for w, r in _MISREAD if r in word and r.isalpha() and w.isalnum()]
                        if rules:
                            wrong, right = rng.choice(rules)
                            at = rng.choice([k for k in range(len(word)) if word.startswith(right, k)])
                            bad = word[:at] + wrong + word[at + len(right) :]
                            line = put(line, m.start(), m.end(), bad, word, m.start(), bad)
            numbers = [m for m in re.finditer(r"\d{2,4}", line) if set(m[0]) & set(_LETTERS_FOR)]
            if numbers and rng.random() < 4 * DAMAGE:
                m = rng.choice(numbers)
                at = rng.choice([k for k, c in enumerate(m[0]) if c in _LETTERS_FOR])
                bad = m[0][:at] + rng.choice(_LETTERS_FOR[m[0][at]]) + m[0][at + 1 :]
                line = put(line, m.start(), m.end(), bad, m[0], m.start(), bad)
            if rng.random() < 4 * DAMAGE:
                sign = rng.choice("|~^_`'□丨")
                at = rng.randrange(len(line) + 1)
                line = put(line, at, at, sign, "", at, sign)
        out.append(line)
        touched |= {(i, *mark) for mark in marks}
    return out, touched


def cut_lines(lines: list[str], rng: random.Random) -> Iterator[tuple[str, str, bool]]:
    """(last character, first character, whether a blank stood between) of lines cut where a line may end."""
    for line in lines:
        if len(line) < 13 or garbled(line):
            continue
        for at in {rng.randrange(4, len(line) - 4) for _ in range(CUTS)}:
            left, right = line[at - 1], line[at]
            if right == " " and left != " " != line[at + 1]:
                yield left, line[at + 1], True
            elif " " not in left + right and not (_class(left) == _class(right) == "word" or _class(left) == _class(right) == "digit"):
                yield left, right, False


def _blank_features(left: str, right: str) -> tuple[str, ...]:
    l, r = _class(left), _class(right)
    return "b", f"b:{l}{r}", f"b:{left if l == 'sign' else l}>{r}", f"b:{l}>{right if r == 'sign' else r}"


_REVERSE: dict[str, list[str]] = defaultdict(list)
for _pair in CONFUSED:
    _REVERSE[_pair[1]].append(_pair[0])


def break_words(lines: list[str], rng: random.Random) -> tuple[list[str], dict[int, bool]]:
    """Latin lines cut anew, some within words with a hyphen put in, some at a word's own hyphen."""
    out: list[str] = []
    breaks: dict[int, bool] = {}
    for line in lines:
        if _ZH.search(line) or garbled(line) or _BREAK.search(line):
            continue
        compound = _COMPOUND.search(line)
        if compound:
            breaks[len(out)] = False
            out += [line[: compound.end(1)] + "-", line[compound.start(2) :]]
            continue
        long = [m for m in _WORD.finditer(line) if len(m[0]) > 5 and m[0].isalpha()]
        if long:
            m = rng.choice(long)
            at = m.start() + rng.randrange(2, len(m[0]) - 2)
            breaks[len(out)] = True
            out += [line[:at] + rng.choice("--‐¬"), line[at:]]
        else:
            out.append(line)
    return out, breaks


_ROMAN = re.compile(r"m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})", re.IGNORECASE)
_ROMAN_VALUES = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
_NUMBER_LINE = re.compile(r"[\s\W_]*(?:第|p\.?|page|seite|s\.)?\s*([\dOolI]{1,5}|[ivxlcdmIVXLCDM]{1,9})\s*(?:页|頁)?[\s\W_]*", re.IGNORECASE)
_CHAPTER = re.compile(
    r"(?:第?\s*[\d一二三四五六七八九十百]+\s*[章节節回卷篇部]|[卷章]\s*[\d一二三四五六七八九十百]+|(?:chapter|kapitel|chapitre|section|livre|buch|book|part|teil)\s*[\divxlc]+|\d{1,3}\s*\.)\s*\S", re.IGNORECASE
)
#: Lines from a page's top and foot that may be furniture.
EDGE = 4


def numbers_of(line: str) -> list[tuple[str, int]]:
    """("arabic" or "roman", value) as which a line that holds a number alone can be read."""
    m = _NUMBER_LINE.fullmatch(line.strip())
    if not m:
        return []
    body, out = m[1], []
    digits = body.translate(_DIGITS)
    if digits.isdigit():
        out.append(("arabic", int(digits)))
    if _ROMAN.fullmatch(body):
        values = [_ROMAN_VALUES[c] for c in body.lower()]
        out.append(("roman", sum(-v if v < max(values[k:]) else v for k, v in enumerate(values))))
    return out


def name_of(line: str) -> str:
    """A line's letters and digits, without a page number before or after them."""
    body = re.sub(r"^[\s\W_]*\d{1,4}(?:[\s\W_]{2,}|\s+)(?=\S)|\s[\s\W_]*\d{1,4}(?:\s\d){0,3}[\s\W_]*$|\s+[ivxl]{1,6}[\s\W_]*$", "", line.strip(), flags=re.IGNORECASE)
    return re.sub(r"[\W_]+", "", body).casefold()


def alike(a: str, b: str) -> bool:
    """Whether two names are the same but for a misread character in ten."""
    if a == b:
        return True
    if not a or not b or abs(len(a) - len(b)) > 2 + len(b) // 12 or len(b) < 4:
        return False
    most = max(1, len(b) // 10)
    if len(set(b) - set(a)) > most:  # each missing character costs an edit at least
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1] <= most


FURNITURE = "page_id long, job_key string, book string, page_number int, printed int, line_no int, form string, value int, name string"
COUNT = "high long, low long, n long"
_FURNITURE_TYPES = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string()]
_COUNT_TYPES = [pa.int64()] * 3
_NAMES = [c.split()[0] for c in f"{FURNITURE}, {COUNT}".split(", ")]
_NUMBER_START = re.compile(r"[\s\W_]*[\dOolIivxcdmIVXLCDMPpSs第]")


def edge_lines(lines: list[str], book: str | None, titles: dict[str | None, str]) -> Iterator[tuple[int, str, int, str | None]]:
    """(line number, form, value, name) of a page's lines that may be furniture.

    Page-position features: a number may stand on a line of its own anywhere, a title or a
    chapter's name on the ``EDGE`` lines at the top and the foot.
    """
    filled = [i for i, line in enumerate(lines) if line.strip()]
    if book not in titles:
        titles[book] = name_of(line_form(book or ""))
    title = titles[book]
    edge = set(filled[:EDGE] + filled[-EDGE:])
    if filled:
        yield 0, "page", 0, ""
    for i in filled:
        line = lines[i]
        if _NUMBER_START.match(line) and (values := numbers_of(line)):
            yield from ((i + 1, form, value, None) for form, value in values)
        elif i in edge and not garbled(line):
            if title and abs(len(_NO_LETTER.sub("", line)) - len(title)) <= 12 + len(title) // 12 and alike(name_of(line), title):
                yield i + 1, "title", 0, title
            elif _CHAPTER.match(line.strip()) and not _SENTENCE.search(line.strip()):
                yield i + 1, "chapter", int(bool(_NUMBERED.search(line.rstrip()))), name_of(line)


_NO_LETTER = re.compile(r"[\W_]+")
#: Share of pages or names that is most, and the names that such a share is told by at least.
MOSTLY, MIN_SHOWN = 0.5, 8
#: A number, or a roman one, behind a name and a gap.
_NUMBERED = re.compile(r"\s[\s\W_]*(?:\d{1,4}|[ivxl]{1,6})[\s\W_]*$")
_SENTENCE = re.compile(r"[。！？，；]|[.!?;]\s*$")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    titles: dict[str | None, str] = {}
    for batch in batches:
        words, contexts, rows = Counter(), Counter(), []
        for page, job, book, number, printed, text in zip(*(batch.column(c).to_pylist() for c in ("page_id", "job_key", "book", "page_number", "printed_page", "text")), strict=True):
            if not text:
                continue
            lines = page_lines(text)
            count_page(clean_lines(lines), words, contexts)
            if page is not None:
                shown = int(printed) if printed and printed.strip().isdecimal() else None
                rows += [(page, job, book if name is None else book or job, number, shown, *found, name) for *found, name in edge_lines(lines, book, titles)]
        counts = expanded(words, contexts)
        columns = list(zip(*rows, strict=True)) or [()] * 9
        told = [pa.array(c, t) for c, t in zip(columns, _FURNITURE_TYPES, strict=True)] + [pa.nulls(len(rows), t) for t in _COUNT_TYPES]
        yield pa.RecordBatch.from_arrays(told, _NAMES)
        numbers = [*halves(counts), pa.array(list(counts.values()), pa.int64())]
        yield pa.RecordBatch.from_arrays([*(pa.nulls(len(counts), t) for t in _FURNITURE_TYPES), *numbers], _NAMES)


def read_pages(pages: DataFrame) -> DataFrame:
    """All that is learned of the corpus beforehand, in one pass over the texts, as a written table.

    Rows of FURNITURE for the lines that may be running heads or page numbers, and rows of
    COUNT, the counts of words and windows in each batch of pages.
    """
    columns = pages.select(F.col("page_id").cast("long").alias("page_id"), "job_key", "book", F.col("page_number").cast("int").alias("page_number"), "printed_page", "text")
    return materialised(columns.mapInArrow(_read, f"{FURNITURE}, {COUNT}"), "scan-pages")


def furniture(read: DataFrame) -> DataFrame:
    """``page_id, line_no, kind``: running heads and feet (header) and page numbers, from ``read_pages``.

    A number is its page's own if it stands as far from page_number as most of its job's, or
    is the page's printed_page. A title counts on every page; a chapter's name where an
    earlier page of the book, in any job, had it or one that differs by a misread character,
    or where a number stands behind it and other pages have it too; so the first, the
    chapter's opening, is none. Whether the first of several is an opening at all is told by
    the names that mostly stand with numbers: if theirs come first with one, so do the others.
    """
    found = read.where("form IS NOT NULL").drop("high", "low", "n")
    numbers = found.where("form in ('arabic', 'roman')").withColumn("offset", F.col("page_number") - F.col("value"))
    support = numbers.groupBy("job_key", "form", "offset").agg(F.count_distinct("page_id").alias("n"))
    usual = support.groupBy("job_key", "form").agg(F.max_by("offset", F.struct("n", -F.abs("offset"))).alias("usual"), F.max("n").alias("n"))
    told = numbers.join(usual.where("n >= 2 OR abs(usual) <= 30"), ["job_key", "form"], "left")
    own = (F.col("offset") == F.col("usual")) | ((F.col("form") == "arabic") & (F.col("value") == F.col("printed")))
    page_numbers = told.where(own).select("page_id", "line_no", F.lit("page_number").alias("kind"))
    chapters = found.where("form = 'chapter'")
    names = chapters.groupBy("book", "name").agg(
        F.min("page_number").alias("opening"), F.max("page_number").alias("last"), F.count_distinct("page_number").alias("n"), F.avg("value").alias("numbered"),
        F.max_by("value", -F.col("page_number")).alias("first_numbered"),
    )
    order = Window.partitionBy("book").orderBy("opening", "name")  # one narrow row a name
    seen = found.where("form = 'page'").select("book", (F.col("page_number") + 1).alias("opening")).distinct().withColumn("seen", F.lit(True))
    names = names.select("*", F.lag("name").over(order).alias("before")).join(seen, ["book", "opening"], "left")
    names = materialised(names.withColumn("is_first", F.col("before").isNull() & F.col("seen").isNull()), "chapter-names")
    # where most heads have numbers it shows whether names come up first as heads: a book's first, on its first page, or others
    shown = names.where(f"n >= 3 AND numbered >= {MOSTLY}").groupBy("is_first").agg(F.avg("first_numbered").alias("share"), F.count("*").alias("n"))
    as_heads = [r.is_first for r in shown.collect() if r.share >= MOSTLY and r.n >= MIN_SHOWN]  # two rows at most
    misread = F.coalesce(F.levenshtein("name", "before") <= F.greatest(F.lit(1), F.floor(F.length("name") / 10)), F.lit(False))
    opens = ~F.col("is_first").isin(*as_heads) if as_heads else F.lit(True)
    told = names.select("book", "name", "opening", "last", misread.alias("misread"), opens.alias("opens"))
    running = chapters.join(told, ["book", "name"]).where("page_number > opening OR value = 1 AND last > opening OR misread OR last > opening AND NOT opens")
    heads = running.select("page_id", "line_no").unionByName(found.where("form = 'title'").select("page_id", "line_no"))
    return page_numbers.unionByName(heads.withColumn("kind", F.lit("header"))).distinct()


def trained_editor(pages: DataFrame, read: DataFrame, sample_pages: int = SAMPLE_PAGES) -> Editor:
    """An editor with counts of all pages, fitted to ``sample_pages`` of them at most."""
    editor = Editor(corpus_counts(read))
    sample = pages.where(F.length("text") > 200).select("page_id", "text").orderBy(F.xxhash64("page_id"), "page_id").limit(sample_pages)
    editor.train([page_lines(r.text) for r in sample.collect()])
    return editor


def noisy_lines(text: str, editor: Editor) -> list[tuple[int, str]]:
    """(line number, misread or hyphen) of a page's lines, numbered from 1."""
    lines = page_lines(text)
    found = {(edit[0] + 1, "misread") for edit in editor.edits(lines) if edit[-1] > 0}
    found |= {(i + 1, "hyphen") for i, _, features in editor.joins(lines) if editor.score(features) > 0}
    return sorted(found)


def _finder(model) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        editor = Editor(KeyFiles(model.value[0]), model.value[1])
        for batch in batches:
            rows = [(p, n, k) for p, t in zip(batch.column("page_id").to_pylist(), batch.column("text").to_pylist(), strict=True) if t for n, k in noisy_lines(t, editor)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())],
                ["page_id", "line_no", "kind"],
            )

    return run


def noise(pages: DataFrame) -> DataFrame:
    """``page_id, line_no, kind`` of all noisy lines: hyphen, misread, header, page_number.

    Null and empty texts have none; repeated rows of a page give each case once.
    """
    read = read_pages(pages)
    editor = trained_editor(pages, read)
    model = pages.sparkSession.sparkContext.broadcast((editor.counts.folder, editor.weights))
    rows = pages.where(F.col("page_id").isNotNull()).select(F.col("page_id").cast("long").alias("page_id"), "text")
    edited = rows.mapInArrow(_finder(model), "page_id long, line_no int, kind string")
    return edited.unionByName(furniture(read)).distinct()


def stored_lines(text: str, lines: list[str]) -> list[str]:
    """The lines as stored where they are as long as in one form; else in one form."""
    raw = text.split("\n")
    if len(raw) != len(lines):
        return list(lines)
    return [r[: len(line)] if len(r.rstrip()) == len(line) else line for r, line in zip(raw, lines, strict=True)]


def repaired_text(text: str, dropped: set[int], editor: Editor) -> str:
    """A page as continuous paragraphs, without furniture and with the chosen edits made.

    Each edit is made at its own place. Characters that are not edited stay as stored where
    a line's stored form is as long as the one it was read in.
    """
    lines = page_lines(text)
    shown = stored_lines(text, lines)
    for i, at, _, wrong, right, _, _ in editor.chosen(lines):
        end = at + len(wrong)
        if line_form(shown[i][at:end]) != wrong.rstrip():
            shown[i] = lines[i]
        lines[i] = lines[i][:at] + right + lines[i][end:]
        shown[i] = shown[i][:at] + right + shown[i][end:]
    cut = {i for i, _, features in editor.joins(lines, frozenset(dropped)) if editor.score(features) > 0}
    longest = max(map(len, lines))
    out, last, at_break = [], "", False
    for i, line in enumerate(lines):
        if i in dropped:
            continue
        body = line.strip()
        if not body:
            out.append("\n\n")
            last = ""
            continue
        indented = line[:1] in " \t" and line[:2].strip() == ""
        if last:
            if indented or _ENDED.search(last) and len(last) < 0.7 * longest:
                out.append("\n")
            elif not at_break and editor.blank_between(last, body):
                out.append(" ")
        at_break = i in cut or bool(_BREAK.search(line))
        kept = shown[i].strip()
        out.append(re.sub(r"[-‐­¬]\s*$", "", kept) if i in cut else kept)
        last = body
    return re.sub(r"\n{2,}", "\n", "".join(out)).strip("\n")


_ENDED = re.compile(r"[.!?。！？”]$")


def _repairer(model) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        editor = Editor(KeyFiles(model.value[0]), model.value[1])
        for batch in batches:
            texts = [
                None if t is None else repaired_text(t, {n - 1 for n in d or ()}, editor)
                for t, d in zip(batch.column("text").to_pylist(), batch.column("dropped").to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(texts, pa.string())], ["page_id", "text"])

    return run


def repaired(pages: DataFrame) -> DataFrame:
    """``page_id, text``: each page once, as continuous readable paragraphs (one a line)."""
    read = read_pages(pages)
    editor = trained_editor(pages, read)
    model = pages.sparkSession.sparkContext.broadcast((editor.counts.folder, editor.weights))
    rows = pages.where(F.col("page_id").isNotNull()).select(F.col("page_id").cast("long").alias("page_id"), "text").dropDuplicates(["page_id"])
    dropped = furniture(read).groupBy("page_id").agg(F.collect_set("line_no").alias("dropped"))
    return rows.join(dropped, "page_id", "left").mapInArrow(_repairer(model), "page_id long, text string")
