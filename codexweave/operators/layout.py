"""Reading order of a page's lines: two columns where there is a gutter, else as they came.

A page's boxes are one value of its row, so the work is per row in Arrow batches; nothing is
shuffled or grouped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Shares of the layout's width and counts that make two columns. Fixed values.
MIN_LINES, SIDE_LINES, SIDE_SHARE, GUTTER, OVERLAP, SEPARATION = 20, 5, 0.15, (0.25, 0.75), 0.35, 0.35


def extent(bbox: list | None) -> tuple[float, float, float, float] | None:
    """Left, top, right and bottom of a box of corner points or of four numbers."""
    try:
        points = [list(map(float, p)) for p in bbox or []]
        if len(points) == 1 and len(points[0]) == 4:
            left, top, right, bottom = points[0]
        elif len(points) == 4 and all(len(p) == 1 for p in points):
            left, top, right, bottom = (p[0] for p in points)
        else:
            xs, ys = [p[0] for p in points], [p[1] for p in points]
            left, top, right, bottom = min(xs), min(ys), max(xs), max(ys)
    except (TypeError, ValueError, IndexError):
        return None
    return left, top, right, bottom


def reading_order(blocks: list[tuple[str, list | None]]) -> list[int]:
    """Indices of (text, bbox) blocks in the order to be read.

    Left column, then right, each from top to bottom, if the wide lines' left edges part at a
    gutter in the middle with enough lines on both sides beside each other; lines without a
    box come last. Otherwise the order stays.
    """
    placed = [(i, e, text) for i, (text, bbox) in enumerate(blocks) if (e := extent(bbox))]
    if len(placed) < MIN_LINES:
        return list(range(len(blocks)))
    layout = [p for p in placed if len("".join(p[2].split())) >= 8 and p[1][2] - p[1][0] >= 80]
    layout = layout if len(layout) >= 16 else placed
    left, right = min(p[1][0] for p in layout), max(p[1][2] for p in layout)
    width = right - left
    if width <= 0:
        return list(range(len(blocks)))
    side = max(SIDE_LINES, round(SIDE_SHARE * len(layout)))
    starts = sorted(p[1][0] for p in layout)
    gaps = []
    for k in range(side, len(starts) - side):
        gap, cut = starts[k] - starts[k - 1], (starts[k] + starts[k - 1]) / 2
        if gap < max(90, 0.1 * width):
            continue
        rights = sorted(p[1][2] for p in layout if p[1][0] <= cut)
        edge = rights[round(0.9 * (len(rights) - 1))]
        gutter, middle = starts[k] - edge, ((edge + starts[k]) / 2 - left) / width
        if gutter >= max(15, 0.01 * width) and GUTTER[0] <= middle <= GUTTER[1]:
            gaps.append(((gutter + 0.2 * gap) * min(k, len(starts) - k) / max(k, len(starts) - k), -k, cut))
    if not gaps:
        return list(range(len(blocks)))
    cut = max(gaps)[2]  # the best gap is chosen first; if it fails there are no columns
    one, two = [p for p in layout if p[1][0] <= cut], [p for p in layout if p[1][0] > cut]
    apart = upper_median([p[1][0] for p in two]) - upper_median([p[1][0] for p in one])
    overlap = min(max(p[1][3] for p in s) for s in (one, two)) - max(min(p[1][1] for p in s) for s in (one, two))
    tall = min(max(p[1][3] for p in s) - min(p[1][1] for p in s) for s in (one, two))
    if min(len(one), len(two)) < SIDE_LINES or apart < SEPARATION * width or tall <= 0 or max(0.0, overlap) / tall < OVERLAP:
        return list(range(len(blocks)))
    order = sorted(placed, key=lambda p: (p[1][0] > cut, p[1][1], p[1][0]))
    seen = {p[0] for p in placed}
    return [p[0] for p in order] + [i for i in range(len(blocks)) if i not in seen]


def upper_median(values: list[float]) -> float:
    return sorted(values)[len(values) // 2]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for blocks in batch.column("blocks").to_pylist():
            rows = [((b or {}).get("text") or "", (b or {}).get("bbox")) for b in blocks or []]
            texts.append("\n".join(rows[i][0] for i in reading_order(rows) if rows[i][0].strip()) if blocks else None)
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(texts, pa.string())], ["page_id", "text"])


def reorder(columns: list[str]) -> object:
    """A step over whole page rows: text in reading order where that differs, and whether it does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, changed = [], []
            for text, blocks in zip(batch.column("text").to_pylist(), batch.column("blocks").to_pylist(), strict=True):
                rows = [((b or {}).get("text") or "", (b or {}).get("bbox")) for b in blocks or []]
                order = reading_order(rows)
                changed.append(order != list(range(len(rows))))
                texts.append("\n".join(rows[i][0] for i in order if rows[i][0].strip()) if changed[-1] else text)
            arrays = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(changed, pa.bool_())], [*columns, "_reordered"])

    return run


def ordered_texts(pages: DataFrame) -> DataFrame:
    """``page_id, text``: the text of each page's blocks in reading order; null without blocks."""
    return pages.select("page_id", "blocks").mapInArrow(_texts, "page_id long, text string")
