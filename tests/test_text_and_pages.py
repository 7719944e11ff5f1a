"""Column functions and page operators against small cases and plain Python models."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from codexweave.functions import text as T
from codexweave.operators import pages as P

BLOCKS = "array<struct<text:string,confidence:double,bbox:array<array<double>>>>"
PAGE = f"page_id long, page_number int, printed_page string, text string, confidence double, source string, warnings array<string>, blocks {BLOCKS}"


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


def garble_model(text):
    """The same score in plain Python."""
    n = 5 * len(re.findall(r"\(cid:\d+\)", text)) + 3 * sum(c in "�□▯■" for c in text)
    n += 2 * sum(unicodedata.category(c)[0] == "C" and c not in "\n\r\t" for c in text)
    shown = [c for c in text if not c.isspace()]
    if shown:
        meant = sum(c.isalpha() or c.isdigit() for c in shown) / len(shown)
        n += int((0.35 - meant) * len(text)) if meant < 0.35 else 0
    n += sum(len(m[0]) for m in re.finditer(r"(.)\1{8,}", text))
    return min(1.0, n / max(1, len(text)))


@pytest.mark.parametrize("text", ["", "清楚的文字", "(cid:12)(cid:3)ab", "□□■", "....!!!!----", "aaaaaaaaaaaa bc", "a\tb\r\nc", "\x01\x02abc", "Ⅻ ① ½"])
def test_garble_score(spark, text):
    assert one(spark, text, T.garble_score) == pytest.approx(garble_model(text))


def test_garble_of_null_is_null(spark):
    assert one(spark, None, T.garble_score) is None


@pytest.mark.parametrize(
    "raw, clean",
    [("中 文　间\n\n hy-\nphen ", "中文间\nhyphen"), ("A-\nB", "A-\nB"), ("a\0b", "ab"), ("0CR", "OCR"), ("", "")],
)
def test_cleaned_ocr_text(spark, raw, clean):
    assert one(spark, raw, T.cleaned_ocr_text) == clean


@pytest.mark.parametrize("seconds, words", [(None, "未知"), (3, "3秒"), (123, "2分3秒"), (3723, "1小时2分3秒"), (-5, "0秒")])
def test_duration_text(spark, seconds, words):
    assert one(spark, seconds, T.duration_text, "double" if seconds is None else "int") == words


def test_contents_and_noise(spark):
    assert one(spark, "目 录\n第一章 起源 ........ 3\n第二章 发展 ........ 9", T.contents_like)
    assert not one(spark, "普通的一段话。", T.contents_like)
    assert [one(spark, x, T.is_noise_line) for x in ("7", "○○○", "12", "", "ab")] == [True, True, False, False, False]


def test_front_matter_limits(spark):
    rows = spark.createDataFrame([("短", 21), ("短", 5), ("长" * 200, 5), ("长" * 200 + "ISBN", 5), ("x\n前\n言\ny", 15)], "t string, n int")
    got = [r[0] for r in rows.select(T.front_matter(F.col("t"), F.col("n"))).collect()]
    assert got == [False, True, False, True, True]


def test_prepared_takes_out_the_printed_number(spark):
    body = [(f"第{i}行正文内容", 0.95, [[100.0, 100.0 + 40 * i], [900.0, 100.0 + 40 * i], [900.0, 130.0 + 40 * i], [100.0, 130.0 + 40 * i]]) for i in range(12)]
    blocks = [*body, ("57", 0.99, [[880.0, 1000.0], [900.0, 1000.0], [900.0, 1020.0], [880.0, 1020.0]])]
    text = "\n".join(b[0] for b in blocks)
    df = spark.createDataFrame([(1, 60, None, text, 0.95, "paddleocr", ["旧"], blocks), (2, 60, None, text, 0.95, "paddleocr", None, None)], PAGE)
    rows = {r.page_id: r for r in P.prepared(df).collect()}
    assert rows[1].printed_page == "57" and rows[1].text.endswith("第11行正文内容") and rows[1].warnings == ["旧"]
    assert rows[2].printed_page is None and rows[2].text == text


def test_plate_noise_goes_captions_stay(spark):
    text = "△1 成虫\n2 幼虫\n3 蛹\nxq"
    df = spark.createDataFrame([(1, 60, None, text, 0.95, "paddleocr", None, [("xq", 0.3, [[1.0, 2.0, 3.0, 4.0]]), ("2 幼虫", 0.3, None)])], PAGE)
    assert P.prepared(df).first().text == "△1 成虫\n2 幼虫\n3 蛹"


def test_flat_boxes_count_like_corner_points(spark):
    df = spark.createDataFrame([([("a", 0.9, [[1.0, 2.0, 3.0, 4.0]]), ("b", None, [[1.0, 2.0], [3.0, 2.0], [3.0, 4.0], [1.0, 4.0]]), ("c", 0.5, None)],)], f"blocks {BLOCKS}")
    boxes = df.select(P.boxes(F.col("blocks"))).first()[0]
    assert [(b.text, b.left, b.top, b.right, b.bottom) for b in boxes] == [("a", 1.0, 2.0, 3.0, 4.0), ("b", 1.0, 2.0, 3.0, 4.0)]


def test_best_reading_keeps_text_from_being_lost(spark):
    long = "字" * 200
    kind = "array<struct<confidence:double,text:string>>"
    assert one(spark, [(0.5, long), (0.9, "短")], P.best_reading, kind).text == long
    assert one(spark, [(0.5, long), (0.9, long + "x")], P.best_reading, kind).confidence == 0.9
    assert one(spark, [(0.5, ""), (0.1, "有")], P.best_reading, kind).text == "有"


def test_warnings_in_order_and_refreshed(spark):
    df = spark.createDataFrame([(1, 2, None, "短", 0.5, "paddleocr", None, None), (2, 2, None, None, None, "blank_page", None, None)], PAGE)
    rows = P.with_features(df)
    got = {r.page_id: r.w for r in rows.select("page_id", P.quality_warnings(rows).alias("w")).collect()}
    assert got == {1: ["low_confidence", "short_text", "front_page"], 2: []}
    merged = spark.range(1).select(P.refreshed(F.array(F.lit("x"), F.lit("no_text"), F.lit("diagram")), F.array(F.lit("diagram"), F.lit("low_confidence")), F.array(*map(F.lit, P.WARNINGS)))).first()[0]
    assert merged == ["x", "diagram", "low_confidence"]


def test_empty_table(spark):
    assert P.prepared(spark.createDataFrame([], PAGE)).count() == 0
