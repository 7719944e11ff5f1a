"""Repair of first pages on small cases."""

import pytest
from pyspark.sql import functions as F

from codexweave.functions import front_matter as FM


def column(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("book", "want"),
    [("全书：果树卷", ["果树卷"]), ("a: b: c-d", ["c-d", "d"]), ("中国农业百科全书 - 蚕业卷", ["蚕业卷"]), ("论：水利—灌溉分册 上", ["水利—灌溉分册 上", "灌溉分册 上", "上"]), ("无", []), ("书：", []), (None, [])],
)
def test_volume_titles(spark, book, want):
    assert (column(spark, book, FM.volume_titles) or []) == want


@pytest.mark.parametrize(
    ("text", "title", "want"),
    [
        ("果\n树\n卷\n正文", "果树卷", "果树卷\n正文"),
        ("正文\n果\n别的\n卷\n树", "果树卷", "正文\n果树卷\n别的"),
        ("果树\n卷\n正文", "果树卷", "果树卷\n正文"),
        ("水产\n养殖\n正文在此", "水产养殖卷", "水产养殖卷\n正文在此"),
        ("果\n正文在此", "果树卷", "果树卷\n正文在此"),
        ("有果树卷的\n果", "果树卷", "有果树卷的\n果"),
        ("果\n正文", None, "果\n正文"),
        ("", "果树卷", ""),
    ],
)
def test_titles_put_together(spark, text, title, want):
    got = spark.createDataFrame([(text, [title] if title else [])], "x string, t array<string>").select(FM.titled(F.col("x"), F.col("t"))).first()[0]
    assert got == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("前\n言\n正文", "前言\n正文"), ("前\n言语", "前\n言语"), (" 目 \n 录 ", "目录"), ("委\n员会名单", "委员会名单"), ("委\n(甲乙)", "委员\n(甲乙)"), ("总\n主编 甲", "总主编 甲"),
        ("编\n辑\n印\n制：乙", "编辑\n印制：乙"), ("总\n编", "总\n编"), ("", ""),
    ],
)
def test_labels_merged(spark, text, want):
    assert FM.T.stripped is not None
    assert column(spark, text, FM.merged_labels).rstrip() == want


def test_repeated_titles(spark):
    df = spark.createDataFrame([("卷一\nx\n 卷一\n卷二\n卷二", ["卷一", "卷二"]), ("卷一\n卷一", [])], "x string, t array<string>")
    assert [r[0] for r in df.select(FM.without_repeated_titles(F.col("x"), F.col("t"))).collect()] == ["卷一\nx\n卷二", "卷一\n卷一"]


def test_noise_of_first_pages(spark):
    rows = [("书：果树卷", 1, [("S63/12", 0.9), ("图书", 0.9), ("某大学图书馆", 0.9), ("12345", 0.9), ("ISBN7-109", 0.9), ("。,", 0.4), ("果树", 0.3), ("正文", 0.5), (None, 0.1)]), ("书", 9, [("S63/12", 0.9), ("，", 0.5), ("图书", 0.9)])]
    df = spark.createDataFrame(rows, "book string, n int, placed array<struct<text:string,confidence:double>>")
    got = [r[0] for r in df.select(FM.noise_lines(F.col("book"), F.col("n"), F.col("placed"))).collect()]
    assert got == [["S63/12", "图书", "某大学图书馆", "12345", "。,", "正文"], ["，"]]


def test_front_pages_as_a_whole(spark):
    long = "正文" * 80
    rows = [
        (1, "中国农业百科全书：果树卷", 1, "中国农业百科金书\n果\n树\n卷"), (2, "x", 3, "前\n言\n1993年第1版 1093年 16月开本"), (3, "x", 30, "前\n言"), (4, None, 2, None), (5, "x", 2, ""), (6, "x", 9, long),
    ]
    df = spark.createDataFrame(rows, "page_id long, book string, page_number int, text string")
    got = {r.page_id: r for r in FM.with_front_matter(df).collect()}
    assert got[1].text == "中国农业百科全书\n果树卷" and got[1].front_notes == [FM.SERIES_NOTE, FM.VOLUME_NOTE]
    assert got[2].text == "前言\n1993年第1版 1993年 16 开本" and got[2].front_notes == [FM.LABEL_NOTE, FM.IMPRINT_NOTE]
    assert [got[i].text for i in (3, 4, 5, 6)] == ["前\n言", None, "", long] and all(got[i].front_notes == [] for i in (3, 4, 5, 6))
    assert FM.with_front_matter(df.limit(0)).count() == 0
