import pytest
from pyspark.sql import functions as F

from foliospark.functions import geometry as G
from foliospark.functions import text as X


def values(spark, fn, inputs, schema="v string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, {schema}")
    return [r.out for r in rows.select("i", fn("v").alias("out")).orderBy("i").collect()]


def test_file_names(spark):
    cases = {
        "a\\b": "a_b.txt", "a/b": "a_b.txt", "a:b?": "a_b_.txt", "a\u0001b\u001fc": "a_b_c.txt", "..": "ocr.txt",
        ".": "ocr.txt", "   ": "ocr.txt", "": "ocr.txt", None: "ocr.txt", "我輩は猫": "我輩は猫.txt",
    }
    assert values(spark, X.text_file_name, list(cases)) == list(cases.values())
    assert values(spark, lambda c: X.export_file_name(c, "pdf"), ["  a:b ", "", None]) == ["a_b.pdf", "book.pdf", "book.pdf"]


def test_trailing_number_text(spark):
    good = ["62", "004", "１５", "二一", " 6 2 "]
    bad = ["a", "---", "$35", "発端", "12345", ""]
    assert values(spark, X.trailing_number_text, good) == ["62", "004", "15", "二一", "62"]
    assert values(spark, X.trailing_number_text, bad) == [None] * len(bad)


def test_white_space_outside_ascii(spark):
    assert values(spark, X.nfkc_trim, ["　第１章 ", "﻿ x  "]) == ["第1章", "x"]
    assert values(spark, X.is_blank, ["　 ", "", "x"]) == [True, True, False]


def test_tail_number_and_titles(spark):
    tail = values(spark, X.toc_tail_number, ["第1章 はじめに ........ 3", "年表 ..... 12345", "序文 iv", "a12\n"])
    assert [(t.title, t.page) if t else None for t in tail] == [("第1章 はじめに", 3), None, None, ("a", 12)]
    assert values(spark, X.bare_page_number, ["48", "二一", "12345", "第1"]) == [48, 21, None, None]
    assert values(spark, X.is_valid_title, ["Chapter", "chapter.", "第", "Chapter 3x", "12"]) == [False, False, False, True, False]
    assert values(spark, X.toc_level, ["1.1 a", "1-2 b", "第 三 節", "( 1 ) x", "2) y", "Section 4", "§ 1", "第1章", "1. x"]) == [2] * 7 + [1, 1]
    assert values(spark, X.is_toc_keyword, ["目 次", "Table of Contents", "contents list"]) == [True, True, False]


def test_natural_order(spark):
    names = ["scan_10.jpg", "scan_9.jpg", "scan.jpg", "scan_009.jpg", "Scan_1.jpg", "10", "9a"]
    rows = spark.createDataFrame([(n,) for n in names], "v string")
    got = [r.v for r in rows.orderBy(X.natural_sort_key("v"), "v").collect()]
    assert got == ["9a", "10", "Scan_1.jpg", "scan.jpg", "scan_009.jpg", "scan_9.jpg", "scan_10.jpg"]


def test_markup_time_and_labels(spark):
    assert values(spark, X.escape_xml, ["<a & 'b' \"c\">"]) == ["&lt;a &amp; &apos;b&apos; &quot;c&quot;&gt;"]
    row = spark.sql("select timestamp'2024-05-06 07:08:09.123' t").select(X.iso_seconds_z("t").alias("z")).first()
    assert row.z == "2024-05-06T07:08:09Z"
    row = spark.sql("select 'width' m, 0 w, cast(null as int) h, 0 b, 0 c, cast(null as int) q").select(
        X.resize_label("m", "w", "h").alias("r"), X.tone_label("b", "c").alias("t"), X.quality_label("q").alias("q")
    ).first()
    assert tuple(row) == (None, None, "画質 75")


def test_sizes(spark):
    one = spark.sql("select 2480 w, 3508 h, 'width' m, 1080 tw, 1920 th")
    fit = one.select(G.fit_within("w", "h", 320).alias("f")).first().f
    assert (fit.width, fit.height) == (226, 320)
    size = one.select(G.target_size("w", "h", "m", "tw", "th").alias("s")).first().s
    assert (size.width, size.height) == (1080, 1528)


def test_half_rounding(spark):
    row = spark.sql("select -2.5D a, 2.5D b").select(G.half_up(F.col("a")).alias("a"), G.byte(F.col("b")).alias("b")).first()
    assert (row.a, row.b) == (-2, 2)


@pytest.mark.parametrize(
    "start,end,view,expected",
    [
        ((10, 20), (110, 220), (0, 0, 200, 400), (50.0, 100.0, 500.0, 1000.0)),
        ((110, 220), (10, 20), (0, 0, 200, 400), (50.0, 100.0, 500.0, 1000.0)),
        ((-50, -50), (100, 100), (0, 0, 200, 400), (0.0, 0.0, 500.0, 500.0)),
        ((10, 10), (17, 100), (0, 0, 200, 400), None),
        ((10, 10), (100, 100), (0, 0, 0, 400), None),
        ((300, 10), (400, 100), (0, 0, 200, 400), None),
    ],
)
def test_drag(spark, start, end, view, expected):
    lit = lambda t: tuple(F.lit(float(v)) for v in t)
    box = spark.range(1).select(G.drag_to_box(lit(start), lit(end), lit(view), lit((1000, 2000))).alias("b")).first().b
    assert (tuple(box) if box else None) == expected


def test_asset_problem(spark):
    rows = spark.createDataFrame(
        [(1, b"<html>", "x"), (2, b"\x08" * 10, "text/html"), (3, b"\x08" * 10, "x"), (4, b"\x08" * 200, "x"), (5, b"", "x")],
        "i int, content binary, kind string",
    )
    got = [r.p for r in rows.select("i", X.asset_problem("content", "kind", 100).alias("p")).orderBy("i").collect()]
    html = "モデルではなくHTMLが返りました"
    assert got == [html, html, "モデルとしては小さすぎます (10 バイト)", None, "モデルとしては小さすぎます (0 バイト)"]
