import pytest

from foliospark.operators import chapters as C
from foliospark.operators import toc as T

LINES = "book_id string, page_ord int, line_no int, text string, w double, h double"


def lines(spark, pages, size=10.0, book="b"):
    rows = [
        (book, p, i, t, s, s * 8)
        for p, page in enumerate(pages)
        for i, (t, s) in enumerate((x if isinstance(x, tuple) else (x, size)) for x in page)
    ]
    return spark.createDataFrame(rows, LINES)


def entries(spark, texts, across=False):
    pages = texts if texts and isinstance(texts[0], list) else [texts]
    rows = T.parse_toc_entries(lines(spark, pages), across_pages=across).orderBy("page_ord", "line_no").collect()
    return [(r.title, r.printed_page, r.level) for r in rows]


CASES = [
    (["第1章 はじめに ........ 3", "第2章 手法 ........ 25"], [("第1章 はじめに", 3, 1), ("第2章 手法", 25, 1)]),
    (["第１章　はじめに………１２"], [("第1章 はじめに", 12, 1)]),
    (["序章 出発 7"], [("序章 出発", 7, 1)]),
    (["第3章 結果と考察", "48"], [("第3章 結果と考察", 48, 1)]),
    (["Ⅰ 総論 ..... 9"], [("I 総論", 9, 1)]),
    (["目次", "Chapter 3", "序文 iv", "第1章 はじめに ..... 3"], [("第1章 はじめに", 3, 1)]),
    (["付録 ..... 0", "年表 ..... 12345"], []),
    (
        ["第一章 発端", "一", "第二章 邂逅", "二一", "第四章 結末", "八九"],
        [("第一章 発端", 1, 1), ("第二章 邂逅", 21, 1), ("第四章 結末", 89, 1)],
    ),
    (["これは唯一の方法である"], []),
    (["習慣と継続の「仕組み化」", "|", "|", "62"], [("習慣と継続の「仕組み化」", 62, 1)]),
    (["第3章 結果と考察", "……", "48"], [("第3章 結果と考察", 48, 1)]),
    (["Contents", "第1章 序論", "1", "1.1 研究背景", "2"], [("第1章 序論", 1, 1), ("1.1 研究背景", 2, 2)]),
    (["題", "5", "6"], [("題", 5, 1)]),
]


@pytest.mark.parametrize("texts,expected", CASES)
def test_entries(spark, texts, expected):
    assert entries(spark, texts) == expected


def test_levels(spark):
    got = entries(spark, ["第1章 概要 ..... 3", "1.1 背景 ..... 4", "1-2 目的 ..... 6", "(1) 補足 ..... 7", "1. Intro ..... 8"])
    assert [g[2] for g in got] == [1, 2, 2, 2, 1]


def test_pending_title_crosses_pages_only_when_parsing_a_book(spark):
    pages = [["第1章 はじめに"], ["12", "第2章", "|"], ["...", "30"]]
    assert entries(spark, pages) == []
    assert entries(spark, pages, across=True) == [("第1章 はじめに", 12, 1), ("第2章", 30, 1)]


def pages_of(spark, n, book="b"):
    return spark.createDataFrame([(book, f"p{i}", i) for i in range(n)], "book_id string, page_id string, ord int")


def toc(k):
    return [f"第{i}章 題名 ........ {i * 10 + k}" for i in range(1, 7)]


PROSE = ["これは本文である。", "次の行もそうである。", "終わり"]


def found(spark, pages, total):
    return [r.ord for r in T.detect_toc_pages(pages_of(spark, total), lines(spark, pages)).orderBy("ord").collect()]


def test_detects_the_first_block_only(spark):
    assert found(spark, [PROSE, toc(1), toc(100), PROSE, toc(200)], 30) == [1, 2]


def test_continuation_page_with_few_entries(spark):
    assert found(spark, [toc(1), ["第7章 結び .... 90", "索引 .... 99"], PROSE], 30) == [0, 1]


def test_page_without_result_ends_the_block(spark):
    rows = lines(spark, [toc(1), [], toc(50)])
    got = T.detect_toc_pages(pages_of(spark, 30), rows).collect()
    assert [r.ord for r in got] == [0]
    missing = T.unscanned_pages(pages_of(spark, 10), spark.createDataFrame([("b", "p0"), ("b", "p2")], "book_id string, page_id string"))
    assert [r.page_id for r in missing.collect()] == ["p1"]


def test_nothing_outside_the_scan_window(spark):
    assert found(spark, [PROSE, PROSE, PROSE, toc(1)], 10) == []


def test_headline_page(spark):
    page = [("第1章 始まり", 51.0), ("12", 16.0), ("副題の行です", 28.0), ("要約の文", 19.0), ("要約の文", 19.0),
            ("要約の文", 19.0), ("第2章 終わり", 51.0), ("34", 16.0), ("要約の文", 19.0), ("要約の文", 19.0)]
    assert found(spark, [page], 10) == [0]
    falling = [(t if t != "34" else "3", s) for t, s in page]
    assert found(spark, [falling], 10) == []


def test_body_start(spark):
    pages = pages_of(spark, 4)
    pick = lambda ids: spark.createDataFrame([("b", i) for i in ids], "book_id string, page_id string")
    start = lambda ids, given=None: T.resolve_body_start(pages, pick(ids), given).first().body_start
    assert start(["p1", "p0"]) == 2
    assert start(["p3"]) == 3
    assert start([]) == 0
    assert start(["p1"], pick(["p0"])) == 0
    with pytest.raises(Exception, match="page not found"):
        start(["p1"], pick(["gone"]))


def test_parse_toc_reads_pages_in_book_order_and_keeps_old_chapters(spark):
    pages = pages_of(spark, 5).unionByName(pages_of(spark, 3, "other"))
    rows = lines(spark, [["目次", "第1章 はじめに ..... 1"], ["第2章 手法 ..... 2", "遠い ... 99"]])
    chosen = spark.createDataFrame([("b", "p1"), ("b", "p0"), ("other", "p0")], "book_id string, page_id string")
    start = spark.createDataFrame([("b", 2), ("other", 0)], "book_id string, body_start int")
    old = spark.createDataFrame(
        [("b", 0, "x", "p0", 1), ("other", 0, "kept", "p1", 1)], "book_id string, seq int, title string, page_id string, level int"
    )
    got = T.parse_toc(chosen, rows, pages, start, old).orderBy("book_id", "seq").collect()
    assert [(r.book_id, r.title, r.page_id) for r in got] == [
        ("b", "第1章 はじめに", "p2"), ("b", "第2章 手法", "p3"), ("b", "遠い", "p4"), ("other", "kept", "p1"),
    ]


CH = "book_id string, chapter_id string, seq int, title string, page_id string, level int"


def chapters(spark, *rows):
    return spark.createDataFrame([("b", c, i, t, p, lv) for i, (c, t, p, lv) in enumerate(rows)], CH)


def named(spark, ids):
    return spark.createDataFrame([("b", p, i) for i, p in enumerate(ids)], "book_id string, page_id string, ord int")


def test_sort_and_export(spark):
    rows = chapters(spark, ("c2", "節", "b", 2), ("x", "x", "zzz", 1), ("c1", "章", "a", 1), ("c3", "c3", "b", 2), ("e", "  ", "a", 1))
    order = C.sort_chapters(rows, named(spark, ["a", "b", "c"])).orderBy("seq").collect()
    assert [r.chapter_id for r in order] == ["c1", "e", "c2", "c3", "x"]
    out = C.chapters_to_page_index(rows, named(spark, ["a", "b"])).orderBy("node_no").collect()
    assert [(r.title, r.page_index, r.level) for r in out] == [("章", 0, 1), ("節", 1, 2), ("c3", 1, 2)]


@pytest.mark.parametrize(
    "old,new,on,expected",
    [
        ("abc", "ac", "b", ["c"]),
        ("abc", "ab", "c", ["b"]),
        ("xabc", "xmc", "ab", ["m", "m"]),
        ("a", "", "a", []),
        ("ab", "a", "a", ["a"]),
        ("ab", "a", "q", []),
    ],
)
def test_remap(spark, old, new, on, expected):
    rows = chapters(spark, *[(f"c{i}", "t", p, 1) for i, p in enumerate(on)])
    empty = named(spark, ["_"]).where("false")
    got = C.remap_chapters(rows, named(spark, old), named(spark, new) if new else empty).orderBy("seq").collect()
    assert [r.page_id for r in got] == expected


def test_outline(spark):
    rows = [("b", i, t, 0, lv) for i, (t, lv) in enumerate([("o", 2), ("o1", 2), ("A", 1), ("A1", 2), ("A2", 2), ("B", 1)])]
    tree = spark.createDataFrame(rows, "book_id string, node_no int, title string, page_index int, level int")
    got = {r.title: r for r in C.outline_links(tree).collect()}
    assert {t: got[t].parent_no for t in got} == {"o": None, "o1": 0, "A": None, "A1": 2, "A2": 2, "B": None}
    assert (got["A"].prev_no, got["A"].next_no, got["A"].first_child, got["A"].last_child, got["A"].n_children) == (0, 5, 3, 4, 2)
    assert (got["A1"].prev_no, got["A1"].next_no, got["A2"].prev_no, got["A2"].next_no) == (None, 4, 3, None)
    assert (got["B"].next_no, got["B"].n_children, got["B"].outline_total) == (None, 0, 6)


def test_edit_chapters(spark):
    rows = chapters(spark, ("a", "A", "p0", 1), ("b", "B", "p1", 1), ("c", "C", "p2", 1))
    pages = named(spark, ["p0", "p1", "p2", "p3"])
    patches = spark.createDataFrame(
        [("b", "a", "A!", "p3", None)], "book_id string, chapter_id string, new_title string, new_page_id string, new_level int"
    )
    deletes = spark.createDataFrame([("b", "b")], "book_id string, chapter_id string")
    adds = spark.createDataFrame([("b", "n1", 0), ("b", "n2", 1)], "book_id string, chapter_id string, add_no int")
    got = C.edit_chapters(rows, pages, patches=patches, deletes=deletes, adds=adds).orderBy("seq").collect()
    assert [(r.chapter_id, r.title, r.page_id, r.seq) for r in got] == [
        ("c", "C", "p2", 0), ("a", "A!", "p3", 1), ("n1", "", "p3", 2), ("n2", "", "p3", 3),
    ]
