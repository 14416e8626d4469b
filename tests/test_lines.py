from foliospark.operators import edits as E
from foliospark.operators import lines as L

SCHEMA = (
    "book_id string, page_id long, line_no int, line_id string, x double, y double, w double, h double, text string,"
    " edited boolean, block_id string"
)


def page(spark, rows, page_id=1):
    """rows: (line_id, text, block_id, (x, y, w, h))"""
    data = [("b", page_id, i, r[0], *map(float, r[3]), r[1], False, r[2]) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA)


UNIT = (0, 0, 1, 1)


def test_paragraphs(spark):
    rows = page(
        spark,
        [("l0", "吾輩は", "b1", (10, 0, 50, 20)), ("l1", "単独", None, UNIT), ("l2", "猫である", "b1", (0, 30, 40, 20)), ("l3", "終", None, UNIT)],
    )
    got = L.build_paragraphs(rows).orderBy("para_no").collect()
    assert [(r.paragraph_id, r.text) for r in got] == [("l0", "吾輩は猫である"), ("l1", "単独"), ("l3", "終")]
    assert (got[0].x, got[0].y, got[0].w, got[0].h) == (0, 0, 60, 50)


def pages(spark, n):
    return spark.createDataFrame([("b", i, i) for i in range(n)], "book_id string, page_id long, ord int")


def test_book_text(spark):
    rows = page(spark, [("a0", "一行目", None, UNIT), ("a1", "二行目", None, UNIT)], 0).unionByName(
        page(spark, [("c0", "三", None, UNIT), ("c1", "", None, UNIT), ("c2", "四", None, UNIT)], 2)
    ).unionByName(page(spark, [("d0", "", None, UNIT)], 3))
    text = L.book_text(pages(spark, 4), rows).collect()
    assert [(r.part_no, r.text) for r in text] == [(0, "一行目\n二行目\n\n三\n四")]
    parts = L.book_text(pages(spark, 4), rows, per_part=2).orderBy("part_no").collect()
    assert [r.text for r in parts] == ["一行目\n二行目", "三\n四"]
    empty = L.book_text(pages(spark, 2), rows.where("page_id = 3")).collect()
    assert [(r.part_no, r.text) for r in empty] == [(0, "")]
    assert L.has_text(pages(spark, 4), rows).first().has_text is True
    assert L.has_text(pages(spark, 4), rows.where("page_id = 3")).first().has_text is False


def test_title_guess(spark):
    rows = page(
        spark,
        [("l0", "小", None, (0, 0, 100, 12)), ("l1", "大", None, (0, 0, 48, 300)), ("l2", "  ", None, (0, 0, 999, 999)), ("l3", "大2", None, (0, 0, 90, 48))],
    )
    ranks = L.rank_lines_by_size(rows).orderBy("size_rank").collect()
    assert [r.line_id for r in ranks] == ["l1", "l3", "l0"]
    assert {r.page_id: r.title for r in L.guess_title(pages(spark, 2), rows).collect()} == {0: "", 1: "大"}


def test_autofill_title(spark):
    rows = page(spark, [("l0", "猫", None, UNIT)], 0)
    books = spark.createDataFrame(
        [("b", "", None, "k1"), ("c", "", "k1", "k1"), ("d", "mine", None, "k1"), ("e", "", None, None)],
        "book_id string, title string, applied_ocr_key string, ocr_key string",
    )
    got = {r.book_id: (r.title, r.applied_ocr_key) for r in L.autofill_title(books, pages(spark, 1), rows).collect()}
    assert got == {"b": ("猫", "k1"), "c": ("", "k1"), "d": ("mine", "k1"), "e": ("", None)}


LOG = "book_id string, page_id long, seq long, op string, line_id string, text string, after_line_id string, to_index int"


def test_replay_matches_plain_lists(spark):
    import random

    rng = random.Random(5)
    base = {p: [(f"{p}-{i}", f"t{i}", False) for i in range(4)] for p in (1, 2, 3)}
    rows = page(spark, [(a, b, None, UNIT) for a, b, _ in base[1]], 1)
    for p in (2, 3):
        rows = rows.unionByName(page(spark, [(a, b, None, UNIT) for a, b, _ in base[p]], p))
    log, state = [], {p: list(v) for p, v in base.items()}
    for seq in range(300):
        p = 1 if rng.random() < 0.7 else rng.choice((2, 3, 9))
        op = rng.choice(["update", "update", "add", "delete", "move"])
        known = [line[0] for line in state.get(p, [])] + ["nobody"]
        target = rng.choice(known)
        entry = ("b", p, seq, op, f"n{seq}" if op == "add" else target, f"e{seq}" if op == "update" else None,
                 target if op == "add" else None, rng.randrange(-2, 9) if op == "move" else None)
        log.append(entry)
        lines = state.get(p)
        if lines is None:
            continue
        ids = [line[0] for line in lines]
        if op == "add":
            at = ids.index(target) + 1 if target in ids else len(lines)
            lines.insert(at, (f"n{seq}", "", True))
        elif target in ids:
            i = ids.index(target)
            if op == "update":
                lines[i] = (target, f"e{seq}", True)
            else:
                line = lines.pop(i)
                if op == "move":
                    lines.insert(max(0, min(entry[7], len(lines))), line)
    rng.shuffle(log)
    got = E.replay_line_edits(rows, spark.createDataFrame(log, LOG)).orderBy("page_id", "line_no").collect()
    result = {}
    for r in got:
        result.setdefault(r.page_id, []).append((r.line_id, r.text, r.edited))
    assert result == {p: v for p, v in state.items() if v}


def test_replay_on_blank_and_emptied_pages(spark):
    rows = page(spark, [("l0", "a", None, UNIT)], 1).unionByName(page(spark, [("l0", "a", None, UNIT)], 4))
    log = [("b", 1, 7, "delete", "l0", None, None, None), ("b", 2, 8, "add", "n0", None, None, None), ("b", 2, 9, "update", "n0", "x", None, None),
           ("b", 3, 9, "add", "n1", None, None, None), ("b", 5, 6, "update", "nobody", "x", None, None)]
    results = spark.createDataFrame([("b", 2), ("b", 4), ("b", 5), ("b", 6)], "book_id string, page_id long")
    names = ["page_id", "line_no", "line_id", "text", "edited", "last_edit"]

    def got(*more):
        return [tuple(r) for r in E.replay_line_edits(rows, spark.createDataFrame(log, LOG), *more).select(*names).orderBy("page_id").collect()]

    emptied, kept = (1, None, None, None, None, 7), (4, 0, "l0", "a", False, None)
    assert got(results) == [emptied, (2, 0, "n0", "x", True, 9), kept, (5, None, None, None, None, 6)]
    assert got() == [emptied, kept]


def test_add_and_move(spark):
    rows = page(spark, [(f"l{i}", str(i), None, UNIT) for i in range(4)])
    adds = spark.createDataFrame(
        [("b", 1, "n0", "l1", 0, 0.0, 0.0, 1.0, 1.0), ("b", 1, "n1", "l1", 1, 0.0, 0.0, 1.0, 1.0), ("b", 1, "n2", None, 2, 0.0, 0.0, 1.0, 1.0)],
        "book_id string, page_id long, line_id string, after_line_id string, add_no int, x double, y double, w double, h double",
    )
    got = E.add_line(rows, adds).orderBy("line_no").collect()
    assert [r.line_id for r in got] == ["l0", "l1", "n1", "n0", "l2", "l3", "n2"]

    def moved(line, to):
        moves = spark.createDataFrame([("b", 1, line, to)], "book_id string, page_id long, line_id string, to_index int")
        return [r.line_id for r in E.move_line(rows, moves).orderBy("line_no").collect()]

    assert moved("l0", 2) == ["l1", "l2", "l0", "l3"]
    assert moved("l3", -5) == ["l3", "l0", "l1", "l2"]
    assert moved("l1", 99) == ["l0", "l2", "l3", "l1"]
    assert moved("zz", 1) == ["l0", "l1", "l2", "l3"]


def test_pages_without_lines(spark):
    from foliospark.operators import lines as L
    from foliospark.operators import pages as P

    pages = spark.createDataFrame([("b", 1, 0), ("b", 2, 1), ("b", 3, 2)], "book_id string, page_id long, ord int")
    lines = spark.createDataFrame([("b", 1, 0, "x", "t", True), ("b", 3, 0, "y", "t", False)], "book_id string, page_id long, line_no int, line_id string, text string, edited boolean")
    results = pages.where("page_id < 3")
    counts = L.ocr_status(pages, lines, results).first()
    assert (counts.n_not_run, counts.n_done, counts.n_edited) == (0, 2, 1)
    assert [r.page_id for r in P.ocr_targets(pages.select("book_id", "page_id"), pages, lines.where("page_id = 1"), results=results).collect()] == [3]
    blank = P.upsert_ocr(lines, lines.where("false"), pages, results=pages)
    assert [r.page_id for r in blank.collect()] == [1]
    geometry = ["cast(0 as double) x", "cast(0 as double) y", "cast(1 as double) w", "cast(1 as double) h"]
    adds = spark.range(2).selectExpr("'b' book_id", "2L page_id", "concat('n', id) line_id", "cast(null as string) after_line_id", "id add_no", *geometry)
    wide = lines.selectExpr("*", "cast(null as string) block_id", *geometry)
    got = E.add_line(wide, adds, results).where("page_id = 2").orderBy("line_no").collect()
    assert [(r.line_id, r.line_no) for r in got] == [("n0", 0), ("n1", 1)]
