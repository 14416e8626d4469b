import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foliospark.operators import pixels as P
from foliospark.operators.decode import greedy_decode

KEY = ["page_id"]


def ink_image(spark, rects, ink=0, width=60, height=400):
    grey = np.full((height, width), 255)
    for x, y, w, h in rects:
        grey[y : y + h, x : x + w] = ink
    rows = [(1, x, y, int(v), int(v), int(v)) for (y, x), v in np.ndenumerate(grey)]
    return spark.createDataFrame(rows, "page_id long, x int, y int, r int, g int, b int")


def glyphs(count, top=4):
    return [(13, top + i * 30, 24, 24) for i in range(count)]


def splits(spark, rects, ink=0, box=(10, 0, 30, 400), width=60, height=400):
    boxes = spark.createDataFrame([(1, 1, *map(float, box))], "page_id long, line_id long, x double, y double, w double, h double")
    pixels = ink_image(spark, rects, ink, width, height)
    runs = P.ink_runs(P.ink_profile(pixels, boxes, KEY), boxes, KEY)
    return P.trailing_splits(runs, boxes, KEY).orderBy("cand_no").collect()


LAST = 4 + 5 * 30 + 24


def test_no_candidates(spark):
    assert splits(spark, [(10, 10, 300, 30)], box=(0, 0, 400, 60), width=400, height=60) == []
    assert splits(spark, glyphs(12)) == []
    assert splits(spark, [*glyphs(6), (16, 230, 18, 12)], ink=230) == []
    assert splits(spark, [*glyphs(4), *glyphs(4, 200)]) == []


def test_page_number_below_a_gap(spark):
    (one,) = splits(spark, [*glyphs(6), (16, 230, 18, 12)])
    assert (one.head_x, one.head_y, one.head_w, one.head_h) == (10, 0, 30, LAST + 2)
    assert (one.tail_x, one.tail_y, one.tail_w, one.tail_h) == (14, 228, 22, 16)


def test_rule_is_not_part_of_the_number(spark):
    first = splits(spark, [*glyphs(6), (25, 200, 1, 12), (25, 216, 1, 12), (16, 234, 18, 12)])[0]
    assert (first.head_h, first.tail_y) == (LAST + 2, 232)


def test_longest_tail_first(spark):
    ys = [s.tail_y for s in splits(spark, [*glyphs(6), (16, 218, 18, 3), (14, 230, 22, 3), (14, 249, 22, 3)])]
    assert ys[0] == 216 and ys == sorted(ys) and 247 in ys


def plain_levels(values):
    import math

    s = sorted(values)
    lo, hi = s[math.floor(len(s) * 0.01)], s[math.ceil(len(s) * 0.99) - 1]
    clamp = lambda v, a, b: min(b, max(a, v))
    contrast = clamp(clamp(255 / max(hi - lo, 1), 0.1, 4) * 100 - 100, -100, 100)
    brightness = clamp(-((lo + hi) / 2 - 128) * ((100 + contrast) / 100), -100, 100)
    return math.floor(brightness + 0.5), math.floor(contrast + 0.5)


@pytest.mark.parametrize(
    "values", [[round(i / 100 * 255) for i in range(101)], list(range(100, 151)), [40] * 51, [0] * 10, [7, 200, 3]]
)
def test_levels_match_the_sorted_rule(spark, values):
    rows = spark.createDataFrame([(1, v, v, v) for v in values], "page_id long, r int, g int, b int")
    got = P.auto_levels(rows, KEY).first()
    assert (got.brightness, got.contrast) == plain_levels(values)


def decode(spark, ids, charset, vocab=6):
    rows = [(1, p, t, 5.0 if t == best else 0.0) for p, best in enumerate(ids) for t in range(vocab)]
    chars = spark.createDataFrame(list(enumerate(charset, start=1)), "tok int, ch string")
    return greedy_decode(spark.createDataFrame(rows, "line_id long, pos int, tok int, logit double"), chars, ["line_id"]).first().text


def test_decode(spark):
    abc = ["x", "y", "z", "c", "d"]
    assert decode(spark, [4, 5], abc) == "cd"
    assert decode(spark, [4, 0, 5], abc) == "c"
    assert decode(spark, [1, 4, 2, 3, 5], abc) == "cd"
    assert decode(spark, [4, 4, 5, 5], abc) == "ccdd"
    assert decode(spark, [7, 4], abc, vocab=8) == "c"
    assert decode(spark, [0], abc) == ""
    assert decode(spark, [4, 5], ["x", "y", "z", "\U0002231E", "あ"]) == "\U0002231Eあ"


def test_decode_ties_and_nan(spark):
    rows = [(1, 0, 4, 2.0), (1, 0, 5, 2.0), (1, 0, 0, float("nan")), (1, 1, 5, 1.0), (1, 1, 0, 0.0)]
    chars = spark.createDataFrame([(4, "c"), (5, "d")], "tok int, ch string")
    assert greedy_decode(spark.createDataFrame(rows, "line_id long, pos int, tok int, logit double"), chars, ["line_id"]).first().text == "cd"


def test_accept_split(spark):
    boxes = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 100.0), (1, 2, 20.0, 0.0, 10.0, 100.0)], "page_id long, line_id long, x double, y double, w double, h double")
    names = [f"{p}_{c}" for p in ("head", "tail") for c in "xywh"]
    cands = spark.createDataFrame(
        [(1, 1, 0, *[float(i) for i in range(8)], "a"), (1, 1, 1, *[float(i) for i in range(8, 16)], " 二一 "), (1, 2, 0, *[0.0] * 8, "$")],
        "page_id long, line_id long, cand_no int, " + ", ".join(f"{n} double" for n in names) + ", tail_text string",
    )
    got = P.accept_trailing_split(boxes, cands, KEY).orderBy("line_id", "piece_no").collect()
    assert [(r.line_id, r.piece_no, r.kind, r.text, r.x) for r in got] == [(1, 0, "head", None, 8.0), (1, 1, "tail", "二一", 12.0), (2, 0, "whole", None, 20.0)]
    assert F is not None


@pytest.mark.parametrize("name", ["ink_profile", "ink_runs", "trailing_splits", "accept_trailing_split"])
def test_unfolded_rows_are_not_broadcast(spark, name):
    """Estimates do not see that a few parts unfold to many pixels and box rows; broadcasting these fails on larger tables."""
    from foliospark.catalog import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "Broadcast" not in plan


def test_image_levels_follow_their_sql(spark, tmp_path):
    """Documents whose bytes give ends on which the two orders of multiplication differ."""
    import duckdb

    from foliospark.catalog import ORACLES, QUERIES

    # an image of doc_id 1 mod 9 has nine pixels a row: half of them an ASCII tone, half two letters of two bytes
    tone = lambda r, g, b: round(0.299 * r + 0.587 * g + 0.114 * b)
    upper = {tone(r, g, b): bytes([r, g, b, 0x80]).decode() for r in range(0xC2, 0xE0) for g in range(0x80, 0xC0) for b in range(0xC2, 0xE0)}
    pairs = [(7, 172), (7, 194), (12, 186), (32, 176), (7, 173), (65, 160)]
    rows = [(1 + 9 * i, chr(lo) * 72 + upper[hi] * 18, "s") for i, (lo, hi) in enumerate(pairs)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con, columns = duckdb.connect(), "page_id, lo, hi, brightness, contrast"
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(f"select {columns} from ({ORACLES['image_auto_levels']})").fetchall()
    got = QUERIES["image_auto_levels"](spark, str(tmp_path)).select(*columns.split(", ")).collect()
    assert sorted(map(tuple, got)) == sorted(want) and [(lo, hi) for _, lo, hi, _, _ in sorted(want)] == pairs


def test_found_rows_leave_in_bounded_frames(spark, monkeypatch):
    """The rows of many images of one batch are not held together."""
    monkeypatch.setattr(P, "ROWS", 100)
    sizes = []

    def seen(self, function, schema):
        row = np.zeros((50, 4, 4), np.uint8)
        row[:, :2] = 255
        box = {"line_id": 1, "x": 0.0, "y": 0.0, "w": 4.0, "h": 50.0}
        batch = pd.DataFrame([(n, 4, 50, row.tobytes(), [box]) for n in range(40)], columns=["page_id", "img_w", "img_h", "rgba", "_boxes"])
        sizes.extend(len(frame) for frame in function(iter([batch])))
        return self

    images = spark.createDataFrame([], "page_id long, img_w int, img_h int, rgba binary")
    boxes = spark.createDataFrame([], "page_id long, line_id long, x double, y double, w double, h double")
    monkeypatch.setattr(type(images), "mapInPandas", seen)
    P.image_ink_profile(images, boxes, KEY)
    assert sum(sizes) == 40 * 50 and max(sizes) <= 150
