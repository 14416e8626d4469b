import math
import random

import numpy as np
import pytest
from pyspark.sql import types as T

from foliospark.operators import detections as D
from foliospark.operators import reading_order as RO
from foliospark.operators.box_ranks import ranks
from foliospark.operators.reading_order import rank_boxes, reading_order

BOX = "page_id long, det_no int, x double, y double, w double, h double, score double"


def boxes(spark, rows, page=1):
    data = [(page, i, *map(float, r[:4]), float(r[4]) if len(r) > 4 else 1.0) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, BOX)


def iou(a, b):
    ix = max(0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]))
    iy = max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
    union = a[2] * a[3] + b[2] * b[3] - ix * iy
    return ix * iy / union if union > 0 else 0


def greedy(rows):
    kept = []
    for i in sorted(range(len(rows)), key=lambda i: (-rows[i][4], i)):
        if all(iou(rows[k], rows[i]) <= 0.5 for k in kept):
            kept.append(i)
    return sorted(kept)


def test_detector_output(spark):
    raw = spark.createDataFrame(
        [
            (1, 0, 2, 100.0, 100.0, 300.0, 200.0, 0.9, 3),   # line, grows by 2 % of its height
            (1, 1, 1, -10.0, -10.0, 500.0, 500.0, 0.8, 0),   # block, only clamped
            (1, 2, 2, 0.0, 0.0, 50.0, 50.0, 0.29, 1),        # below the score
            (1, 3, 7, 0.0, 0.0, 50.0, 50.0, 0.9, 1),         # ignored class
            (1, 4, 17, 0.0, 0.0, 100.0, 50.0, 0.9, 1),       # class 16 counts as a line
            (1, 5, 2, 0.0, 0.0, 4.9, 5.0, 0.9, 1),           # too small
            (1, 6, 2, 790.0, 0.0, 900.0, 100.0, 0.9, 1),     # outside the image after clamping
        ],
        "page_id long, det_no int, label int, x1 double, y1 double, x2 double, y2 double, score double, char_count int",
    )
    images = spark.createDataFrame([(1, 0.5, 800, 700)], "page_id long, scale double, img_w int, img_h int")
    got = {r.det_no: r for r in D.detection_filter(raw, images, ["page_id"]).collect()}
    assert sorted(got) == [0, 1, 4]
    assert (got[0].x, got[0].y, got[0].w, got[0].h) == (200, 196, 400, 208)
    assert (got[1].kind, got[1].x, got[1].y, got[1].w, got[1].h) == ("block", 0, 0, 800, 700)
    assert got[4].class_id == 16


@pytest.mark.parametrize("seed", [11, 12])
def test_suppression_matches_the_walk(spark, seed):
    rng = random.Random(seed)
    pages = {}
    for page in (1, 2, 3):
        n = 150 if page == 1 else 12
        pages[page] = [
            (rng.randrange(0, 120, 10), rng.randrange(0, 90, 10), rng.choice((20, 30, 40)), rng.choice((15, 30)), rng.randrange(20) / 20)
            for _ in range(n)
        ]
        pages[page] += pages[page][: n // 3]  # copies
    df = None
    for page, rows in pages.items():
        part = boxes(spark, rows, page)
        df = part if df is None else df.unionByName(part)
    got = {}
    for r in D.nms_lines(df, ["page_id"]).collect():
        got.setdefault(r.page_id, []).append(r.det_no)
    assert {p: sorted(v) for p, v in got.items()} == {p: greedy(rows) for p, rows in pages.items()}


def d(x, y, w, h):
    return (x, y, w, h, 1.0)


def order(spark, lines, blocks=()):
    rows = boxes(spark, lines)
    areas = boxes(spark, blocks) if blocks else boxes(spark, [d(0, 0, 1, 1)]).where("false")
    placed = D.assign_lines_to_blocks(rows, areas, ["page_id"])
    return [(r.det_no, r.block_id) for r in reading_order(placed, ["page_id"]).orderBy("line_no").collect()]


def test_order_without_blocks(spark):
    assert order(spark, [d(10, 0, 20, 300), d(100, 0, 20, 300)]) == [(1, None), (0, None)]
    assert order(spark, [d(0, 100, 300, 20), d(0, 10, 300, 20)]) == [(1, None), (0, None)]
    assert order(spark, [d(5, 5, 30, 10)]) == [(0, None)]


def test_order_with_two_columns(spark):
    lines = [d(300, 30, 100, 20), d(0, 30, 100, 20), d(300, 0, 100, 20), d(0, 0, 100, 20)]
    got = order(spark, lines, [d(0, 0, 100, 50), d(300, 0, 100, 50)])
    assert [g[0] for g in got] == [3, 1, 2, 0]
    assert [g[1] for g in got] == ["block-1", "block-1", "block-0", "block-0"]


def test_block_coverage(spark):
    most = order(spark, [d(500, 500, 100, 20), d(0, 60, 100, 20), d(0, 30, 100, 20), d(0, 0, 100, 20)], [d(0, 0, 100, 80)])
    assert {b for i, b in most if i} == {"block-0"} and dict(most)[0] is None
    few = order(spark, [d(0, 0, 100, 20), d(0, 100, 100, 20), d(0, 200, 100, 20)], [d(0, 0, 100, 20)])
    assert few == [(0, None), (1, None), (2, None)]


def test_images_with_many_blocks(spark):
    lines = boxes(spark, [d(i * 10, 0, 8, 8) for i in range(20)])
    areas = boxes(spark, [d(i * 10 - 1, -1, 40, 12) for i in range(20)])
    one = {r.det_no: (r.block_no, r.block_id) for r in D.assign_lines_to_blocks(lines, areas, ["page_id"]).collect()}
    assert [one[i][0] for i in range(6)] == [0, 0, 0, 0, 1, 2]


def test_blocks_of_all_sizes(spark):
    rng = random.Random(4)
    spot = lambda size: (rng.uniform(-50, 400), rng.uniform(0, 400), rng.uniform(1, size), rng.uniform(1, size), rng.random())
    lines, areas = [spot(30) for _ in range(150)], [spot(rng.choice((3, 40, 300))) for _ in range(60)]
    got = {r.det_no: r._hit for r in D.assign_lines_to_blocks(boxes(spark, lines), boxes(spark, areas), ["page_id"]).withColumnRenamed("block_no", "_hit").collect()}
    expected = {}
    for i, (x, y, w, h, _) in enumerate(lines):
        cx, cy = x + w / 2, y + h / 2
        expected[i] = next((k for k, (bx, by, bw, bh, _) in enumerate(areas) if bx <= cx <= bx + bw and by <= cy <= by + bh), None)
    used = sum(v is not None for v in expected.values()) >= 0.7 * len(lines)
    assert got == (expected if used else dict.fromkeys(expected))


def slow_rank(items):
    """Brute force with cell sets, recursion on nested lists."""
    if len(items) == 1:
        return [0]
    x_lo, y_lo = min(b[0] for b in items), min(b[1] for b in items)
    wide, high = max(b[0] + b[2] for b in items) - x_lo, max(b[1] + b[3] for b in items) - y_lo
    gx, gy = (100 * (wide / high), 100.0) if high >= wide else (100.0, 100 * (high / wide))
    w, h = math.ceil(gx) + 1, math.ceil(gy) + 1
    norm = []
    for bx, by, bw, bh in (b[:4] for b in items):
        a, c = math.floor((bx - x_lo) * gx / wide), math.floor((by - y_lo) * gy / high)
        e, f = min(w - 1, math.ceil((bx + bw - x_lo) * gx / wide)), min(h - 1, math.ceil((by + bh - y_lo) * gy / high))
        norm.append((a, c, max(a + 1, e), max(c + 1, f)))
    ink = {(x, y) for a, c, e, f in norm for x in range(a, min(e, w)) for y in range(c, min(f, h))}

    def valley(counts):
        if len(counts) <= 1:
            return 0, len(counts), 0
        best, i = (0, 0), 0
        while i < len(counts):
            j = i
            while j < len(counts) and counts[j] == min(counts):
                j += 1
            if j - i > best[1] - best[0]:
                best = (i, j)
            i = max(j, i + 1)
        return *best, (-min(counts) / max(counts) if max(counts) else 0)

    def cut(area):
        x0, y0, x1, y1 = area
        cols = [sum((x, y) in ink for y in range(y0, y1)) for x in range(x0, x1)]
        rows = [sum((x, y) in ink for x in range(x0, x1)) for y in range(y0, y1)]
        (xa, xb, xs), (ya, yb, ys) = valley(cols), valley(rows)
        sideways = ys < xs or (ys == xs and xb - xa >= yb - ya)
        edges = [x0, x0 + xa, x0 + xb, x1] if sideways else [y0, y0 + ya, y0 + yb, y1]
        kids = [((a, y0, b, y1) if sideways else (x0, a, x1, b)) for a, b in zip(edges, edges[1:]) if a < b]
        kids = [k for k in kids if k != area]
        return {"area": area, "side": sideways, "kids": [cut(k) for k in kids], "in": []}

    root = cut((0, 0, w, h))

    def leaves(node):
        return [node] if not node["kids"] else [x for k in node["kids"] for x in leaves(k)]

    for i, b in enumerate(norm):
        def share(leaf):
            l0, t0, l1, t1 = leaf["area"]
            ix, iy = max(0, min(b[2], l1) - max(b[0], l0)), max(0, min(b[3], t1) - max(b[1], t0))
            size = (b[2] - b[0]) * (b[3] - b[1]) + (l1 - l0) * (t1 - t0) - ix * iy
            return ix * iy / size if ix * iy else 0
        max(leaves(root), key=share)["in"].append(i)

    def members(node):
        return node["in"] if not node["kids"] else [i for k in node["kids"] for i in members(k)]

    def upright(node):
        inside = members(node)
        return 2 * sum(norm[i][2] - norm[i][0] < norm[i][3] - norm[i][1] for i in inside) > len(inside)

    def read(node):
        if not node["kids"]:
            key = (lambda i: (-norm[i][0], norm[i][1])) if upright(node) else (lambda i: (norm[i][1], norm[i][0]))
            return sorted(node["in"], key=key)
        kids = node["kids"][::-1] if node["side"] and upright(node) else node["kids"]
        return [i for k in kids for i in read(k)]

    place = {i: n for n, i in enumerate(read(root))}
    return [place[i] for i in range(len(items))]


def test_ranks_match_brute_force(spark):
    rng = random.Random(2)
    pages = {}
    for page in range(14):
        tall = page % 2
        n = rng.randrange(2, 14)
        pages[page] = [
            (rng.randrange(0, 400), rng.randrange(0, 500), *((rng.randrange(10, 30), rng.randrange(60, 200)) if rng.random() < (0.8 if tall else 0.2)
             else (rng.randrange(60, 200), rng.randrange(10, 30))))
            for _ in range(n)
        ]
    df = None
    for page, rows in pages.items():
        part = boxes(spark, rows, page)
        df = part if df is None else df.unionByName(part)
    got = {}
    for r in rank_boxes(df, ["page_id"], "det_no", "place").collect():
        got.setdefault(r.page_id, {})[r.det_no] = r.place
    for page, rows in pages.items():
        assert [got[page][i] for i in range(len(rows))] == slow_rank(rows), page


def test_best_leaves_by_brute_force(spark):
    """Overlaps counted on common grid lines equal those of every box with every leaf."""
    rng = random.Random(12)
    grid_rows, tree_rows, want = [], [], {}
    for group in range(8):
        w, h = rng.randrange(2, 60), rng.randrange(2, 60)
        mesh = np.zeros((h, w), int)
        shapes = []
        for _ in range(25):
            x, y = rng.randrange(w), rng.randrange(h)
            shapes.append((x, y, x + rng.randrange(1, 12), y + rng.randrange(1, 12)))
            mesh[y : shapes[-1][3], x : shapes[-1][2]] = 1
        shapes += shapes[:5]
        leaves = [(i, *box, path) for i, (*box, path) in enumerate(RO._cut_regions(mesh))]
        tree_rows.append((group, leaves))
        for no, (a, b, c, d) in enumerate(shapes):
            grid_rows.append((group, no, a, b, c, d))
            scores = []
            for leaf, x0, y0, x1, y1, _ in leaves:
                inter = max(0, min(c, x1) - max(a, x0)) * max(0, min(d, y1) - max(b, y0))
                scores.append((inter / ((c - a) * (d - b) + (x1 - x0) * (y1 - y0) - inter) if inter else 0.0, -leaf))
            want[group, no] = -max(scores)[1]
    trees = spark.createDataFrame(tree_rows, T.StructType([T.StructField("g", T.IntegerType()), T.StructField("_tree", T.ArrayType(RO.LEAF))]))
    grid = spark.createDataFrame(grid_rows, "g int, no int, _nx0 int, _ny0 int, _nx1 int, _ny1 int")
    placed = RO._best_leaves(grid, trees, ["g"])
    assert {(r["g"], r["no"]): r["_leaf"] for r in placed.collect()} == want
    assert "_tree" not in placed.columns


def test_unfolded_boxes_are_not_broadcast(spark):
    """Estimates do not see that boxes unfold to cells and grid lines, so the driver would hold them all."""
    from foliospark.operators import detections as D
    from foliospark.operators import reading_order as R

    boxes = spark.createDataFrame([(1, 1, 0.9, 0.0, 0.0, 20.0, 20.0)], "page_id long, det_no int, score double, x double, y double, w double, h double")
    grid = spark.createDataFrame([(1, 0, 0, 2, 2)], "page_id long, _nx0 int, _ny0 int, _nx1 int, _ny1 int")
    tree = "array(named_struct('leaf', 0, 'x0', 0, 'y0', 0, 'x1', 2, 'y1', 2, 'path', array(0))) _tree"
    found = D._overlaps(boxes, ["page_id"], 0.5), R._best_leaves(grid, spark.sql(f"select 1L page_id, {tree}"), ["page_id"])
    for rows in (*found, D.assign_lines_to_blocks(boxes, boxes, ["page_id"])):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan
    assert all("Broadcast" not in rows._jdf.queryExecution().executedPlan().toString() for rows in found)


def test_suppression_of_small_and_crowded_images_agrees(spark, monkeypatch):
    """Small images need no join; rounds of joins, for crowded ones, keep the same rows. Copies and equal scores are among them."""
    rng = np.random.default_rng(4)
    rows = []
    for page in range(12):
        for n in range(3 * page):
            x, y = (float(v) for v in rng.integers(0, 60, 2))
            w, h = (float(v) for v in rng.integers(0, 40, 2))
            rows += [(page, 2 * n + i, float(rng.integers(0, 5)) / 4, x, y, w, h, f"{page}/{n}/{i}") for i in range(1 + n % 2)]
    lines = spark.createDataFrame(rows, "page_id long, det_no int, score double, x double, y double, w double, h double, note string")
    small = D.nms_lines(lines, ["page_id"])
    assert "Join" not in small._jdf.queryExecution().executedPlan().toString() and small.columns == lines.columns
    got = sorted(map(tuple, small.collect()))
    for limit in (0, 10):
        monkeypatch.setattr(D, "CROWDED", limit)
        assert sorted(map(tuple, D.nms_lines(lines, ["page_id"]).collect())) == got
    assert 12 <= len(got) < len(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_order_of_few_and_of_crowded_images_agrees(spark, monkeypatch, seed):
    """Images that are ordered together in one task have the order of those that Spark joins."""
    rng = random.Random(seed)
    rows = []
    for page in range(60):
        for no in range(rng.choice([1, 2, 3, 4, 7, 12, 30])):
            long, short = float(rng.randrange(40, 200)), float(rng.randrange(10, 30))
            w, h = (short, long) if rng.random() < page % 5 / 4 else (long, short)
            block = f"block-{rng.randrange(3)}" if page % 3 == 0 and rng.random() < 0.6 else None
            if page % 4 == 0:
                at = float(rng.randrange(4) * 60), float(rng.randrange(5) * 40)
            else:
                at = rng.uniform(0, 400), rng.uniform(0, 500)
            rows.append((page, no, rng.randrange(5) / 5, *at, 0.0 if page == 7 else w, h, block))
    lines = spark.createDataFrame(rows, "page_id long, det_no int, score double, x double, y double, w double, h double, block_id string")
    want = sorted(map(tuple, RO._ordered_by_joins(lines, ["page_id"]).select(*lines.columns, "line_no").collect()))
    monkeypatch.setattr(RO, "_ordered_by_joins", None)
    got = sorted(map(tuple, RO.reading_order(lines, ["page_id"]).select(*lines.columns, "line_no").collect()))
    assert got == want and len(got) == len(rows)


def test_crowded_images_are_ordered_by_joins(spark, monkeypatch):
    """One image too large for a task and one with a box that has no number go the other way, and none is lost."""
    monkeypatch.setattr(RO, "CROWDED", 4)
    rows = [(page, no, 0.5, 10.0 * no, 5.0, 8.0, None if (page, no) == (3, 1) else 4.0, None) for page, n in ((1, 3), (2, 6), (3, 2)) for no in range(n)]
    lines = spark.createDataFrame(rows, "page_id long, det_no int, score double, x double, y double, w double, h double, block_id string")
    seen, joins = [], RO._ordered_by_joins
    monkeypatch.setattr(RO, "_ordered_by_joins", lambda df, keys: seen.extend(r.page_id for r in df.select("page_id").distinct().collect()) or joins(df, keys))
    got = {(r.page_id, r.det_no): r.line_no for r in RO.reading_order(lines, ["page_id"]).collect()}
    assert sorted(seen) == [2, 3] and {k: v for k, v in got.items() if k[0] < 3} == {(p, no): no for p, n in ((1, 3), (2, 6)) for no in range(n)}
    assert {k for k in got if k[0] == 3} == {(3, 0), (3, 1)}


def test_ranks_of_many_groups_match_brute_force():
    rng = random.Random(7)
    groups = []
    for i in range(200):
        n = rng.choice([1, 2, 3, 4, 6, 9, 17, 33])
        whole = lambda lo, hi: float(rng.randrange(lo, hi))
        groups.append([(whole(0, 9), whole(0, 9), whole(1, 5), whole(1, 5)) if i % 2 else (rng.uniform(0, 400), rng.uniform(0, 500), rng.uniform(5, 99), rng.uniform(5, 99)) for _ in range(n)])
    got = ranks(np.array([len(g) for g in groups]), *np.array([b for g in groups for b in g]).T).tolist()
    for g in groups:
        assert got[: len(g)] == slow_rank(g)
        del got[: len(g)]
