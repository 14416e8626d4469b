"""Reading order by recursive cuts along white space.

The work is split so that only small, bounded data reaches Python:

1. Spark scales the boxes of each group to a grid of at most 101 x 101 cells and paints them as bit masks, one row
   of two 51-bit words per grid line. ``bit_or`` combines them before and after the shuffle, so a group has at most
   101 rows whatever the number of its boxes.
2. ``_cut_regions`` (Python, per group) cuts the painted grid into leaf regions.
3. Spark gives each box the leaf with the highest overlap, found on common grid lines, and counts boxes per leaf.
4. ``_leaf_order`` (Python, per group) turns leaf counts into the order of the leaves.
5. Spark numbers the boxes by leaf and position with the bucketed numbering.

Most images hold few lines. ``reading_order`` shuffles those once and ranks the boxes of many of them together
(``box_ranks``); the steps above are left for crowded ones.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.operators.box_ranks import GRID, ranks
from foliospark.operators.detections import CROWDED
from foliospark.plans.ordered import number_rows, slot
from foliospark.plans.session import cut_lineage, spread, stored

BLOCKS = 2**50  # blocks are numbered below zero by so much
WORD = 51  # bits per word; two words cover 0..101

LEAF = T.StructType(
    [
        T.StructField("leaf", T.IntegerType()),
        T.StructField("x0", T.IntegerType()),
        T.StructField("y0", T.IntegerType()),
        T.StructField("x1", T.IntegerType()),
        T.StructField("y1", T.IntegerType()),
        # Steps from the root: twice the position among the siblings, plus one below a left-right cut.
        T.StructField("path", T.ArrayType(T.IntegerType())),
    ]
)
ORDERED_LEAF = T.StructType(
    [
        T.StructField("leaf", T.IntegerType()),
        T.StructField("place", T.IntegerType()),
        T.StructField("vertical", T.BooleanType()),
    ]
)


def _widest_valley(profile: np.ndarray) -> tuple[int, int, float]:
    """Start, end and depth of the longest run of the profile's minimum (the first one on ties)."""
    if profile.size <= 1:
        return 0, int(profile.size), 0.0
    low, high = int(profile.min()), int(profile.max())
    at_low = np.concatenate(([0], (profile == low).astype(np.int8), [0]))
    edges = np.flatnonzero(np.diff(at_low))
    starts, ends = edges[0::2], edges[1::2]
    i = int(np.argmax(ends - starts))
    return int(starts[i]), int(ends[i]), (-low / high if high else 0.0)


def _cut_regions(mesh: np.ndarray) -> list[tuple[int, int, int, int, list[int]]]:
    """Leaf regions of a painted grid in depth-first order."""
    leaves: list[tuple[int, int, int, int, list[int]]] = []
    todo = [(0, 0, mesh.shape[1], mesh.shape[0], [], False)]
    while todo:
        x0, y0, x1, y1, path, blank = todo.pop()
        across = None if blank else mesh[y0:y1, x0:x1].sum(axis=0)
        painted = 0 if blank else int(across.sum())
        if painted == 0 or painted == (x1 - x0) * (y1 - y0):  # even areas have no valley
            leaves.append((x0, y0, x1, y1, path))
            continue
        xa, xb, xs = _widest_valley(across)
        ya, yb, ys = _widest_valley(mesh[y0:y1, x0:x1].sum(axis=1))
        # The axis whose valley is nearer to empty is cut; on equal depth the longer valley, then left-right.
        left_right = ys < xs or (ys == xs and xb - xa >= yb - ya)
        if left_right:
            stops, clear = [x0, x0 + xa, x0 + xb, x1], xs == 0
            parts = [(a, y0, b, y1, clear and i == 1) for i, (a, b) in enumerate(zip(stops, stops[1:])) if a < b]
        else:
            stops, clear = [y0, y0 + ya, y0 + yb, y1], ys == 0
            parts = [(x0, a, x1, b, clear and i == 1) for i, (a, b) in enumerate(zip(stops, stops[1:])) if a < b]
        if len(parts) == 1:  # nothing was cut off
            leaves.append((x0, y0, x1, y1, path))
            continue
        children = [(*part[:4], [*path, 2 * i + int(left_right)], part[4]) for i, part in enumerate(parts)]
        todo.extend(reversed(children))
    return leaves


@F.pandas_udf(T.ArrayType(LEAF))
def _leaves(rows: pd.Series, grid_w: pd.Series, grid_h: pd.Series) -> pd.Series:
    bits = np.arange(WORD)
    out = []
    for masks, w, h in zip(rows, grid_w, grid_h):
        mesh = np.zeros((int(h), int(w)), dtype=np.int64)
        for m in masks:
            word = np.array([m["low"], m["high"]], dtype=np.int64)
            mesh[m["y"]] = ((word[:, None] >> bits) & 1).reshape(-1)[: int(w)]
        out.append(
            [
                {"leaf": i, "x0": a, "y0": b, "x1": c, "y1": d, "path": path}
                for i, (a, b, c, d, path) in enumerate(_cut_regions(mesh))
            ]
        )
    return pd.Series(out)


@F.pandas_udf(T.ArrayType(ORDERED_LEAF))
def _leaf_order(leaves: pd.Series, counts: pd.Series) -> pd.Series:
    out = []
    for tree, filled in zip(leaves, counts):
        paths = {node["leaf"]: tuple(node["path"]) for node in tree}
        total: dict[tuple[int, ...], int] = {}
        tall: dict[tuple[int, ...], int] = {}
        for c in filled:
            path = paths[c["leaf"]]
            for depth in range(len(path) + 1):
                head = path[:depth]
                total[head] = total.get(head, 0) + c["n"]
                tall[head] = tall.get(head, 0) + c["n_tall"]
        upright = {head: total[head] < 2 * tall[head] for head in total}

        def key(leaf: int) -> list[int]:
            path = paths[leaf]
            # Below a left-right cut, upright text is read from right to left.
            return [-step if step % 2 and upright[path[:d]] else step for d, step in enumerate(path)]

        ordered = sorted((c["leaf"] for c in filled), key=key)
        out.append(
            [{"leaf": leaf, "place": i, "vertical": upright[paths[leaf]]} for i, leaf in enumerate(ordered)]
        )
    return pd.Series(out)


def rank_boxes(boxes: DataFrame, keys: Sequence[str], item: str, name: str) -> DataFrame:
    """Adds the reading position ``name`` (from 0) of each box (x, y, w, h) within its group.

    ``item`` is an integer column that identifies a box in its group and decides ties.
    """
    keys = list(keys)
    right, bottom = F.col("x") + F.col("w"), F.col("y") + F.col("h")
    frame = boxes.groupBy(*keys).agg(
        F.min("x").alias("_x0"),
        F.min("y").alias("_y0"),
        (F.max(right) - F.min("x")).alias("_pw"),
        (F.max(bottom) - F.min("y")).alias("_ph"),
        F.count(F.lit(1)).alias("_n"),
    )
    portrait = F.col("_ph") >= F.col("_pw")
    flat = (F.col("_pw") == 0) | (F.col("_ph") == 0)
    pw, ph = F.nullif("_pw", F.lit(0.0)), F.nullif("_ph", F.lit(0.0))
    full = F.lit(float(GRID))
    frame = frame.withColumns(
        {
            "_gx": F.when(portrait, full * (F.col("_pw") / ph)).otherwise(full),
            "_gy": F.when(portrait, full).otherwise(full * (F.col("_ph") / pw)),
        }
    ).withColumns(
        {
            "_flat": flat,
            "_w": F.when(flat, 2).otherwise(F.ceil("_gx") + 1).cast("int"),
            "_h": F.when(flat, 2).otherwise(F.ceil("_gy") + 1).cast("int"),
        }
    )
    # A box alone in its group needs no cutting.
    everything = boxes.join(frame.hint("merge"), keys)
    alone = everything.where(F.col("_n") == 1).select(*boxes.columns, F.lit(0).alias(name))
    scaled = everything.where(F.col("_n") > 1)

    def along(low, size, origin, grid, extent, cells):
        ratio = lambda v: (v - F.col(origin)) * F.col(grid) / F.nullif(F.col(extent), F.lit(0.0))
        a = F.greatest(F.lit(0), F.floor(ratio(F.col(low))))
        b = F.least(F.col(cells) - 1, F.ceil(ratio(F.col(low) + F.col(size))))
        start = F.when(F.col("_flat"), 0).otherwise(a)
        end = F.when(F.col("_flat"), 1).otherwise(F.greatest(a + 1, b))
        return start.cast("int"), end.cast("int")

    nx0, nx1 = along("x", "w", "_x0", "_gx", "_pw", "_w")
    ny0, ny1 = along("y", "h", "_y0", "_gy", "_ph", "_h")
    cells = [nx0.alias("_nx0"), ny0.alias("_ny0"), nx1.alias("_nx1"), ny1.alias("_ny1")]
    grid = scaled.select(*boxes.columns, "_w", "_h", *cells)

    # Paint. A shape that occurs often is painted once.
    shapes = grid.select(*keys, "_w", "_h", "_nx0", "_ny0", "_nx1", "_ny1").distinct()

    def word(offset: int):
        lo = F.greatest(F.lit(0), F.least(F.lit(WORD), F.col("_nx0") - offset))
        hi = F.greatest(F.lit(0), F.least(F.lit(WORD), F.least("_nx1", "_w") - offset))
        power = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int"))
        return F.when(hi > lo, power(hi) - power(lo)).otherwise(F.lit(0).cast("long"))

    painted = (
        shapes.select(
            *keys,
            "_w",
            "_h",
            word(0).alias("low"),
            word(WORD).alias("high"),
            F.explode(F.sequence(F.col("_ny0"), F.least("_ny1", "_h") - 1)).alias("y"),
        )
        .groupBy(*keys, "y")
        .agg(F.bit_or("low").alias("low"), F.bit_or("high").alias("high"), F.first("_w").alias("_w"), F.first("_h").alias("_h"))
    )
    trees = (
        spread(painted, *keys)
        .groupBy(*keys)
        .agg(F.collect_list(F.struct("y", "low", "high")).alias("_rows"), F.first("_w").alias("_w"), F.first("_h").alias("_h"))
        .select(*keys, _leaves("_rows", "_w", "_h").alias("_tree"))
    )
    trees = stored(trees, "order-trees")

    placed = stored(_best_leaves(grid, trees, keys), "order-placed")
    tall = (F.col("_nx1") - F.col("_nx0")) < (F.col("_ny1") - F.col("_ny0"))
    counts = (
        placed.groupBy(*keys, "_leaf")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(tall).alias("n_tall"))
        .groupBy(*keys)
        .agg(F.collect_list(F.struct(F.col("_leaf").alias("leaf"), "n", "n_tall")).alias("_counts"))
    )
    order = (
        counts.join(trees, keys)
        .select(*keys, F.explode(_leaf_order("_tree", "_counts")).alias("_o"))
        .select(*keys, F.col("_o.leaf").alias("_leaf"), F.col("_o.place").alias("_place"), F.col("_o.vertical").alias("_vertical"))
    )
    ready = placed.join(order, [*keys, "_leaf"])
    first = F.when(F.col("_vertical"), -F.col("_nx0")).otherwise(F.col("_ny0"))
    second = F.when(F.col("_vertical"), F.col("_ny0")).otherwise(F.col("_nx0"))
    numbered = number_rows(ready, keys, [F.col("_place"), first, second, slot(item)], [F.col(item)], name)
    return numbered.select(*boxes.columns, name).unionByName(alone)


CELLS = ["_nx0", "_ny0", "_nx1", "_ny1"]


def _best_leaves(grid: DataFrame, trees: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``_leaf``: the first leaf with the highest overlap (intersection over union) of each box, 0 without any.

    Leaves and distinct shapes of boxes are unfolded to grid lines and meet by an equal key, (group, line): a line holds
    a few leaves beside each other. Their common cells, summed by shape and leaf, are the intersection. So a box meets
    the leaves around it, and no list of leaves travels with it.
    """
    leaves = trees.select(*keys, F.explode("_tree").alias("_l")).select(*keys, "_l.leaf", "_l.x0", "_l.y0", "_l.x1", "_l.y1")
    bands = leaves.withColumn("_y", F.explode(F.sequence(F.col("y0"), F.col("y1") - 1)))
    shapes = grid.select(*keys, *CELLS).distinct()
    lines = shapes.withColumn("_y", F.explode(F.sequence(F.col("_ny0"), F.col("_ny1") - 1)))
    common = F.least(F.col("_nx1"), F.col("x1")) - F.greatest(F.col("_nx0"), F.col("x0"))
    # Estimates do not see the unfolding, so the join asks for a shuffle: a broadcast would hold all lines in the driver.
    met = lines.join(bands.hint("shuffle_hash"), [*keys, "_y"]).where(common > 0)
    other = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    sums = met.groupBy(*keys, *CELLS, "leaf").agg(F.sum(common).alias("_in"), F.first(other).alias("_other"))
    own = (F.col("_nx1") - F.col("_nx0")) * (F.col("_ny1") - F.col("_ny0"))
    share = F.col("_in") / (own + F.col("_other") - F.col("_in"))
    best = sums.groupBy(*keys, *CELLS).agg(F.max_by("leaf", F.struct(share, -F.col("leaf"))).alias("_best"))
    return grid.join(best.hint("merge"), [*keys, *CELLS], "left").withColumn("_leaf", F.coalesce("_best", F.lit(0))).drop("_best")


def reading_order(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds ``line_no``: lines in reading order, first by block group, then inside the group.

    ``lines`` come from ``assign_lines_to_blocks``. Lines without a block are groups of their own. Images of at most
    ``CROWDED`` lines are shuffled once; in larger ones, and where a box has no number on a side, Spark orders the lines.
    """
    keys = list(keys)
    lines = stored(lines, "order-lines")
    numbers = F.abs(F.col("x") + F.col("y") + F.col("w") + F.col("h")) < F.lit(float("inf"))
    counts = lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.count_if(numbers).alias("_good"))
    crowded = cut_lineage(counts.where((F.col("_n") > CROWDED) | (F.col("_good") < F.col("_n"))).select(*keys))
    if crowded.isEmpty():
        return _ordered(lines, keys)
    few, many = lines.join(crowded, keys, "left_anti"), lines.join(crowded, keys, "left_semi")
    return _ordered(few, keys).unionByName(_ordered_by_joins(many, keys))


def _block_seq():
    return F.regexp_extract("block_id", "([0-9]+)$", 1).try_cast("long")


def _ordered(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Orders the lines of all images of an Arrow batch together."""
    columns = lines.columns
    rest = [c for c in columns if c not in {*keys, "det_no"}]
    listed = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("_rank"), "det_no", _block_seq().alias("_block"), *rest)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("_lines")
            sizes, found = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten()
            if not len(found):
                continue
            image = np.repeat(np.arange(len(sizes)), sizes)
            place = np.arange(len(image)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            # blocks come first, in the order of their ids, then single lines; this decides ties
            block = found.field("_block")
            group = np.where(block.is_valid().to_numpy(zero_copy_only=False), block.fill_null(0).to_numpy() - BLOCKS, place)
            order = np.lexsort((place, group, image))
            image, group, place = image[order], group[order], place[order]
            x, y, w, h = (found.field(c).to_numpy(zero_copy_only=False)[order] for c in ("x", "y", "w", "h"))
            heads = np.flatnonzero((np.diff(image, prepend=-1) != 0) | (np.diff(group, prepend=group[0]) != 0))
            members = np.diff(np.append(heads, len(image)))
            left, top = np.minimum.reduceat(x, heads), np.minimum.reduceat(y, heads)
            wide, high = np.maximum.reduceat(x + w, heads) - left, np.maximum.reduceat(y + h, heads) - top
            outer = ranks(np.bincount(image[heads], minlength=len(sizes)), left, top, wide, high)
            order = order[np.lexsort((ranks(members, x, y, w, h), np.repeat(outer, members), image))]
            number = (np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
            rows, images = found.take(pa.array(order)), pa.array(image)
            data = [batch.column(c).take(images) if c in keys else rows.field(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*data, pa.array(number)], [*columns, "line_no"])

    schema = T.StructType([*lines.schema.fields, T.StructField("line_no", T.IntegerType())])
    return lines.groupBy(*keys).agg(listed.alias("_lines")).mapInArrow(run, schema)


def _ordered_by_joins(lines: DataFrame, keys: list[str]) -> DataFrame:
    """The same without an image in a task."""
    # Groups are listed by block first, in the order of the block ids, then single lines; this decides ties. Blocks are
    # numbered below zero and single lines from zero on, so the two never meet.
    by_score = lines.withColumn("_neg_score", -F.col("score"))
    rank = number_rows(by_score, keys, [F.col("_neg_score"), slot("det_no")], [F.col("det_no")], "_in_order")
    members = stored(
        rank.drop("_neg_score").withColumn("_group", F.coalesce(_block_seq() - F.lit(BLOCKS), F.col("_in_order"))),
        "order-members",
    )
    groups = members.groupBy(*keys, "_group").agg(
        F.min("x").alias("x"),
        F.min("y").alias("y"),
        (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w"),
        (F.max(F.col("y") + F.col("h")) - F.min("y")).alias("h"),
    )
    group_order = rank_boxes(groups, keys, "_group", "_group_place").select(*keys, "_group", "_group_place")
    inside = rank_boxes(members, [*keys, "_group"], "_in_order", "_inner_place")
    joined = inside.join(group_order, [*keys, "_group"])
    numbered = number_rows(
        joined, keys, [F.col("_group_place"), slot("_inner_place")], [F.col("_inner_place")], "line_no"
    )
    return numbered.drop("_group", "_in_order", "_group_place", "_inner_place")
