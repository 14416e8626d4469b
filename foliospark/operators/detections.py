"""Detected boxes: filtering, suppression of overlaps and assignment to text blocks.

Boxes of one image share ``keys`` (for example book_id and page_id). ``det_no`` is the detector's output position.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliospark.functions.geometry import LINE_PAD, box_center_in, box_iou
from foliospark.plans.session import cut_lineage

# Fixed values of the detector.
SCORE_THRESHOLD = 0.3
MIN_BOX_PX = 10.0
LINE_CLASSES = [1, 2, 3, 4, 5, 16]
BLOCK_CLASS = 0
IOU_THRESHOLD = 0.5
CROWDED = 128  # boxes of an image that are suppressed in one task at most
BLOCK_COVERAGE = 0.7


def detection_filter(dets: DataFrame, images: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Detector output to boxes in image pixels.

    ``dets`` has x1, y1, x2, y2, score and label in model pixels; ``images`` has scale, img_w and img_h. Line boxes
    grow by 2 % of their height above and below. Boxes are clamped to the image and must be 10 px on both sides.
    """
    label_class = F.col("label") - 1
    wanted = dets.where((F.col("score") >= SCORE_THRESHOLD) & label_class.isin(*LINE_CLASSES, BLOCK_CLASS))
    rows = rescale_detections(wanted, images, keys)
    return rows.where((F.col("w") >= MIN_BOX_PX) & (F.col("h") >= MIN_BOX_PX))


def rescale_detections(dets: DataFrame, images: DataFrame, keys: Sequence[str]) -> DataFrame:
    rows = dets.join(images.select(*keys, "scale", "img_w", "img_h").hint("merge"), list(keys))
    is_block = (F.col("label") - 1) == BLOCK_CLASS
    top, bottom = F.col("y1") / F.col("scale"), F.col("y2") / F.col("scale")
    left, right = F.col("x1") / F.col("scale"), F.col("x2") / F.col("scale")
    pad = F.when(is_block, F.lit(0.0)).otherwise((bottom - top) * F.lit(LINE_PAD))
    zero = F.lit(0.0)
    x, y = F.greatest(zero, left), F.greatest(zero, top - pad)
    rest = [c for c in dets.columns if c not in {*keys, "x1", "y1", "x2", "y2", "label"}]
    return rows.select(
        *keys,
        *rest,
        (F.col("label") - 1).alias("class_id"),
        F.when(is_block, F.lit("block")).otherwise(F.lit("line")).alias("kind"),
        x.alias("x"),
        y.alias("y"),
        (F.least(F.col("img_w").cast("double"), right) - x).alias("w"),
        (F.least(F.col("img_h").cast("double"), bottom + pad) - y).alias("h"),
    )


def _box(prefix: Column) -> tuple[Column, ...]:
    return prefix["x"], prefix["y"], prefix["w"], prefix["h"]


def _level(side: Column) -> Column:
    """Exponent of the smallest power of two that is not below a box side."""
    return F.ceil(F.log2(F.greatest(side, F.lit(1e-6)))).cast("int")


def _cell(at: Column, level: Column) -> Column:
    return F.floor(at / F.pow(F.lit(2.0), level)).cast("long")


def _cells(boxes: DataFrame, level: Column) -> DataFrame:
    """A row for each cell of the grid of ``level`` that a box touches: at most two by two when no side is longer."""
    along = lambda at, size: F.sequence(_cell(F.col(at), F.col("_level")), _cell(F.col(at) + F.col(size), F.col("_level")))
    placed = boxes.withColumn("_level", level)
    return placed.withColumn("_cx", F.explode(along("x", "w"))).withColumn("_cy", F.explode(along("y", "h")))


def _overlaps(boxes: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """Pairs (a, b) of box numbers of an image whose overlap exceeds the threshold, the better box first.

    Boxes meet by an equal key, the cell of a grid as coarse as the larger box. Boxes that overlap by more than the
    threshold differ in size by less than its inverse, so the smaller one enters a few levels only. A pair is taken in
    the cell in which the intersection begins.
    """
    side = _level(F.greatest("w", "h"))
    levels = math.ceil(-math.log2(threshold)) + 1
    sized = boxes.where("w > 0 and h > 0").select(*keys, "det_no", "score", "x", "y", "w", "h", side.alias("_own"))
    up = sized.withColumn("_up", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    grid = [*keys, "_level", "_cx", "_cy"]
    inner = _cells(up, F.col("_own") + F.col("_up")).drop("_up")
    outer = _cells(sized, F.col("_own"))
    names = ["det_no", "score", "x", "y", "w", "h", "_own"]
    one, two = ({n: f"{n}{i}" for n in names} for i in (1, 2))
    # a shuffle is asked for, as estimates do not see how many cells boxes unfold to
    both = inner.withColumnsRenamed(one).join(outer.withColumnsRenamed(two).hint("shuffle_hash"), grid)
    box = lambda i: tuple(F.col(f"{c}{i}") for c in "xywh")
    begins = (_cell(F.greatest("x1", "x2"), F.col("_level")) == F.col("_cx")) & (_cell(F.greatest("y1", "y2"), F.col("_level")) == F.col("_cy"))
    once = (F.col("_own1") < F.col("_own2")) | ((F.col("_own1") == F.col("_own2")) & (F.col("det_no1") < F.col("det_no2")))
    rank = lambda i: F.struct(-F.col(f"score{i}"), F.col(f"det_no{i}"))
    better = rank(1) < rank(2)
    return both.where(once & begins & (box_iou(box(1), box(2)) > F.lit(threshold))).select(
        *keys, F.when(better, F.col("det_no1")).otherwise(F.col("det_no2")).alias("_a"), F.when(better, F.col("det_no2")).otherwise(F.col("det_no1")).alias("_b")
    )


def nms_lines(lines: DataFrame, keys: Sequence[str], threshold: float = IOU_THRESHOLD) -> DataFrame:
    """Greedy non-maximum suppression per image; returns the kept rows of ``lines``.

    Images of at most ``CROWDED`` boxes are shuffled once and suppressed in Arrow batches of many images. Those with more
    boxes are counted before and go through rounds of joins on a grid, so no task holds a crowded image.
    """
    keys = list(keys)
    counts = lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    crowded = cut_lineage(counts.where(F.col("_n") > CROWDED).select(*keys))
    if crowded.isEmpty():
        return _suppressed(lines, keys, threshold)
    few, many = lines.join(crowded, keys, "left_anti"), lines.join(crowded, keys, "left_semi")
    return _suppressed(few, keys, threshold).unionByName(_suppressed_in_rounds(many, keys, threshold))


def _suppressed(lines: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """Boxes are taken best first in all images of a batch at once; what an undropped box overlaps or copies is dropped."""
    rest = [c for c in lines.columns if c not in {*keys, "det_no"}]
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("_rank"), "det_no", *rest)))
    columns = lines.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("_lines")
            sizes, found = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten()
            image = np.repeat(np.arange(len(sizes)), sizes)
            head = np.repeat(np.cumsum(sizes) - sizes, sizes)
            place = np.arange(len(image)) - head
            x, y, w, h = (found.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y", "w", "h"))
            kept, left = np.ones(len(image), bool), np.arange(len(image))
            for k in range(int(sizes.max(initial=0))):
                left = left[(place[left] > k) & kept[left]]
                b = left[kept[head[left] + k]]
                a = head[b] + k
                across = np.maximum(0.0, np.minimum(x[a] + w[a], x[b] + w[b]) - np.maximum(x[a], x[b]))
                down = np.maximum(0.0, np.minimum(y[a] + h[a], y[b] + h[b]) - np.maximum(y[a], y[b]))
                common = across * down
                union = w[a] * h[a] + w[b] * h[b] - common
                over = np.divide(common, union, out=np.zeros(len(a)), where=union > 0) > threshold
                kept[b[over | ((x[a] == x[b]) & (y[a] == y[b]) & (w[a] == w[b]) & (h[a] == h[b]))]] = False
            rows, images = found.filter(pa.array(kept)), pa.array(image[kept])
            yield pa.RecordBatch.from_arrays([batch.column(c).take(images) if c in keys else rows.field(c) for c in columns], columns)

    return lines.groupBy(*keys).agg(ranked.alias("_lines")).mapInArrow(run, lines.schema)


def _suppressed_in_rounds(lines: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """Suppression without an image in a task.

    Exact copies of a box are reduced to the best one before the shuffle: whatever a copy would be compared with, it
    overlaps fully with the better one. Overlapping pairs are then found once, on a grid. In each round the boxes that
    no better undecided box overlaps are kept, and what they overlap goes. Rounds follow the longest chain of
    overlapping boxes, whatever an image's number of boxes.
    """
    boxes = cut_lineage(_distinct(lines, keys))
    live = cut_lineage(_overlaps(boxes, keys, threshold))
    removed = live.select(*keys, F.col("_b").alias("det_no")).where("false")
    while not live.isEmpty():
        worse = live.select(*keys, F.col("_b").alias("_a")).distinct()
        best = live.select(*keys, "_a").distinct().join(worse, [*keys, "_a"], "left_anti")
        gone = cut_lineage(live.join(best, [*keys, "_a"], "left_semi").select(*keys, "_b").distinct())
        removed = removed.unionByName(gone.withColumnRenamed("_b", "det_no"))
        live = cut_lineage(live.join(gone, [*keys, "_b"], "left_anti").join(gone.withColumnRenamed("_b", "_a"), [*keys, "_a"], "left_anti"))
    return boxes.join(removed, [*keys, "det_no"], "left_anti").select(*lines.columns)


def _distinct(lines: DataFrame, keys: list[str]) -> DataFrame:
    """The best row of each distinct box of an image."""
    box = ["x", "y", "w", "h"]
    rest = [c for c in lines.columns if c not in {*keys, *box, "det_no"}]
    best = F.min_by(F.struct("det_no", *rest), F.struct(-F.col("score"), F.col("det_no"))).alias("_best")
    return lines.groupBy(*keys, *box).agg(best).select(*keys, *box, "_best.*")


def assign_lines_to_blocks(lines: DataFrame, blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds ``block_no`` (first block that holds the line's centre) and ``block_id`` to suppressed lines.

    When fewer than 70 % of an image's lines lie in a block, blocks are not used for the image. Block ids count the
    blocks in the order in which lines, best score first, meet them.

    A block stands in at most four cells of a grid as coarse as itself, and a line's centre in one cell of each grid
    that its image's blocks use, so lines meet the blocks around them by an equal key.
    """
    keys = list(keys)
    shapes = blocks.groupBy(*keys, "x", "y", "w", "h").agg(F.min("det_no").alias("no"))
    cells = _cells(shapes, _level(F.greatest("w", "h")))
    levels = shapes.select(*keys, _level(F.greatest("w", "h")).alias("_level")).distinct()
    here = (F.col("x"), F.col("y"), F.col("w"), F.col("h"))
    at = lines.select(*keys, "det_no", *here).join(levels.hint("merge"), keys)
    at = at.withColumn("_cx", _cell(F.col("x") + F.col("w") / 2, F.col("_level"))).withColumn("_cy", _cell(F.col("y") + F.col("h") / 2, F.col("_level")))
    around = cells.select(*keys, "_level", "_cx", "_cy", "no", F.struct("x", "y", "w", "h").alias("_block"))
    hits = (
        at.join(around.hint("shuffle_hash"), [*keys, "_level", "_cx", "_cy"])
        .where(box_center_in(here, _box(F.col("_block"))))
        .groupBy(*keys, "det_no")
        .agg(F.min("no").alias("_hit"))
    )
    placed = lines.join(hits.hint("merge"), [*keys, "det_no"], "left")

    first = F.min(F.struct((-F.col("score")).alias("rank"), "det_no"))
    per_block = placed.groupBy(*keys, "_hit").agg(F.count(F.lit(1)).alias("_n"), first.alias("_first"))
    image = Window.partitionBy(*keys)
    covered = F.sum(F.when(F.col("_hit").isNotNull(), F.col("_n")).otherwise(0)).over(image)
    total = F.sum("_n").over(image)
    seq = F.row_number().over(image.orderBy(F.col("_hit").isNull(), "_first")) - 1
    ids = (
        per_block.withColumn("_use", covered >= total * F.lit(BLOCK_COVERAGE))
        .withColumn("_id", F.concat(F.lit("block-"), seq.cast("string")))
        .where(F.col("_use") & F.col("_hit").isNotNull())
        .select(*keys, "_hit", F.col("_id").alias("block_id"))
    )
    return (
        placed.join(ids, [*keys, "_hit"], "left")
        .withColumn("block_no", F.when(F.col("block_id").isNotNull(), F.col("_hit")))
        .drop("_hit")
    )
