"""Tone levels from histograms, and ink runs that reveal a page number at the end of a tall line.

Both come from pixel tables or, without one, from images: numpy reduces an image beside its boxes inside the task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliospark.functions.geometry import half_up, ink_luminance, tone_luminance
from foliospark.functions.text import trailing_number_text

# Fixed values of the trailing-number rule.
VERTICAL_ASPECT = 1.5
GAP_TO_MEDIAN = 1.5
MIN_GAP_RATIO = 0.3
MAX_TAIL_RATIO = 3.5
MIN_CONTRAST = 40
RULE_MIN_LENGTH = 0.25
RULE_MAX_WIDTH = 0.12
PAD = 2

PIXELS = 1 << 20
ROWS = 20_000  # found rows that leave a task together


def auto_levels(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Brightness and contrast that stretch the 1st..99th percentile of luminance.

    Pixels are reduced to at most 256 counts per image before the shuffle; the window runs over those counts.
    """
    keys = list(keys)
    return _levels(pixels.groupBy(*keys, tone_luminance("r", "g", "b").alias("bin")).agg(F.count(F.lit(1)).alias("n")), keys)


def image_histograms(images: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts of luminance (bin, n) per image (img_w, img_h, rgba), in one pass beside the image; unreadable ones have none."""
    keys = list(keys)
    kinds = {f.name: f.dataType.simpleString() for f in images.schema.fields}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if r.rgba is None or len(r.rgba) != r.img_w * r.img_h * 4:
                    continue
                counts = np.zeros(256, np.int64)
                pixels = np.frombuffer(r.rgba, np.uint8).reshape(-1, 4)
                for at in range(0, len(pixels), PIXELS):  # a large scan is counted in bands
                    red, green, blue = pixels[at : at + PIXELS, :3].T.astype(np.float64)
                    light = np.rint(0.299 * red + 0.587 * green + 0.114 * blue)
                    counts += np.bincount(np.clip(light, 0, 255).astype(np.int64), minlength=256)
                out += [(*(getattr(r, k) for k in keys), b, int(counts[b])) for b in np.flatnonzero(counts).tolist()]
            yield pd.DataFrame(out, columns=[*keys, "bin", "n"])

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "bin int, n long"])
    return images.select(*keys, "img_w", "img_h", "rgba").mapInPandas(run, schema)


def image_auto_levels(images: DataFrame, keys: Sequence[str], percent_last: bool = False) -> DataFrame:
    """``auto_levels`` from images or thumbnails: 256 counts leave an image, and rows of one key add up.

    With ``percent_last`` the brightness is multiplied by the contrast in percent and divided by 100 after that. The two
    orders differ in the last bit, and by one after rounding for twelve pairs of ends.
    """
    bins = image_histograms(images, keys).groupBy(*keys, "bin").agg(F.sum("n").alias("n"))
    return _levels(bins, list(keys), percent_last)


def _levels(bins: DataFrame, keys: list[str], percent_last: bool = False) -> DataFrame:
    image = Window.partitionBy(*keys)
    bins = bins.withColumn("cum", F.sum("n").over(image.orderBy("bin"))).withColumn("total", F.sum("n").over(image))
    low = F.min(F.when(F.col("cum") > F.floor(F.col("total") * F.lit(0.01)), F.col("bin")))
    high = F.min(F.when(F.col("cum") >= F.ceil(F.col("total") * F.lit(0.99)), F.col("bin")))
    ends = bins.groupBy(*keys).agg(low.alias("lo"), high.alias("hi"))

    def clamp(x, a: float, b: float):
        return F.least(F.lit(b), F.greatest(F.lit(a), x))

    spread = F.greatest(F.col("hi") - F.col("lo"), F.lit(1))
    contrast = clamp(clamp(F.lit(255.0) / spread, 0.1, 4.0) * 100 - 100, -100.0, 100.0)
    percent, middle = F.lit(100) + contrast, -((F.col("lo") + F.col("hi")) / F.lit(2.0) - 128)
    moved = middle * percent / F.lit(100.0) if percent_last else middle * (percent / F.lit(100.0))
    brightness = clamp(moved, -100.0, 100.0)
    return ends.select(
        *keys,
        "lo",
        "hi",
        half_up(brightness).cast("int").alias("brightness"),
        half_up(contrast).cast("int").alias("contrast"),
    )


def _pixels_in_boxes(pixels: DataFrame, boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels of each line box.

    A box is unfolded to its pixel rows, which makes this an equal-key join on (image, y) with a check of x, instead
    of comparing every pixel of an image with every box. Both sides are shuffled: Spark's estimates do not see the
    unfolding, so it would take boxes or even pixels for small enough to broadcast.
    """
    rows = boxes.select(
        *keys,
        "line_id",
        F.greatest(F.lit(0), F.floor("x")).cast("int").alias("_xa"),
        F.ceil(F.col("x") + F.col("w")).cast("int").alias("_xb"),
        F.explode(
            F.sequence(
                F.greatest(F.lit(0), F.floor("y")).cast("int"),
                F.greatest(F.lit(0), F.ceil(F.col("y") + F.col("h")) - 1).cast("int"),
            )
        ).alias("y"),
    )
    light = pixels.select(*keys, "x", "y", ink_luminance("r", "g", "b").alias("v"))
    return light.join(rows.hint("shuffle_hash"), [*keys, "y"]).where((F.col("x") >= F.col("_xa")) & (F.col("x") < F.col("_xb")))


def ink_profile(pixels: DataFrame, boxes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Leftmost and rightmost ink pixel of each pixel row of a line box; nothing for boxes without contrast.

    Pixels are reduced, before they move, to the ends of each brightness of a pixel row; a line's threshold and its ink
    come from those.
    """
    keys = list(keys)
    line = [*keys, "line_id"]
    ends = _pixels_in_boxes(pixels, boxes, keys).groupBy(*line, "y", "v").agg(F.min("x").alias("_a"), F.max("x").alias("_b"))
    whole = Window.partitionBy(*line)
    lit = ends.withColumns({"_lo": F.min("v").over(whole), "_hi": F.max("v").over(whole)})
    ink = (F.col("_hi") - F.col("_lo") >= MIN_CONTRAST) & (F.col("v") < (F.col("_lo") + F.col("_hi")) / F.lit(2.0))
    return lit.where(ink).groupBy(*line, "y").agg(F.min("_a").alias("min_x"), F.max("_b").alias("max_x"))


def box_ink(image: np.ndarray, x: float, y: float, w: float, h: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pixel rows of a box that hold ink, with their leftmost and rightmost ink pixel."""
    top, left = max(0, math.floor(y)), max(0, math.floor(x))
    part = image[top : max(top, math.ceil(y + h)), left : max(left, math.ceil(x + w)), :3]
    none = np.zeros(0, int)
    if not part.size:
        return none, none, none
    # the plain mean of three bytes, compared as sums
    light = part.astype(np.int32).sum(2)
    low, high = int(light.min()), int(light.max())
    if high - low < 3 * MIN_CONTRAST:
        return none, none, none
    dark = 2 * light < low + high
    rows = np.flatnonzero(dark.any(1))
    return rows + top, dark[rows].argmax(1) + left, left + dark.shape[1] - 1 - dark[rows, ::-1].argmax(1)


def box_runs(image: np.ndarray, x: float, y: float, w: float, h: float) -> list[tuple[int, int, int, int]]:
    """Runs of consecutive pixel rows with ink: first and last row, leftmost and rightmost pixel."""
    rows, low, high = box_ink(image, x, y, w, h)
    if not len(rows):
        return []
    first = np.flatnonzero(np.diff(rows, prepend=rows[0] - 2) != 1)
    last = np.append(first[1:], len(rows)) - 1
    return list(zip(rows[first].tolist(), rows[last].tolist(), np.minimum.reduceat(low, first).tolist(), np.maximum.reduceat(high, first).tolist()))


def _by_box(images: DataFrame, boxes: DataFrame, keys: list[str], found: Callable, names: list[str]) -> DataFrame:
    """Rows that ``found`` gives for each box (line_id, x, y, w, h) of an image.

    An image meets the list of its boxes; images of a table bucketed by ``keys`` stay where they are.
    """
    kinds = {f.name: f.dataType.simpleString() for f in (*images.schema.fields, *boxes.schema.fields)}
    lists = boxes.groupBy(*keys).agg(F.collect_list(F.struct("line_id", *[F.col(c).cast("double").alias(c) for c in "xywh"])).alias("_boxes"))
    rows = images.select(*keys, "img_w", "img_h", "rgba").join(lists.hint("shuffle_hash"), keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [*keys, "line_id", *names]
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                try:
                    image = np.frombuffer(r.rgba, np.uint8).reshape(int(r.img_h), int(r.img_w), 4)
                except (TypeError, ValueError):  # an unreadable image has no ink
                    continue
                key = tuple(getattr(r, k) for k in keys)
                for b in r[-1]:
                    out += [(*key, b["line_id"], *row) for row in found(image, b["x"], b["y"], b["w"], b["h"])]
                    if len(out) >= ROWS:  # a batch of images has many times its rows
                        yield pd.DataFrame(out, columns=columns)
                        out = []
            yield pd.DataFrame(out, columns=columns)

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in (*keys, "line_id")), *(f"{n} int" for n in names)])
    return rows.mapInPandas(run, schema)


def image_ink_profile(images: DataFrame, boxes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``ink_profile`` from images (img_w, img_h, rgba): one row per line and pixel row with ink, and no pixel table."""

    def found(image: np.ndarray, *box: float) -> Iterator[tuple[int, int, int]]:
        return zip(*[part.tolist() for part in box_ink(image, *box)])

    return _by_box(images, boxes, list(keys), found, ["y", "min_x", "max_x"])


def image_ink_runs(images: DataFrame, boxes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``ink_runs`` from images: runs are found beside the image, so one row per run leaves it."""
    runs = _by_box(images, boxes, list(keys), box_runs, ["start_y", "end_y", "min_x", "max_x"])
    return without_rules(runs, boxes, list(keys))


def ink_runs(profile: DataFrame, boxes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Runs of consecutive ink rows per line; thin rules are left out. A line has at most one row per pixel row."""
    keys = list(keys)
    line = [*keys, "line_id"]
    island = F.col("y") - F.row_number().over(Window.partitionBy(*line).orderBy("y"))
    runs = (
        profile.withColumn("_island", island)
        .groupBy(*line, "_island")
        .agg(
            F.min("y").alias("start_y"),
            F.max("y").alias("end_y"),
            F.min("min_x").alias("min_x"),
            F.max("max_x").alias("max_x"),
        )
        .drop("_island")
    )
    return without_rules(runs, boxes, keys)


def without_rules(runs: DataFrame, boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Runs but for thin rules: long and narrow beside their line's width."""
    line = [*keys, "line_id"]
    width = boxes.select(*line, F.col("w").alias("_w"))
    rule = ((F.col("end_y") - F.col("start_y") + 1) >= F.col("_w") * F.lit(RULE_MIN_LENGTH)) & (
        (F.col("max_x") - F.col("min_x") + 1) <= F.greatest(F.lit(2.0), F.col("_w") * F.lit(RULE_MAX_WIDTH))
    )
    return runs.join(width.hint("merge"), line).where(~rule).drop("_w")


def trailing_splits(runs: DataFrame, boxes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Places where a short tail may be split off a tall line, longest tail first (``cand_no`` from 0)."""
    keys = list(keys)
    line = [*keys, "line_id"]
    by_line = Window.partitionBy(*line)
    down = by_line.orderBy("start_y")
    rest = down.rowsBetween(0, Window.unboundedFollowing)
    tall = boxes.where(F.col("h") >= F.col("w") * F.lit(VERTICAL_ASPECT)).select(*line, "x", "y", "w", "h")
    rows = (
        runs.join(tall.hint("merge"), line)
        .withColumns(
            {
                "_prev_end": F.lag("end_y").over(down),
                "_left": F.min("min_x").over(rest),
                "_right": F.max("max_x").over(rest),
                "_end": F.max("end_y").over(by_line),
            }
        )
        .withColumn("_gap", F.col("start_y") - F.col("_prev_end") - 1)
        .withColumn("_median", F.median("_gap").over(by_line))
    )
    min_gap = F.greatest(F.col("w") * F.lit(MIN_GAP_RATIO), F.col("_median") * F.lit(GAP_TO_MEDIAN))
    short = (F.col("_end") - F.col("start_y") + 1) <= F.col("w") * F.lit(MAX_TAIL_RATIO)
    tail_x = F.greatest(F.col("x"), F.col("_left") - F.lit(float(PAD)))
    tail_y = (F.col("start_y") - PAD).cast("double")
    return rows.where(F.col("_gap").isNotNull() & short & (F.col("_gap") >= min_gap)).select(
        *line,
        (F.row_number().over(down) - 1).alias("cand_no"),
        F.col("x").alias("head_x"),
        F.col("y").alias("head_y"),
        F.col("w").alias("head_w"),
        (F.col("_prev_end") + F.lit(PAD + 1) - F.col("y")).alias("head_h"),
        tail_x.alias("tail_x"),
        tail_y.alias("tail_y"),
        (F.least(F.col("x") + F.col("w"), F.col("_right") + F.lit(float(PAD + 1))) - tail_x).alias("tail_w"),
        (F.col("_end") + F.lit(PAD + 1) - tail_y).alias("tail_h"),
    )


def accept_trailing_split(boxes: DataFrame, read_candidates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Splits a line at its first candidate whose tail reads as a page number; other lines stay whole.

    ``read_candidates`` is ``trailing_splits`` with ``tail_text``. Result: piece_no 0 (whole or head) and 1 (tail) with
    its box, ``kind`` and, for tails, the cleaned number text.
    """
    line = [*keys, "line_id"]
    head = F.struct(*[F.col(f"head_{c}").alias(c) for c in "xywh"], F.lit("head").alias("kind"), F.lit(None).cast("string").alias("text"))
    tail = F.struct(*[F.col(f"tail_{c}").alias(c) for c in "xywh"], F.lit("tail").alias("kind"), F.col("_text").alias("text"))
    chosen = (
        read_candidates.withColumn("_text", trailing_number_text("tail_text"))
        .where(F.col("_text").isNotNull())
        .groupBy(*line)
        .agg(F.min_by(F.array(head, tail), "cand_no").alias("_pieces"))
    )
    whole = F.array(F.struct("x", "y", "w", "h", F.lit("whole").alias("kind"), F.lit(None).cast("string").alias("text")))
    joined = boxes.join(chosen.hint("merge"), line, "left")
    pieces = F.posexplode(F.coalesce("_pieces", whole)).alias("piece_no", "_piece")
    rest = [c for c in boxes.columns if c not in {*line, "x", "y", "w", "h"}]
    return joined.select(*line, *rest, pieces).select(*line, *rest, "piece_no", "_piece.*")
