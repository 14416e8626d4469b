"""Recognition of page images with user-supplied models.

``detect_fn(pixels)`` returns a list of (x1, y1, x2, y2, score, label, char_count) in image pixels;
``read_fn(route, crop)`` returns the text of a cropped line, where route is 30, 50 or 100. Both are called inside
executors, so they should load their model once per Python worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.functions.geometry import recognizer_route
from foliospark.operators.detections import assign_lines_to_blocks, detection_filter, nms_lines
from foliospark.operators.images import _pixels
from foliospark.operators.pixels import (
    VERTICAL_ASPECT,
    accept_trailing_split,
    image_ink_runs,
    trailing_splits,
)
from foliospark.operators.reading_order import reading_order
from foliospark.plans.ordered import number_rows, slot
from foliospark.plans.session import bucketed, stored

KEYS = ["book_id", "page_id"]
DETECTED = (
    "book_id string, page_id long, det_no int, x1 double, y1 double, x2 double, y2 double, score double, label int,"
    " char_count int, error string"
)
NUMBER_ROUTE = 30


def _error_text(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"


def _detected(box: tuple) -> tuple:
    """A detector's row with its types; a row of another length is that page's error."""
    x1, y1, x2, y2, score, label, char_count = box
    return float(x1), float(y1), float(x2), float(y2), float(score), int(label), None if char_count is None else int(char_count)


def detect(images: DataFrame, detect_fn: Callable[[np.ndarray], list[tuple]]) -> DataFrame:
    """Boxes of every page; a page whose detection fails is one row with its error."""
    names = ["det_no", "x1", "y1", "x2", "y2", "score", "label", "char_count", "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                try:
                    found = detect_fn(_pixels(r.rgba, r.img_w, r.img_h))
                    rows += [(r.book_id, r.page_id, i, *_detected(box), None) for i, box in enumerate(found)]
                except Exception as e:  # reported per page
                    rows.append((r.book_id, r.page_id, *[None] * 8, _error_text(e)))
            kinds = {"det_no": "Int32", "label": "Int32", "char_count": "Int32"}
            yield pd.DataFrame(rows, columns=[*KEYS, *names]).astype(kinds)

    return images.select(*KEYS, "img_w", "img_h", "rgba").mapInPandas(run, DETECTED)


def read_boxes(images: DataFrame, boxes: DataFrame, read_fn: Callable[[int, np.ndarray], str]) -> DataFrame:
    """Text or error of boxes (piece_id, x, y, w, h, route).

    A page meets the list of its boxes. Pages of a table bucketed by book and page stay where they are, unsorted, and
    only the lists move.
    """
    lists = boxes.groupBy(*KEYS).agg(
        F.sort_array(F.collect_list(F.struct("route", "piece_id", "x", "y", "w", "h"))).alias("boxes")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                for b in r.boxes:
                    x0, y0 = max(0, int(np.floor(b["x"]))), max(0, int(np.floor(b["y"])))
                    x1, y1 = int(np.ceil(b["x"] + b["w"])), int(np.ceil(b["y"] + b["h"]))
                    try:
                        image = _pixels(r.rgba, r.img_w, r.img_h)
                        answer = read_fn(int(b["route"]), image[y0:y1, x0:x1]), None
                    except Exception as e:  # reported per page
                        answer = None, _error_text(e)
                    rows.append((r.book_id, r.page_id, b["piece_id"], *answer))
            yield pd.DataFrame(rows, columns=[*KEYS, "piece_id", "text", "error"])

    pages = images.select(*KEYS, "img_w", "img_h", "rgba").join(lists.hint("shuffle_hash"), KEYS)
    return pages.mapInPandas(run, "book_id string, page_id long, piece_id string, text string, error string")


def recognize_pages(
    images: DataFrame,
    detect_fn: Callable[[np.ndarray], list[tuple]],
    read_fn: Callable[[int, np.ndarray], str],
    prepared: bool = False,
) -> DataFrame:
    """Lines (line_no, line_id, box, text, edited, block_id, error) of every page image.

    Images are written once, bucketed by book and page, unless ``prepared`` says that they come from such a table. After
    that no image moves: boxes, ink and texts are found beside it, and what leaves it is boxes, runs and texts.

    A page without text, and one on which a model fails, is one row without a line; a failed page has its error there
    and no lines. Other pages go on.
    """
    if not prepared:
        images = bucketed(images.select(*KEYS, "img_w", "img_h", "rgba"), KEYS, "recognise-images")
    sizes = images.select(*KEYS, F.lit(1.0).alias("scale"), "img_w", "img_h")
    raw = stored(detect(images, detect_fn), "recognise-detected")
    found = stored(detection_filter(raw.where("error is null").drop("error"), sizes, KEYS), "recognise-boxes")
    lines = nms_lines(found.where("kind = 'line'"), KEYS)
    placed = assign_lines_to_blocks(lines, found.where("kind = 'block'"), KEYS)
    ordered = stored(
        reading_order(placed, KEYS).withColumn("line_id", F.concat_ws("-", "page_id", "det_no")), "recognise-lines"
    )

    tall = ordered.where(F.col("h") >= F.col("w") * F.lit(VERTICAL_ASPECT)).select(*KEYS, "line_id", "x", "y", "w", "h")
    runs = stored(image_ink_runs(images, tall, KEYS), "recognise-runs")
    candidates = stored(trailing_splits(runs, tall, KEYS), "recognise-candidates")
    tails = candidates.select(
        *KEYS,
        F.concat_ws("/", "line_id", "cand_no").alias("piece_id"),
        F.lit(NUMBER_ROUTE).alias("route"),
        *[F.col(f"tail_{c}").alias(c) for c in "xywh"],
    )
    tail_read = stored(read_boxes(images, tails, read_fn), "recognise-tails")
    tail_texts = tail_read.where("error is null").drop("error").withColumnRenamed("text", "tail_text")
    read = candidates.withColumn("piece_id", F.concat_ws("/", "line_id", "cand_no")).join(tail_texts, [*KEYS, "piece_id"])
    pieces = stored(
        accept_trailing_split(
            ordered.select(*KEYS, "line_id", "x", "y", "w", "h", "line_no", "block_id", "char_count"),
            read.drop("piece_id"),
            KEYS,
        ),
        "recognise-pieces",
    )

    rest = pieces.where("kind <> 'tail'").select(
        *KEYS, F.col("line_id").alias("piece_id"), "x", "y", "w", "h", recognizer_route("char_count").alias("route")
    )
    read_lines = stored(read_boxes(images, rest, read_fn), "recognise-texts")
    texts = read_lines.drop("error").withColumnsRenamed({"piece_id": "line_id", "text": "read_text"})
    joined = pieces.join(texts, [*KEYS, "line_id"], "left").withColumn("text", F.coalesce("text", "read_text"))
    numbered = number_rows(
        joined, KEYS, [slot("line_no")], [F.col("line_no"), F.col("piece_no")], "_no"
    )
    out = numbered.select(
        *KEYS,
        F.col("_no").alias("line_no"),
        F.concat_ws("-", "line_id", "piece_no").alias("line_id"),
        "x",
        "y",
        "w",
        "h",
        "text",
        F.lit(False).alias("edited"),
        "block_id",
        F.lit(None).cast("string").alias("error"),
    )
    errors = [t.where("error is not null").select(*KEYS, "error") for t in (raw, tail_read, read_lines)]
    failed = errors[0].union(errors[1]).union(errors[2]).groupBy(*KEYS).agg(F.min("error").alias("error"))
    out = stored(out.join(failed.select(*KEYS), KEYS, "left_anti"), "recognise-out")
    others = images.select(*KEYS).join(out.select(*KEYS).distinct(), KEYS, "left_anti").join(failed, KEYS, "left")
    return out.unionByName(others.withColumn("edited", F.lit(False)), allowMissingColumns=True)
