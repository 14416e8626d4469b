"""Column functions for sizes, boxes and tone values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions.text import DEFAULT_QUALITY, DEFAULT_RESIZE_HEIGHT, DEFAULT_RESIZE_WIDTH

# Fixed values
THUMBNAIL_EDGE = 320
PREVIEW_EDGE = 1200
MIN_DRAG_PX = 8.0
LINE_PAD = 0.02


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def half_up(x: Column) -> Column:
    """Round half towards plus infinity."""
    return F.floor(x + F.lit(0.5))


def byte(x: Column) -> Column:
    """Value stored in a clamped byte: half to even, 0..255."""
    return F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.rint(x))).cast("int")


def line_font_size(w: str | Column, h: str | Column) -> Column:
    return F.least(_c(w), _c(h))


def fit_within(w: str | Column, h: str | Column, edge: int) -> Column:
    """struct(width, height) with the longest side at most ``edge``; never enlarged."""
    w, h = _c(w), _c(h)
    longest = F.greatest(w, h)
    scale = F.lit(float(edge)) / longest

    def side(x: Column) -> Column:
        return F.when(longest <= edge, x).otherwise(F.greatest(F.lit(1), half_up(x * scale))).cast("int")

    return F.struct(side(w).alias("width"), side(h).alias("height"))


def target_size(
    w: str | Column, h: str | Column, mode: str | Column, want_w: str | Column, want_h: str | Column
) -> Column:
    w, h, mode = _c(w), _c(h), F.coalesce(_c(mode), F.lit("none"))
    tw = F.greatest(F.lit(1), half_up(F.coalesce(_c(want_w), F.lit(DEFAULT_RESIZE_WIDTH)).cast("double")))
    th = F.greatest(F.lit(1), half_up(F.coalesce(_c(want_h), F.lit(DEFAULT_RESIZE_HEIGHT)).cast("double")))
    width = F.when(mode == "width", tw).when(mode == "height", F.greatest(F.lit(1), half_up(w / h * th))).otherwise(w)
    height = F.when(mode == "height", th).when(mode == "width", F.greatest(F.lit(1), half_up(h / w * tw))).otherwise(h)
    return F.struct(width.cast("int").alias("width"), height.cast("int").alias("height"))


def tone_curve(v: str | Column, brightness: str | Column, contrast: str | Column) -> Column:
    factor = (F.lit(100) + _c(contrast)) / F.lit(100.0)
    return byte((_c(v) - F.lit(128)) * factor + F.lit(128) + _c(brightness))


def tone_luminance(r: str | Column, g: str | Column, b: str | Column) -> Column:
    return byte(F.lit(0.299) * _c(r) + F.lit(0.587) * _c(g) + F.lit(0.114) * _c(b))


def ink_luminance(r: str | Column, g: str | Column, b: str | Column) -> Column:
    return (_c(r) + _c(g) + _c(b)) / F.lit(3.0)


def jpeg_quality(quality: str | Column) -> Column:
    q = F.coalesce(_c(quality), F.lit(DEFAULT_QUALITY))
    return F.least(F.lit(100), F.greatest(F.lit(1), q)) / F.lit(100.0)


def clamp_level(level: str | Column) -> Column:
    return F.when(_c(level) >= 2, F.lit(2)).otherwise(F.lit(1))


def box_iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union of two (x, y, w, h) boxes."""
    ax, ay, aw, ah = a
    bx, by, bw, bh = b
    zero = F.lit(0.0)
    ix = F.greatest(zero, F.least(ax + aw, bx + bw) - F.greatest(ax, bx))
    iy = F.greatest(zero, F.least(ay + ah, by + bh) - F.greatest(ay, by))
    inter = ix * iy
    union = aw * ah + bw * bh - inter
    return F.when(union > 0, inter / union).otherwise(zero)


def box_center_in(det: tuple[Column, ...], block: tuple[Column, ...]) -> Column:
    x, y, w, h = det
    bx, by, bw, bh = block
    cx, cy = x + w / 2, y + h / 2
    return (cx >= bx) & (cx <= bx + bw) & (cy >= by) & (cy <= by + bh)


def recognizer_route(char_count: str | Column) -> Column:
    c = _c(char_count)
    return F.when(c == 3, F.lit(30)).when(c == 2, F.lit(50)).otherwise(F.lit(100))


def drag_to_box(start: tuple[Column, ...], end: tuple[Column, ...], view: tuple[Column, ...], size: tuple[Column, ...]) -> Column:
    """Drag on screen to a box in image pixels, null when it is too small or outside."""
    (sx, sy), (ex, ey) = start, end
    left, top, vw, vh = view
    width, height = size
    zero = F.lit(0.0)

    def along(a: Column, b: Column, origin: Column, extent: Column, full: Column) -> tuple[Column, Column]:
        ratio = full / F.nullif(extent, zero)
        lo = F.least(full, F.greatest(zero, (F.least(a, b) - origin) * ratio))
        hi = F.least(full, F.greatest(zero, (F.greatest(a, b) - origin) * ratio))
        return lo, hi

    x1, x2 = along(sx, ex, left, vw, width)
    y1, y2 = along(sy, ey, top, vh, height)
    fits = (vw > 0) & (vh > 0) & (F.abs(ex - sx) >= MIN_DRAG_PX) & (F.abs(ey - sy) >= MIN_DRAG_PX)
    box = F.struct(
        half_up(x1).cast("double").alias("x"),
        half_up(y1).cast("double").alias("y"),
        half_up(x2 - x1).cast("double").alias("w"),
        half_up(y2 - y1).cast("double").alias("h"),
    )
    return F.when(fits & (x2 > x1) & (y2 > y1), box)
