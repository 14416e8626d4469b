"""Bulk work on an image table (img_w, img_h, rgba) with numpy inside Arrow batches.

Images are processed one row at a time, so a task holds one decoded page besides its batch. For full-size scans lower
``spark.sql.execution.arrow.maxRecordsPerBatch``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.functions.geometry import fit_within, jpeg_quality, target_size


def _pixels(rgba: bytes, w: float, h: float) -> np.ndarray:
    """Sizes are floats in a batch that has a null among them."""
    return np.frombuffer(rgba, dtype=np.uint8).reshape(int(h), int(w), 4)


def _readable(rgba: bytes | None, w: float, h: float) -> bool:
    return rgba is not None and len(rgba) == w * h * 4


def _to_bytes(values: np.ndarray) -> np.ndarray:
    """Half to even, 0..255."""
    return np.clip(np.rint(values), 0, 255).astype(np.uint8)


def _tone(image: np.ndarray, brightness: int, contrast: int) -> np.ndarray:
    out = image.copy()
    out[..., :3] = _to_bytes((image[..., :3].astype(np.float64) - 128) * ((100 + contrast) / 100) + 128 + brightness)
    return out


def _resample(image: np.ndarray, w: int, h: int) -> np.ndarray:
    """Bilinear with pixel centres at half positions, edges repeated."""
    sh, sw = image.shape[:2]
    if (w, h) == (sw, sh):
        return image

    def taps(n: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(n) + 0.5) * (size / n) - 0.5, 0, size - 1)
        low = np.floor(at).astype(np.int64)
        return low, np.minimum(size - 1, low + 1), at - low

    ya, yb, wy = taps(h, sh)
    xa, xb, wx = taps(w, sw)
    src = image.astype(np.float64)
    wx, wy = wx[None, :, None], wy[:, None, None]
    upper = src[ya][:, xa] + (src[ya][:, xb] - src[ya][:, xa]) * wx
    lower = src[yb][:, xa] + (src[yb][:, xb] - src[yb][:, xa]) * wx
    return _to_bytes(upper + (lower - upper) * wy)


def _schema(df: DataFrame, names: Sequence[str], more: str) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return ", ".join([*(f"`{n}` {kinds[n]}" for n in names), more])


def _map_images(
    df: DataFrame, keep: Sequence[str], change: Callable[[object], tuple], more: str, names: Sequence[str]
) -> DataFrame:
    keep = list(keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(*(getattr(r, k) for k in keep), *change(r)) for r in batch.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=[*keep, *names])

    return df.mapInPandas(run, _schema(df, keep, more))


IMAGE = "img_w int, img_h int, rgba binary"
IMAGE_NAMES = ["img_w", "img_h", "rgba"]


def _with_plan(images: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """Images with the tone and the output size of their page, and its quality where pages have one."""
    sides = [F.nullif(c, F.lit(0)) for c in ("img_w", "img_h")]
    size = target_size(*sides, "resize_mode", "resize_width", "resize_height")
    more = [jpeg_quality("quality").alias("_quality")] if "quality" in pages.columns else []
    plan = pages.select(*keys, "brightness", "contrast", "resize_mode", "resize_width", "resize_height", *more)
    kept = [c for c in plan.columns if c == "_quality"]
    return images.join(plan, keys).select(
        *keys, *IMAGE_NAMES, "brightness", "contrast", size["width"].alias("out_w"), size["height"].alias("out_h"),
        *[F.col(c).alias("quality") for c in kept],
    )


def _adjusted(r) -> np.ndarray:
    image = _pixels(r.rgba, r.img_w, r.img_h)
    if not image.size:  # there is nothing to resize
        return image
    return _resample(_tone(image, int(r.brightness), int(r.contrast)), int(r.out_w), int(r.out_h))


def adjust_images(images: DataFrame, pages: DataFrame, keys: Sequence[str] = ("book_id", "page_id")) -> DataFrame:
    """Applies each page's tone, then its resize rule.

    An image without pixels stays as it is; an unreadable one keeps its size and has no bytes.
    """
    keys = list(keys)

    def change(r) -> tuple:
        if not _readable(r.rgba, r.img_w, r.img_h):
            return r.img_w, r.img_h, None
        out = _adjusted(r)
        return out.shape[1], out.shape[0], out.tobytes()

    return _map_images(_with_plan(images, pages, keys), keys, change, IMAGE, IMAGE_NAMES)


def downscale_images(images: DataFrame, max_edge: int, keys: Sequence[str] = ("book_id", "page_id")) -> DataFrame:
    """Images with their longest side at most ``max_edge``; the original size stays as columns.

    Images without pixels and unreadable ones are as in ``adjust_images``.
    """
    fit = fit_within("img_w", "img_h", max_edge)
    rows = images.select(
        *keys,
        *IMAGE_NAMES,
        F.col("img_w").alias("original_w"),
        F.col("img_h").alias("original_h"),
        fit["width"].alias("out_w"),
        fit["height"].alias("out_h"),
    )

    def change(r) -> tuple:
        if not _readable(r.rgba, r.img_w, r.img_h):
            return r.img_w, r.img_h, None
        image = _pixels(r.rgba, r.img_w, r.img_h)
        out = _resample(image, int(r.out_w), int(r.out_h)) if image.size else image
        return out.shape[1], out.shape[0], out.tobytes()

    return _map_images(rows, [*keys, "original_w", "original_h"], change, IMAGE, IMAGE_NAMES)


def merge_spread_images(pairs: DataFrame, images: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Left and right page of a pair (book_id, merged_id, left_id, right_id) side by side on white, top aligned.

    With ``pages``, tone and resize rule of each page are applied first, as when it is shown. A pair with an unreadable
    page is a row without an image.
    """
    if pages is not None:
        images = adjust_images(images, pages)
    left = images.selectExpr("book_id", "page_id left_id", "img_w lw", "img_h lh", "rgba lp")
    right = images.selectExpr("book_id", "page_id right_id", "img_w rw", "img_h rh", "rgba rp")
    rows = pairs.join(left, ["book_id", "left_id"]).join(right, ["book_id", "right_id"])

    def change(r) -> tuple:
        if not (_readable(r.lp, r.lw, r.lh) and _readable(r.rp, r.rw, r.rh)):
            return None, None, None
        left, right = _pixels(r.lp, r.lw, r.lh), _pixels(r.rp, r.rw, r.rh)
        sheet = np.full((max(len(left), len(right)), left.shape[1] + right.shape[1], 4), 255, dtype=np.uint8)
        sheet[: len(left), : left.shape[1]] = left
        sheet[: len(right), left.shape[1] :] = right
        return sheet.shape[1], sheet.shape[0], sheet.tobytes()

    return _map_images(rows, ["book_id", "merged_id"], change, IMAGE, IMAGE_NAMES)


def image_pixels(images: DataFrame, keys: Sequence[str] = ("book_id", "page_id")) -> DataFrame:
    """One row per pixel (x, y, r, g, b), for the histogram and ink operators; unreadable images have none."""
    keys = list(keys)
    pixels_at_once = 1 << 18

    def bands(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                if not _readable(r.rgba, r.img_w, r.img_h):
                    continue
                image = _pixels(r.rgba, r.img_w, r.img_h)
                height, width = image.shape[:2]
                step = max(1, pixels_at_once // max(1, width))
                for top in range(0, height, step):  # a large scan leaves in bands of image lines
                    band = image[top : top + step]
                    y, x = np.divmod(np.arange(band.shape[0] * width, dtype=np.int32), np.int32(width))
                    flat = band.reshape(-1, 4).astype(np.int32)
                    frame = {"x": x, "y": y + top, "r": flat[:, 0], "g": flat[:, 1], "b": flat[:, 2]}
                    yield pd.DataFrame({**{k: getattr(r, k) for k in keys}, **frame})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for band in bands(batches):  # small images leave together
            held.append(band)
            size += len(band)
            if size >= pixels_at_once:
                yield pd.concat(held, ignore_index=True)
                held, size = [], 0
        if held:
            yield pd.concat(held, ignore_index=True)

    return images.select(*keys, *IMAGE_NAMES).mapInPandas(
        run, _schema(images, keys, "x int, y int, r int, g int, b int")
    )


def export_pages(
    images: DataFrame,
    pages: DataFrame,
    encode_fn: Callable[[np.ndarray, float], bytes],
    keys: Sequence[str] = ("book_id", "page_id"),
) -> DataFrame:
    """Adjusted pages encoded by a user function (pixels, quality 0..1), in one pass over the images.

    A page that cannot be adjusted or encoded gets its error text and its original size.
    """
    keys = list(keys)
    rows = _with_plan(images, pages, keys)

    def change(r) -> tuple:
        w, h = r.img_w, r.img_h
        try:
            out = _adjusted(r)
            h, w = out.shape[:2]
            return w, h, encode_fn(out, float(r.quality)), None
        except Exception as e:  # reported per row
            return w, h, None, f"{type(e).__name__}: {e}"

    return _map_images(
        rows, keys, change, "img_w int, img_h int, encoded binary, error string", ["img_w", "img_h", "encoded", "error"]
    )
