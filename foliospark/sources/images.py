"""Image files and pixel data."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions.text import is_image_name


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Writes ``content`` to ``path`` below a folder of any store that Arrow reaches; returns path and length per file.

    The files are written when the result is read. Each gets its name once it is complete, so a repeated task replaces
    it by the same bytes and a failed one leaves no file under its name.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        made = set()
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                target = f"{root}/{path}"
                place = target.rsplit("/", 1)[0]
                if place not in made:
                    store.create_dir(place, recursive=True)
                    made.add(place)
                part = f"{place}/_{uuid.uuid4().hex}"  # names that begin so are no input to Spark
                with store.open_output_stream(part) as out:
                    out.write(content)
                store.move(part, target)
            yield pd.DataFrame({"path": batch["path"], "length": batch["content"].map(len)})

    return files.select("path", "content").mapInPandas(run, "path string, length long")


def filter_image_files(files: DataFrame) -> DataFrame:
    """Files whose name says they are images (column path)."""
    return files.where(is_image_name("path"))


FILES_TOGETHER = 16


def _fewer_tasks(files: DataFrame) -> DataFrame:
    """Merges the tasks of a scan of files.

    Opening a file counts as reading 4 MB, so small files come in tasks of 32, and the driver spends more time on handing
    out tasks than they take. Every core keeps several tasks.
    """
    tasks, least = files.rdd.getNumPartitions(), 4 * files.sparkSession.sparkContext.defaultParallelism
    return files.coalesce(max(least, tasks // FILES_TOGETHER)) if tasks > least else files


def scan_image_files(spark: SparkSession, folder: str) -> DataFrame:
    """Image files below a folder: path, length, modification time. File contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return filter_image_files(_fewer_tasks(files.select("path", "length", "modificationTime")))


def decoded_columns(frames: DataFrame) -> DataFrame:
    """Rows of the image source with plain columns; ``data`` holds B, G, R (and A) bytes by row."""
    ok = F.col("image.height") > 0
    return frames.select(
        F.col("image.origin").alias("path"),
        F.when(ok, F.col("image.width")).alias("width"),
        F.when(ok, F.col("image.height")).alias("height"),
        F.when(ok, F.col("image.nChannels")).alias("channels"),
        F.when(ok, F.col("image.data")).alias("data"),
        F.coalesce(ok, F.lit(False)).alias("ok"),
    )


ImageDecoder = Callable[[bytes], tuple[int, int, int, bytes]]


def decode_bitmap(content: bytes) -> tuple[int, int, int, bytes]:
    """Width, height, channels and B, G, R bytes by row, top row first, of an uncompressed bitmap of 24 bits."""
    if content[:2] != b"BM" or len(content) < 54:
        raise ValueError("no bitmap")
    start, head = (int.from_bytes(content[i : i + 4], "little") for i in (10, 14))
    width, height = (int.from_bytes(content[i : i + 4], "little", signed=True) for i in (18, 22))
    depth, packed = int.from_bytes(content[28:30], "little"), int.from_bytes(content[30:34], "little")
    if head < 40 or depth != 24 or packed or width <= 0 or height == 0:
        raise ValueError("not an uncompressed bitmap of 24 bits")
    line = (3 * width + 3) // 4 * 4
    if len(content) < start + line * abs(height):
        raise ValueError("truncated bitmap")
    rows = np.frombuffer(content, np.uint8, line * abs(height), start).reshape(abs(height), line)[:, : 3 * width]
    return width, abs(height), 3, (rows if height < 0 else rows[::-1]).tobytes()


def decode_contents(files: DataFrame, decode_fn: ImageDecoder) -> DataFrame:
    """``path`` and ``content`` to the columns of ``decoded_columns`` by a user function; what it refuses has ok = false."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    out.append((path, *decode_fn(bytes(content)), True))
                except Exception:  # reported per row
                    out.append((path, None, None, None, None, False))
            done = pd.DataFrame(out, columns=["path", "width", "height", "channels", "data", "ok"])
            yield done.astype({"width": "Int32", "height": "Int32", "channels": "Int32", "ok": "bool"})

    schema = "path string, width int, height int, channels int, data binary, ok boolean"
    return files.select("path", "content").mapInPandas(run, schema)


def decode_images(spark: SparkSession, folder: str, decode_fn: ImageDecoder | None = None) -> DataFrame:
    """Decoded images of a folder; an unreadable file is a row with ok = false.

    Without ``decode_fn`` Spark's image source opens the files. It prepares its row encoder anew for each file, which takes
    longer than opening a small one; a function from bytes to (width, height, channels, data), such as ``decode_bitmap``
    where all images are plain bitmaps, is given the files as they are.
    """
    if decode_fn is None:
        frames = spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", False).load(folder)
        return decoded_columns(_fewer_tasks(frames))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return decode_contents(_fewer_tasks(files.select("path", "content")), decode_fn)


def decode_with(files: DataFrame, decode_fn: Callable[[bytes], tuple[int, int, bytes]]) -> DataFrame:
    """Decodes a ``content`` column with a user function (bytes to width, height, RGBA bytes).

    A row that cannot be decoded gets ok = false and its error text; the job goes on.
    """
    rest = [f for f in files.schema.fields if f.name != "content"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for content in batch["content"]:
                try:
                    out.append((*decode_fn(bytes(content)), True, None))
                except Exception as e:  # reported per row
                    out.append((None, None, None, False, f"{type(e).__name__}: {e}"))
            done = pd.DataFrame(out, columns=["img_w", "img_h", "rgba", "ok", "error"], index=batch.index)
            done = done.astype({"img_w": "Int32", "img_h": "Int32"})
            yield pd.concat([batch.drop(columns="content"), done], axis=1)

    return files.mapInPandas(run, f"{schema}, img_w int, img_h int, rgba binary, ok boolean, error string")
