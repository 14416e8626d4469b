"""Images that arrive in a folder while the job runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from foliospark.sources.images import ImageDecoder, decode_contents, decode_with, decoded_columns

IMAGE_SCHEMA = T.StructType(
    [
        T.StructField(
            "image",
            T.StructType(
                [
                    T.StructField("origin", T.StringType()),
                    T.StructField("height", T.IntegerType()),
                    T.StructField("width", T.IntegerType()),
                    T.StructField("nChannels", T.IntegerType()),
                    T.StructField("mode", T.IntegerType()),
                    T.StructField("data", T.BinaryType()),
                ]
            ),
        )
    ]
)


# A micro-batch lists its files again, one a task, and reads 32 in a task. These settings make both fewer; file streams look
# them up in the session that made them, so they hold as long as the stream runs.
FEWER_LISTINGS = ("spark.sql.sources.parallelPartitionDiscovery.parallelism", "64")
LARGER_READS = ("spark.sql.files.openCostInBytes", "131072")
CONTENT_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def stream_import(spark: SparkSession, folder: str, max_files: int = 20_000, decode_fn: ImageDecoder | None = None) -> DataFrame:
    """Decoded images as they arrive; unreadable files come out with ok = false and do not stop the stream.

    A micro-batch has a cost of its own and takes at most ``max_files``. Run the stream under ``FEWER_LISTINGS`` and
    ``LARGER_READS`` (``plans.session.setting``) where very many files are small. ``decode_fn`` is as in ``decode_images``.
    """
    form, schema = ("image", IMAGE_SCHEMA) if decode_fn is None else ("binaryFile", CONTENT_SCHEMA)
    frames = (
        spark.readStream.format(form)
        .schema(schema)
        .option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", max_files)
        .load(folder)
    )
    return decoded_columns(frames) if decode_fn is None else decode_contents(frames, decode_fn)


def stream_import_rows(files: DataFrame, decode_fn: Callable[[bytes], tuple[int, int, bytes]]) -> DataFrame:
    """The same for a stream of rows with a ``content`` column and a user decoder."""
    return decode_with(files, decode_fn)
