"""Stored tables of a corpus: one Parquet table per kind of row, partitioned by book."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from foliospark.functions.text import text_file_name
from foliospark.plans.session import cut_lineage

TABLES = ("pages", "lines", "chapters", "books")


def write_tables(df: DataFrame, root: str, name: str) -> None:
    """Replaces the books that occur in ``df``; other books of the table stay as they are.

    Rows are rebalanced by book at run time: partitions of small books are merged, a large book is split into as many
    as its size asks for.
    """
    (
        df.hint("rebalance", "book_id")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("book_id")
        .parquet(f"{root}/{name}")
    )


def put_pages(
    rows: DataFrame, root: str, name: str, replaces: Callable[[Column, Column], Column] | None = None, buckets: int = 64
) -> list[int]:
    """Stores rows, one per page, in place of those of the same pages; other pages stay. Returns the buckets written.

    The table is laid out by a hash of the page, and only buckets that hold one of the pages are written anew, each as
    a whole; files of others keep their names. ``replaces`` (old row, new row) may keep stored rows: without a page that
    is to be replaced nothing is written. A writer that breaks off leaves whole buckets, old or new. One writer at a
    time may change a table.
    """
    spark, path, keys = rows.sparkSession, f"{root}/{name}", ["book_id", "page_id"]
    new = rows.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    stored_before = exists(spark, path)
    if stored_before:
        old = spark.read.schema(new.schema).parquet(path)
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most the number of buckets
        old = old.where(F.col("bucket").isin(touched))
        columns = [c for c in new.columns if c not in (*keys, "bucket")]
        pair = lambda side: F.struct(*[F.col(f"{side}.{c}").alias(c) for c in columns])
        join = [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in keys]
        both = new.alias("new").join(old.alias("old"), [*join, F.col("old.bucket") == F.col("new.bucket")], "left")
        absent = F.col("old.bucket").isNull()
        takes = absent | replaces(pair("old"), pair("new")) if replaces else F.lit(True)
        new = cut_lineage(both.where(takes).select("new.*"))
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]
        if not touched:
            return []
        same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
        stay = old.where(F.col("bucket").isin(touched)).alias("a").join(new.alias("b"), [*same, F.col("a.bucket") == F.col("b.bucket")], "left_anti")
        new = new.unionByName(stay.select("a.*"))
    new.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return touched if stored_before else [r["bucket"] for r in spark.read.parquet(path).select("bucket").distinct().collect()]


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in its file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place)


def load_book_tables(spark: SparkSession, root: str, name: str, schema: StructType | str | None = None, merge: bool = False) -> DataFrame:
    """A stored table; files with fewer columns than ``schema`` are read with nulls.

    Without a schema ``merge`` must be set: it takes the columns of every file, which opens each of them first. One
    file's columns do not stand for a table, whose books may have been written with different ones.
    """
    if schema is None and not merge:
        raise ValueError("give the schema of the table, or merge=True to read the columns of every file")
    reader = spark.read.option("mergeSchema", merge and schema is None)
    return (reader.schema(schema) if schema else reader).parquet(f"{root}/{name}")


def write_book_text(texts: DataFrame, books: DataFrame, path: str) -> None:
    """One folder per book, named by its title, with the text parts in order.

    ``texts`` (book_id, part_no, text) from ``book_text``. Parts are range-partitioned by book and part, so a long
    book is written by several tasks and its files, in name order, are the book's text, ended by a newline (the text
    sink ends every record with one; a later part adds the second newline of the blank line between pages). Parts
    without text are left out, but for one of a book without any. Inside a task rows are sorted by the folder columns
    first, else the sink sorts them again by these alone and loses the order of the parts.
    """
    filled = F.col("text") != ""
    ends = texts.groupBy("book_id").agg(F.min(F.when(filled, F.col("part_no"))).alias("_first"), F.min("part_no").alias("_least"))
    ends = ends.select("book_id", F.coalesce("_first", "_least").alias("_first"))
    later = F.col("part_no") > F.col("_first")
    named = (
        texts.join(ends, "book_id")
        .where((F.col("part_no") == F.col("_first")) | (later & filled))
        .join(books.select("book_id", text_file_name("title").alias("file_name")), "book_id")
        .withColumn("value", F.when(later, F.concat(F.lit("\n"), F.col("text"))).otherwise(F.col("text")))
    )
    (
        named.repartitionByRange("book_id", "part_no")
        .sortWithinPartitions("book_id", "file_name", "part_no")
        .select("book_id", "file_name", "value")
        .write.mode("overwrite")
        .partitionBy("book_id", "file_name")
        .text(path)
    )
