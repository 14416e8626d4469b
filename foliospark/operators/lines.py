"""Recognised lines: paragraphs, page and book text, status, title guess."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.geometry import line_font_size
from foliospark.functions.text import is_blank
from foliospark.operators.pages import page_flags
from foliospark.plans.ordered import number_rows, slot, text_parts

PAGE = ["book_id", "page_id"]
# Pages whose text is joined in one row; longer books continue in the next part.
PAGES_PER_PART = 1024


def nonblank_lines(lines: DataFrame) -> DataFrame:
    return lines.where(~is_blank("text"))


def build_paragraphs(lines: DataFrame) -> DataFrame:
    """One row per paragraph: lines with the same block, or a line of its own without a block."""
    paragraph = F.coalesce("block_id", "line_id")
    return (
        lines.withColumn("paragraph_key", paragraph)
        .groupBy(*PAGE, "paragraph_key")
        .agg(
            F.min("line_no").alias("para_no"),
            F.min_by("line_id", "line_no").alias("paragraph_id"),
            F.expr("listagg(text, '') within group (order by line_no)").alias("text"),
            F.count(F.lit(1)).cast("int").alias("n_lines"),
            F.min("x").alias("x"),
            F.min("y").alias("y"),
            (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w"),
            (F.max(F.col("y") + F.col("h")) - F.min("y")).alias("h"),
        )
        .drop("paragraph_key")
    )


def page_text(lines: DataFrame) -> DataFrame:
    """Non-empty paragraphs of a recognised page joined by newlines; '' when there are none."""
    key = F.coalesce("block_id", "line_id")
    # Joining texts does not shrink them, so the lines move once, by page, and both levels aggregate in place.
    paragraphs = (
        lines.select(*PAGE, "line_no", "text", key.alias("paragraph_key"))
        .repartition(*PAGE)
        .groupBy(*PAGE, "paragraph_key")
        .agg(
            F.min("line_no").alias("para_no"),
            F.expr("listagg(text, '') within group (order by line_no)").alias("text"),
        )
    )
    kept = F.when(F.col("text") != "", F.col("text"))
    return (
        paragraphs.withColumn("text", kept)
        .groupBy(*PAGE)
        .agg(F.coalesce(F.expr("listagg(text, '\n') within group (order by para_no)"), F.lit("")).alias("text"))
    )


def book_text(pages: DataFrame, lines: DataFrame, per_part: int = PAGES_PER_PART) -> DataFrame:
    """Text of each book in parts of at most ``per_part`` pages, pages joined by a blank line.

    A book up to ``per_part`` pages is one row. Pages without result or text add nothing, and a book (or part)
    without text keeps its row with ''.
    """
    texts = pages.select(*PAGE, "ord").join(page_text(lines), PAGE, "left")
    texts = texts.withColumn("text", F.when(F.col("text") != "", F.col("text")))
    parts = text_parts(texts, ["book_id"], "ord", "text", "\n\n", "text", per_part=per_part)
    return parts.withColumn("text", F.coalesce("text", F.lit("")))


def has_text(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """Whether a book has any text. Looks at lines only, no text is joined."""
    filled = lines.where(F.col("text") != "").select("book_id", "page_id").distinct().withColumn("filled", F.lit(True))
    return (
        pages.select(*PAGE)
        .join(filled, PAGE, "left")
        .groupBy("book_id")
        .agg(F.coalesce(F.bool_or("filled"), F.lit(False)).alias("has_text"))
    )


def page_status(pages: DataFrame, lines: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """Per page: not-run, done or edited. ``results`` (book_id, page_id) also names recognised pages without lines."""
    per_page = page_flags(lines, results).drop("n_lines")
    status = (
        F.when(F.col("any_edit").isNull(), F.lit("not-run")).when(F.col("any_edit"), F.lit("edited")).otherwise(F.lit("done"))
    )
    return pages.select(*PAGE, "ord").join(per_page, PAGE, "left").select(*PAGE, "ord", status.alias("status"))


def ocr_status(pages: DataFrame, lines: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """Counts of page states per book."""

    def n(value: str) -> Column:
        return F.count_if(F.col("status") == value)

    return (
        page_status(pages, lines, results)
        .groupBy("book_id")
        .agg(
            F.count(F.lit(1)).alias("n_pages"),
            n("not-run").alias("n_not_run"),
            n("done").alias("n_done"),
            n("edited").alias("n_edited"),
        )
    )


def rank_lines_by_size(lines: DataFrame) -> DataFrame:
    """Non-blank lines of a page from the largest font size down, ties in reading order."""
    sized = nonblank_lines(lines).withColumn("font_size", line_font_size("w", "h"))
    return number_rows(
        sized,
        PAGE,
        [F.col("font_size"), slot("line_no")],
        [F.col("line_no")],
        "size_rank",
        start=1,
        descending=[True, False],
    )


def guess_title(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """Text of the largest line of every page, '' when the page has none."""
    size = line_font_size("w", "h")
    best = nonblank_lines(lines).groupBy(*PAGE).agg(F.max_by("text", F.struct(size, -F.col("line_no"))).alias("title"))
    return pages.select(*PAGE).join(best, PAGE, "left").select(*PAGE, F.coalesce("title", F.lit("")).alias("title"))


def join_selected_lines(pages: DataFrame, lines: DataFrame, selected: DataFrame) -> DataFrame:
    """Selected non-blank lines of a page in reading order, '' when nothing is selected."""
    joined = (
        nonblank_lines(lines)
        .join(selected.select(*PAGE, "line_id").distinct(), [*PAGE, "line_id"], "left_semi")
        .groupBy(*PAGE)
        .agg(F.expr("listagg(text, '') within group (order by line_no)").alias("text"))
    )
    return pages.select(*PAGE).join(joined, PAGE, "left").select(*PAGE, F.coalesce("text", F.lit("")).alias("text"))


def autofill_title(books: DataFrame, pages: DataFrame, lines: DataFrame) -> DataFrame:
    """Fill empty titles from the cover page once per recognition result.

    ``books`` has title, applied_ocr_key and ocr_key (time of the cover's latest result, null without one). A new
    result is marked as applied whether or not the title was empty.
    """
    cover = pages.where(F.col("ord") == 0).select(*PAGE)
    guess = guess_title(cover, lines.join(cover, PAGE, "left_semi")).select("book_id", F.col("title").alias("guess"))
    fresh = F.col("ocr_key").isNotNull() & ~F.col("ocr_key").eqNullSafe(F.col("applied_ocr_key"))
    filled = fresh & (F.col("title") == "") & (F.coalesce(F.col("guess"), F.lit("")) != "")
    return books.join(guess, "book_id", "left").select(
        "book_id",
        F.when(filled, F.col("guess")).otherwise(F.col("title")).alias("title"),
        F.when(fresh, F.col("ocr_key")).otherwise(F.col("applied_ocr_key")).alias("applied_ocr_key"),
    )
