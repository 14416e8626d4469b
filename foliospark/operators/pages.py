"""Page tables: appending, ordering, merging, deleting, adjustments and run reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.geometry import target_size
from foliospark.functions.text import (
    DEFAULT_QUALITY,
    DEFAULT_RESIZE_HEIGHT,
    DEFAULT_RESIZE_WIDTH,
    display_name,
    natural_sort_key,
)
from foliospark.plans.ordered import number_rows, slot, sorted_positions, text_parts

PAGE = ["book_id", "page_id"]
# Failed names joined in one row of a report.
NAMES_PER_PART = 4096

ADJUSTMENT_GROUPS = {
    "resize": ["resize_mode", "resize_width", "resize_height"],
    "quality": ["quality"],
    "tone": ["brightness", "contrast"],
}


def with_schema_defaults(pages: DataFrame) -> DataFrame:
    """Fills fields that older rows do not have."""
    defaults: dict[str, tuple[str, object]] = {
        "resize_mode": ("string", "none"),
        "resize_width": ("int", DEFAULT_RESIZE_WIDTH),
        "resize_height": ("int", DEFAULT_RESIZE_HEIGHT),
        "quality": ("int", DEFAULT_QUALITY),
        "file_name": ("string", None),
        "thumb_id": ("string", None),
        "block_id": ("string", None),
    }
    have = set(pages.columns)
    filled: dict[str, Column] = {}
    for name, (kind, value) in defaults.items():
        default = F.lit(value).cast(kind)
        filled[name] = F.coalesce(F.col(name), default) if name in have else default
    return pages.withColumns(filled)


def append_pages(pages: DataFrame, new: DataFrame) -> DataFrame:
    """Adds pages after the last one of their book with neutral tone. ``new`` has arrival_no as input order."""
    last = pages.groupBy("book_id").agg(F.max("ord").alias("_last"))
    placed = number_rows(new, ["book_id"], [slot("arrival_no")], [F.col("arrival_no")], "_i").join(last, "book_id", "left")
    added = placed.withColumns(
        {
            "ord": (F.coalesce(F.col("_last") + 1, F.lit(0)) + F.col("_i")).cast("int"),
            "brightness": F.lit(0),
            "contrast": F.lit(0),
        }
    )
    return pages.unionByName(added.drop("_last", "_i", "arrival_no"), allowMissingColumns=True)


def import_report(files: DataFrame, decoded: DataFrame) -> DataFrame:
    """Per book: files done, files in total and the names of failed files in input order.

    ``files`` (book_id, file_no, file_name); ``decoded`` (book_id, file_no, quota_exceeded, ok). Names come in parts
    of at most 4,096 inputs, so a report with very many failures stays in rows of bounded size.
    """
    rows = files.join(decoded, ["book_id", "file_no"], "left").withColumn("_failed", ~F.coalesce("ok", F.lit(False)))
    totals = rows.groupBy("book_id").agg(
        F.count_if(~F.col("_failed")).alias("n_done"),
        F.count(F.lit(1)).alias("n_total"),
        F.coalesce(F.bool_or(F.col("_failed") & F.col("quota_exceeded")), F.lit(False)).alias("quota_failure"),
    )
    failed = rows.where("_failed")
    names = text_parts(failed, ["book_id"], "file_no", "file_name", ", ", "failed_names", per_part=NAMES_PER_PART)
    return (
        totals.join(names, "book_id", "left")
        .withColumn("part_no", F.coalesce("part_no", F.lit(0)))
        .withColumn("failed_names", F.coalesce("failed_names", F.lit("")))
    )


def run_summary(targets: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Per run (book): finished pages, all pages, pages skipped because edited, failed names in target order."""
    rows = targets.join(outcomes, PAGE, "left")
    counts = rows.groupBy("book_id").agg(
        F.count_if(F.col("outcome").isin("done", "failed")).alias("n_done"),
        F.count_if(F.coalesce(F.col("outcome") != "skipped", F.lit(True))).alias("n_total"),
        F.count_if(F.col("outcome") == "skipped").alias("n_skipped_edited"),
    )
    failed = rows.where(F.col("outcome") == "failed").withColumn("name", F.coalesce("file_name", F.col("page_id").cast("string")))
    names = text_parts(failed, ["book_id"], "ord", "name", ", ", "failed_names", per_part=NAMES_PER_PART)
    return (
        counts.join(names, "book_id", "left")
        .withColumn("part_no", F.coalesce("part_no", F.lit(0)))
        .withColumn("failed_names", F.coalesce("failed_names", F.lit("")))
    )


def reindex_pages(pages: DataFrame) -> DataFrame:
    """Consecutive order from 0 per book."""
    return number_rows(pages, ["book_id"], [slot("ord")], [F.col("ord")], "_new").withColumn("ord", F.col("_new")).drop("_new")


def natural_order_pages(pages: DataFrame, descending: bool = False) -> DataFrame:
    """Pages in natural name order; descending is the exact reverse, ties included."""
    named = pages.withColumn("_key", natural_sort_key(display_name("file_name", "ord")))
    order = [F.col("_key"), F.col("ord")]
    # File names have no usable bucket, so the rows are placed by one range shuffle.
    wanted = [c.desc() for c in order] if descending else order
    placed = sorted_positions(named, ["book_id"], wanted, "_new")
    return placed.withColumn("ord", F.col("_new")).drop("_key", "_new")


def reorder_pages(pages: DataFrame, ordered: DataFrame) -> DataFrame:
    """Sets the order from an explicit list (book_id, page_id, new_ord); unlisted pages keep theirs.

    A listed page that does not exist is an error.
    """
    mine = pages.withColumn("_known", F.lit(True))
    rows = mine.join(ordered.select(*PAGE, "new_ord"), PAGE, "full_outer")
    missing = F.raise_error(F.concat(F.lit("page not found: "), F.col("page_id").cast("string")))
    order = F.when(F.col("_known").isNull(), missing.cast("int")).otherwise(F.coalesce("new_ord", "ord"))
    return rows.withColumn("ord", order).drop("_known", "new_ord")


def move_page(pages: DataFrame, moves: DataFrame) -> DataFrame:
    """Drags one page of a book onto another (book_id, source_id, target_id).

    Moving down it lands after the target, moving up before it; either way it takes the target's place and the pages
    in between shift by one.
    """
    at = pages.select("book_id", "page_id", "ord")
    spots = moves.join(
        at.select("book_id", F.col("page_id").alias("source_id"), F.col("ord").alias("_from")), ["book_id", "source_id"]
    ).join(at.select("book_id", F.col("page_id").alias("target_id"), F.col("ord").alias("_to")), ["book_id", "target_id"])
    o, a, b = F.col("ord"), F.col("_from"), F.col("_to")
    shifted = (
        F.when(a.isNull(), o)
        .when(o == a, b)
        .when((a < b) & (o > a) & (o <= b), o - 1)
        .when((a > b) & (o >= b) & (o < a), o + 1)
        .otherwise(o)
    )
    return pages.join(spots.select("book_id", "_from", "_to"), "book_id", "left").withColumn("ord", shifted).drop("_from", "_to")


def merge_spread_pages(pages: DataFrame, pairs: DataFrame) -> DataFrame:
    """Replaces two pages by one at the first page's place (book_id, first_id, second_id, merged_id).

    Both pages count with the size that their resize rule gives them: the merged page is as wide as both and as high
    as the higher one. Its adjustment starts from zero.
    """
    size = target_size("width", "height", "resize_mode", "resize_width", "resize_height")
    sized = with_schema_defaults(pages).select("book_id", "page_id", "ord", size.alias("_size"))
    first = sized.select("book_id", F.col("page_id").alias("first_id"), "ord", F.col("_size.width").alias("_w1"), F.col("_size.height").alias("_h1"))
    second = sized.select("book_id", F.col("page_id").alias("second_id"), F.col("_size.width").alias("_w2"), F.col("_size.height").alias("_h2"))
    merged = pairs.join(first, ["book_id", "first_id"]).join(second, ["book_id", "second_id"])
    gone = pairs.select("book_id", F.explode(F.array("first_id", "second_id")).alias("page_id"))
    fresh = merged.select(
        "book_id",
        F.col("merged_id").alias("page_id"),
        "ord",
        (F.col("_w1") + F.col("_w2")).alias("width"),
        F.greatest("_h1", "_h2").alias("height"),
        F.lit(0).alias("brightness"),
        F.lit(0).alias("contrast"),
    )
    kept = pages.join(gone, PAGE, "left_anti")
    return reindex_pages(kept.unionByName(fresh, allowMissingColumns=True))


def copy_adjustment(pages: DataFrame, source: DataFrame, group: str) -> DataFrame:
    """Copies one group of fields from the source page of a book (book_id, page_id) to all its pages.

    The source side has one row per book. It is not hinted: the planner broadcasts it when it measures small, and
    otherwise joins by key with skewed books split at run time.
    """
    fields = ADJUSTMENT_GROUPS[group]
    values = pages.join(source.select(*PAGE), PAGE, "left_semi").select(
        "book_id", F.lit(True).alias("_found"), *[F.col(f).alias(f"_{f}") for f in fields]
    )
    joined = pages.join(values, "book_id", "left")
    return joined.withColumns(
        {f: F.when(F.col("_found"), F.col(f"_{f}")).otherwise(F.col(f)) for f in fields}
    ).drop("_found", *[f"_{f}" for f in fields])


def merge_auto_adjustment(pages: DataFrame, levels: DataFrame) -> DataFrame:
    """Overwrites the tone of pages that have a measured result (book_id, page_id, auto_brightness, auto_contrast)."""
    return (
        pages.join(levels, PAGE, "left")
        .withColumn("brightness", F.coalesce("auto_brightness", "brightness"))
        .withColumn("contrast", F.coalesce("auto_contrast", "contrast"))
        .drop("auto_brightness", "auto_contrast")
    )


def page_flags(lines: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """Per recognised page: any_edit and n_lines. ``results`` (book_id, page_id) also names pages without lines."""
    rows = lines.select(*PAGE, "edited", F.lit(1).alias("_line"))
    if results is not None:
        rows = rows.unionByName(results.select(*PAGE, F.lit(False).alias("edited"), F.lit(0).alias("_line")))
    return rows.groupBy(*PAGE).agg(F.bool_or("edited").alias("any_edit"), F.sum("_line").alias("n_lines"))


def upsert_ocr(
    old: DataFrame, new: DataFrame, pages: DataFrame, overwrite_edited: bool = False, results: DataFrame | None = None
) -> DataFrame:
    """Replaces the lines of newly recognised pages.

    A result whose page is gone is dropped; a page with edited lines keeps them unless overwriting is on. ``results``
    (book_id, page_id) names the new results, which may have no lines; without it they are the pages of ``new``.
    """
    accepted = (new if results is None else results).select(*PAGE).distinct().join(pages.select(*PAGE), PAGE, "left_semi")
    if not overwrite_edited:
        accepted = accepted.join(old.where("edited").select(*PAGE).distinct(), PAGE, "left_anti")
    kept = old.join(accepted, PAGE, "left_anti")
    return kept.unionByName(new.join(accepted, PAGE, "left_semi").select(*old.columns))


def ocr_targets(
    requested: DataFrame,
    pages: DataFrame,
    lines: DataFrame,
    skip_done: bool = True,
    overwrite_edited: bool = False,
    results: DataFrame | None = None,
) -> DataFrame:
    """Requested pages that exist, with ``decision`` = run or skipped-edited; finished pages are left out.

    ``results`` (book_id, page_id) also names finished pages without lines.
    """
    flags = page_flags(lines, results).drop("n_lines")
    rows = requested.join(pages.select(*PAGE), PAGE, "left_semi").join(flags, PAGE, "left")
    if skip_done:
        rows = rows.where(F.col("any_edit").isNull())
    held = F.coalesce(F.col("any_edit"), F.lit(False)) & F.lit(not overwrite_edited)
    return rows.withColumn("decision", F.when(held, F.lit("skipped-edited")).otherwise(F.lit("run"))).drop("any_edit")


def delete_pages(table: DataFrame, deleted: DataFrame) -> DataFrame:
    """Removes all rows of deleted pages from a page, line or blob table."""
    return table.join(deleted.select(*PAGE), PAGE, "left_anti")


def prune_toc_selection(selection: DataFrame, pages: DataFrame) -> DataFrame:
    """Chosen pages that still exist, in the order of choice."""
    return selection.join(pages.select(*PAGE), PAGE, "left_semi")


def missing_thumbnails(pages: DataFrame, thumbnails: DataFrame) -> DataFrame:
    return pages.join(thumbnails.select(*PAGE), PAGE, "left_anti")


def restore_snapshot(current: DataFrame, snapshot: DataFrame, keys: list[str]) -> DataFrame:
    """Puts saved rows back by key; a saved row replaces the current one."""
    kept = current.join(snapshot.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(snapshot, allowMissingColumns=True)


def deleted_pages(before: DataFrame, after: DataFrame) -> DataFrame:
    """Page keys that disappeared, and survivors, as ``state``."""
    alive = after.select(*PAGE).withColumn("_alive", F.lit(True))
    state = F.when(F.col("_alive"), F.lit("kept")).otherwise(F.lit("deleted"))
    return before.select(*PAGE).join(alive, PAGE, "left").select(*PAGE, state.alias("state"))


def undo_bulk_adjustment(pages: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Adjustments as they were in the snapshot; pages without a snapshot row keep theirs, deleted ones stay deleted."""
    fields = [f for group in ADJUSTMENT_GROUPS.values() for f in group if f in pages.columns]
    saved = snapshot.select(*PAGE, F.lit(True).alias("_saved"), *[F.col(f).alias(f"_{f}") for f in fields])
    joined = pages.join(saved, PAGE, "left")
    return joined.withColumns(
        {f: F.when(F.col("_saved"), F.col(f"_{f}")).otherwise(F.col(f)) for f in fields}
    ).drop("_saved", *[f"_{f}" for f in fields])


def book_state(
    books: DataFrame, pages: DataFrame, lines: DataFrame, chapters: DataFrame, results: DataFrame | None = None
) -> DataFrame:
    """One summary row per book. ``results`` (book_id, page_id) also names recognised pages without lines."""
    page_side = (
        pages.select(*PAGE)
        .join(page_flags(lines, results), PAGE, "left")
        .groupBy("book_id")
        .agg(
            F.count(F.lit(1)).alias("n_pages"),
            F.count_if(F.col("any_edit").isNotNull()).alias("n_recognised"),
            F.count_if("any_edit").alias("n_edited"),
            F.coalesce(F.sum("n_lines"), F.lit(0)).alias("n_lines"),
        )
    )
    chapter_side = chapters.groupBy("book_id").agg(F.count(F.lit(1)).alias("n_chapters"))
    return books.join(page_side, "book_id", "left").join(chapter_side, "book_id", "left").fillna(
        0, ["n_pages", "n_recognised", "n_edited", "n_lines", "n_chapters"]
    )
