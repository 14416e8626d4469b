"""Chapter lists: order, page mapping, survival of page changes, outline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.text import js_trim
from foliospark.plans.ordered import Nearest, carry, carry_all, number_rows, running_sum, slot
from foliospark.plans.session import stored

NO_PAGE = 2**31 - 1


def _by_page(chapters: DataFrame, name: str) -> DataFrame:
    """Numbers chapters by (page_index, seq). One page may hold most chapters, so seq is a bucket too."""
    return number_rows(
        chapters,
        ["book_id"],
        [F.col("page_index"), slot("seq")],
        [F.col("seq")],
        name,
        coarse=slot("page_index"),
    )


def _with_index(chapters: DataFrame, pages: DataFrame, how: str) -> DataFrame:
    order = pages.select("book_id", "page_id", F.col("ord").alias("page_index"))
    return chapters.join(order, ["book_id", "page_id"], how)


def sort_chapters(chapters: DataFrame, pages: DataFrame) -> DataFrame:
    """New ``seq`` by page order; chapters of unknown pages go last, ties keep the list order."""
    placed = _with_index(chapters, pages, "left").withColumn("page_index", F.coalesce("page_index", F.lit(NO_PAGE)))
    return _by_page(placed, "_new").withColumn("seq", F.col("_new")).select(*chapters.columns)


def export_chapter_filter(chapters: DataFrame, pages: DataFrame) -> DataFrame:
    """Chapters with a known page and a title that is not blank; titles trimmed."""
    return (
        _with_index(chapters, pages, "inner")
        .withColumn("title", js_trim("title"))
        .where(F.col("title") != "")
    )


def chapters_to_page_index(chapters: DataFrame, pages: DataFrame) -> DataFrame:
    """Export form: title, page_index, level and ``node_no``, the position in page order."""
    return _by_page(export_chapter_filter(chapters, pages), "node_no").select(
        "book_id", "node_no", "title", "page_index", "level"
    )


def outline_range_filter(exported: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows whose page index exists in the exported book."""
    counts = pages.groupBy("book_id").agg(F.count(F.lit(1)).alias("n_pages"))
    inside = (F.col("page_index") >= 0) & (F.col("page_index") < F.col("n_pages"))
    return exported.join(counts, "book_id").where(inside).drop("n_pages")


def remap_chapters(chapters: DataFrame, old_pages: DataFrame, new_pages: DataFrame) -> DataFrame:
    """Moves chapters of vanished pages to the page that now stands at their place.

    Place = number of surviving pages before the old one, at most the last page. Unknown pages and books without
    pages lose their chapters.
    """
    alive = new_pages.select("book_id", "page_id").withColumn("_alive", F.lit(1))
    marked = old_pages.select("book_id", "page_id", "ord").join(alive, ["book_id", "page_id"], "left")
    survivors = running_sum(
        marked, ["book_id"], [slot("ord")], [F.col("ord")], F.coalesce("_alive", F.lit(0)), "_place", inclusive=False
    ).where(F.col("_alive").isNull())
    counts = new_pages.groupBy("book_id").agg(F.count(F.lit(1)).alias("_n"))
    targets = (
        survivors.join(counts, "book_id")
        .withColumn("ord", F.least(F.col("_place"), F.col("_n") - 1).cast("int"))
        .join(new_pages.select("book_id", "ord", F.col("page_id").alias("_target")), ["book_id", "ord"])
        .select("book_id", "page_id", "_target")
    )
    moved = chapters.join(targets, ["book_id", "page_id"]).withColumn("page_id", F.col("_target"))
    kept = chapters.join(alive, ["book_id", "page_id"], "left_semi")
    return kept.select(*chapters.columns).unionByName(moved.select(*chapters.columns))


def _is_root() -> Column:
    return (F.col("level") < 2) | (F.col("node_no") == 0)


def outline_tree(exported: DataFrame) -> DataFrame:
    """Adds ``parent_no``: null for roots, else the last root before the row. The first row is always a root."""
    root_no = F.when(_is_root(), F.col("node_no"))
    rows = carry(exported, ["book_id"], slot("node_no"), ["node_no"], root_no, "_root")
    return rows.withColumn("parent_no", F.when(~_is_root(), F.col("_root"))).drop("_root")


def outline_links(exported: DataFrame) -> DataFrame:
    """Sibling and child links of the two-level outline.

    Children follow their root without a gap, so links come from the neighbouring roots and the total per book.
    """
    root_no = F.when(_is_root(), F.col("node_no"))
    around = [Nearest(root_no, "_prev_root"), Nearest(root_no, "_next_root", backwards=True)]
    rows = carry_all(exported, ["book_id"], slot("node_no"), ["node_no"], around)
    rows = rows.withColumn("parent_no", F.when(~_is_root(), F.col("_prev_root")))
    totals = exported.groupBy("book_id").agg(F.count(F.lit(1)).cast("int").alias("outline_total"))
    rows = rows.join(totals, "book_id").withColumn("_end", F.coalesce("_next_root", "outline_total"))
    root = F.col("parent_no").isNull()
    no = F.col("node_no")
    children = F.when(root, F.col("_end") - no - 1).otherwise(F.lit(0))
    return rows.select(
        "book_id",
        "node_no",
        "title",
        "page_index",
        "level",
        "parent_no",
        F.when(root, F.col("_prev_root")).when(no - 1 > F.col("parent_no"), no - 1).alias("prev_no"),
        F.when(root, F.col("_next_root")).when(no + 1 < F.col("_end"), no + 1).alias("next_no"),
        F.when(children > 0, no + 1).alias("first_child"),
        F.when(children > 0, F.col("_end") - 1).alias("last_child"),
        children.alias("n_children"),
        "outline_total",
    )


def edit_chapters(chapters: DataFrame, pages: DataFrame, *, patches: DataFrame, deletes: DataFrame, adds: DataFrame) -> DataFrame:
    """Applies one batch of edits to chapter lists (book_id, chapter_id, seq, title, page_id, level).

    ``deletes`` (book_id, chapter_id); ``patches`` the same keys with new_title, new_page_id, new_level, null meaning
    unchanged; ``adds`` (book_id, chapter_id, add_no). A book with a changed page is sorted again. Added chapters are blank,
    on level 1, on the page of the last chapter or else the first page, at the end of the list.
    """
    key = ["book_id", "chapter_id"]
    patched = chapters.join(deletes.select(*key), key, "left_anti").join(patches, key, "left")
    patched = patched.select(
        *key,
        "seq",
        F.coalesce("new_title", "title").alias("title"),
        F.coalesce("new_page_id", "page_id").alias("page_id"),
        F.coalesce("new_level", "level").alias("level"),
        F.coalesce(F.col("new_page_id") != F.col("page_id"), F.lit(False)).alias("_moved"),
    )
    resort = patched.where("_moved").select("book_id").distinct().withColumn("_resort", F.lit(True))
    placed = _with_index(patched, pages, "left").join(resort, "book_id", "left")
    placed = placed.withColumn(
        "page_index", F.when(F.col("_resort"), F.coalesce("page_index", F.lit(NO_PAGE))).otherwise(F.lit(0))
    )
    placed = stored(placed, "chapter-edits")
    listed = _by_page(placed, "_new").withColumn("seq", F.col("_new")).select(*chapters.columns)
    ends = listed.groupBy("book_id").agg(
        F.max_by("page_id", "seq").alias("_last"), (F.max("seq") + 1).alias("_next")
    )
    first = pages.where(F.col("ord") == 0).select("book_id", F.col("page_id").alias("_first"))
    numbered = number_rows(adds, ["book_id"], [slot("add_no")], [F.col("add_no")], "_i")
    new = (
        numbered.join(first, "book_id")
        .join(ends, "book_id", "left")
        .select(
            *key,
            (F.coalesce("_next", F.lit(0)) + F.col("_i")).cast("int").alias("seq"),
            F.lit("").alias("title"),
            F.coalesce("_last", "_first").alias("page_id"),
            F.lit(1).alias("level"),
        )
    )
    return listed.unionByName(new.select(*listed.columns))
