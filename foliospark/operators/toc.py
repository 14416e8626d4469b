"""Tables of contents: line classes, entries, page scores, page detection and chapters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from foliospark.functions.geometry import line_font_size
from foliospark.functions.text import (
    bare_page_number,
    clean_title,
    has_letter_or_number,
    is_leader_line,
    is_toc_keyword,
    is_valid_title,
    nfkc_trim,
    toc_level,
    toc_tail_number,
)
from foliospark.operators.chapters import sort_chapters
from foliospark.plans.ordered import carry, number_rows, slot
from foliospark.plans.session import stored

# Fixed values of the detection rule.
SCAN_RATIO = 0.3
SCAN_MAX_PAGES = 40
MIN_ENTRIES = 5
HIT_SCORE = 0.5
MORE_MIN_ENTRIES = 2
HEADLINE_MIN_ENTRIES = 2
HEADLINE_SIZE_RATIO = 1.8

PAGE = ["book_id", "page_ord"]


def _earlier_on_page() -> WindowSpec:
    """A page is one image and its lines are the output of one recognition run, so this window is small.

    Everything that looks across the pages of a book uses the bucketed helpers instead.
    """
    return Window.partitionBy(*PAGE).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)


def normalized(lines: DataFrame) -> DataFrame:
    """Adds ``norm``, the trimmed NFKC text; computed once and reused by every rule below."""
    return lines.withColumn("norm", nfkc_trim("text"))


def significant_lines(lines: DataFrame) -> DataFrame:
    """Lines with at least one letter or number; blank lines, rule marks and lone leaders are left out."""
    return normalized(lines).where(has_letter_or_number("norm"))


def toc_line_flags(lines: DataFrame) -> DataFrame:
    return normalized(lines).withColumns(
        {"is_keyword": is_toc_keyword("norm"), "is_leader": is_leader_line("norm")}
    )


def _classified(lines: DataFrame) -> DataFrame:
    """Adds the role of each line: number only, title with number, plain text, or null for insignificant lines."""
    tail = toc_tail_number("norm")
    lines = lines.withColumns({"_bare": bare_page_number("norm"), "_tail": tail})
    inline = F.col("_tail").isNotNull() & is_valid_title(F.col("_tail.title"))
    role = (
        F.when(~has_letter_or_number("norm"), F.lit(None))
        .when(F.col("_bare").isNotNull(), F.lit("number"))
        .when(inline, F.lit("inline"))
        .otherwise(F.lit("text"))
    )
    return lines.withColumn("_role", role)


def _paired(lines: DataFrame, across_pages: bool) -> DataFrame:
    """Adds the entry that ends on a line, if any.

    A number pairs only with the significant line right before it, and only when that line is plain text with a valid
    title. Inside a page for scoring; over the whole book, in page order, for parsing.
    """
    rows = _classified(lines)
    if across_pages:
        rows = stored(rows.select(*PAGE, "line_no", "norm", "font_size", "_bare", "_tail", "_role"), "toc-lines")
    seen = F.when(
        F.col("_role").isNotNull(),
        F.struct(
            F.col("_role").alias("role"),
            F.when(F.col("_role") == "text", clean_title("norm")).alias("title"),
            F.col("page_ord"),
            F.col("line_no"),
            F.col("font_size"),
        ),
    )
    if across_pages:
        bucket = F.struct("page_ord", slot("line_no").alias("block"))
        rows = carry(rows, ["book_id"], bucket, ["page_ord", "line_no"], seen, "_prev", coarse=slot("page_ord"))
    else:
        rows = rows.withColumn("_prev", F.last(seen, ignorenulls=True).over(_earlier_on_page()))
    pairs = (F.col("_role") == "number") & (F.col("_prev.role") == "text") & is_valid_title(F.col("_prev.title"))
    alone = F.col("_role") == "inline"
    title = F.when(alone, F.col("_tail.title")).when(pairs, F.col("_prev.title"))
    page = F.when(alone, F.col("_tail.page")).when(pairs, F.col("_bare"))
    entry = F.when(
        title.isNotNull() & (page >= 1),
        F.struct(
            title.alias("title"),
            page.alias("printed_page"),
            toc_level(title).alias("level"),
            F.when(alone, F.col("page_ord")).otherwise(F.col("_prev.page_ord")).alias("title_page_ord"),
            F.when(alone, F.col("line_no")).otherwise(F.col("_prev.line_no")).alias("title_line_no"),
            F.when(alone, F.col("font_size")).otherwise(F.col("_prev.font_size")).alias("title_size"),
        ),
    )
    return rows.withColumn("entry", entry).drop("_bare", "_tail", "_role", "_prev")


def _sized(lines: DataFrame) -> DataFrame:
    return normalized(lines).withColumn("font_size", line_font_size("w", "h"))


def parse_toc_entries(lines: DataFrame, across_pages: bool = False) -> DataFrame:
    """Entries (title, printed page, level) with the lines they came from.

    ``lines`` needs book_id, page_ord, line_no, text, w and h. ``page_ord``/``line_no`` of the result is the line with
    the number.
    """
    rows = _paired(_sized(lines), across_pages).where(F.col("entry").isNotNull())
    return rows.select(*PAGE, "line_no", "entry.*")


def used_entry_lines(entries: DataFrame) -> DataFrame:
    """Distinct lines that serve as title or number of an entry."""
    titles = entries.select("book_id", F.col("title_page_ord").alias("page_ord"), F.col("title_line_no").alias("line_no"))
    numbers = entries.select("book_id", "page_ord", "line_no")
    return titles.unionByName(numbers).distinct()


def increasing_pages(entries: DataFrame) -> DataFrame:
    """Adds ``increasing``: printed page above that of the entry before it on the same page."""
    before = F.last("printed_page", ignorenulls=True).over(_earlier_on_page())
    return entries.withColumn("previous_page", before).withColumn(
        "increasing", F.col("previous_page").isNull() | (F.col("printed_page") > F.col("previous_page"))
    )


def toc_page_score(lines: DataFrame) -> DataFrame:
    """Score of every page as a table-of-contents page: one shuffle by page for pairing and aggregate together."""
    rows = _paired(_sized(lines), across_pages=False)
    before = F.last(F.col("entry.printed_page"), ignorenulls=True).over(_earlier_on_page())
    rows = rows.withColumn("_before", before)
    has_entry = F.col("entry").isNotNull()
    # The number and title lines of different entries never coincide, so the distinct lines can be added up.
    used = F.when(has_entry, F.when(F.col("entry.title_line_no") == F.col("line_no"), 1).otherwise(2)).otherwise(0)
    rising = F.when(
        has_entry, F.col("_before").isNull() | (F.col("entry.printed_page") > F.col("_before"))
    )
    filled = F.col("norm") != ""
    page = rows.groupBy(*PAGE).agg(
        F.count_if(filled).alias("n_lines"),
        F.count_if(has_entry).alias("entries"),
        F.sum(used).alias("used"),
        F.coalesce(F.bool_or(filled & is_toc_keyword("norm")), F.lit(False)).alias("has_keyword"),
        F.count_if(filled & is_leader_line("norm")).alias("leader_lines"),
        F.median(F.when(filled, F.col("font_size"))).alias("median_size"),
        F.min("entry.title_size").alias("smallest_title"),
        F.coalesce(F.bool_and(rising), F.lit(False)).alias("rising"),
    )
    ratio = F.when(F.col("n_lines") > 0, F.col("used") / F.col("n_lines")).otherwise(F.lit(0.0))
    bonus = F.when(F.col("has_keyword"), F.lit(0.3)).otherwise(F.lit(0.0))
    bonus2 = F.when(F.col("leader_lines") >= 3, F.lit(0.2)).otherwise(F.lit(0.0))
    headline = (
        (F.col("entries") >= HEADLINE_MIN_ENTRIES)
        & (F.col("smallest_title") >= F.col("median_size") * F.lit(HEADLINE_SIZE_RATIO))
        & F.col("rising")
    )
    return page.select(
        *PAGE,
        "entries",
        ratio.alias("ratio"),
        (ratio + bonus + bonus2).alias("score"),
        F.coalesce(headline, F.lit(False)).alias("headline_toc"),
    )


def toc_scan_window(pages: DataFrame) -> DataFrame:
    """The first pages of each book in which a table of contents is looked for."""
    counts = pages.groupBy("book_id").agg(F.count(F.lit(1)).alias("n_pages"))
    limit = F.least(F.ceil(F.col("n_pages") * F.lit(SCAN_RATIO)), F.lit(SCAN_MAX_PAGES))
    # The fixed upper bound reaches the scan; the exact one needs the page count.
    early = pages.where(F.col("ord") < SCAN_MAX_PAGES)
    return early.join(counts, "book_id").where(F.col("ord") < limit).drop("n_pages")


def unscanned_pages(pages: DataFrame, recognised: DataFrame) -> DataFrame:
    """Pages of the scan window without a recognition result."""
    return toc_scan_window(pages).join(recognised.select("book_id", "page_id").distinct(), ["book_id", "page_id"], "left_anti")


def detect_toc_pages(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """The first run of table-of-contents pages of each book.

    Only lines inside the scan window are normalised and scored. The windows below hold at most 40 rows per book.
    """
    window = toc_scan_window(pages).select("book_id", "page_id", "ord")
    keys = window.select("book_id", F.col("ord").alias("page_ord"))
    scores = toc_page_score(lines.join(keys, PAGE, "left_semi")).withColumnRenamed("page_ord", "ord")
    scored = window.join(scores, ["book_id", "ord"], "left")
    is_toc = F.coalesce(
        ((F.col("entries") >= MIN_ENTRIES) & (F.col("score") >= HIT_SCORE)) | F.col("headline_toc"), F.lit(False)
    )
    goes_on = is_toc | F.coalesce(
        (F.col("entries") >= MORE_MIN_ENTRIES) & (F.col("ratio") >= HIT_SCORE), F.lit(False)
    )
    book = Window.partitionBy("book_id")
    return (
        scored.withColumns({"_toc": is_toc, "_on": goes_on})
        .withColumn("_start", F.min(F.when(F.col("_toc"), F.col("ord"))).over(book))
        .withColumn("_stop", F.min(F.when((F.col("ord") > F.col("_start")) & ~F.col("_on"), F.col("ord"))).over(book))
        .where((F.col("ord") >= F.col("_start")) & (F.col("_stop").isNull() | (F.col("ord") < F.col("_stop"))))
        .select("book_id", "page_id", "ord")
    )


def resolve_body_start(pages: DataFrame, toc_pages: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """Index of the image with printed page 1 per book.

    A given page (book_id, page_id) decides, and must exist; otherwise it is the page after the last TOC page.
    """
    counts = pages.groupBy("book_id").agg(F.count(F.lit(1)).alias("n_pages"))
    last = (
        pages.join(toc_pages.select("book_id", "page_id").distinct(), ["book_id", "page_id"], "left_semi")
        .groupBy("book_id")
        .agg(F.max("ord").alias("last_toc"))
    )
    start = F.when(F.col("last_toc").isNull(), F.lit(0)).otherwise(F.least(F.col("last_toc") + 1, F.col("n_pages") - 1))
    result = counts.join(last, "book_id", "left").withColumn("body_start", start)
    if given is not None:
        wanted = given.select("book_id", F.col("page_id").alias("given_page"))
        found = (
            wanted.join(
                pages.select("book_id", F.col("page_id").alias("given_page"), F.col("ord").alias("given_ord")),
                ["book_id", "given_page"],
                "left",
            )
        )
        missing = F.raise_error(F.concat(F.lit("page not found: "), F.col("given_page").cast("string")))
        result = result.join(found, "book_id", "left").withColumn(
            "body_start",
            F.when(F.col("given_page").isNull(), F.col("body_start"))
            .when(F.col("given_ord").isNull(), missing.cast("int"))
            .otherwise(F.col("given_ord")),
        )
    return result.select("book_id", F.col("body_start").cast("int").alias("body_start"))


def entries_to_chapters(entries: DataFrame, pages: DataFrame, body_start: DataFrame) -> DataFrame:
    """Maps printed pages to images: index = body start + printed page - 1, kept inside the book.

    ``entries`` needs book_id, seq, title, printed_page and level.
    """
    counts = pages.groupBy("book_id").agg(F.count(F.lit(1)).alias("n_pages"))
    per_book = counts.join(body_start, "book_id")
    index = F.greatest(
        F.lit(0), F.least(F.col("body_start") + F.col("printed_page") - 1, (F.col("n_pages") - 1).cast("int"))
    )
    return (
        entries.join(per_book, "book_id")
        .withColumn("ord", index)
        .join(pages.select("book_id", "ord", "page_id"), ["book_id", "ord"])
        .select("book_id", "seq", "title", "page_id", "level")
    )


def number_entries(entries: DataFrame) -> DataFrame:
    """Position of each entry in its book."""
    return number_rows(
        stored(entries, "toc-entries"),
        ["book_id"],
        [F.col("page_ord"), slot("line_no")],
        [F.col("line_no")],
        "seq",
        coarse=slot("page_ord"),
    )


def parse_toc(
    toc_pages: DataFrame,
    lines: DataFrame,
    pages: DataFrame,
    body_start: DataFrame,
    old_chapters: DataFrame | None = None,
) -> DataFrame:
    """Chapters of each book from its chosen TOC pages, read in book order across page breaks.

    A book without any entry keeps its old chapters.
    """
    chosen = pages.join(toc_pages.select("book_id", "page_id").distinct(), ["book_id", "page_id"], "left_semi").select(
        "book_id", F.col("ord").alias("page_ord")
    )
    entries = number_entries(parse_toc_entries(lines.join(chosen, PAGE, "left_semi"), across_pages=True))
    chapters = sort_chapters(stored(entries_to_chapters(entries, pages, body_start), "toc-chapters"), pages)
    if old_chapters is None:
        return chapters
    kept = old_chapters.join(chapters.select("book_id").distinct(), "book_id", "left_anti")
    return chapters.unionByName(kept.select(*chapters.columns))
