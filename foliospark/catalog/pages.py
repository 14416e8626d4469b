"""Queries over page tables."""

from pyspark.sql import functions as F

from foliospark.catalog.registry import query, sql
from foliospark.functions import geometry as G
from foliospark.functions import text as X
from foliospark.functions.text import DEFAULT_RESIZE_HEIGHT, DEFAULT_RESIZE_WIDTH
from foliospark.operators import chapters as C
from foliospark.operators import pages as P
from foliospark.plans.bindings import DUCK, NEEDS, Views
from foliospark.plans.session import stored

PAGE = ["book_id", "page_id"]


@query(
    "with_schema_defaults",
    sql(
        "v_pages",
        """select book_id, page_id, coalesce(resize_mode, 'none') resize_mode, 1080 resize_width, 1920 resize_height,
        coalesce(quality, 75) quality, file_name, cast(null as varchar) thumb_id, cast(null as varchar) block_id from v_pages""",
    ),
)
def _(v: Views):
    names = ["resize_mode", "resize_width", "resize_height", "quality", "file_name", "thumb_id", "block_id"]
    return P.with_schema_defaults(v.pages).select(*PAGE, *names)


@query(
    "display_name",
    sql("v_pages", "select book_id, page_id, coalesce(case when page_id % 5 <> 2 then file_name end, concat('ページ ', ord + 1)) as name from v_pages"),
)
def _(v: Views):
    shown = X.display_name(F.when(F.col("page_id") % 5 != 2, F.col("file_name")), "ord")
    return v.pages.select(*PAGE, shown.alias("name"))


NATURAL = """list_transform(regexp_extract_all(nm, '([0-9]+|[^0-9]+)'), lambda c: {'k': case when regexp_full_match(c, '[0-9]+') then 1
 when c < '0' then 0 else 2 end, 'n': case when regexp_full_match(c, '[0-9]+') then length(ltrim(c, '0')) else 0 end,
 'v': case when regexp_full_match(c, '[0-9]+') then ltrim(c, '0') else c end})"""
DUCK["v_natural"] = f"""
select *, {NATURAL} skey from (select *, coalesce(case when page_id % 5 <> 2 then file_name end, concat('ページ ', ord + 1)) nm from v_pages)"""
NEEDS["v_natural"] = ["v_pages"]


@query(
    "natural_sort_key",
    sql(
        "v_natural",
        """select book_id, page_id, array_to_string(list_transform(skey, lambda s: concat(s.k, ':', s.n, ':', s.v)), '|') as sort_key from v_natural""",
    ),
)
def _(v: Views):
    name = X.display_name(F.when(F.col("page_id") % 5 != 2, F.col("file_name")), "ord")
    parts = F.transform(
        X.natural_sort_key(name),
        lambda s: F.concat_ws(":", s["k"].cast("string"), s["n"].cast("string"), s["v"]),
    )
    return v.pages.select(*PAGE, F.array_join(parts, "|").alias("sort_key"))


@query(
    "natural_order_pages",
    sql(
        "v_natural",
        "select book_id, page_id, cast(row_number() over (partition by book_id order by skey, ord) - 1 as int) ord from v_natural",
    ),
)
def _(v: Views):
    named = v.pages.withColumn("file_name", F.when(F.col("page_id") % 5 != 2, F.col("file_name")))
    return P.natural_order_pages(named).select(*PAGE, "ord")


@query(
    "natural_order_pages_desc",
    sql(
        "v_natural",
        "select book_id, page_id, cast(row_number() over (partition by book_id order by skey desc, ord desc) - 1 as int) ord from v_natural",
    ),
)
def _(v: Views):
    named = v.pages.withColumn("file_name", F.when(F.col("page_id") % 5 != 2, F.col("file_name")))
    return P.natural_order_pages(named, descending=True).select(*PAGE, "ord")


def _fit(edge: int) -> str:
    side = "cast(case when greatest(width, height) <= {e} then {s} else greatest(1, floor({s} * ({e}::double / greatest(width, height)) + 0.5::double)) end as int)"
    return ", ".join(f"{side.format(e=edge, s=s)} fit_{s}" for s in ("width", "height"))


@query("fit_within", sql("v_pages", f"select book_id, page_id, {_fit(320)} from v_pages"))
def _(v: Views):
    fit = G.fit_within("width", "height", G.THUMBNAIL_EDGE)
    return v.pages.select(*PAGE, fit["width"].alias("fit_width"), fit["height"].alias("fit_height"))


@query("fit_within_preview", sql("v_pages", f"select book_id, page_id, {_fit(1200)} from v_pages"))
def _(v: Views):
    fit = G.fit_within("width", "height", G.PREVIEW_EDGE)
    return v.pages.select(*PAGE, fit["width"].alias("fit_width"), fit["height"].alias("fit_height"))


@query(
    "target_size",
    sql(
        "v_pages",
        """select book_id, page_id,
        cast(case when m = 'width' then tw when m = 'height' then greatest(1, floor(width::double / height * th + 0.5::double)) else width end as int) out_width,
        cast(case when m = 'height' then th when m = 'width' then greatest(1, floor(height::double / width * tw + 0.5::double)) else height end as int) out_height
        from (select *, coalesce(resize_mode, 'none') m, 800 + page_id % 90 tw, case when page_id % 3 = 0 then 1920 else 700 + page_id % 50 end th from v_pages)""",
    ),
)
def _(v: Views):
    want_h = F.when(F.col("page_id") % 3 != 0, 700 + F.col("page_id") % 50)
    size = G.target_size("width", "height", "resize_mode", 800 + F.col("page_id") % 90, want_h)
    return v.pages.select(*PAGE, size["width"].alias("out_width"), size["height"].alias("out_height"))


@query(
    "adjustment_labels",
    sql(
        "v_pages",
        """select book_id, page_id,
        case when resize_mode = 'width' then concat('幅 ', width, 'px') when resize_mode = 'height' and page_id % 3 > 0 then concat('高さ ', height, 'px') end resize_label,
        case when not (brightness = 0 and contrast = 0) then concat('明るさ', brightness, ' コントラスト', contrast) end tone_label,
        concat('画質 ', coalesce(quality, 75)) quality_label from v_pages""",
    ),
)
def _(v: Views):
    height = F.when(F.col("page_id") % 3 > 0, F.col("height"))
    return v.pages.select(
        *PAGE,
        X.resize_label("resize_mode", "width", height).alias("resize_label"),
        X.tone_label("brightness", "contrast").alias("tone_label"),
        X.quality_label("quality").alias("quality_label"),
    )


@query(
    "jpeg_quality",
    sql("v_pages", "select book_id, page_id, least(100, greatest(1, coalesce(quality * 2 - 60, 75))) / 100.0::double quality from v_pages"),
)
def _(v: Views):
    return v.pages.select(*PAGE, G.jpeg_quality(F.col("quality") * 2 - 60).alias("quality"))


@query(
    "append_pages",
    sql(
        "v_pages",
        """select book_id, page_id, ord, brightness, contrast from v_pages where page_id % 4 <> 1
        union all select book_id, page_id, cast(coalesce(m + 1, 0) + row_number() over (partition by book_id order by page_id) - 1 as int), 0, 0
        from (select * from v_pages where page_id % 4 = 1) left join (select book_id, max(ord) m from v_pages where page_id % 4 <> 1 group by 1) using (book_id)""",
    ),
)
def _(v: Views):
    new = v.pages.where("page_id % 4 = 1").drop("ord", "brightness", "contrast").withColumn("arrival_no", F.col("page_id"))
    return P.append_pages(v.pages.where("page_id % 4 <> 1"), new).select(*PAGE, "ord", "brightness", "contrast")


def _report(failed: str, position: str) -> str:
    return f"""select book_id, cast(floor({position}/4096) as int) part_no, string_agg(file_name, ', ' order by {position}) failed_names
     from v_pages where {failed} group by 1, 2"""


@query(
    "import_report",
    sql(
        "v_pages",
        f"""with names as ({_report('page_id % 6 in (1, 4)', 'ord')})
        select t.book_id, n_done, n_total, quota_failure, coalesce(part_no, 0) part_no, coalesce(failed_names, '') failed_names
        from (select book_id, count(*) filter (page_id % 6 not in (1, 4)) n_done, count(*) n_total, bool_or(page_id % 6 = 4 and page_id % 5 = 0) quota_failure
         from v_pages group by 1) t left join names using (book_id)""",
    ),
)
def _(v: Views):
    files = v.pages.select("book_id", F.col("ord").alias("file_no"), "file_name", "page_id")
    decoded = files.where("page_id % 6 <> 1").select(
        "book_id",
        "file_no",
        (F.col("page_id") % 6 != 4).alias("ok"),
        (F.col("page_id") % 5 == 0).alias("quota_exceeded"),
    )
    return P.import_report(files.drop("page_id"), decoded)


@query(
    "run_summary",
    sql(
        "v_pages",
        f"""with names as ({_report('page_id % 9 = 4', 'ord')})
        select t.book_id, n_done, n_total, n_skipped_edited, coalesce(part_no, 0) part_no, coalesce(failed_names, '') failed_names
        from (select book_id, count(*) filter (page_id % 9 in (0, 1, 2, 4)) n_done, count(*) filter (page_id % 9 <> 5) n_total,
          count(*) filter (page_id % 9 = 5) n_skipped_edited from v_pages group by 1) t left join names using (book_id)""",
    ),
)
def _(v: Views):
    outcome = F.expr(
        "case when page_id % 9 in (0, 1, 2) then 'done' when page_id % 9 = 4 then 'failed' when page_id % 9 = 5 then 'skipped' end"
    )
    outcomes = v.pages.select(*PAGE, outcome.alias("outcome")).where("outcome is not null")
    return P.run_summary(v.pages.select(*PAGE, "ord", "file_name"), outcomes)


@query(
    "reindex_pages",
    sql(
        "v_pages",
        "select book_id, page_id, cast(row_number() over (partition by book_id order by ord) - 1 as int) ord from v_pages where page_id % 5 <> 2",
    ),
)
def _(v: Views):
    return P.reindex_pages(v.pages.where("page_id % 5 <> 2")).select(*PAGE, "ord")


@query(
    "reorder_pages",
    sql(
        "v_pages",
        """select book_id, page_id, case when page_id % 3 <> 1 then cast(count(*) over (partition by book_id) - 1 - ord as int) else ord end ord from v_pages""",
    ),
)
def _(v: Views):
    n = v.pages.groupBy("book_id").agg(F.count(F.lit(1)).alias("n"))
    listed = v.pages.where("page_id % 3 <> 1").join(n, "book_id")
    return P.reorder_pages(
        v.pages, listed.select(*PAGE, (F.col("n") - 1 - F.col("ord")).cast("int").alias("new_ord"))
    ).select(*PAGE, "ord")


@query(
    "move_page",
    sql(
        "v_pages",
        """with s as (select book_id, case when book_id like '%1' then 1 else n - 2 end a, case when book_id like '%1' then n // 2 else 0 end b
          from (select book_id, count(*) n from v_pages group by 1)),
        u as (select p.book_id, page_id, ord, case when ord = a then case when a < b then b + 0.5::double else b - 0.5::double end else ord end k
          from v_pages p join s using (book_id))
        select book_id, page_id, cast(row_number() over (partition by book_id order by k) - 1 as int) ord from u""",
    ),
)
def _(v: Views):
    pages = stored(v.pages.select(*PAGE, "ord"), "pages")
    n = pages.groupBy("book_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    spots = n.select(
        "book_id",
        F.expr("case when book_id like '%1' then 1 else n - 2 end a"),
        F.expr("case when book_id like '%1' then n div 2 else 0 end b"),
    )
    moves = (
        spots.join(pages.selectExpr("book_id", "page_id source_id", "ord a"), ["book_id", "a"])
        .join(pages.selectExpr("book_id", "page_id target_id", "ord b"), ["book_id", "b"])
        .select("book_id", "source_id", "target_id")
    )
    return P.move_page(pages, moves)


@query(
    "merge_spread_pages",
    sql(
        "v_pages",
        f"""with t as (select book_id, page_id, ord,
          cast(case when resize_mode = 'width' then {DEFAULT_RESIZE_WIDTH} when resize_mode = 'height' then greatest(1, floor(width::double / height * {DEFAULT_RESIZE_HEIGHT} + 0.5::double)) else width end as int) width,
          cast(case when resize_mode = 'height' then {DEFAULT_RESIZE_HEIGHT} when resize_mode = 'width' then greatest(1, floor(height::double / width * {DEFAULT_RESIZE_WIDTH} + 0.5::double)) else height end as int) height
          from v_pages),
        pr as (select a.book_id, a.ord, a.page_id first_id, b.page_id second_id, a.width + b.width width, greatest(a.height, b.height) height
          from t a join t b on a.book_id = b.book_id and b.ord = a.ord + 1 where a.ord % 6 = 2),
        u as (select book_id, page_id, ord, width, height, brightness, contrast from v_pages
          where (book_id, page_id) not in (select (book_id, first_id) from pr) and (book_id, page_id) not in (select (book_id, second_id) from pr)
         union all select book_id, -1 - first_id, ord, width, height, 0, 0 from pr)
        select book_id, page_id, cast(row_number() over (partition by book_id order by ord) - 1 as int) ord, width, height, brightness, contrast from u""",
    ),
)
def _(v: Views):
    pages = stored(v.pages, "pages")
    first = pages.where("ord % 6 = 2").selectExpr("book_id", "ord + 1 ord", "page_id first_id")
    second = pages.selectExpr("book_id", "ord", "page_id second_id")
    pairs = first.join(second, ["book_id", "ord"]).selectExpr("book_id", "first_id", "second_id", "-1 - first_id merged_id")
    return P.merge_spread_pages(pages, pairs).select(*PAGE, "ord", "width", "height", "brightness", "contrast")


def _source(v: Views):
    return v.pages.where("ord = 0").select(*PAGE)


@query(
    "copy_adjustment",
    sql(
        "v_pages",
        """select p.book_id, p.page_id, p.resize_mode, p.quality, s.brightness, s.contrast from v_pages p
        join (select * from v_pages where ord = 0) s using (book_id)""",
    ),
)
def _(v: Views):
    return P.copy_adjustment(v.pages, _source(v), "tone").select(*PAGE, "resize_mode", "quality", "brightness", "contrast")


@query(
    "copy_adjustment_resize",
    sql(
        "v_pages",
        """select p.book_id, p.page_id, s.resize_mode, s.width resize_width, s.height resize_height, p.quality from v_pages p
        join (select * from v_pages where ord = 0) s using (book_id)""",
    ),
)
def _(v: Views):
    sized = v.pages.withColumns({"resize_width": F.col("width"), "resize_height": F.col("height")})
    return P.copy_adjustment(sized, _source(v), "resize").select(
        *PAGE, "resize_mode", "resize_width", "resize_height", "quality"
    )


@query(
    "copy_adjustment_quality",
    sql(
        "v_pages",
        "select p.book_id, p.page_id, s.quality, p.resize_mode from v_pages p join (select * from v_pages where ord = 0) s using (book_id)",
    ),
)
def _(v: Views):
    return P.copy_adjustment(v.pages, _source(v), "quality").select(*PAGE, "quality", "resize_mode")


CHAPTERS = "select book_id, page_id, ord seq, file_name title, cast(1 + page_id % 2 as int) level from v_pages"


@query(
    "remap_chapters",
    sql(
        "v_pages",
        f"""with ch as ({CHAPTERS}), nxt as (select book_id, page_id, row_number() over (partition by book_id order by ord) - 1 ord,
          count(*) over (partition by book_id) n from v_pages where page_id % 3 <> 1),
        place as (select book_id, page_id, sum(case when page_id % 3 <> 1 then 1 else 0 end) over (partition by book_id order by ord
          rows between unbounded preceding and 1 preceding) before from v_pages)
        select ch.book_id, coalesce(a.page_id, b.page_id) page_id, seq, title, level from ch join place using (book_id, page_id)
        left join nxt a on a.book_id = ch.book_id and a.page_id = ch.page_id
        join nxt b on b.book_id = ch.book_id and b.ord = least(coalesce(before, 0), b.n - 1)""",
    ),
)
def _(v: Views):
    pages = stored(v.pages, "pages")
    chapters = pages.selectExpr("book_id", "page_id", "ord seq", "file_name title", "cast(1 + page_id % 2 as int) level")
    after = stored(P.reindex_pages(pages.where("page_id % 3 <> 1")), "pages-after")
    return C.remap_chapters(chapters, pages, after)


@query(
    "merge_auto_adjustment",
    sql(
        "v_pages v_pixels",
        """with a as (select page_id, cast(avg(r) as int) - 100 ab, cast(avg(g) as int) - 120 ac from v_pixels group by 1)
        select book_id, p.page_id, coalesce(ab, brightness) brightness, coalesce(ac, contrast) contrast, quality from v_pages p left join a using (page_id)""".replace(
            "cast(avg(r) as int)", "cast(floor(avg(r)) as int)"
        ).replace("cast(avg(g) as int)", "cast(floor(avg(g)) as int)"),
    ),
)
def _(v: Views):
    levels = v.pixels.groupBy("page_id").agg(
        (F.floor(F.avg("r")) - 100).cast("int").alias("auto_brightness"),
        (F.floor(F.avg("g")) - 120).cast("int").alias("auto_contrast"),
    )
    levels = levels.join(v.pages.select(*PAGE), "page_id")
    return P.merge_auto_adjustment(v.pages, levels).select(*PAGE, "brightness", "contrast", "quality")


NEW_LINES = "select book_id, page_id, line_no, line_id || '-r2' line_id, concat(text, '!') as text, false edited from v_lines where page_id % 3 = 0"
GONE = "page_id % 10 = 6"


@query(
    "upsert_ocr",
    sql(
        "v_pages v_ocr_lines",
        f"""with new as ({NEW_LINES}), acc as (select book_id, page_id from v_pages where (page_id % 3 = 0 or page_id % 7 = 5) and not ({GONE})
          and (book_id, page_id) not in (select distinct (book_id, page_id) from v_ocr_lines where edited))
        select book_id, page_id, line_no, line_id, text, edited from v_ocr_lines where (book_id, page_id) not in (select (book_id, page_id) from acc)
        union all select * from new where (book_id, page_id) in (select (book_id, page_id) from acc)""",
    ),
)
def _(v: Views):
    columns = ["book_id", "page_id", "line_no", "line_id", "text", "edited"]
    new = v.lines.where("page_id % 3 = 0").select(
        "book_id", "page_id", "line_no", F.concat("line_id", F.lit("-r2")).alias("line_id"),
        F.concat("text", F.lit("!")).alias("text"), F.lit(False).alias("edited"),
    )
    # every page of the first kind has new lines, those of the second kind came out blank
    results = v.pages.where("page_id % 3 = 0 or page_id % 7 = 5")
    return P.upsert_ocr(v.ocr_lines.select(*columns), new, v.pages.where(f"not ({GONE})"), results=results)


@query(
    "ocr_targets",
    sql(
        "v_pages v_ocr_lines",
        f"""select book_id, page_id, case when e then 'skipped-edited' else 'run' end decision from v_pages
        left join (select book_id, page_id, bool_or(edited) e from v_ocr_lines group by 1, 2) using (book_id, page_id) where not ({GONE})""",
    ),
)
def _(v: Views):
    return P.ocr_targets(v.pages.select(*PAGE), v.pages.where(f"not ({GONE})"), v.ocr_lines, skip_done=False)


@query(
    "ocr_targets_new_only",
    sql("v_pages v_results", f"select book_id, page_id, 'run' decision from v_pages where not ({GONE}) and (book_id, page_id) not in (select (book_id, page_id) from v_results)"),
)
def _(v: Views):
    return P.ocr_targets(v.pages.select(*PAGE), v.pages.where(f"not ({GONE})"), v.ocr_lines, results=v.results)


@query("delete_pages", sql("v_lines", f"select book_id, page_id, line_no from v_lines where not ({GONE})"))
def _(v: Views):
    return P.delete_pages(v.lines.select("book_id", "page_id", "line_no"), v.pages.where(GONE))


@query(
    "prune_toc_selection",
    sql("v_pages", f"select book_id, page_id, cast(page_id * 7 % 1000 as int) choice_no from v_pages where page_id % 4 = 2 and not ({GONE})"),
)
def _(v: Views):
    chosen = v.pages.where("page_id % 4 = 2").selectExpr("book_id", "page_id", "cast(page_id * 7 % 1000 as int) choice_no")
    return P.prune_toc_selection(chosen, v.pages.where(f"not ({GONE})"))


@query("missing_thumbnails", sql("v_pages", "select book_id, page_id, width, height from v_pages where page_id % 8 in (1, 3)"))
def _(v: Views):
    done = v.pages.where("page_id % 8 not in (1, 3)").select(*PAGE)
    return P.missing_thumbnails(v.pages.select(*PAGE, "width", "height"), done)


@query(
    "restore_snapshot",
    sql(
        "v_pages",
        """select book_id, page_id, ord, case when page_id % 5 in (0, 1) then brightness else 7 end brightness from v_pages
        where page_id % 5 in (0, 1) or page_id % 3 = 0""",
    ),
)
def _(v: Views):
    rows = v.pages.select(*PAGE, "ord", "brightness")
    return P.restore_snapshot(rows.where("page_id % 3 = 0").withColumn("brightness", F.lit(7)), rows.where("page_id % 5 in (0, 1)"), PAGE)


@query(
    "deleted_pages",
    sql("v_pages", "select book_id, page_id, case when page_id % 3 = 1 then 'deleted' else 'kept' end state from v_pages"),
)
def _(v: Views):
    return P.deleted_pages(v.pages, v.pages.where("page_id % 3 <> 1"))


@query(
    "undo_bulk_adjustment",
    sql(
        "v_pages",
        """select book_id, page_id, case when page_id % 4 <> 3 then brightness else 50 end brightness, case when page_id % 4 <> 3 then contrast else 50 end contrast,
        case when page_id % 4 <> 3 then quality else 90 end quality from v_pages where page_id % 7 <> 2""",
    ),
)
def _(v: Views):
    now = v.pages.where("page_id % 7 <> 2").withColumns({"brightness": F.lit(50), "contrast": F.lit(50), "quality": F.lit(90)})
    return P.undo_bulk_adjustment(now, v.pages.where("page_id % 4 <> 3")).select(*PAGE, "brightness", "contrast", "quality")


@query(
    "book_state",
    sql(
        "v_pages v_ocr_lines v_results",
        """select b.book_id, concat('Title of ', b.book_id) title, n_pages, coalesce(n_recognised, 0) n_recognised, coalesce(n_edited, 0) n_edited,
         cast(coalesce(n_lines, 0) as bigint) n_lines, coalesce(n_chapters, 0) n_chapters
        from (select book_id, count(*) n_pages from v_pages group by 1) b
        left join (select book_id, count(*) n_recognised, count(*) filter (e) n_edited, sum(c) n_lines
          from v_results left join (select book_id, page_id, bool_or(edited) e, count(*) c from v_ocr_lines group by 1, 2) using (book_id, page_id)
          group by 1) using (book_id)
        left join (select book_id, count(*) n_chapters from v_pages where page_id % 6 = 0 group by 1) using (book_id)""",
    ),
)
def _(v: Views):
    books = v.pages.select("book_id").distinct().withColumn("title", F.concat(F.lit("Title of "), F.col("book_id")))
    return P.book_state(books, v.pages, v.ocr_lines, v.pages.where("page_id % 6 = 0"), v.results)
