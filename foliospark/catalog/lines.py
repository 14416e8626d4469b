"""Queries over recognised lines."""

from pyspark.sql import functions as F

from foliospark.catalog.registry import query, sql
from foliospark.functions.geometry import line_font_size
from foliospark.operators import lines as L
from foliospark.plans.bindings import Views

PARAGRAPHS = """paras as (select book_id, page_id, min(line_no) para_no, arg_min(line_id, line_no) paragraph_id,
 string_agg(text, '' order by line_no) as text, cast(count(*) as int) n_lines, min(x) x, min(y) y,
 max(x+w)-min(x) w, max(y+h)-min(y) h from v_lines group by book_id, page_id, coalesce(block_id, line_id))"""
PAGE_TEXT = """page_texts as (select book_id, page_id, coalesce(string_agg(case when text <> '' then text end, chr(10) order by para_no), '') as text
 from paras group by book_id, page_id)"""
BLANK = "trim(text, ' ' || chr(9) || chr(10) || chr(13)) = ''"


@query("line_font_size", sql("v_lines", "select book_id, page_id, line_no, least(w, h) font_size from v_lines"))
def _(v: Views):
    return v.lines.select("book_id", "page_id", "line_no", line_font_size("w", "h").alias("font_size"))


@query("nonblank_lines", sql("v_lines", f"select book_id, page_id, line_no, text from v_lines where not {BLANK}"))
def _(v: Views):
    return L.nonblank_lines(v.lines).select("book_id", "page_id", "line_no", "text")


@query("build_paragraphs", sql("v_lines", f"with {PARAGRAPHS} select * from paras"))
def _(v: Views):
    return L.build_paragraphs(v.lines)


@query("page_text", sql("v_lines", f"with {PARAGRAPHS}, {PAGE_TEXT} select * from page_texts"))
def _(v: Views):
    return L.page_text(v.lines)


@query(
    "book_text",
    sql(
        "v_pages v_lines",
        f"""with {PARAGRAPHS}, {PAGE_TEXT}
        select book_id, cast(floor(ord/1024) as int) part_no,
         coalesce(string_agg(case when text <> '' then text end, chr(10) || chr(10) order by ord), '') as text
        from v_pages left join page_texts using (book_id, page_id) group by 1, 2""",
    ),
)
def _(v: Views):
    return L.book_text(v.pages, v.lines)


@query(
    "has_text",
    sql(
        "v_pages v_lines",
        """select book_id, coalesce(bool_or(text <> ''), false) has_text
        from v_pages left join v_lines using (book_id, page_id) group by 1""",
    ),
)
def _(v: Views):
    return L.has_text(v.pages, v.lines)


STATUS = """st as (select p.book_id, p.page_id, case when e then 'edited' when (p.book_id, p.page_id) in (select (book_id, page_id) from v_results) then 'done'
 else 'not-run' end status
 from v_pages p left join (select book_id, page_id, bool_or(edited) e from v_ocr_lines group by 1, 2) using (book_id, page_id))"""


@query(
    "ocr_status",
    sql(
        "v_pages v_ocr_lines v_results",
        f"""with {STATUS} select book_id, count(*) n_pages, count(*) filter (status = 'not-run') n_not_run,
        count(*) filter (status = 'done') n_done, count(*) filter (status = 'edited') n_edited from st group by 1""",
    ),
)
def _(v: Views):
    return L.ocr_status(v.pages, v.ocr_lines, v.results)


@query(
    "rank_lines_by_size",
    sql(
        "v_lines",
        f"""select book_id, page_id, line_id, cast(row_number() over (partition by book_id, page_id
        order by least(w, h) desc, line_no) as int) size_rank from v_lines where not {BLANK}""",
    ),
)
def _(v: Views):
    return L.rank_lines_by_size(v.lines).select("book_id", "page_id", "line_id", "size_rank")


@query(
    "guess_title",
    sql(
        "v_pages v_lines",
        f"""with best as (select book_id, page_id, text, row_number() over (partition by book_id, page_id
         order by least(w, h) desc, line_no) rn from v_lines where not {BLANK})
        select p.book_id, p.page_id, coalesce(text, '') title from v_pages p
        left join (select * from best where rn = 1) using (book_id, page_id)""",
    ),
)
def _(v: Views):
    return L.guess_title(v.pages, v.lines)


@query(
    "join_selected_lines",
    sql(
        "v_pages v_ocr_lines",
        f"""select p.book_id, p.page_id, coalesce(t, '') as text from v_pages p left join
        (select book_id, page_id, string_agg(text, '' order by line_no) t from v_ocr_lines
         where line_no % 3 = 1 and not {BLANK} group by 1, 2) using (book_id, page_id)""",
    ),
)
def _(v: Views):
    chosen = v.ocr_lines.where("line_no % 3 = 1").select("book_id", "page_id", "line_id")
    return L.join_selected_lines(v.pages, v.ocr_lines, chosen)


BOOKS = """books as (select book_id, case when book_id like '%1' then 'Kept title' else '' end title,
 case when book_id like '%2' then 'run-1' end applied_ocr_key,
 case when bool_or(page_id % 11 <> 3 and ord = 0) then 'run-1' end ocr_key from v_pages group by 1)"""


@query(
    "autofill_title",
    sql(
        "v_pages v_ocr_lines",
        f"""with {BOOKS}, best as (select book_id, page_id, text, row_number() over (partition by book_id, page_id
         order by least(w, h) desc, line_no) rn from v_ocr_lines where not {BLANK}),
        guess as (select book_id, coalesce(text, '') g from v_pages p left join (select * from best where rn = 1) using (book_id, page_id) where ord = 0)
        select book_id, case when fresh and title = '' and g <> '' then g else title end title,
         case when fresh then ocr_key else applied_ocr_key end applied_ocr_key
        from (select *, ocr_key is not null and ocr_key is distinct from applied_ocr_key fresh from books left join guess using (book_id))""",
    ),
)
def _(v: Views):
    books = v.pages.groupBy("book_id").agg(
        F.max(F.when((F.col("ord") == 0) & (F.col("page_id") % 11 != 3), F.lit("run-1"))).alias("ocr_key")
    )
    books = books.select(
        "book_id",
        F.when(F.col("book_id").like("%1"), F.lit("Kept title")).otherwise(F.lit("")).alias("title"),
        F.when(F.col("book_id").like("%2"), F.lit("run-1")).alias("applied_ocr_key"),
        "ocr_key",
    )
    return L.autofill_title(books, v.pages, v.ocr_lines)
