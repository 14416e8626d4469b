"""Queries over names, markup, e-book members and line edits."""

from pyspark.sql import functions as F

from foliospark.catalog.registry import query, sql
from foliospark.catalog.toc import with_outside
from foliospark.functions import text as X
from foliospark.operators import edits as E
from foliospark.operators import epub as U
from foliospark.plans.bindings import DUCK, NEEDS, Views
from foliospark.plans.session import stored

# Titles with awkward characters, one per document.
TITLE = """case doc_id % 6 when 0 then concat(source, ': ', text, '?') when 1 then repeat('.', cast(doc_id % 4 as int)) when 2 then ' '
 when 3 then concat('a\\b/', doc_id, '*"<x>|y ') when 4 then concat(' tab', chr(9), doc_id) end"""
DUCK["v_titles"] = f"select doc_id, text, {TITLE} title from documents"
JAVA_TITLE = TITLE.replace("a\\b", "a\\\\b")
STRIP = "' ' || chr(9) || chr(10) || chr(13)"


def titles(v: Views):
    return v.documents.selectExpr("doc_id", "text", f"{JAVA_TITLE} title")


@query(
    "text_file_name",
    sql(
        "v_titles",
        rf"""select doc_id, concat(case when regexp_full_match(b, '\.*') then 'ocr' else b end, '.txt') as name
        from (select doc_id, trim(regexp_replace(coalesce(title, ''), '[\\/:*?"<>|\x00-\x1f]', '_', 'g'), {STRIP}) b from v_titles)""",
    ),
)
def _(v: Views):
    return titles(v).select("doc_id", X.text_file_name("title").alias("name"))


@query(
    "export_file_name",
    sql(
        "v_titles",
        rf"""select doc_id, concat(coalesce(nullif(regexp_replace(trim(coalesce(title, ''), {STRIP}), '[\\/:*?"<>|]', '_', 'g'), ''), 'book'), '.epub') as name from v_titles""",
    ),
)
def _(v: Views):
    return titles(v).select("doc_id", X.export_file_name("title", "epub").alias("name"))


ESCAPE = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"


@query("escape_xml", sql("v_titles", f"select doc_id, {ESCAPE.format('text')} escaped, {ESCAPE.format('title')} escaped_title from v_titles"))
def _(v: Views):
    return titles(v).select("doc_id", X.escape_xml("text").alias("escaped"), X.escape_xml("title").alias("escaped_title"))


@query("iso_seconds_z", sql("v_events", "select seq, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') stamp from v_events"))
def _(v: Views):
    zoned = dict(v.events.dtypes)["ts"] == "timestamp"
    return v.events.select("seq", X.iso_seconds_z("ts", zoned=zoned).alias("stamp"))


DUCK["v_size"] = "select book_id, page_id, ord, cast(700 + ord % 90 as int) width, cast(900 + ord % 70 as int) height from v_toc_pages"
DUCK["v_nav"] = f"""
select *, case when not root then max(case when root then no end) over (partition by book_id order by no rows between unbounded preceding and 1 preceding) end par,
 lead(root) over (partition by book_id order by no) next_root from
 (select *, level < 2 or no = 0 root, concat('<li><a href="text/page-', page_index + 1, '.xhtml">', {ESCAPE.format('title')}, '</a>') link from
  (select *, row_number() over (partition by book_id order by node_no) - 1 no from v_export))"""
DUCK["v_nav_lists"] = """
select book_id, 'nav' list, cast(no // 4096 as int) part_no, string_agg(case when root and next_root = false then concat('      ', link, chr(10), '        <ol>')
 when root then concat('      ', link, '</li>') when coalesce(next_root, true) then concat('          ', link, '</li>', chr(10), '        </ol>', chr(10), '      </li>')
 else concat('          ', link, '</li>') end, chr(10) order by no) items from v_nav group by book_id, no // 4096
 union all select distinct book_id, 'nav', 0, '      <li><a href="text/page-1.xhtml">Start</a></li>' from v_toc_pages where book_id not in (select book_id from v_nav)
 union all select book_id, 'manifest', cast(ord // 4096 as int), string_agg(concat('    <item id="img', ord + 1, '" href="images/page-', ord + 1, '.jpg" media-type="image/jpeg"/>', chr(10),
  '    <item id="page', ord + 1, '" href="text/page-', ord + 1, '.xhtml" media-type="application/xhtml+xml"/>'), chr(10) order by ord) from v_toc_pages group by 1, ord // 4096
 union all select book_id, 'spine', cast(ord // 4096 as int), string_agg(concat('    <itemref idref="page', ord + 1, '"/>'), chr(10) order by ord) from v_toc_pages group by 1, ord // 4096"""
NEEDS.update(v_size=["v_toc_pages"], v_nav=["v_export"], v_nav_lists=["v_nav", "v_toc_pages"])


def sized_pages(v: Views):
    return v.toc_pages.selectExpr(
        "book_id", "page_id", "ord", "cast(700 + ord % 90 as int) width", "cast(900 + ord % 70 as int) height"
    )


@query("epub_lists", sql("v_nav_lists", "select * from v_nav_lists"))
@query("epub_lists_whole", sql("v_nav_lists", "select * from v_nav_lists"))
def _(v: Views):
    """All exported chapters, among others that lie before and behind the book."""
    return U.epub_lists(sized_pages(v), with_outside(v))


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _page_sql() -> str:
    out = _q(U.PAGE_XHTML)
    for mark, value in (("{n}", "ord + 1"), ("{w}", "width"), ("{h}", "height")):
        out = f"replace({out}, '{mark}', cast({value} as varchar))"
    return out


HEAD_SQL = (
    f"replace(replace(replace(replace({_q(U.OPF_HEAD)}, '{{identifier}}', md5(book_id)), '{{title}}', concat('T &amp; ', book_id)),"
    " '{author}', 'A &lt;x&gt;'), '{modified}', '2024-01-01T00:00:00Z')"
)


PACKAGE = f"""with b as (select distinct book_id from v_toc_pages), j as (select *, case when part_no > 0 then concat(chr(10), items) else items end c from v_nav_lists)
        select book_id, 'mimetype' path, 0 part_no, '{U.MIMETYPE}' as content from b
        union all select book_id, 'META-INF/container.xml', 0, {_q(U.CONTAINER)} from b
        union all select book_id, concat('OEBPS/text/page-', ord + 1, '.xhtml'), 0, {_page_sql()} from v_size
        union all select book_id, 'OEBPS/nav.xhtml', 0, {_q(U.NAV_HEAD)} from b
        union all select book_id, 'OEBPS/nav.xhtml', 1000000 + part_no, c from j where list = 'nav'
        union all select book_id, 'OEBPS/nav.xhtml', 2000000, {_q(U.NAV_TAIL)} from b
        union all select book_id, 'OEBPS/content.opf', 0, {HEAD_SQL} from b
        union all select book_id, 'OEBPS/content.opf', 1000000 + part_no, c from j where list = 'manifest'
        union all select book_id, 'OEBPS/content.opf', 2000000, {_q(U.OPF_MIDDLE)} from b
        union all select book_id, 'OEBPS/content.opf', 3000000 + part_no, c from j where list = 'spine'
        union all select book_id, 'OEBPS/content.opf', 4000000, {_q(U.OPF_TAIL)} from b"""


def package(v: Views, chapters):
    books = v.toc_pages.select("book_id").distinct().select(
        "book_id",
        F.concat(F.lit("T & "), "book_id").alias("title"),
        F.lit("A <x>").alias("author"),
        F.md5(F.col("book_id").cast("binary")).alias("identifier"),
        F.lit("2024-01-01T00:00:00Z").alias("modified"),
    )
    return U.epub_package_rows(books, sized_pages(v), chapters)


@query("epub_package_rows", sql("v_nav_lists v_size", PACKAGE))
@query("epub_package_rows_whole", sql("v_nav_lists v_size", PACKAGE))
def _(v: Views):
    return package(v, with_outside(v))


LINE_COLUMNS = ["book_id", "page_id", "line_no", "line_id", "text", "edited"]
KEYS = ["book_id", "page_id"]


@query(
    "update_line",
    sql(
        "v_lines",
        """select book_id, page_id, line_no, line_id, case when line_no % 4 = 1 then concat('new ', line_id) else text end as text,
        edited or line_no % 4 = 1 edited from v_lines""",
    ),
)
def _(v: Views):
    edits = v.lines.where("line_no % 4 = 1").select(*KEYS, "line_id", F.concat(F.lit("new "), "line_id").alias("new_text"))
    return E.update_line(v.lines.select(*LINE_COLUMNS), edits)


@query(
    "delete_line",
    sql(
        "v_lines",
        """select book_id, page_id, line_id, cast(row_number() over (partition by book_id, page_id order by line_no) - 1 as int) line_no
        from v_lines where line_no % 5 <> 2""",
    ),
)
def _(v: Views):
    gone = v.lines.where("line_no % 5 = 2").select(*KEYS, "line_id")
    return E.delete_line(v.lines.select(*LINE_COLUMNS), gone).select(*KEYS, "line_id", "line_no")


@query(
    "add_line",
    sql(
        "v_lines",
        """with new as (select book_id, page_id, concat(line_id, '/', i) line_id, '' as text, true edited, null block_id,
          case when i = 2 then (select max(line_no) + 1 from v_lines m where m.book_id = l.book_id and m.page_id = l.page_id) else line_no end pos, 1 kind,
          case when i = 2 then line_no * 3 + i else -(line_no * 3 + i) end tie
          from v_lines l, (select unnest([0, 1, 2]) i) where line_no % 6 = 3)
        select book_id, page_id, line_id, text, edited, block_id, cast(row_number() over (partition by book_id, page_id order by pos, kind, tie) - 1 as int) line_no
        from (select book_id, page_id, line_id, text, edited, block_id, line_no pos, 0 kind, 0 tie from v_lines union all select * from new)""",
    ),
)
def _(v: Views):
    lines = v.lines
    adds = lines.where("line_no % 6 = 3").selectExpr(
        *KEYS, "line_id anchor", "line_no", "x", "y", "w", "h", "explode(array(0, 1, 2)) i"
    ).selectExpr(
        *KEYS,
        "concat(anchor, '/', i) line_id",
        "case when i = 2 then 'unknown' else anchor end after_line_id",
        "line_no * 3 + i add_no",
        "x", "y", "w", "h",
    )
    return E.add_line(lines, adds).select(*KEYS, "line_id", "text", "edited", "block_id", "line_no")


@query(
    "move_line",
    sql(
        "v_lines",
        """with t as (select book_id, page_id, line_no a, greatest(0, least(n - 1, case when page_id % 2 = 0 then 99999 else cast(page_id % 5 - 2 as int) end)) b
          from (select *, count(*) over (partition by book_id, page_id) n from v_lines) where line_no = n // 2),
        k as (select l.*, case when line_no = a then case when a < b then b + 0.5::double else b - 0.5::double end else line_no end p from v_lines l join t using (book_id, page_id))
        select book_id, page_id, line_id, cast(row_number() over (partition by book_id, page_id order by p) - 1 as int) line_no from k""",
    ),
)
def _(v: Views):
    n = v.lines.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))
    middle = v.lines.select(*KEYS, "line_id", "line_no").join(n, KEYS).where("line_no = n div 2")
    moves = middle.selectExpr(*KEYS, "line_id", "case when page_id % 2 = 0 then 99999 else cast(page_id % 5 - 2 as int) end to_index")
    return E.move_line(v.lines.select(*LINE_COLUMNS), moves).select(*KEYS, "line_id", "line_no")


def edit_log(v: Views):
    """The event table as edits of the page with the user's number."""
    return v.events.selectExpr(
        "page_id",
        "seq",
        "op",
        "case when op = 'add' then concat(page_id, '+', seq) else concat(page_id, '-', cast(value as int) % 9) end line_id",
        "case when op = 'update' then concat('edit ', seq) end text",
        "case when op = 'add' then concat(page_id, '-', cast(value * 10 as int) % 9) end after_line_id",
        "case when op = 'move' then cast(value * 10 as int) % 12 - 1 end to_index",
    )


DUCK["v_replay_pages"] = """
select source book_id, doc_id page_id from documents union all select source, -1 - doc_id from documents
 union all select concat(source, '/copy'), doc_id from documents"""
DUCK["v_replay_lines"] = """
select book_id, page_id, list({'id': line_id, 'text': text, 'edited': edited} order by line_no) lines from (
 select book_id, page_id, line_no, line_id, text, edited from v_lines
 union all select concat(book_id, '/copy'), page_id, line_no, line_id, concat(text, '+'), edited from v_lines where page_id % 2 = 0) group by all"""
DUCK["v_replay_log"] = """
select p.book_id, p.page_id, list({'op': op, 'id': line_id, 'text': text, 'after': after_line_id, 'to': to_index} order by seq) edits, max(seq) last_edit
 from (select event_page, seq, op, case when op = 'add' then concat(event_page, '+', seq) else concat(event_page, '-', cast(floor(value) as int) % 9) end line_id,
   case when op = 'update' then concat('edit ', seq) end as text,
   case when op = 'add' then concat(event_page, '-', cast(floor(value * 10) as int) % 9) end after_line_id,
   case when op = 'move' then cast(floor(value * 10) as int) % 12 - 1 end to_index
  from (select page_id event_page, seq, op, value from v_events where op <> 'undo')) e
 join v_replay_pages p on e.event_page = case when p.page_id < 0 then -1 - p.page_id else p.page_id end group by p.book_id, p.page_id"""
_AT = "coalesce(list_position(list_transform(s, lambda l: l.id), {}), 0)"
_LINE = "struct_pack(id := x.id, text := {}, edited := true)"
DUCK["v_replayed"] = f"""
select book_id, page_id, last_edit, list_reduce(coalesce(edits, []), lambda s, x: list_transform([{_AT.format("case when x.op = 'add' then x.after else x.id end")}], lambda p:
  case when x.op = 'add' then s[1:case when p = 0 then len(s) else p end] || [{_LINE.format("''")}] || s[case when p = 0 then len(s) else p end + 1:]
   when p = 0 then s
   when x.op = 'update' then s[1:p - 1] || [{_LINE.format("x.text")}] || s[p + 1:]
   when x.op = 'delete' then s[1:p - 1] || s[p + 1:]
   else list_transform([greatest(0, least(x."to", len(s) - 1))], lambda k: (s[1:p - 1] || s[p + 1:])[1:k] || [s[p]] || (s[1:p - 1] || s[p + 1:])[k + 1:])[1] end)[1],
  coalesce(lines, [])) lines
 from v_replay_pages left join v_replay_lines using (book_id, page_id) left join v_replay_log using (book_id, page_id)"""
NEEDS.update(v_replay_pages=[], v_replay_lines=["v_lines"], v_replay_log=["v_events", "v_replay_pages"], v_replayed=["v_replay_pages", "v_replay_lines", "v_replay_log"])
REPLAYED = """
select book_id, page_id, cast(no - 1 as int) line_no, lines[no].id line_id, lines[no].text as text, lines[no].edited edited, last_edit
 from (select *, unnest(range(1, len(lines) + 1)) as no from v_replayed)
union all select book_id, page_id, null, null, null, null, last_edit from v_replayed where len(lines) = 0 and last_edit is not null"""


def replay_input(v: Views):
    """Lines, log and recognised pages: every page has a blank back, and a page of the same number in a second book.

    Odd pages of the second book are blank. All have the same edits.
    """
    pages = v.documents.selectExpr("source book_id", "doc_id page_id")
    second = "concat(book_id, '/copy') book_id"
    results = pages.unionByName(pages.selectExpr("book_id", "-1 - page_id page_id")).unionByName(pages.selectExpr(second, "page_id"))
    log = edit_log(v).where("op <> 'undo'").join(pages, "page_id")
    rest = [c for c in log.columns if c not in ("book_id", "page_id")]
    log = log.unionByName(log.selectExpr("book_id", "-1 - page_id page_id", *rest)).unionByName(log.selectExpr(second, "page_id", *rest))
    columns = ["book_id", "page_id", "line_no", "line_id", "text", "edited"]
    copies = v.lines.where("page_id % 2 = 0").selectExpr(second, "page_id", "line_no", "line_id", "concat(text, '+') text", "edited")
    return v.lines.select(*columns).unionByName(copies), log, results


@query("replay_line_edits", sql("v_replayed", REPLAYED))
def _(v: Views):
    return E.replay_line_edits(*replay_input(v))
