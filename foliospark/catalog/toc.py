"""Queries over tables of contents and chapters."""

from pyspark.sql import functions as F

from foliospark.catalog.registry import query, sql
from foliospark.functions import geometry as G
from foliospark.functions import text as X
from foliospark.operators import chapters as C
from foliospark.operators import toc as T
from foliospark.plans.bindings import DUCK, NEEDS, Views
from foliospark.plans.session import stored

LEADERS = r"\s.·・…‥⋯_\-–—―"
VALID = r"regexp_matches({0}, '\p{{L}}') and not regexp_full_match(lower({0}), '(chapter|part|section|page|no|p|第)\.?')"
CLEAN = "trim(regexp_replace({0}, '[" + LEADERS + "]+$', ''))"
LEVEL = (
    r"case when regexp_matches({0}, '^[0-9]+[.-][0-9]+') or regexp_matches({0}, '^第\s*[0-9一二三四五六七八九十百]+\s*節')"
    r" or regexp_matches({0}, '^\(\s*[0-9]+\s*\)') or regexp_matches({0}, '^[0-9]+\)')"
    r" or regexp_matches({0}, '(?i)^section\s*[0-9]') or regexp_matches({0}, '^§') then 2 else 1 end"
)
KEYWORD = r"regexp_full_match(lower(regexp_replace(t, '\s+', '', 'g')), '目次|もくじ|contents|tableofcontents')"
LEADER = r"regexp_matches(t, '[.·・…‥⋯]{2,}\s*[0-9]{1,4}\s*$')"

DUCK["v_norm"] = """
select *, regexp_extract(t, '([0-9]+)$', 1) digits, case when regexp_full_match(t, '[0-9]{1,4}') then cast(t as int)
 when regexp_full_match(t, '[〇一二三四五六七八九]{1,4}') then cast(translate(t, '〇一二三四五六七八九', '0123456789') as int) end bare
 from (select *, trim(replace(text, '…', '...')) t, least(w, h) font_size from v_toc_lines)"""
DUCK["v_tail"] = f"""
select *, case when length(digits) between 1 and 4 then {CLEAN.format('left(t, length(t) - length(digits))')} end tail_title,
 case when length(digits) between 1 and 4 then cast(digits as int) end tail_page, {CLEAN.format('t')} clean from v_norm"""
DUCK["v_sig"] = rf"""
select *, case when bare is not null then 'number' when tail_title is not null and {VALID.format('tail_title')} then 'inline' else 'text' end as role
 from v_tail where regexp_matches(t, '[\p{{L}}\p{{N}}]')"""


def _entries(partition: str) -> str:
    prev = f"over (partition by {partition} order by page_ord, line_no)"
    return f"""
select book_id, page_ord, line_no, title, printed_page, {LEVEL.format('title')} as level, title_page_ord, title_line_no, title_size from (
 select book_id, page_ord, line_no, case when role = 'inline' then tail_title else p_clean end title,
  case when role = 'inline' then tail_page else bare end printed_page,
  case when role = 'inline' then page_ord else p_page end title_page_ord, case when role = 'inline' then line_no else p_line end title_line_no,
  case when role = 'inline' then font_size else p_size end title_size
 from (select *, lag(role) {prev} p_role, lag(clean) {prev} p_clean, lag(page_ord) {prev} p_page, lag(line_no) {prev} p_line,
   lag(font_size) {prev} p_size from v_sig)
 where role = 'inline' or (role = 'number' and p_role = 'text' and {VALID.format('p_clean')})) where printed_page >= 1"""


DUCK["v_entries"] = _entries("book_id, page_ord")
DUCK["v_book_entries"] = _entries("book_id")
DUCK["v_scores_p"] = f"""
select l.book_id, l.page_ord, coalesce(entries, 0) entries, coalesce(used, 0) / n_lines ratio,
 coalesce(used, 0) / n_lines + (case when kw then 0.3::double else 0::double end) + (case when leaders >= 3 then 0.2::double else 0::double end) score,
 coalesce(entries >= 2 and smallest >= med * 1.8::double and rising, false) headline_toc
 from (select book_id, page_ord, count(*) n_lines, bool_or({KEYWORD}) kw, count(*) filter ({LEADER}) leaders, median(font_size) med
       from v_norm where t <> '' group by 1, 2) l
 left join (select book_id, page_ord, count(*) entries, min(title_size) smallest, bool_and(rise) rising
       from (select *, coalesce(printed_page > lag(printed_page) over (partition by book_id, page_ord order by line_no), true) rise from v_entries) group by 1, 2) e using (book_id, page_ord)
 left join (select book_id, page_ord, cast(count(*) as double) used from (select book_id, page_ord, line_no from v_entries union select book_id, title_page_ord, title_line_no from v_entries) group by 1, 2) u using (book_id, page_ord)"""
DUCK["v_window"] = """
select book_id, page_id, ord from v_toc_pages join (select book_id, count(*) n from v_toc_pages group by 1) using (book_id)
 where ord < least(ceil(n * 0.3::double), 40)"""
DUCK["v_found"] = """
select book_id, page_id, ord from (select *, min(case when ord > start_ord and not goes_on then ord end) over (partition by book_id) stop_ord
 from (select *, min(case when is_toc then ord end) over (partition by book_id) start_ord
  from (select w.*, coalesce((entries >= 5 and score >= 0.5) or headline_toc, false) is_toc,
    coalesce((entries >= 5 and score >= 0.5) or headline_toc or (entries >= 2 and ratio >= 0.5), false) goes_on
   from v_window w left join v_scores_p s on w.book_id = s.book_id and w.ord = s.page_ord)))
 where ord >= start_ord and (stop_ord is null or ord < stop_ord)"""
DUCK["v_chapters"] = """
select book_id, concat(book_id, '#', seq) chapter_id, seq, title, concat(book_id, '/', least(greatest(printed_page - 1, 0), n - 1)) page_id, level
 from (select *, cast(row_number() over (partition by book_id order by page_ord, line_no) - 1 as int) seq from v_book_entries)
 join (select book_id, count(*) n from v_toc_pages group by 1) using (book_id)"""
DUCK["v_export"] = """
select book_id, cast(row_number() over (partition by book_id order by ord, seq) - 1 as int) node_no, trim(title) title, ord page_index, level
 from v_chapters join v_toc_pages using (book_id, page_id) where trim(title) <> ''"""
DUCK["v_outline"] = """
select *, case when not is_root then max(case when is_root then node_no end) over (partition by book_id order by node_no
 rows between unbounded preceding and 1 preceding) end parent_no from (select *, level < 2 or node_no = 0 is_root from v_export)"""
NEEDS.update(
    v_norm=["v_toc_lines"], v_tail=["v_norm"], v_sig=["v_tail"], v_entries=["v_sig"], v_book_entries=["v_sig"],
    v_scores_p=["v_norm", "v_entries"], v_window=["v_toc_pages"], v_found=["v_window", "v_scores_p"],
    v_chapters=["v_book_entries", "v_toc_pages"], v_export=["v_chapters", "v_toc_pages"], v_outline=["v_export"],
)


def book_entries(v: Views):
    return T.number_entries(T.parse_toc_entries(v.toc_lines, across_pages=True))


def chapters(v: Views):
    """All entries of a book as chapters, printed page 1 being the first image."""
    start = v.toc_pages.select("book_id").distinct().withColumn("body_start", F.lit(0))
    mapped = T.entries_to_chapters(book_entries(v), v.toc_pages, start)
    rows = mapped.select(
        "book_id", F.concat_ws("#", "book_id", "seq").alias("chapter_id"), "seq", "title", "page_id", "level"
    )
    return stored(rows, "chapters")


def exported(v: Views):
    return stored(C.chapters_to_page_index(chapters(v), v.toc_pages), "exported-chapters")


LINE = "book_id, page_ord, line_no"
LINE_KEYS = ["book_id", "page_ord", "line_no"]


def _norm(v: Views, **columns):
    return T.normalized(v.toc_lines).select(*LINE_KEYS, *[c.alias(n) for n, c in columns.items()])


@query("nfkc_trim", sql("v_norm", f"select {LINE}, t norm from v_norm"))
def _(v: Views):
    return _norm(v, norm=F.col("norm"))


@query("toc_tail_number", sql("v_tail", f"select {LINE}, tail_title, tail_page from v_tail"))
def _(v: Views):
    tail = X.toc_tail_number("norm")
    return _norm(v, tail_title=tail["title"], tail_page=tail["page"])


@query("bare_page_number", sql("v_norm", f"select {LINE}, bare from v_norm"))
def _(v: Views):
    return _norm(v, bare=X.bare_page_number("norm"))


@query(
    "kanji_digits_to_int",
    sql(
        "v_norm",
        f"select {LINE}, case when regexp_full_match(t, '[〇一二三四五六七八九]+') then bare end as value from v_norm",
    ),
)
def _(v: Views):
    return _norm(v, value=X.kanji_digits_to_int("norm"))


@query("clean_title", sql("v_tail", f"select {LINE}, clean from v_tail"))
def _(v: Views):
    return _norm(v, clean=X.clean_title("norm"))


@query("is_valid_title", sql("v_tail", f"select {LINE}, {VALID.format('clean')} as valid from v_tail"))
def _(v: Views):
    return _norm(v, valid=X.is_valid_title(X.clean_title("norm")))


@query("toc_level", sql("v_tail", f"select {LINE}, {LEVEL.format('clean')} as level from v_tail"))
def _(v: Views):
    return _norm(v, level=X.toc_level(X.clean_title("norm")))


@query(
    "trailing_number_text",
    sql(
        "v_norm",
        f"""select {LINE}, case when regexp_full_match(s, '[0-9]{{1,4}}|[〇一二三四五六七八九]{{1,4}}') then s end number_text
        from (select *, regexp_replace(t, '\\s+', '', 'g') s from v_norm)""",
    ),
)
def _(v: Views):
    return v.toc_lines.select(*LINE_KEYS, X.trailing_number_text("text").alias("number_text"))


@query("toc_line_flags", sql("v_norm", f"select {LINE}, {KEYWORD} is_keyword, {LEADER} is_leader from v_norm"))
def _(v: Views):
    return T.toc_line_flags(v.toc_lines).select(*LINE_KEYS, "is_keyword", "is_leader")


@query("clamp_level", sql("v_tail", f"select {LINE}, case when length(t) % 4 >= 2 then 2 else 1 end as level from v_tail"))
def _(v: Views):
    return _norm(v, level=G.clamp_level(F.length("norm") % 4))


@query("significant_lines", sql("v_sig", f"select {LINE}, t norm from v_sig"))
def _(v: Views):
    return T.significant_lines(v.toc_lines).select(*LINE_KEYS, "norm")


@query("parse_toc_entries", sql("v_entries", "select * from v_entries"))
def _(v: Views):
    return T.parse_toc_entries(v.toc_lines)


@query(
    "used_entry_lines",
    sql("v_entries", f"select {LINE} from v_entries union select book_id, title_page_ord, title_line_no from v_entries"),
)
def _(v: Views):
    return T.used_entry_lines(T.parse_toc_entries(v.toc_lines))


@query(
    "increasing_pages",
    sql(
        "v_entries",
        f"""select {LINE}, printed_page, coalesce(printed_page > lag(printed_page) over (partition by book_id, page_ord
        order by line_no), true) increasing from v_entries""",
    ),
)
def _(v: Views):
    return T.increasing_pages(T.parse_toc_entries(v.toc_lines)).select(*LINE_KEYS, "printed_page", "increasing")


@query("toc_page_score", sql("v_scores_p", "select book_id, page_ord, entries, ratio, score from v_scores_p"))
def _(v: Views):
    return T.toc_page_score(v.toc_lines).drop("headline_toc")


@query("headline_toc", sql("v_scores_p", "select book_id, page_ord, headline_toc from v_scores_p"))
def _(v: Views):
    return T.toc_page_score(v.toc_lines).select("book_id", "page_ord", "headline_toc")


@query("toc_scan_window", sql("v_window", "select * from v_window"))
def _(v: Views):
    return T.toc_scan_window(v.toc_pages)


@query("detect_toc_pages", sql("v_found", "select * from v_found"))
def _(v: Views):
    return T.detect_toc_pages(v.toc_pages, v.toc_lines)


@query(
    "unscanned_pages",
    sql(
        "v_pages v_results",
        """select book_id, page_id, ord from v_pages join (select book_id, count(*) n from v_pages group by 1) using (book_id)
        where ord < least(ceil(n * 0.3::double), 40) and (book_id, page_id) not in (select (book_id, page_id) from v_results)""",
    ),
)
def _(v: Views):
    return T.unscanned_pages(v.pages, v.results).select("book_id", "page_id", "ord")


@query(
    "resolve_body_start",
    sql(
        "v_pages",
        """select book_id, cast(case when book_id like '%3' then min(case when ord = 2 then ord end)
         when max(case when page_id % 17 = 5 then ord end) is null then 0
         else least(max(case when page_id % 17 = 5 then ord end) + 1, count(*) - 1) end as int) body_start
        from v_pages group by 1""",
    ),
)
def _(v: Views):
    given = v.pages.where((F.col("ord") == 2) & F.col("book_id").like("%3"))
    return T.resolve_body_start(v.pages, v.pages.where("page_id % 17 = 5"), given)


@query(
    "entries_to_chapters",
    sql("v_chapters", "select book_id, seq, title, page_id, level from v_chapters"),
)
def _(v: Views):
    return chapters(v).drop("chapter_id")


@query(
    "parse_toc",
    sql(
        "v_found v_toc_pages v_sig",
        f"""with sig as (select v_sig.* from v_sig join v_found on v_sig.book_id = v_found.book_id and page_ord = ord),
        ents as ({DUCK['v_book_entries'].replace('v_sig', 'sig')}),
        starts as (select p.book_id, count(*) n, case when max(f.ord) is null then 0 else least(max(f.ord) + 1, count(*) - 1) end b
          from v_toc_pages p left join v_found f using (book_id, page_id) group by 1),
        idx as (select *, row_number() over (partition by book_id order by page_ord, line_no) s,
          greatest(0, least(b + printed_page - 1, n - 1)) i from ents join starts using (book_id)),
        fresh as (select book_id, cast(row_number() over (partition by book_id order by i, s) - 1 as int) seq, title, concat(book_id, '/', i) page_id, level from idx)
        select * from fresh union all select book_id, ord, concat('old ', ord), page_id, 1 from v_toc_pages where book_id not in (select book_id from fresh)""",
    ),
)
def _(v: Views):
    found = stored(T.detect_toc_pages(v.toc_pages, v.toc_lines), "found-toc-pages")
    start = T.resolve_body_start(v.toc_pages, found)
    old = v.toc_pages.selectExpr("book_id", "ord seq", "concat('old ', ord) title", "page_id", "1 level")
    return T.parse_toc(found, v.toc_lines, v.toc_pages, start, old)


# Pages whose ordinal is 5 modulo 7 count as unknown in the two join queries below.
KNOWN = "ord % 7 <> 5"


@query(
    "sort_chapters",
    sql(
        "v_chapters v_toc_pages",
        f"""select book_id, chapter_id, cast(row_number() over (partition by book_id order by ord nulls last, seq) - 1 as int) seq, title,
        page_id, level from v_chapters left join (select * from v_toc_pages where {KNOWN}) using (book_id, page_id)""",
    ),
)
def _(v: Views):
    return C.sort_chapters(chapters(v), v.toc_pages.where(KNOWN))


BLANKED = "case when seq % 9 = 4 then '  ' else concat(' ', title) end"


@query(
    "export_chapter_filter",
    sql(
        "v_chapters v_toc_pages",
        f"""select book_id, chapter_id, trim({BLANKED}) title, ord page_index from v_chapters join v_toc_pages using (book_id, page_id)
        where {KNOWN} and trim({BLANKED}) <> ''""",
    ),
)
def _(v: Views):
    rows = C.export_chapter_filter(chapters(v).withColumn("title", F.expr(BLANKED)), v.toc_pages.where(KNOWN))
    return rows.select("book_id", "chapter_id", "title", "page_index")


@query("chapters_to_page_index", sql("v_export", "select * from v_export"))
def _(v: Views):
    return exported(v)


def with_outside(v: Views):
    """All exported chapters, each beside one that lies before its book and one that lies behind it."""
    n = v.toc_pages.groupBy("book_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    places = F.array(F.col("page_index"), -1 - F.col("page_index"), F.col("page_index") + F.col("n"))
    rows = exported(v).join(n, "book_id").withColumn("page_index", F.explode(places))
    return rows.drop("n")


@query("outline_range_filter", sql("v_export", "select book_id, node_no, title, page_index, level from v_export"))
@query("outline_range_filter_whole", sql("v_export", "select book_id, node_no, title, page_index, level from v_export"))
def _(v: Views):
    return C.outline_range_filter(with_outside(v), v.toc_pages)


@query("outline_tree", sql("v_outline", "select book_id, node_no, title, page_index, level, parent_no from v_outline"))
def _(v: Views):
    return C.outline_tree(exported(v))


@query(
    "outline_links",
    sql(
        "v_outline",
        """with sib as (select *, coalesce(parent_no, -1) grp from v_outline),
        kids as (select book_id, parent_no, min(node_no) f, max(node_no) l, count(*) c from v_outline where parent_no is not null group by 1, 2)
        select s.book_id, s.node_no, title, page_index, level, s.parent_no,
         lag(s.node_no) over (partition by s.book_id, grp order by s.node_no) prev_no,
         lead(s.node_no) over (partition by s.book_id, grp order by s.node_no) next_no,
         f first_child, l last_child, cast(coalesce(c, 0) as int) n_children, cast(count(*) over (partition by s.book_id) as int) outline_total
        from sib s left join kids k on k.book_id = s.book_id and k.parent_no = s.node_no""",
    ),
)
def _(v: Views):
    return C.outline_links(exported(v))


@query(
    "edit_chapters",
    sql(
        "v_chapters v_toc_pages",
        """with n as (select book_id, count(*) n from v_toc_pages group by 1),
        patched as (select book_id, chapter_id, seq, case when seq % 5 = 1 then concat(title, ' *') else title end title,
          case when seq % 7 = 2 and book_id like '%1' then concat(book_id, '/', seq % n) else page_id end page_id, level
          from v_chapters join n using (book_id) where seq % 11 <> 3),
        moved as (select distinct p.book_id from patched p join v_chapters c using (book_id, chapter_id) where p.page_id <> c.page_id),
        listed as (select book_id, chapter_id, cast(row_number() over (partition by book_id
          order by case when book_id in (select book_id from moved) then ord else 0 end, seq) - 1 as int) seq, title, page_id, level
          from patched join v_toc_pages using (book_id, page_id))
        select * from listed union all
        select b.book_id, concat(b.book_id, '+', i), cast(coalesce(m, -1) + 1 + i as int), '', coalesce(lp, concat(b.book_id, '/0')), 1
        from (select book_id, unnest([0, 1]) i from n) b left join (select book_id, max(seq) m, arg_max(page_id, seq) lp from listed group by 1) using (book_id)""",
    ),
)
def _(v: Views):
    chs = chapters(v)
    n = v.toc_pages.groupBy("book_id").agg(F.count(F.lit(1)).alias("n"))
    moves = (F.col("seq") % 7 == 2) & F.col("book_id").like("%1")
    patches = (
        chs.join(n, "book_id")
        .where((F.col("seq") % 5 == 1) | moves)
        .select(
            "book_id",
            "chapter_id",
            F.when(F.col("seq") % 5 == 1, F.concat("title", F.lit(" *"))).alias("new_title"),
            F.when(moves, F.concat_ws("/", "book_id", (F.col("seq") % F.col("n")).cast("string"))).alias("new_page_id"),
            F.lit(None).cast("int").alias("new_level"),
        )
    )
    adds = n.select("book_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("add_no")).withColumn(
        "chapter_id", F.concat_ws("+", "book_id", "add_no")
    )
    deletes = chs.where("seq % 11 = 3").select("book_id", "chapter_id")
    return C.edit_chapters(chs, v.toc_pages, patches=patches, deletes=deletes, adds=adds)
