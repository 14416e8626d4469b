"""Queries over pixels, scores and assets."""

from pyspark.sql import functions as F

from foliospark.catalog.registry import query, sql
from foliospark.functions import geometry as G
from foliospark.functions import text as X
from foliospark.operators import assets as S
from foliospark.operators import pages as P
from foliospark.operators import pixels as I
from foliospark.operators.decode import greedy_decode
from foliospark.plans.bindings import DUCK, NEEDS, Views
from foliospark.plans.session import stored

KEY = ["page_id"]


def _curve(c: str) -> str:
    return f"cast(greatest(0, least(255, round_even(({c} - 128) * ((100 + k) / 100.0::double) + 128 + b0, 0))) as int) {c}"


@query(
    "tone_curve",
    sql(
        "v_pixels",
        f"""select page_id, {_curve('r')}, {_curve('g')}, {_curve('b')}, count(*) n from
        (select *, cast(page_id * 7 % 201 - 100 as int) b0, cast(page_id * 11 % 201 - 100 as int) k from v_pixels) group by all""",
    ),
)
def _(v: Views):
    b, k = F.expr("cast(page_id * 7 % 201 - 100 as int)"), F.expr("cast(page_id * 11 % 201 - 100 as int)")
    out = v.pixels.select("page_id", *[G.tone_curve(c, b, k).alias(c) for c in "rgb"])
    return out.groupBy("page_id", "r", "g", "b").agg(F.count(F.lit(1)).alias("n"))


LUM = "cast(round_even(0.299::double * r + 0.587::double * g + 0.114::double * b, 0) as int)"


@query(
    "luminance",
    sql("v_pixels", f"select page_id, {LUM} tone, (r + g + b) / 3.0::double ink, count(*) n from v_pixels group by all"),
)
def _(v: Views):
    out = v.pixels.select("page_id", G.tone_luminance("r", "g", "b").alias("tone"), G.ink_luminance("r", "g", "b").alias("ink"))
    return out.groupBy("page_id", "tone", "ink").agg(F.count(F.lit(1)).alias("n"))


DUCK["v_levels"] = f"""
select page_id, lo, hi, cast(floor(least(100, greatest(-100, -((lo + hi) / 2.0::double - 128) * ((100 + c) / 100.0::double))) + 0.5::double) as int) brightness,
 cast(floor(c + 0.5::double) as int) contrast from
 (select *, least(100, greatest(-100, least(4, greatest(0.1::double, 255.0::double / greatest(hi - lo, 1))) * 100 - 100)) c from
 (select page_id, min(case when cum > floor(total * 0.01::double) then bin end) lo, min(case when cum >= ceil(total * 0.99::double) then bin end) hi from
 (select *, sum(n) over (partition by page_id order by bin) cum, sum(n) over (partition by page_id) total from
 (select page_id, {LUM} bin, count(*) n from v_pixels group by 1, 2)) group by 1))"""
NEEDS["v_levels"] = ["v_pixels"]


@query("auto_levels", sql("v_levels", "select * from v_levels"))
def _(v: Views):
    return I.auto_levels(v.pixels, KEY)


@query(
    "auto_adjust_pages",
    sql(
        "v_pages v_levels",
        """select book_id, p.page_id, coalesce(l.brightness, p.brightness) brightness, coalesce(l.contrast, p.contrast) contrast, quality
        from v_pages p left join v_levels l using (page_id)""",
    ),
)
def _(v: Views):
    levels = I.auto_levels(v.pixels, KEY).selectExpr("page_id", "brightness auto_brightness", "contrast auto_contrast")
    levels = levels.join(v.pages.select("book_id", "page_id"), "page_id")
    return P.merge_auto_adjustment(v.pages, levels).select("book_id", "page_id", "brightness", "contrast", "quality")


@query(
    "greedy_decode",
    sql(
        "v_scores v_charset",
        """with best as (select line_id, pos, tok, row_number() over (partition by line_id, pos order by logit desc, tok) rn from v_scores),
        path as (select line_id, pos, tok, min(case when tok = 0 then pos end) over (partition by line_id) stop from best where rn = 1)
        select line_id, coalesce(string_agg(case when (stop is null or pos < stop) and tok >= 4 then ch end, '' order by pos), '') as text
        from path left join v_charset using (tok) group by 1""",
    ),
)
def _(v: Views):
    return greedy_decode(v.scores, v.charset, ["line_id"])


DUCK["v_profile"] = """
select page_id, line_id, y, min(x) min_x, max(x) max_x from
 (select *, min(v) over (partition by line_id) lo, max(v) over (partition by line_id) hi from
  (select b.page_id, line_id, p.x, p.y, (r + g + b_) / 3.0::double v from (select * exclude (b), b b_ from v_ink_pixels) p join v_ink_boxes b
   on p.page_id = b.page_id and p.x >= floor(b.x) and p.x < ceil(b.x + b.w) and p.y >= floor(b.y) and p.y < ceil(b.y + b.h)))
 where hi - lo >= 40 and v < (lo + hi) / 2 group by 1, 2, 3"""
DUCK["v_runs"] = """
select page_id, line_id, start_y, end_y, min_x, max_x from (select page_id, line_id, min(y) start_y, max(y) end_y, min(min_x) min_x, max(max_x) max_x from
 (select *, y - row_number() over (partition by line_id order by y) island from v_profile) group by page_id, line_id, island) join (select line_id, w from v_ink_boxes) using (line_id)
 where not (end_y - start_y + 1 >= w * 0.25::double and max_x - min_x + 1 <= greatest(2, w * 0.12::double))"""
DUCK["v_splits"] = """
select page_id, line_id, cast(row_number() over (partition by line_id order by start_y) - 1 as int) cand_no, x head_x, y head_y, w head_w, prev_end + 3 - y head_h,
 greatest(x, l - 2) tail_x, cast(start_y - 2 as double) tail_y, least(x + w, r + 3) - greatest(x, l - 2) tail_w, last_end + 3 - cast(start_y - 2 as double) tail_h
 from (select *, median(gap) over (partition by line_id) med from (select *, start_y - prev_end - 1 gap from
  (select v_runs.*, x, y, w, h, lag(end_y) over (partition by line_id order by start_y) prev_end, max(end_y) over (partition by line_id) last_end,
    min(min_x) over (partition by line_id order by start_y rows between current row and unbounded following) l,
    max(max_x) over (partition by line_id order by start_y rows between current row and unbounded following) r
   from v_runs join (select line_id, x, y, w, h from v_ink_boxes where h >= w * 1.5) using (line_id))))
 where gap >= greatest(w * 0.3::double, med * 1.5::double) and last_end - start_y + 1 <= w * 3.5::double"""
NEEDS.update(v_profile=["v_ink_pixels", "v_ink_boxes"], v_runs=["v_profile"], v_splits=["v_runs"])


def profile(v: Views):
    return I.ink_profile(v.ink_pixels, v.ink_boxes, KEY)


def splits(v: Views):
    return I.trailing_splits(I.ink_runs(profile(v), v.ink_boxes, KEY), v.ink_boxes, KEY)


@query("ink_profile", sql("v_profile", "select * from v_profile"))
def _(v: Views):
    return profile(v)


@query("ink_runs", sql("v_runs", "select * from v_runs"))
def _(v: Views):
    return I.ink_runs(profile(v), v.ink_boxes, KEY)


@query("trailing_splits", sql("v_splits", "select * from v_splits"))
def _(v: Views):
    return splits(v)


READ = "case when line_id % 3 = 0 then '6２' when line_id % 3 = 1 and cand_no = 0 then 'a1' else ' 二一 ' end"


@query(
    "accept_trailing_split",
    sql(
        "v_splits v_ink_boxes",
        f"""with ok as (select *, case when line_id % 3 = 0 then '62' else '二一' end txt, row_number() over (partition by line_id order by cand_no) rn
          from v_splits where not (line_id % 3 = 1 and cand_no = 0))
        select page_id, line_id, 0 piece_no, 'head' kind, cast(null as varchar) as text, head_x x, head_y y, head_w w, head_h h from ok where rn = 1
        union all select page_id, line_id, 1, 'tail', txt, tail_x, tail_y, tail_w, tail_h from ok where rn = 1
        union all select page_id, line_id, 0, 'whole', null, x, y, w, h from v_ink_boxes where line_id not in (select line_id from ok)""",
    ),
)
def _(v: Views):
    read = stored(splits(v), "splits").withColumn("tail_text", F.expr(READ))
    return I.accept_trailing_split(v.ink_boxes, read, KEY)


DUCK["v_expected"] = """
select dest, case when cast(substring(dest, 7) as int) % 9 <> 4 then sha256(arg_min(content, src_no)) end sha from v_assets group by 1"""
DUCK["v_checked"] = """
select a.dest, src_no, official, http_status, http_status between 200 and 299 st, sha,
 http_status between 200 and 299 and (sha is null or sha256(content) = sha) good from v_assets a join v_expected e using (dest)"""
NEEDS.update(v_expected=["v_assets"], v_checked=["v_assets", "v_expected"])


def expected(v: Views):
    sha = F.min_by(F.sha2(F.col("content").cast("binary"), 256), "src_no")
    return v.assets.groupBy("dest").agg(sha.alias("sha")).select(
        "dest", F.when(F.substring("dest", 7, 9).cast("int") % 9 != 4, F.col("sha")).alias("sha256")
    )


@query(
    "read_asset_manifest",
    sql(
        "v_assets",
        """select concat('set-', src_no // 5) dest, cast(null as varchar) sha256, cast(row_number() over (partition by src_no // 5 order by src_no) - 1 as int) priority,
        concat(dest, '/', src_no) source from v_assets""",
    ),
)
def _(v: Views):
    manifest = (
        v.assets.withColumn("source", F.concat_ws("/", "dest", "src_no"))
        .groupBy(F.expr("concat('set-', src_no div 5)").alias("dest"))
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("src_no", "source"))), lambda s: s["source"]).alias("sources"))
        .withColumn("sha256", F.lit(None).cast("string"))
    )
    return S.read_asset_manifest(manifest)


SHA = "case when src_no % 5 = 0 then null when src_no % 5 = 1 then 'xyz' else sha256(content) end"


@query(
    "content_key",
    sql("v_assets", f"select dest, src_no, concat('models/', sha, '/', dest, '.bin') as key from (select *, {SHA} sha from v_assets) where length(sha) = 64"),
)
def _(v: Views):
    sha = F.when(F.col("src_no") % 5 == 1, F.lit("xyz")).when(
        F.col("src_no") % 5 > 1, F.sha2(F.col("content").cast("binary"), 256)
    )
    files = v.assets.select("src_no", sha.alias("sha256"), F.concat(F.lit("public/a/"), "dest", F.lit(".bin")).alias("path"), "dest")
    good, _rejected = S.content_keys(files.withColumnsRenamed({"dest": "name", "path": "dest"}))
    return good.select(F.col("name").alias("dest"), "src_no", "key")


@query(
    "asset_problem",
    sql(
        "v_assets",
        """select dest, src_no, case when src_no % 3 = 0 or left(body, 1) = '<' then 'モデルではなくHTMLが返りました'
        when octet_length(encode(body)) < 2000 then concat('モデルとしては小さすぎます (', octet_length(encode(body)), ' バイト)') end problem
        from (select *, case when src_no % 2 = 0 then content else substring(content, 2) end body from v_assets)""",
    ),
)
def _(v: Views):
    kind = F.when(F.col("src_no") % 3 == 0, F.lit("text/html; charset=utf-8")).otherwise(F.lit("application/octet-stream"))
    body = F.when(F.col("src_no") % 2 == 0, F.col("content")).otherwise(F.expr("substring(content, 2)"))
    return v.assets.select("dest", "src_no", X.asset_problem(body, kind, min_bytes=2000).alias("problem"))


@query(
    "source_audit",
    sql(
        "v_checked",
        """select dest, official_alive, mirror_alive, official_alive = 0 official_dead, official_alive = 0 and not coalesce(mirror_alive, false) fully_dead,
        coalesce(not mirror_alive, false) mirror_dead from (select dest, count(*) filter (official and good) official_alive,
        bool_or(case when not official and sha is not null then good end) mirror_alive from v_checked group by 1)""",
    ),
)
def _(v: Views):
    return S.source_audit(expected(v), v.assets)


@query(
    "source_audit_exit",
    sql("v_checked", "select cast(max(case when alive = 0 then 1 else 0 end) as int) exit_code from (select dest, count(*) filter (official and good) alive from v_checked group by 1)"),
)
def _(v: Views):
    return S.audit_exit_code(S.source_audit(expected(v), v.assets))


@query(
    "first_valid_source",
    sql(
        "v_checked",
        """with p as (select *, row_number() over (partition by dest order by not official, src_no) - 1 priority,
          concat(src_no, ': ', case when st then 'SHA-256 不一致' else concat('HTTP ', http_status) end) reason from v_checked),
        best as (select dest, arg_min(src_no, priority) chosen_source from p where good group by 1),
        why as (select dest, cast(priority // 4096 as int) part_no, string_agg(reason, chr(10) order by priority) reasons from p
          where dest not in (select dest from best) group by 1, 2)
        select d.dest, chosen_source, coalesce(part_no, 0) part_no, reasons from (select distinct dest from p) d left join best using (dest) left join why using (dest)""",
    ),
)
def _(v: Views):
    return S.first_valid_source(expected(v), v.assets)


@query("mirror_plan", sql("v_expected", "select concat('models/', sha, '/', dest) as key, dest local_path, sha sha256 from v_expected where sha is not null"))
def _(v: Views):
    return S.mirror_plan(expected(v))
