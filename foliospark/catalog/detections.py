"""Queries over detected boxes."""

from pyspark.sql import functions as F

from foliospark.catalog.registry import query, sql
from foliospark.functions import geometry as G
from foliospark.operators import detections as D
from foliospark.operators.reading_order import reading_order
from foliospark.plans.bindings import DUCK, NEEDS, Views
from foliospark.plans.session import stored

KEY = ["page_id"]

DUCK["v_scaled"] = """
select page_id, det_no, score, char_count, label - 1 class_id, case when label = 1 then 'block' else 'line' end kind, x, y,
 least(iw, r) - x w, least(ih, b + pad) - y h from (select *, greatest(0, l) x, greatest(0, t - pad) y from
  (select *, case when label = 1 then 0 else (b - t) * 0.02::double end pad from
   (select *, x1/s l, x2/s r, y1/s t, y2/s b from
    (select *, 1 + (page_id % 3) * 0.5::double s, cast(300 + page_id % 80 as double) iw, cast(250 + page_id % 60 as double) ih from v_dets))))"""
DUCK["v_boxes"] = "select * from v_scaled where score >= 0.3 and class_id in (0, 1, 2, 3, 4, 5, 16) and w >= 10 and h >= 10"
DUCK["v_steps"] = """
select page_id, row_number() over (partition by page_id order by score desc, det_no) n, {'d': det_no, 'x': x, 'y': y, 'w': w, 'h': h} box
 from v_boxes where kind = 'line'"""
IX = "greatest(0, least(k.x + k.w, s.box.x + s.box.w) - greatest(k.x, s.box.x)) * greatest(0, least(k.y + k.h, s.box.y + s.box.h) - greatest(k.y, s.box.y))"
DUCK["walk"] = f"""
select page_id, n, [box] kept from v_steps where n = 1
union all
select s.page_id, s.n, case when len(list_filter(kept, lambda k: {IX} > 0.5::double * (k.w * k.h + s.box.w * s.box.h - {IX}))) = 0
 then list_append(kept, s.box) else kept end from walk r join v_steps s on s.page_id = r.page_id and s.n = r.n + 1"""
DUCK["v_kept"] = """
select b.* from v_boxes b join (select page_id, unnest(kept).d det_no from (select page_id, arg_max(kept, n) kept from walk group by 1)) using (page_id, det_no)"""
NEEDS.update(v_scaled=["v_dets"], v_boxes=["v_scaled"], v_steps=["v_boxes"], walk=["v_steps"], v_kept=["v_boxes", "walk"])


def images(v: Views):
    return (
        v.dets.select("page_id")
        .distinct()
        .selectExpr(
            "page_id",
            "1 + (page_id % 3) * 0.5D scale",
            "cast(300 + page_id % 80 as int) img_w",
            "cast(250 + page_id % 60 as int) img_h",
        )
    )


def boxes(v: Views):
    return D.detection_filter(v.dets, images(v), KEY)


def kept_lines(v: Views, rows=None):
    rows = rows if rows is not None else boxes(v)
    return D.nms_lines(rows.where("kind = 'line'"), KEY)


@query("rescale_detections", sql("v_scaled", "select * from v_scaled"))
def _(v: Views):
    return D.rescale_detections(v.dets, images(v), KEY)


@query("detection_filter", sql("v_boxes", "select * from v_boxes"))
def _(v: Views):
    return boxes(v)


PAIRS = """select a.page_id, a.det_no, a.x1 ax, a.y1 ay, a.x2 - a.x1 aw, a.y2 - a.y1 ah, b.x1 bx, b.y1 by_, b.x2 - b.x1 bw, b.y2 - b.y1 bh
 from v_dets a join v_dets b on a.page_id = b.page_id and b.det_no = a.det_no + 1"""


def _pairs(v: Views):
    a = v.dets.selectExpr("page_id", "det_no", "x1 ax", "y1 ay", "x2 - x1 aw", "y2 - y1 ah")
    b = v.dets.selectExpr("page_id", "det_no - 1 det_no", "x1 bx", "y1 by", "x2 - x1 bw", "y2 - y1 bh")
    return a.join(b, ["page_id", "det_no"])


A = ("ax", "ay", "aw", "ah")
B = ("bx", "by", "bw", "bh")


@query(
    "box_iou",
    sql(
        "v_dets",
        f"""select page_id, det_no, case when u > 0 then i / u else 0 end iou from (select *, aw * ah + bw * bh - i u from
        (select *, greatest(0, least(ax + aw, bx + bw) - greatest(ax, bx)) * greatest(0, least(ay + ah, by_ + bh) - greatest(ay, by_)) i from ({PAIRS})))""",
    ),
)
def _(v: Views):
    iou = G.box_iou(tuple(map(F.col, A)), tuple(map(F.col, B)))
    return _pairs(v).select("page_id", "det_no", iou.alias("iou"))


@query(
    "box_center_in",
    sql(
        "v_dets",
        f"""select page_id, det_no, ax + aw/2 between bx and bx + bw and ay + ah/2 between by_ and by_ + bh inside from ({PAIRS})""",
    ),
)
def _(v: Views):
    inside = G.box_center_in(tuple(map(F.col, A)), tuple(map(F.col, B)))
    return _pairs(v).select("page_id", "det_no", inside.alias("inside"))


@query(
    "drag_to_box",
    sql(
        "v_dets",
        """select page_id, det_no, case when ok then floor(lx + 0.5::double) end x, case when ok then floor(ly + 0.5::double) end y,
         case when ok then floor(hx - lx + 0.5::double) end w, case when ok then floor(hy - ly + 0.5::double) end h
        from (select *, vw > 0 and abs(ex - sx) >= 8 and abs(y2 - y1) >= 8 and hx > lx and hy > ly ok from
        (select *, least(1000, greatest(0, (least(sx, ex) - 20) * rx)) lx, least(1000, greatest(0, (greatest(sx, ex) - 20) * rx)) hx,
          least(2000, greatest(0, (least(y1, y2) - 30) * 8::double)) ly, least(2000, greatest(0, (greatest(y1, y2) - 30) * 8::double)) hy from
        (select *, case when det_no % 2 = 0 then x1 else x2 end sx, case when det_no % 2 = 0 then x2 - det_no * 9 else x1 end ex,
          case when det_no % 5 = 4 then 0 else 200 end vw, 1000::double / nullif(case when det_no % 5 = 4 then 0 else 200 end, 0) rx from v_dets)))""",
    ),
)
def _(v: Views):
    log = v.dets.selectExpr(
        "*",
        "case when det_no % 2 = 0 then x1 else x2 end sx",
        "case when det_no % 2 = 0 then x2 - det_no * 9 else x1 end ex",
        "cast(case when det_no % 5 = 4 then 0 else 200 end as double) vw",
    )
    box = G.drag_to_box(
        (F.col("sx"), F.col("y1")),
        (F.col("ex"), F.col("y2")),
        (F.lit(20.0), F.lit(30.0), F.col("vw"), F.lit(250.0)),
        (F.lit(1000.0), F.lit(2000.0)),
    )
    return log.select("page_id", "det_no", *[box[c].alias(c) for c in "xywh"])


@query(
    "recognizer_route",
    sql("v_dets", "select page_id, det_no, case when det_no % 4 = 0 then 100 when char_count = 3 then 30 when char_count = 2 then 50 else 100 end route from v_dets"),
)
def _(v: Views):
    known = F.when(F.col("det_no") % 4 != 0, F.col("char_count"))
    return v.dets.select("page_id", "det_no", G.recognizer_route(known).alias("route"))


@query("nms_lines", sql("v_kept", "select * from v_kept").replace("with ", "with recursive ", 1))
def _(v: Views):
    return kept_lines(v, stored(boxes(v), "boxes"))


@query(
    "assign_lines_to_blocks",
    sql(
        "v_kept",
        """with recursive blocks as (select * from v_boxes where kind = 'block'),
        hit as (select l.page_id, l.det_no, l.score, (select min(b.det_no) from blocks b where b.page_id = l.page_id
          and l.x + l.w/2 between b.x and b.x + b.w and l.y + l.h/2 between b.y and b.y + b.h) block_no from v_kept l),
        used as (select *, count(block_no) over (partition by page_id) >= count(*) over (partition by page_id) * 0.7::double use from hit),
        firsts as (select page_id, block_no, row_number() over (partition by page_id order by max(score) desc, min(d)) - 1 seq from
          (select *, first_value(det_no) over (partition by page_id, block_no order by score desc, det_no) d from used where use and block_no is not null) group by 1, 2)
        select u.page_id, u.det_no, f.block_no, concat('block-', f.seq) block_id from used u join firsts f on f.page_id = u.page_id and f.block_no = u.block_no and use
        union all select page_id, det_no, null, null from used where not use or block_no is null""",
    ),
)
def _(v: Views):
    rows = stored(boxes(v), "boxes")
    return D.assign_lines_to_blocks(kept_lines(v, rows), rows.where("kind = 'block'"), KEY).select(
        "page_id", "det_no", "block_no", "block_id"
    )


@query("reading_order")
def _(v: Views):
    rows = stored(boxes(v), "boxes")
    lines = D.assign_lines_to_blocks(kept_lines(v, rows), rows.where("kind = 'block'"), KEY)
    return reading_order(lines, KEY).select("page_id", "det_no", "block_id", "line_no")
