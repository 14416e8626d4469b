"""Book-shaped views over the shared test tables.

``Views`` builds each view with DataFrame operations; ``DUCK`` holds the same views as DuckDB text for the oracle
queries. Views that number rows inside a book use the bucketed numbering of ``plans.ordered``.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.plans.ordered import number_rows, slot
from foliospark.plans.session import spread, stored

CHARSET = ["x", "y", "z", "a", "b", "c", "d"]


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def documents(self) -> DataFrame:
        return self.table("documents")

    @cached_property
    def pages(self) -> DataFrame:
        docs = self.table("documents").select(F.col("source").alias("book_id"), F.col("doc_id").alias("page_id"))
        docs = number_rows(docs, ["book_id"], [slot("page_id")], [F.col("page_id")], "ord")
        return docs.selectExpr(
            "book_id",
            "page_id",
            "ord",
            "concat('scan_', page_id % 37, case when page_id % 3 = 0 then '_b' else '' end, '.jpg') file_name",
            "cast(1000 + page_id % 1481 as int) width",
            "cast(1400 + (page_id*7) % 2109 as int) height",
            "cast((page_id*13) % 201 - 100 as int) brightness",
            "cast((page_id*29) % 201 - 100 as int) contrast",
            "case when page_id % 4 = 0 then 'width' when page_id % 4 = 1 then 'height' when page_id % 4 = 2 then 'none' end resize_mode",
            "case when page_id % 5 = 0 then cast(40 + page_id % 60 as int) end quality",
        )

    @cached_property
    def lines(self) -> DataFrame:
        return (
            self.table("documents")
            .selectExpr("source", "doc_id", r"posexplode(split(text, '\\n')) as (pos, t)")
            .selectExpr(
                "source book_id",
                "doc_id page_id",
                "cast(pos as int) line_no",
                "concat(doc_id,'-',pos) line_id",
                "cast((pos % 3)*400 as double) x",
                "cast(30*pos as double) y",
                "cast(8*length(t) as double) w",
                "cast(12 + (doc_id*7 + pos*13) % 40 as double) h",
                "t text",
                "(doc_id*31 + pos) % 97 = 0 edited",
                "case when (doc_id+pos) % 5 = 0 then null else concat('block-', cast(floor(pos/3) as int)) end block_id",
            )
        )

    @cached_property
    def ocr_lines(self) -> DataFrame:
        """Lines of the pages that were recognised: every eleventh page has no result."""
        return self.lines.where("page_id % 11 <> 3")

    @cached_property
    def results(self) -> DataFrame:
        """Recognised pages; half of those without lines are among them, as blank pages."""
        docs = self.table("documents").where("doc_id % 11 <> 3 or doc_id % 2 = 0")
        return docs.selectExpr("source book_id", "doc_id page_id")

    @cached_property
    def toc_lines(self) -> DataFrame:
        part = self.table("part").selectExpr("p_brand book_id", "p_partkey", "p_name", "p_type")
        part = number_rows(part, ["book_id"], [slot("p_partkey")], [F.col("p_partkey")], "idx")
        part = part.selectExpr(
            "*", "cast(floor(idx/8) as int) page_ord", "cast(idx % 8 as int) line_no", "p_partkey % 300 pg"
        ).selectExpr("*", "case when page_ord % 3 = 2 then 5 else cast(p_partkey % 9 as int) end kind")
        return part.selectExpr(
            "book_id",
            "page_ord",
            "line_no",
            """case kind
              when 0 then concat('第', 1 + p_partkey % 20, '章 ', p_name, ' ........ ', pg)
              when 1 then concat(p_name, ' - ', pg)
              when 2 then concat(p_name, '……', pg)
              when 3 then concat(1 + p_partkey % 9, '.', 1 + p_partkey % 4, ' ', p_name, ' ', pg)
              when 4 then concat('第', 1 + p_partkey % 20, '章 ', p_name)
              when 6 then concat('', pg)
              when 7 then case when p_partkey % 2 = 0 then 'Contents' else '二一' end
              when 8 then '|'
              else concat(p_name, ' and ', p_type, '.') end text""",
            "cast(10 + (p_partkey*7) % 50 as double) h",
            "cast(200 as double) w",
        )

    @cached_property
    def toc_pages(self) -> DataFrame:
        """Page table of the TOC books, written once because queries read it several times."""
        rows = (
            self.toc_lines.groupBy("book_id", "page_ord")
            .agg(F.count(F.lit(1)).alias("n"))
            .selectExpr("book_id", "concat(book_id, '/', page_ord) page_id", "page_ord ord")
        )
        return stored(rows, "toc-pages")

    @cached_property
    def dets(self) -> DataFrame:
        columns = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
        rows = self.table("lineitem").select(*columns).withColumn("page_id", F.expr("cast(floor(l_orderkey/4) as bigint)"))
        rows = number_rows(
            rows,
            ["page_id"],
            [F.col("l_orderkey"), F.col("l_linenumber"), slot("l_partkey", 64)],
            [F.col(c) for c in columns[:5]],
            "det_no",
        )
        return rows.selectExpr(
            "page_id",
            "det_no",
            "cast(1 + l_partkey % 7 as int) label",
            "cast((l_partkey % 4)*60 as double) x1",
            "cast((l_suppkey % 5)*40 as double) y1",
            "cast((l_partkey % 4)*60 + case when l_partkey % 7 = 0 then 180 else 40 + l_quantity end as double) x2",
            "cast((l_suppkey % 5)*40 + case when l_partkey % 7 = 0 then 160 else 12 + l_suppkey % 9 end as double) y2",
            "cast((l_partkey*17 + l_suppkey) % 1000 as double)/1000 score",
            "cast(1 + l_partkey % 3 as int) char_count",
        )

    @cached_property
    def pixels(self) -> DataFrame:
        return self.table("lineitem").selectExpr(
            "l_orderkey % 100 page_id",
            "cast(l_partkey % 256 as int) r",
            "cast((l_suppkey*3) % 256 as int) g",
            "cast(l_quantity*5 as int) % 256 b",
        )

    @cached_property
    def scores(self) -> DataFrame:
        return (
            self.table("embeddings")
            .selectExpr("vec_id", "posexplode(embedding) as (i, v)")
            .selectExpr(
                "vec_id line_id", "cast(floor(i/8) as int) pos", "cast(i % 8 as int) tok", "cast(v as double) logit"
            )
        )

    @cached_property
    def charset(self) -> DataFrame:
        return self.spark.createDataFrame(list(enumerate(CHARSET, start=1)), "tok int, ch string")

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events").selectExpr(
            "event_id seq",
            "ts",
            "concat('b', user_id % 10) book_id",
            "user_id page_id",
            """case event_type when 'click' then 'update' when 'view' then 'move' when 'purchase' then 'add'
               when 'error' then 'delete' else 'undo' end op""",
            "value",
        )

    @cached_property
    def assets(self) -> DataFrame:
        return self.table("pages").selectExpr(
            "concat('asset-', page_id % 100) dest",
            "page_id src_no",
            "case when page_id % 7 = 0 then 404 else 200 end http_status",
            "html content",
            "page_id % 2 = 0 official",
        )

    @cached_property
    def ink_boxes(self) -> DataFrame:
        """One tall line box per part, four next to each other on a page."""
        return self.table("part").selectExpr(
            "cast(floor(p_partkey/4) as bigint) page_id",
            "p_partkey line_id",
            "cast(10 + 10*(p_partkey % 4) as double) x",
            "cast(2 as double) y",
            "cast(6 as double) w",
            "cast(60 as double) h",
        )

    @cached_property
    def ink_pixels(self) -> DataFrame:
        """Pixels of the line boxes: glyphs, sometimes a thin rule, and a short tail below."""
        return (
            # a small file of parts unfolds to very many pixels, so parts are spread before
            spread(self.table("part").select("p_partkey"), "p_partkey")
            .selectExpr("p_partkey p", "explode(sequence(0, 63)) y")
            .selectExpr("p", "y", "explode(sequence(0, 6)) xo")
            .selectExpr("p", "y", "xo", f"{INK_RULE} ink")
            .selectExpr(
                "cast(floor(p/4) as bigint) page_id",
                "cast(10 + 10*(p % 4) + xo as int) x",
                "cast(y as int) y",
                "cast(case when ink then 40 + p % 60 when p % 7 = 0 then 70 + p % 60 else 230 end as int) r",
                "cast(case when ink then 40 + p % 60 when p % 7 = 0 then 70 + p % 60 else 230 end as int) g",
                "cast(case when ink then 43 + p % 60 when p % 7 = 0 then 70 + p % 60 else 233 end as int) b",
            )
        )

    @cached_property
    def page_images(self) -> DataFrame:
        """RGBA images whose bytes are the whole text of a document, row by row; the rest of the last rows repeats it.

        An empty text gives an image without rows, and a missing one neither height nor bytes.
        """
        return (
            self.table("documents")
            .selectExpr("source book_id", "doc_id page_id", "text", "octet_length(text) n", "cast(8 + doc_id % 9 as int) img_w")
            .selectExpr("*", "cast(4*ceil(n/(img_w*16.0)) as int) img_h", "cast(1 + ceil(img_w*16.0/greatest(n, 1)) as int) times")
            .selectExpr("book_id", "page_id", "img_w", "img_h", "substring(encode(repeat(text, times), 'UTF-8'), 1, img_w*img_h*4) rgba")
        )


INK_RULE = (
    "case when y < 36 then y % 6 < 5 and xo between 1 and 4 when y between 38 and 41 then p % 3 = 0 and xo = 2"
    " when y >= 46 + p % 5 and y < 58 then xo between 2 and 4 and (p % 2 = 0 or y % 6 <> 3) else false end"
)

DUCK: dict[str, str] = {
    "v_pages": """
select source book_id, doc_id page_id, cast(row_number() over (partition by source order by doc_id)-1 as int) ord,
 concat('scan_', doc_id % 37, case when doc_id % 3 = 0 then '_b' else '' end, '.jpg') file_name,
 cast(1000 + doc_id % 1481 as int) width, cast(1400 + (doc_id*7) % 2109 as int) height,
 cast((doc_id*13) % 201 - 100 as int) brightness, cast((doc_id*29) % 201 - 100 as int) contrast,
 case when doc_id % 4 = 0 then 'width' when doc_id % 4 = 1 then 'height' when doc_id % 4 = 2 then 'none' end resize_mode,
 case when doc_id % 5 = 0 then cast(40 + doc_id % 60 as int) end quality from documents""",
    "v_lines": """
select source book_id, doc_id page_id, cast(pos as int) line_no, concat(doc_id,'-',pos) line_id,
 cast((pos % 3)*400 as double) x, cast(30*pos as double) y, cast(8*length(t) as double) w, cast(12 + (doc_id*7 + pos*13) % 40 as double) h,
 t as text, (doc_id*31 + pos) % 97 = 0 edited, case when (doc_id+pos) % 5 = 0 then null else concat('block-', cast(floor(pos/3) as int)) end block_id
 from (select source, doc_id, generate_subscripts(a,1)-1 pos, unnest(a) t from (select source, doc_id, string_split(text, chr(10)) a from documents))""",
    "v_ocr_lines": "select * from v_lines where page_id % 11 <> 3",
    "v_toc_lines": """
select book_id, page_ord, line_no, case kind
  when 0 then concat('第', 1 + p_partkey % 20, '章 ', p_name, ' ........ ', pg) when 1 then concat(p_name, ' - ', pg) when 2 then concat(p_name, '……', pg)
  when 3 then concat(1 + p_partkey % 9, '.', 1 + p_partkey % 4, ' ', p_name, ' ', pg) when 4 then concat('第', 1 + p_partkey % 20, '章 ', p_name)
  when 6 then concat('', pg) when 7 then case when p_partkey % 2 = 0 then 'Contents' else '二一' end when 8 then '|' else concat(p_name, ' and ', p_type, '.') end as text,
  cast(10 + (p_partkey*7) % 50 as double) h, cast(200 as double) w
 from (select *, case when page_ord % 3 = 2 then 5 else cast(p_partkey % 9 as int) end kind, p_partkey % 300 pg from
  (select *, cast(floor(idx/8) as int) page_ord, cast(idx % 8 as int) line_no from
   (select p_brand book_id, p_partkey, p_name, p_type, row_number() over (partition by p_brand order by p_partkey)-1 idx from part)))""",
    "v_toc_pages": "select book_id, concat(book_id, '/', page_ord) page_id, page_ord ord from v_toc_lines group by book_id, page_ord",
    "v_dets": """
select cast(floor(l_orderkey/4) as bigint) page_id,
  cast(row_number() over (partition by floor(l_orderkey/4)
       order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as int) det_no,
  cast(1 + l_partkey % 7 as int) label,
  cast((l_partkey % 4)*60 as double) x1, cast((l_suppkey % 5)*40 as double) y1,
  cast((l_partkey % 4)*60 + case when l_partkey % 7 = 0 then 180 else 40 + l_quantity end as double) x2,
  cast((l_suppkey % 5)*40 + case when l_partkey % 7 = 0 then 160 else 12 + l_suppkey % 9 end as double) y2,
  cast((l_partkey*17 + l_suppkey) % 1000 as double)/1000 score,
  cast(1 + l_partkey % 3 as int) char_count
from lineitem""",
    "v_results": "select source book_id, doc_id page_id from documents where doc_id % 11 <> 3 or doc_id % 2 = 0",
    "v_pixels": "select l_orderkey % 100 page_id, cast(l_partkey % 256 as int) r, cast((l_suppkey*3) % 256 as int) g, cast(l_quantity*5 as int) % 256 b from lineitem",
    "v_scores": """
select vec_id line_id, cast(floor(i/8) as int) pos, cast(i % 8 as int) tok, cast(v as double) logit
 from (select vec_id, generate_subscripts(embedding,1)-1 i, unnest(embedding) v from embeddings)""",
    "v_charset": "select * from (values " + ", ".join(f"({i},'{c}')" for i, c in enumerate(CHARSET, start=1)) + ") t(tok, ch)",
    "v_events": """
select event_id seq, ts, concat('b', user_id % 10) book_id, user_id page_id, case event_type when 'click' then 'update' when 'view' then 'move'
 when 'purchase' then 'add' when 'error' then 'delete' else 'undo' end op, value from events""",
    "v_assets": """
select concat('asset-', page_id % 100) dest, page_id src_no, case when page_id % 7 = 0 then 404 else 200 end http_status,
 html as content, page_id % 2 = 0 official from pages""",
    "v_ink_boxes": """
select cast(floor(p_partkey/4) as bigint) page_id, p_partkey line_id, cast(10 + 10*(p_partkey % 4) as double) x, cast(2 as double) y,
 cast(6 as double) w, cast(60 as double) h from part""",
    "v_ink_pixels": f"""
select cast(floor(p/4) as bigint) page_id, cast(10 + 10*(p % 4) + xo as int) x, cast(y as int) y,
 cast(case when ink then 40 + p % 60 when p % 7 = 0 then 70 + p % 60 else 230 end as int) r,
 cast(case when ink then 40 + p % 60 when p % 7 = 0 then 70 + p % 60 else 230 end as int) g,
 cast(case when ink then 43 + p % 60 when p % 7 = 0 then 70 + p % 60 else 233 end as int) b
 from (select p, y, xo, {INK_RULE} ink from (select p_partkey p, y, xo from part, range(0, 64) a(y), range(0, 7) b(xo)))""",
}

# Views that are built from other views.
NEEDS = {"v_ocr_lines": ["v_lines"], "v_toc_pages": ["v_toc_lines"]}
