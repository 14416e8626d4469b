"""Queries over event logs."""

from pyspark.sql import functions as F

from foliospark.catalog.registry import query, sql
from foliospark.catalog.books import REPLAYED, replay_input
from foliospark.plans.bindings import Views
from foliospark.plans.session import scratch_table, setting
from foliospark.streaming import edits as SE
from foliospark.streaming import events as E

HOUR = 3_600_000_000


@query(
    "debounce_adjustments",
    sql(
        "v_events",
        """select book_id, page_id, seq, value from (select *, lead(ts) over (partition by book_id, page_id order by ts, seq) nxt from v_events where op = 'update')
        where nxt is null or nxt >= ts + interval 12 hours""",
    ),
)
def _(v: Views):
    return E.debounce_adjustments(v.events.where("op = 'update'"), 12 * HOUR).select("book_id", "page_id", "seq", "value")


@query(
    "confirmed_deletes",
    sql(
        "v_events",
        """select book_id, page_id, seq from v_events d where op = 'delete' and not exists (select 1 from v_events u where u.op = 'undo'
        and u.page_id = d.page_id and u.book_id = d.book_id and u.ts between d.ts and d.ts + interval 24 hours)""",
    ),
)
def _(v: Views):
    return E.confirmed_deletes(v.events, 24 * HOUR).select("book_id", "page_id", "seq")


STALE = sql(
    "v_events",
    """with req as (select seq request_id, ts from v_events where op = 'update'),
        rep as (select seq - 3 + seq % 5 request_id, seq reply_no, ts, case when op = 'move' then 'stage' else 'done' end kind, value from v_events where op <> 'update')
        select request_id, arg_min(reply_no, (r.ts, reply_no)) reply_no, arg_min(value, (r.ts, reply_no)) as value
        from rep r join req q using (request_id) where kind = 'done' and r.ts >= q.ts group by 1""",
)


def requests_and_replies(v: Views):
    requests = v.events.where("op = 'update'").selectExpr("seq request_id", "ts")
    replies = v.events.where("op <> 'update'").selectExpr(
        "seq - 3 + seq % 5 request_id", "seq reply_no", "ts", "case when op = 'move' then 'stage' else 'done' end kind", "value"
    )
    return requests, replies


@query("drop_stale_responses", STALE)
def _(v: Views):
    return E.drop_stale_responses(*requests_and_replies(v))


@query("drop_stale_responses_stream", STALE)
def _(v: Views):
    """Streams all requests and replies; a last request far ahead moves the watermark past every reply."""
    requests, replies = requests_and_replies(v)
    last = requests.selectExpr("-1L request_id", "ts").agg(F.min("request_id").alias("request_id"), (F.max("ts") + F.expr("interval 400 days")).alias("ts"))
    asked, answered, out, state = (scratch_table(v.spark, n) for n in ("requests", "replies", "answers", "answer-state"))
    kinds = {n: t for n, t in requests.dtypes}
    requests.unionByName(last.select(*[F.col(c).cast(kinds[c]).alias(c) for c in requests.columns])).withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(asked)
    replies.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(answered)
    read = lambda path: v.spark.readStream.schema(v.spark.read.parquet(path).schema).parquet(path)
    with setting(v.spark, *SE.PROVIDER):
        stream = E.drop_stale_responses_stream(read(asked), read(answered))
        run = (
            stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
            .trigger(availableNow=True).start()
        )
        run.awaitTermination()
    return v.spark.read.schema(stream.schema).parquet(out)


KEPT = """with r as (select book_id, page_id, ts, seq, op, cast(seq % 3 as int) n from v_events where op in ('update', 'add') and page_id % 4 <> 0),
 newest as (select book_id, page_id, arg_max(seq, (ts, seq)) result_no, arg_max(n, (ts, seq)) n_lines from r group by 1, 2)
 select book_id, page_id, result_no, n_lines, case when n_lines > 0 then concat('line 0 of ', result_no) end first_line from newest"""


@query("keep_page_results", sql("v_events", KEPT))
def _(v: Views):
    """Streams page results of none to two lines into the bucketed table, then all of them once more."""
    pages = v.events.where("page_id % 4 <> 0").select("book_id", "page_id").distinct()
    line = "transform(sequence(1, cast(seq % 3 as int)), k -> struct(concat('line ', k - 1, ' of ', seq) as text, false as edited))"
    none = "cast(array() as array<struct<text:string,edited:boolean>>)"
    results = v.events.where("op in ('update', 'add')").selectExpr(
        "book_id", "page_id", "ts updated_at", "seq result_no", f"case when seq % 3 = 0 then {none} else {line} end lines"
    )
    source, root, state = (scratch_table(v.spark, n) for n in ("results", "result-table", "result-state"))
    results.write.parquet(source)
    for again in ("", "-again"):
        stream = v.spark.readStream.schema(results.schema).parquet(source)
        E.keep_page_results(stream, lambda: pages, root, state + again).awaitTermination()
    kept = v.spark.read.parquet(f"{root}/results")
    return kept.selectExpr("book_id", "page_id", "result_no", "size(lines) n_lines", "get(lines, 0).text first_line")


@query(
    "latest_page_result",
    sql(
        "v_events",
        """select book_id, page_id, arg_max(seq, (ts, seq)) result_no, arg_max(value, (ts, seq)) as value from v_events where op in ('update', 'add')
        group by 1, 2""",
    ),
)
def _(v: Views):
    results = v.events.where("op in ('update', 'add')").selectExpr("book_id", "page_id", "ts updated_at", "seq result_no", "value")
    return E.latest_page_result(results).select("book_id", "page_id", "result_no", "value")


@query(
    "valid_undo_points",
    sql(
        "v_events",
        """with k as (select *, seq % 503 = book_id_no bulk, op = 'update' and seq % 101 = 0 single, seq % 701 = book_id_no clear_, op = 'add' and seq % 211 = 0 import_
          from (select *, cast(substring(book_id, 2) as int) book_id_no from v_events))
        select book_id, bulk_seq, bulk_seq is not null and coalesce(b > s, true) can_undo_bulk, clear_seq, clear_seq is not null and coalesce(c > i, true) can_undo_clear
        from (select book_id, max((ts, seq)) filter (bulk) b, arg_max(seq, (ts, seq)) filter (bulk) bulk_seq,
          max((ts, seq)) filter (single and not bulk and not clear_) s,
          max((ts, seq)) filter (clear_ and not bulk) c, arg_max(seq, (ts, seq)) filter (clear_ and not bulk) clear_seq,
          max((ts, seq)) filter (import_ and not bulk and not clear_) i from k group by 1)""",
    ),
)
def _(v: Views):
    no = "cast(substring(book_id, 2) as int)"
    kind = F.expr(
        f"case when seq % 503 = {no} then 'bulk' when seq % 701 = {no} then 'clear'"
        " when op = 'update' and seq % 101 = 0 then 'single' when op = 'add' and seq % 211 = 0 then 'import' end"
    )
    return E.valid_undo_points(v.events.withColumn("kind", kind))


@query(
    "run_progress",
    sql(
        "v_events",
        """select book_id run_id, count(*) filter (op = 'add') n_done, count(*) n_events, cast(max(100 + page_id % 50) as int) total, arg_max(op, seq) stage
        from v_events group by 1""",
    ),
)
def _(v: Views):
    events = v.events.selectExpr(
        "book_id run_id", "seq", "case when op = 'add' then 'done' else 'stage' end kind", "cast(100 + page_id % 50 as int) total", "op stage"
    )
    return E.run_progress(events)


EVENT_SCHEMA = "book_id string, page_id long, seq long, op string, line_id string, text string, after_line_id string, to_index int"


@query("stateful_line_edits", sql("v_replayed", REPLAYED))
def _(v: Views):
    """Runs the stream over all pages, lines and edits, and returns the final pages."""
    lines, edits, results = replay_input(v)
    columns = [part.split()[0] for part in EVENT_SCHEMA.split(", ")]
    base = lines.selectExpr(
        "book_id", "page_id", "cast(line_no as long) - 1000000000 seq", "'base' op", "line_id", "text",
        "cast(null as string) after_line_id", "cast(edited as int) to_index",
    )
    blank = results.selectExpr(
        "book_id", "page_id", "-2000000000L seq", "'page' op", "cast(null as string) line_id", "cast(null as string) text",
        "cast(null as string) after_line_id", "cast(null as int) to_index",
    )
    source, out, state = (scratch_table(v.spark, n) for n in ("edit-log", "edit-pages", "edit-state"))
    base.unionByName(blank).unionByName(edits.select(*columns)).write.option("compression", "zstd").parquet(source)
    stream = SE.stateful_line_edits(v.spark.readStream.schema(EVENT_SCHEMA).parquet(source))
    with setting(v.spark, *SE.PROVIDER), setting(v.spark, *SE.SMALLER_STATE):
        run = (
            stream.writeStream.outputMode("update")
            .foreachBatch(lambda batch, _id: batch.write.mode("append").option("compression", "zstd").parquet(out))
            .option("checkpointLocation", state)
            .trigger(availableNow=True)
            .start()
        )
        run.awaitTermination()
    return SE.current_pages(v.spark.read.schema(SE.OUTPUT).parquet(out))
