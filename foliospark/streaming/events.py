"""Rules about event order and time: batch forms for stored logs, streaming forms for live ones.

A page is known by its book and its number where events have both. Batch forms use the bucketed helpers, with one
bucket per quarter of an hour, so that one very active page or book does not end up in a single task. Streaming forms use a watermark of ten seconds, because the original rules define none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from foliospark.operators.pages import upsert_ocr
from foliospark.plans.ordered import carry
from foliospark.sources.tables import put_pages

WATERMARK = "10 seconds"
# Silence before an adjustment is written, and time to undo a delete.
DEBOUNCE = "250 milliseconds"
DELETE_WAIT = "5 seconds"
BUCKET = 900_000_000


def micros(col: str = "ts") -> Column:
    """Microseconds, for zoned and plain time stamps alike."""
    return F.unix_micros(F.col(col).cast("timestamp"))


def _bucket() -> Column:
    return F.floor(F.col("_us") / F.lit(BUCKET)).cast("long")


def page_key(events: DataFrame) -> list[str]:
    return [c for c in ("book_id", "page_id") if c in events.columns]


def debounce_adjustments(events: DataFrame, gap_us: int = 250_000) -> DataFrame:
    """Adjustments that are written: those with no newer one of the same page within the gap."""
    timed = events.withColumn("_us", micros())
    rows = carry(timed, page_key(events), _bucket(), ["_us", "seq"], F.col("_us"), "_next", backwards=True)
    return rows.where(F.col("_next").isNull() | (F.col("_next") - F.col("_us") >= gap_us)).drop("_us", "_next")


def debounce_stream(events: DataFrame, gap: str = DEBOUNCE, watermark: str = WATERMARK) -> DataFrame:
    page = page_key(events)
    return (
        events.withWatermark("ts", watermark)
        .groupBy(*page, F.session_window("ts", gap))
        .agg(F.max_by(F.struct("seq", "value"), F.struct("ts", "seq")).alias("_last"))
        .select(*page, "_last.seq", "_last.value")
    )


def confirmed_deletes(events: DataFrame, wait_us: int = 5_000_000) -> DataFrame:
    """Deletes without an undo of the same page within the waiting time.

    Each delete looks at the next undo only, so deletes and undos of a page are never paired with each other.
    """
    both = events.where(F.col("op").isin("delete", "undo")).withColumn("_us", micros())
    undo = F.when(F.col("op") == "undo", F.col("_us"))
    rows = carry(both, page_key(events), _bucket(), ["_us", "seq"], undo, "_undo", backwards=True)
    late = F.col("_undo").isNull() | (F.col("_undo") - F.col("_us") > wait_us)
    return rows.where((F.col("op") == "delete") & late).drop("_us", "_undo")


def confirmed_deletes_stream(events: DataFrame, wait: str = DELETE_WAIT, watermark: str = WATERMARK) -> DataFrame:
    """Left outer interval join; a delete comes out once the watermark has passed its waiting time."""
    page = page_key(events)
    deletes = events.where("op = 'delete'").select(*page, "seq", "ts").withWatermark("ts", watermark)
    undos = (
        events.where("op = 'undo'")
        .select(*[F.col(c).alias(f"undo_{c}") for c in page], F.col("ts").alias("undo_ts"))
        .withWatermark("undo_ts", watermark)
    )
    same = " and ".join(f"undo_{c} = {c}" for c in page)
    within = F.expr(f"{same} and undo_ts >= ts and undo_ts <= ts + interval {wait}")
    return deletes.join(undos, within, "left_outer").where("undo_ts is null").select(*page, "seq", "ts")


def drop_stale_responses(requests: DataFrame, replies: DataFrame) -> DataFrame:
    """The first final reply of each open request; replies to unknown requests or from before them are ignored.

    ``requests`` (request_id, ts), ``replies`` (request_id, reply_no, ts, kind, value) with kind stage or done.
    """
    opened = requests.select("request_id", F.col("ts").alias("_opened"))
    valid = replies.where("kind = 'done'").join(opened, "request_id").where(F.col("ts") >= F.col("_opened"))
    first = F.min_by(F.struct("reply_no", "value"), F.struct("ts", "reply_no"))
    return valid.groupBy("request_id").agg(first.alias("_r")).select("request_id", "_r.*")


class RequestState(StatefulProcessor):
    """A block of requests: each open since a time, with the smallest (ts, reply_no) of its final replies so far.

    Once the watermark has passed that reply no smaller one can come: it leaves and the request is closed, that is,
    forgotten, so that further replies find no open request. Replies may come before the row of their request; without
    one they go when the watermark has passed them, as a request is never younger than its replies.

    A block is read and written as one list, with one timer for its next request, as each call to the store takes longer
    than the work on a request.
    """

    def __init__(self, open_for_ms: int | None, request: str, value: str, out: list[str]):
        self.open_for_ms, self.request, self.value, self.out = open_for_ms, request, value, out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.opened = handle.getListState("opened", f"request_id {self.request}, opened long, us long, reply_no long, value {self.value}")

    def _load(self) -> dict:
        """Request id to the time it was opened, if known, and its replies (us, reply_no, value)."""
        requests: dict = {}
        for request_id, opened, us, reply_no, value in self.opened.get() if self.opened.exists() else ():
            known = requests.setdefault(request_id, [opened, []])
            if us is not None:
                known[1].append((us, reply_no, value))
        return requests

    def _due(self, opened: int | None, waiting: list[tuple]) -> int | None:
        """When a reply stands, as the watermark is past its time, or when the time of an unanswered request is over."""
        due = max((us for us, _, _ in waiting), default=None)
        if due is None and opened is not None and self.open_for_ms is not None:
            due = opened + 1000 * self.open_for_ms
        return None if due is None else due // 1000 + 1

    def _save(self, requests: dict) -> None:
        rows = [(q, opened, *reply) for q, (opened, waiting) in requests.items() for reply in waiting or [(None, None, None)]]
        if rows:
            self.opened.put(rows)
        elif self.opened.exists():
            self.opened.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        due = min((d for d in (self._due(*r) for r in requests.values()) if d is not None), default=None)
        if due is not None:
            self.handle.registerTimer(due)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        requests, touched = self._load(), set()
        for part in rows:
            for request_id, kind, us, reply_no, value in zip(*[part[c].tolist() for c in ("request_id", "kind", "us", "reply_no", "value")]):
                known = requests.setdefault(request_id, [None, []])
                touched.add(request_id)
                if kind == "open":
                    known[0] = us if known[0] is None else min(known[0], us)
                else:
                    known[1].append((us, reply_no, None if pd.isna(value) else value))
        for known in map(requests.get, touched):
            if known[0] is not None:
                known[1] = sorted((w for w in known[1] if w[0] >= known[0]), key=lambda w: w[:2])[:1]
        self._save(requests)
        yield pd.DataFrame([], columns=self.out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, requests, rows = timerValues.getCurrentWatermarkInMs(), self._load(), []
        for request_id, (opened, waiting) in list(requests.items()):
            due = self._due(opened, waiting)
            if due is None or due > now:
                continue
            del requests[request_id]
            best = min(waiting, key=lambda w: w[:2], default=None)
            if best and opened is not None and (self.open_for_ms is None or best[0] <= opened + 1000 * self.open_for_ms):
                rows.append((request_id, best[1], best[2]))
        self._save(requests)
        yield pd.DataFrame(rows, columns=self.out)

    def close(self) -> None:
        pass


def drop_stale_responses_stream(
    requests: DataFrame, replies: DataFrame, open_for_ms: int | None = None, watermark: str = WATERMARK, blocks: int = 1024
) -> DataFrame:
    """The stream form: the smallest (ts, reply_no) of a request's final replies, once the watermark has passed it.

    State holds open requests only. A request without a reply is remembered until ``open_for_ms`` has passed, or for
    good without it; replies after that time do not count. The state store must be RocksDB. Requests are kept in
    ``blocks`` by a hash of their id, and a micro-batch writes the blocks that it touches; give more blocks where very many
    requests stay open. Their number belongs to a checkpoint.
    """
    kinds = {f.name: f.dataType.simpleString() for f in (*requests.schema.fields, *replies.schema.fields)}
    nothing = [F.lit(0).cast("long").alias("reply_no"), F.lit(None).cast(kinds["value"]).alias("value")]
    opened = requests.select("request_id", "ts", F.lit("open").alias("kind"), *nothing)
    done = replies.where("kind = 'done'").select("request_id", "ts", "kind", F.col("reply_no").cast("long").alias("reply_no"), "value")
    events = opened.unionByName(done).where("request_id is not null").withColumn("us", micros()).withWatermark("ts", watermark)
    events = events.withColumn("_block", F.pmod(F.xxhash64("request_id"), F.lit(blocks)))
    out = ["request_id", "reply_no", "value"]
    schema = f"request_id {kinds['request_id']}, reply_no long, value {kinds['value']}"
    return events.groupBy("_block").transformWithStateInPandas(RequestState(open_for_ms, kinds["request_id"], kinds["value"], out), schema, "Append", "EventTime")


def latest_page_result(results: DataFrame) -> DataFrame:
    """The newest result per page from (book_id, page_id, updated_at, result_no, …)."""
    rest = [c for c in results.columns if c not in ("book_id", "page_id")]
    newest = F.max_by(F.struct(*rest), F.struct("updated_at", "result_no")).alias("_r")
    return results.groupBy("book_id", "page_id").agg(newest).select("book_id", "page_id", "_r.*")


def keep_page_results(
    results: DataFrame, pages: Callable[[], DataFrame], root: str, checkpoint: str, name: str = "results", buckets: int = 64, overwrite_edited: bool = False
) -> StreamingQuery:
    """Keeps the newest result of each page in a table of buckets of pages.

    ``results`` has one row per page result: book_id, page_id, updated_at, result_no and ``lines``, an array of structs
    with ``edited``; an empty array is a page without text and replaces lines as well. A result replaces an older one of
    a page that exists, unless that holds an edited line and ``overwrite_edited`` is off. Only buckets with such pages
    are written anew. A result that is stored already is not newer than itself, so a repeated batch changes nothing, and
    one that broke off is completed.
    """

    def merge(batch: DataFrame, _batch_id: int) -> None:
        newest = latest_page_result(batch).join(pages().select("book_id", "page_id").distinct(), ["book_id", "page_id"], "left_semi")

        def replaces(old: Column, new: Column) -> Column:
            key = lambda r: F.struct(r["updated_at"], r["result_no"])
            edited = F.exists(old["lines"], lambda line: F.coalesce(line["edited"], F.lit(False)))
            return (key(new) > key(old)) & (F.lit(overwrite_edited) | ~F.coalesce(edited, F.lit(False)))

        put_pages(newest, root, name, replaces, buckets)

    return results.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_latest_results(
    results: DataFrame,
    read_current: Callable[[], DataFrame],
    read_pages: Callable[[], DataFrame],
    write_current: Callable[[DataFrame], None],
    checkpoint: str,
    overwrite_edited: bool = False,
) -> StreamingQuery:
    """Upserts each micro-batch into the line table under the rules of ``upsert_ocr``.

    ``results`` has one row per line with updated_at and result_no of its page result.
    """

    def merge(batch: DataFrame, _batch_id: int) -> None:
        newest = latest_page_result(batch.select("book_id", "page_id", "updated_at", "result_no").distinct())
        keys = ["book_id", "page_id", "updated_at", "result_no"]
        lines = batch.join(newest, keys, "left_semi")
        current = read_current()
        write_current(upsert_ocr(current, lines.select(*current.columns), read_pages(), overwrite_edited))

    return (
        results.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def valid_undo_points(events: DataFrame) -> DataFrame:
    """Per book: the last bulk change and the last clear-all, and whether each may still be undone.

    ``kind`` is bulk, single, clear or import. A bulk change can be undone until the next single change, a clear-all
    until the next import. Plain maxima, combined before the shuffle.
    """

    def last(kind: str) -> Column:
        return F.max(F.when(F.col("kind") == kind, F.struct(micros().alias("us"), F.col("seq").alias("seq"))))

    per_book = events.groupBy("book_id").agg(*[last(k).alias(k) for k in ("bulk", "single", "clear", "import")])

    def after(a: str, b: str) -> Column:
        return F.col(a).isNotNull() & F.coalesce(F.col(a) > F.col(b), F.lit(True))

    return per_book.select(
        "book_id",
        F.col("bulk.seq").alias("bulk_seq"),
        after("bulk", "single").alias("can_undo_bulk"),
        F.col("clear.seq").alias("clear_seq"),
        after("clear", "import").alias("can_undo_clear"),
    )


def run_progress(events: DataFrame) -> DataFrame:
    """Done, total and newest stage per run; works on a log and, in update mode, on a stream."""
    return events.groupBy("run_id").agg(
        F.count_if(F.col("kind") == "done").alias("n_done"),
        F.count(F.lit(1)).alias("n_events"),
        F.max("total").alias("total"),
        F.max_by("stage", "seq").alias("stage"),
    )
