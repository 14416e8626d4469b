"""Streaming forms against their batch forms."""

import random
import time

from pyspark.sql import functions as F

from foliospark.operators import edits
from foliospark.plans.session import setting
from foliospark.sources.tables import put_pages
from foliospark.streaming import edits as SE
from foliospark.streaming import events as E

SCHEMA = "page_id long, seq long, ts timestamp, op string, value double"


def write_in_order(spark, rows, schema, path, chunks=3):
    """Files in time order, and a closing event far in the future that moves the watermark."""
    size = max(1, len(rows) // chunks)
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i : i + size], schema).coalesce(1).write.mode("append").parquet(path)


def run(df, folder, mode="append"):
    out = []
    query = (
        df.writeStream.outputMode(mode)
        .foreachBatch(lambda b, _: out.extend(b.collect()))
        .option("checkpointLocation", folder)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return out


def at(spark, seconds):
    import datetime as dt

    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_debounce(spark, tmp_path):
    rows = [(1, 0, 0.0), (1, 1, 0.1), (1, 2, 0.34), (1, 3, 0.60), (2, 4, 0.2), (2, 5, 5.0), (1, 6, 9.0)]
    data = [(p, s, at(spark, t), "update", float(s)) for p, s, t in rows]
    batch = E.debounce_adjustments(spark.createDataFrame(data, SCHEMA))
    expected = {(r.page_id, r.seq) for r in batch.collect()}
    assert expected == {(1, 2), (1, 3), (1, 6), (2, 4), (2, 5)}
    closing = (99, 99, at(spark, 1000), "update", 0.0)
    write_in_order(spark, sorted(data, key=lambda r: r[2]) + [closing], SCHEMA, f"{tmp_path}/in")
    got = run(E.debounce_stream(stream(spark, f"{tmp_path}/in", SCHEMA)), f"{tmp_path}/cp")
    assert {(r.page_id, r.seq) for r in got if r.page_id != 99} == expected


def test_confirmed_deletes(spark, tmp_path):
    rows = [(1, 0, 0, "delete"), (1, 1, 3, "undo"), (1, 2, 10, "delete"), (1, 3, 16, "undo"), (2, 4, 20, "delete"), (2, 5, 25, "undo"), (3, 6, 30, "delete")]
    data = [(p, s, at(spark, t), op, 0.0) for p, s, t, op in rows]
    expected = {r.seq for r in E.confirmed_deletes(spark.createDataFrame(data, SCHEMA)).collect()}
    assert expected == {2, 6}
    closing = [(98, 98, at(spark, 900), "delete", 0.0), (99, 99, at(spark, 900), "undo", 0.0), (98, 100, at(spark, 1800), "delete", 0.0), (99, 101, at(spark, 1800), "undo", 0.0)]
    write_in_order(spark, data + closing, SCHEMA, f"{tmp_path}/in", chunks=4)
    got = run(E.confirmed_deletes_stream(stream(spark, f"{tmp_path}/in", SCHEMA)), f"{tmp_path}/cp")
    assert {r.seq for r in got if r.page_id < 90} == expected


REPLY = "request_id long, reply_no long, ts timestamp, kind string, value double"


def test_stale_responses(spark, tmp_path):
    requests = [(1, at(spark, 10)), (2, at(spark, 20)), (3, at(spark, 30))]
    replies = [(1, 0, 11, "stage"), (1, 1, 12, "done"), (1, 2, 13, "done"), (2, 3, 15, "done"), (2, 4, 25, "done"), (7, 5, 26, "done")]
    rep = [(q, n, at(spark, t), k, float(n)) for q, n, t, k in replies]
    req_df = spark.createDataFrame(requests, "request_id long, ts timestamp")
    batch = E.drop_stale_responses(req_df, spark.createDataFrame(rep, REPLY))
    expected = {(r.request_id, r.reply_no) for r in batch.collect()}
    assert expected == {(1, 1), (2, 4)}
    far = at(spark, 9000)
    write_in_order(spark, [*requests, (99, far)], "request_id long, ts timestamp", f"{tmp_path}/req", chunks=1)
    write_in_order(spark, [*rep, (99, 99, far, "stage", 0.0)], REPLY, f"{tmp_path}/rep", chunks=1)
    assert {(r.request_id, r.reply_no) for r in reply_stream(spark, tmp_path)} == expected


def reply_stream(spark, tmp_path, **options):
    with setting(spark, *SE.PROVIDER):
        requests = stream(spark, f"{tmp_path}/req", "request_id long, ts timestamp")
        return run(E.drop_stale_responses_stream(requests, stream(spark, f"{tmp_path}/rep", REPLY), **options), f"{tmp_path}/cp")


def test_replies_in_any_order_give_the_batch_values(spark, tmp_path):
    """A smaller reply in a later batch counts, one before its request's row too, and one after the close does not."""
    steps = [
        ([(1, 10)], [(1, 5, 14, "done"), (2, 6, 15, "done"), (3, 1, 14, "done")]),  # replies 6 and 1 are before their requests' rows
        ([(2, 12)], [(1, 3, 13, "done"), (1, 4, 14, "done"), (1, 2, 9, "done")]),
        ([(4, 100)], [(4, 8, 101, "stage")]),  # moves the watermark past the replies above
        ([(3, 95)], [(1, 7, 96, "done"), (3, 9, 97, "done")]),  # request 1 is closed; reply 1 was before request 3
        ([(5, 9000)], []),
    ]
    asked, answered, got = [], [], []
    for requests, replies in steps:
        opened = [(q, at(spark, t)) for q, t in requests]
        done = [(q, n, at(spark, t), k, float(n)) for q, n, t, k in replies]
        asked, answered = asked + opened, answered + done
        spark.createDataFrame(opened, "request_id long, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/req")
        spark.createDataFrame(done, REPLY).coalesce(1).write.mode("append").parquet(f"{tmp_path}/rep")
        got += [tuple(r) for r in reply_stream(spark, tmp_path)]
    batch = E.drop_stale_responses(spark.createDataFrame(asked, "request_id long, ts timestamp"), spark.createDataFrame(answered, REPLY))
    assert sorted(got) == sorted(map(tuple, batch.select("request_id", "reply_no", "value").collect())) == [(1, 3, 3.0), (2, 6, 6.0), (3, 9, 9.0)]


def test_requests_leave_the_state(spark, tmp_path):
    got = []
    for opened, replies in [([(q, 10) for q in range(20)], [(q, q, 11, "done") for q in range(0, 20, 2)]), ([(50, 5000)], []), ([(51, 9000)], [])]:
        spark.createDataFrame([(q, at(spark, t)) for q, t in opened], "request_id long, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/req")
        rows = [(q, n, at(spark, t), k, float(n)) for q, n, t, k in replies]
        spark.createDataFrame(rows, REPLY).coalesce(1).write.mode("append").parquet(f"{tmp_path}/rep")
        got += reply_stream(spark, tmp_path, open_for_ms=60_000)
    assert sorted(r.request_id for r in got) == list(range(0, 20, 2))
    with setting(spark, *SE.PROVIDER):
        state = spark.read.format("statestore").option("path", f"{tmp_path}/cp").option("stateVarName", "opened").load()
    assert state.count() <= 2  # only what was asked last is remembered


def test_latest_results_upsert(spark, tmp_path):
    lines = "book_id string, page_id long, line_no int, text string, edited boolean"
    full = lines + ", updated_at long, result_no long"
    root = f"{tmp_path}/lines"
    spark.createDataFrame([("b", 1, 0, "old", False), ("b", 2, 0, "mine", True), ("b", 3, 0, "gone soon", False)], lines).write.parquet(root)
    new = [("b", 1, 0, "v1", False, 5, 1), ("b", 1, 0, "v2", False, 6, 2), ("b", 2, 0, "lost", False, 6, 3), ("b", 9, 0, "no page", False, 6, 4)]
    write_in_order(spark, new, full, f"{tmp_path}/in", chunks=1)
    versions = [root]

    def save(df):
        path = f"{root}-{len(versions)}"
        df.write.parquet(path)
        versions.append(path)

    pages = spark.createDataFrame([("b", p) for p in (1, 2, 3)], "book_id string, page_id long")
    query = E.keep_latest_results(
        spark.readStream.schema(full).parquet(f"{tmp_path}/in"), lambda: spark.read.parquet(versions[-1]), lambda: pages, save, f"{tmp_path}/cp"
    )
    query.awaitTermination()
    got = {(r.page_id, r.text) for r in spark.read.parquet(versions[-1]).collect()}
    assert got == {(1, "v2"), (2, "mine"), (3, "gone soon")}


PAGE_RESULT = "book_id string, page_id long, updated_at long, result_no long, lines array<struct<text:string,edited:boolean>>"


def page_results(spark, root):
    return {(r.book_id, r.page_id): (r.result_no, [x.text for x in r.lines]) for r in spark.read.schema(PAGE_RESULT + ", bucket int").parquet(f"{root}/results").collect()}


def test_page_results_are_kept_by_bucket(spark, tmp_path):
    pages = spark.createDataFrame([(b, p) for b in "xy" for p in range(40)], "book_id string, page_id long")
    root, source = f"{tmp_path}/store", f"{tmp_path}/in"

    def step(rows, checkpoint="cp"):
        if rows:
            spark.createDataFrame(rows, PAGE_RESULT).coalesce(1).write.mode("append").parquet(source)
        E.keep_page_results(spark.readStream.schema(PAGE_RESULT).parquet(source), lambda: pages, root, f"{tmp_path}/{checkpoint}", buckets=8).awaitTermination()
        return {f.relative_to(root) for f in (tmp_path / "store").rglob("*.parquet")}

    first = [(b, p, 1, 1, [(f"{b}{p}", p == 3)]) for b in "xy" for p in range(40)] + [("x", 99, 1, 1, [("no page", False)])]
    files = step(first)
    assert len(page_results(spark, root)) == 80
    after = step([("x", 1, 2, 5, []), ("x", 3, 9, 6, [("lost", False)]), ("y", 1, 0, 0, [("old", False)])])
    stored = page_results(spark, root)
    assert stored["x", 1] == (5, []) and stored["x", 3] == (1, ["x3"]) and stored["y", 1] == (1, ["y1"]) and len(stored) == 80
    changed = {f.parent for f in files ^ after}
    assert len(changed) == 1  # the other buckets' files keep their names
    assert step([]) == after
    assert step([], "another-checkpoint") == after  # all batches once more
    assert page_results(spark, root) == stored


def test_put_pages_replaces_single_pages(spark, tmp_path):
    schema = "book_id string, page_id long, text string"
    rows = [("x", 1, "a"), ("x", 2, "b"), (None, 1, "c"), ("y", 1, "d")]
    assert put_pages(spark.createDataFrame(rows, schema), str(tmp_path), "t", buckets=4)
    assert len(put_pages(spark.createDataFrame([("x", 2, "B"), (None, 1, "C")], schema), str(tmp_path), "t", buckets=4)) in (1, 2)
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/t").select("book_id", "page_id", "text").collect()}
    assert got == {("x", 1, "a"), ("x", 2, "B"), (None, 1, "C"), ("y", 1, "d")}
    assert put_pages(spark.createDataFrame([], schema), str(tmp_path), "t", buckets=4) == []


def test_run_progress_stream(spark, tmp_path):
    schema = "run_id string, seq long, kind string, total int, stage string"
    rows = [("r", i, "done" if i % 2 else "stage", 4, f"s{i}") for i in range(6)]
    write_in_order(spark, rows, schema, f"{tmp_path}/in")
    got = run(E.run_progress(stream(spark, f"{tmp_path}/in", schema)), f"{tmp_path}/cp", "update")
    last = max(got, key=lambda r: r.n_events)
    assert (last.n_done, last.n_events, last.total, last.stage) == (3, 6, 4, "s5")


def test_valid_undo_points(spark):
    rows = [("a", 1, "bulk"), ("a", 2, "clear"), ("b", 1, "bulk"), ("b", 2, "single"), ("b", 3, "clear"), ("b", 4, "import"), ("c", 1, "single"), ("c", 2, "bulk")]
    df = spark.createDataFrame([(b, s, at(spark, s), k) for b, s, k in rows], "book_id string, seq long, ts timestamp, kind string")
    got = {r.book_id: (r.can_undo_bulk, r.can_undo_clear) for r in E.valid_undo_points(df).collect()}
    assert got == {"a": (True, True), "b": (False, False), "c": (True, False)}


EDITS = "book_id string, page_id long, seq long, op string, line_id string, text string, after_line_id string, to_index int"


def edit_stream(spark, tmp_path, parts):
    """Runs the stream once per part over a growing folder and returns all its rows."""
    with setting(spark, *SE.PROVIDER):
        for part in parts:
            spark.createDataFrame(part, EDITS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            rows = run(SE.stateful_line_edits(spark.readStream.schema(EDITS).parquet(f"{tmp_path}/in")), f"{tmp_path}/cp", "update")
            spark.createDataFrame(rows, SE.OUTPUT).write.mode("append").parquet(f"{tmp_path}/out")
    return spark.read.parquet(f"{tmp_path}/out")


def test_stateful_edits_over_several_batches(spark, tmp_path):
    base = [("x", 1, -2, "base", "a", "A", None, 0), ("x", 1, -1, "base", "b", "B", None, 0), ("x", 2, -1, "base", "z", "Z", None, 0)]
    base += [("y", 1, -9, "page", None, None, None, None)]
    first = [("x", 1, 5, "add", "n", None, "a", None), ("x", 2, 6, "delete", "z", None, None, None), ("y", 1, 5, "add", "own", None, None, None), ("y", 7, 3, "add", "q", None, None, None)]
    second = [("x", 1, 8, "move", "b", None, None, 0), ("x", 1, 4, "update", "a", "late", None, None), ("x", 1, 9, "update", "n", "N", None, None)]
    out = edit_stream(spark, tmp_path, (base, first, second))
    pages = {}
    for r in SE.current_pages(out).orderBy("line_no").collect():
        pages.setdefault((r.book_id, r.page_id, r.last_edit), []).append((r.line_id, r.text, r.edited))
    assert pages == {("x", 1, 9): [("b", "B", False), ("a", "A", False), ("n", "N", True)], ("x", 2, 6): [(None, None, None)], ("y", 1, 5): [("own", "", True)]}
    assert sorted((r.book_id, r.page_id, r.kind, r.late_seq) for r in out.where("late_seq is not null").collect()) == [("x", 1, "late", 4), ("y", 7, "unknown", 3)]


def test_stateful_edits_equal_the_replay_over_many_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(edits, "BLOCK", 4)
    rng = random.Random(8)
    base = [("x", p, i - 1000, "base", f"l{i}", f"t{i}", None, i % 2) for p in (1, 2) for i in range(40)]
    log = []
    for seq in range(400):
        op = rng.choice(["add", "update", "delete", "move"])
        target = f"n{rng.randrange(seq + 1)}" if rng.random() < 0.5 else f"l{rng.randrange(42)}"
        log.append(("x", 1 + seq % 2, seq, op, f"n{seq}" if op == "add" else target, f"e{seq}", target, rng.randrange(-2, 60)))
    out = edit_stream(spark, tmp_path, (base, log[:150], log[150:170], log[170:]))
    names = ["book_id", "page_id", "line_no", "line_id", "text", "edited", "last_edit"]
    lines = spark.createDataFrame(base, EDITS).selectExpr("book_id", "page_id", "cast(seq + 1000 as int) line_no", "line_id", "text", "to_index = 1 edited")
    want = edits.replay_line_edits(lines, spark.createDataFrame(log, EDITS)).select(*names)
    assert sorted(map(tuple, SE.current_pages(out).select(*names).collect())) == sorted(map(tuple, want.collect()))


def test_lines_of_single_versions_do_not_move(spark):
    """After one micro-batch lines are read as they lie; older and repeated versions are left out by one shuffle."""
    line = lambda page, version, no, text, kind="line": ("x", page, kind, version, no, f"l{no}", text, False, None, None)
    once = [line(1, 5, 0, "a"), line(1, 5, 1, "b"), ("x", 2, "line", 6, None, None, None, None, 6, None), ("x", 3, "line", 6, None, None, None, None, None, None)]
    once.append(("x", 4, "unknown", None, None, None, None, None, None, 9))
    want = [(1, 0, "a"), (1, 1, "b"), (2, None, None)]
    again = [line(1, 4, 0, "old"), line(1, 4, 2, "gone"), line(1, 5, 0, "a", "closed"), line(1, 5, 1, "b", "closed")]
    for rows, shuffles in ((once, 0), (once + again, 1)):
        found = SE.current_pages(spark.createDataFrame(rows, SE.OUTPUT))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == shuffles and "Join" not in plan
        assert sorted((r.page_id, r.line_no, r.text) for r in found.collect()) == want


def test_quiet_pages_leave_and_are_forgotten(spark, tmp_path):
    """Timers of processing time need a running stream; it ends here once the page has been closed and edited again."""
    out, source = [], f"{tmp_path}/in"
    spark.createDataFrame([("x", 1, -1, "base", "a", "A", None, 0)], EDITS).coalesce(1).write.mode("append").parquet(source)
    with setting(spark, *SE.PROVIDER):
        edited = SE.stateful_line_edits(spark.readStream.schema(EDITS).parquet(source), quiet_ms=500)
        query = edited.writeStream.outputMode("update").foreachBatch(lambda b, _: out.extend(b.collect())).option("checkpointLocation", f"{tmp_path}/cp").start()
    try:
        wait(lambda: any(r.kind == "closed" for r in out), query)
        spark.createDataFrame([("x", 1, 5, "update", "a", "new", None, None)], EDITS).coalesce(1).write.mode("append").parquet(source)
        wait(lambda: any(r.kind == "unknown" for r in out), query)
    finally:
        query.stop()
    assert [(r.kind, r.text, r.late_seq) for r in out] == [("line", "A", None), ("closed", "A", None), ("unknown", None, 5)]


def wait(done, query, seconds=90):
    until = time.monotonic() + seconds
    while not done():
        assert time.monotonic() < until and query.isActive
        time.sleep(0.2)


def test_line_blocks_by_plain_list(monkeypatch):
    monkeypatch.setattr(edits, "BLOCK", 3)
    for seed in range(60):
        rng, page, plain = random.Random(seed), edits.PageLines(), []
        for seq in range(120):
            op = rng.choice(["base", "add", "add", "update", "delete", "move"] if seq > 5 else ["base"])
            known = [line[0] for line in plain] + ["nobody", None]
            new = op in ("add", "base") and rng.random() > 0.1
            target, after, to = f"n{seq}" if new else rng.choice(known), rng.choice(known), rng.randrange(-3, 40)
            page.apply(op, seq, target, f"t{seq}", after, to)
            ids = [line[0] for line in plain]
            at = ids.index(target) if target in ids else -1
            if op == "base":
                plain.append((target, f"t{seq}", bool(to)))
            elif op == "add":
                plain.insert(ids.index(after) + 1 if after in ids else len(plain), (target, "", True))
            elif at >= 0 and op == "update":
                plain[at] = (target, f"t{seq}", True)
            elif at >= 0:
                line = plain.pop(at)
                if op == "move":
                    plain.insert(max(0, min(to, len(plain))), line)
            assert list(page.lines()) == plain and page.sizes == [len(page._block(n)) for n in page.order]


def test_many_edits_of_one_page_are_fast():
    rng, page = random.Random(1), edits.PageLines()
    start = time.perf_counter()
    for seq in range(50_000):
        page.apply("base", seq, f"l{seq}", "x", None, 0)
    for seq in range(100_000):
        op = rng.choice(["add", "update", "delete", "move"])
        page.apply(op, seq, f"n{seq}" if op == "add" else f"l{rng.randrange(50_000)}", "t", f"l{rng.randrange(50_000)}", rng.randrange(50_000))
    assert time.perf_counter() - start < 60 and page.last_edit == 99_999


def test_pages_of_two_books_are_apart(spark):
    keyed = "book_id string, " + SCHEMA
    rows = [("a", 1, 0, at(spark, 0), "delete", 0.0), ("b", 1, 1, at(spark, 2), "undo", 0.0), ("a", 1, 2, at(spark, 10), "update", 1.0), ("b", 1, 3, at(spark, 10.1), "update", 1.0)]
    events = spark.createDataFrame(rows, keyed)
    assert [r.seq for r in E.confirmed_deletes(events).collect()] == [0]
    assert {r.seq for r in E.debounce_adjustments(events.where("op = 'update'")).collect()} == {2, 3}


def test_requests_share_a_block_of_state(spark, tmp_path):
    """Many requests take few keys of state, and requests of one block leave one after the other."""
    got = []
    steps = [([(q, 10) for q in range(300)], [(q, q, 11 + q, "done") for q in range(300)]), ([(-1, 200)], []), ([(-2, 9000)], [])]
    for opened, replies in steps:
        spark.createDataFrame([(q, at(spark, t)) for q, t in opened], "request_id long, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/req")
        rows = [(q, n, at(spark, t), k, float(n)) for q, n, t, k in replies]
        spark.createDataFrame(rows, REPLY).coalesce(1).write.mode("append").parquet(f"{tmp_path}/rep")
        got.append(sorted(r.request_id for r in reply_stream(spark, tmp_path, blocks=3)))
    assert sorted(sum(got, [])) == list(range(300)) and 0 < len(got[0]) < 300


def test_pages_share_calls_and_large_ones_keep_an_index(spark, tmp_path, monkeypatch):
    """Small pages lie in lists of their groups, a page of many blocks few parts of an index; copied ids stay right."""
    monkeypatch.setattr(edits, "BLOCK", 4)
    base = [("x", p, -100 + i, "base", f"l{i % 3}", f"t{i}", None, 0) for p in range(30) for i in range(4)]
    base += [("y", 1, -1000 + i, "base", f"l{i}", f"t{i}", None, 0) for i in range(600)]
    more = [("x", p, seq, op, "l0", f"e{seq}", "l0", 9) for p in range(30) for seq, op in enumerate(["delete", "move", "update", "delete", "add", "base"])]
    log = [("y", 1, seq, ["move", "delete", "add", "update"][seq % 4], f"l{seq * 7 % 640}", f"e{seq}", f"l{seq * 11 % 640}", seq * 13 % 600) for seq in range(300)]
    later = [("x", p, 10 + seq, op, "l0", f"e{seq}", "l1", 0) for p in range(30) for seq, op in enumerate(["delete", "update", "add", "update"])]
    out = edit_stream(spark, tmp_path, (base, more + log[:200], later + log[200:]))
    want: dict = {}
    for row in sorted(base + more + later + log, key=lambda r: r[2]):
        want.setdefault(row[:2], edits.PageLines()).apply(row[3], row[2], *row[4:])
    got: dict = {}
    for r in SE.current_pages(out).where("line_no is not null").orderBy("line_no").collect():
        got.setdefault((r.book_id, r.page_id), []).append((r.line_id, r.text, r.edited))
    assert got == {key: list(page.lines()) for key, page in want.items() if page.order}
    with setting(spark, *SE.PROVIDER):
        state = lambda name: spark.read.format("statestore").option("path", f"{tmp_path}/cp").option("stateVarName", name).load()
        assert state("pages").count() == 31 and state("blocks").where("user_map_key.book_id = 'x'").count() == 0 and state("where").count() <= SE.INDEX
