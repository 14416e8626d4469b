import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.catalog.images import toy_detector
from foliospark.operators import assets as A
from foliospark.operators import epub as U
from foliospark.operators import images as I
from foliospark.operators import pages as P
from foliospark.operators.images import image_pixels
from foliospark.operators.pixels import auto_levels, image_auto_levels, image_ink_profile, image_ink_runs, ink_profile, ink_runs
from foliospark.operators.recognise import recognize_pages
from foliospark.plans.session import bucketed, setting
from foliospark.sources import images as SI
from foliospark.sources.book_files import write_book_files
from foliospark.sources import tables as ST
from foliospark.streaming.imports import FEWER_LISTINGS, LARGER_READS, stream_import


def png(width, height, rgb):
    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    raw = b"".join(b"\0" + bytes(rgb) * width for _ in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def image_folder(tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.png").write_bytes(png(4, 3, (1, 2, 3)))
    (tmp_path / "in" / "sub" / "b.PNG").write_bytes(png(2, 2, (9, 9, 9)))
    (tmp_path / "in" / "broken.jpg").write_bytes(b"no image")
    (tmp_path / "in" / "note.txt").write_text("x")
    return f"{tmp_path}/in"


def test_scan_and_decode(spark, tmp_path):
    folder = image_folder(tmp_path)
    names = {r.path.rsplit("/", 1)[1] for r in SI.scan_image_files(spark, folder).collect()}
    assert names == {"a.png", "b.PNG", "broken.jpg"}
    plan = SI.scan_image_files(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan
    got = {r.path.rsplit("/", 1)[1]: r for r in SI.decode_images(spark, folder).collect()}
    assert (got["a.png"].width, got["a.png"].height, bytes(got["a.png"].data[:3])) == (4, 3, bytes((3, 2, 1)))
    assert not got["broken.jpg"].ok and got["broken.jpg"].width is None


def test_stream_import(spark, tmp_path):
    folder = image_folder(tmp_path)
    out = []
    query = (
        stream_import(spark, folder).writeStream.foreachBatch(lambda b, _: out.extend(b.collect()))
        .option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert sum(r.ok for r in out) == 2


def test_tables_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("b", 1, "x"), ("c", 2, "y")], "book_id string, page_id long, v string")
    ST.write_tables(rows, str(tmp_path), "pages")
    ST.write_tables(spark.createDataFrame([("b", 5, "z", 1)], "book_id string, page_id long, v string, more int"), str(tmp_path), "pages")
    got = {(r.book_id, r.page_id, r.v, r.more) for r in ST.load_book_tables(spark, str(tmp_path), "pages", merge=True).collect()}
    assert got == {("b", 5, "z", 1), ("c", 2, "y", None)}


def test_tables_need_a_schema_or_merge(spark, tmp_path):
    ST.write_tables(spark.createDataFrame([("b", 1)], "book_id string, page_id long"), str(tmp_path), "pages")
    newer = spark.createDataFrame([("c", 2, "z")], "book_id string, page_id long, more string")
    ST.write_tables(newer, str(tmp_path), "pages")
    with pytest.raises(ValueError, match="merge=True"):
        ST.load_book_tables(spark, str(tmp_path), "pages")
    for given in ({"schema": newer.schema}, {"schema": "book_id string, page_id long, more string"}, {"merge": True}):
        got = ST.load_book_tables(spark, str(tmp_path), "pages", **given).select("book_id", "page_id", "more").collect()
        assert sorted(map(tuple, got)) == [("b", 1, None), ("c", 2, "z")]


def test_tone_resize_and_merge(spark):
    left = np.arange(2 * 3 * 4, dtype=np.uint8).reshape(2, 3, 4)
    rows = [("b", 1, 3, 2, left.tobytes()), ("b", 2, 2, 1, bytes([7] * 8))]
    images = spark.createDataFrame(rows, "book_id string, page_id long, img_w int, img_h int, rgba binary")
    pages = spark.createDataFrame(
        [("b", 1, 10, 50, None, None, None, None), ("b", 2, 0, 0, "width", 4, None, 300)],
        "book_id string, page_id long, brightness int, contrast int, resize_mode string, resize_width int, resize_height int, quality int",
    )
    got = {r.page_id: r for r in I.adjust_images(images, pages).collect()}
    pixel = bytes(got[1].rgba)
    assert pixel[0] == max(0, round((0 - 128) * 1.5 + 128 + 10)) and pixel[3] == 3
    assert (got[2].img_w, got[2].img_h, bytes(got[2].rgba)) == (4, 2, bytes([7] * 32))
    pairs = spark.createDataFrame([("b", 9, 1, 2)], "book_id string, merged_id long, left_id long, right_id long")
    sheet = I.merge_spread_images(pairs, images).first()
    merged = np.frombuffer(bytes(sheet.rgba), dtype=np.uint8).reshape(2, 5, 4)
    assert (merged[:, :3] == left).all() and (merged[0, 3:] == 7).all() and (merged[1, 3:] == 255).all()

    def encoder(pixels, quality):
        if pixels.shape[1] == 4:
            raise RuntimeError("full")
        return f"{quality}".encode()

    out = {r.page_id: r for r in I.export_pages(images, pages, encoder).collect()}
    assert bytes(out[1].encoded) == b"0.75" and out[2].error == "RuntimeError: full"
    broken = images.selectExpr("book_id", "page_id", "img_w", "img_h", "case when page_id = 1 then substring(rgba, 1, 5) else rgba end rgba")
    out = {r.page_id: r for r in I.export_pages(broken, pages, lambda pixels, quality: b"x").collect()}
    assert out[1].error.startswith("ValueError") and bytes(out[2].encoded) == b"x"


def slow_resize(px, w, h):
    """Bilinear rule pixel by pixel."""
    import math

    sh, sw = px.shape[:2]
    out = np.zeros((h, w, 4), dtype=np.uint8)
    for y in range(h):
        for x in range(w):
            fy = min(sh - 1, max(0, (y + 0.5) * (sh / h) - 0.5))
            fx = min(sw - 1, max(0, (x + 0.5) * (sw / w) - 0.5))
            iy, ix = math.floor(fy), math.floor(fx)
            jy, jx = min(sh - 1, iy + 1), min(sw - 1, ix + 1)
            for c in range(4):
                p = [float(px[a, b, c]) for a in (iy, jy) for b in (ix, jx)]
                top, low = p[0] + (p[1] - p[0]) * (fx - ix), p[2] + (p[3] - p[2]) * (fx - ix)
                out[y, x, c] = round(top + (low - top) * (fy - iy))
    return out


def test_resampling_matches_the_pixel_rule(spark):
    rng = np.random.default_rng(4)
    shapes = [(13, 9), (5, 31), (40, 17), (7, 7)]
    images = [rng.integers(0, 256, (h, w, 4), dtype=np.uint8) for w, h in shapes]
    rows = [("b", i, w, h, images[i].tobytes()) for i, (w, h) in enumerate(shapes)]
    df = spark.createDataFrame(rows, "book_id string, page_id long, img_w int, img_h int, rgba binary")
    for r in I.downscale_images(df, 12).collect():
        expected = slow_resize(images[r.page_id], r.img_w, r.img_h) if max(shapes[r.page_id]) > 12 else images[r.page_id]
        assert max(r.img_w, r.img_h) <= 12 and (r.original_w, r.original_h) == shapes[r.page_id]
        assert bytes(r.rgba) == expected.tobytes()
    plan = spark.createDataFrame(
        [("b", i, 20, -30, "height" if i % 2 else "width", 19, 23) for i in range(4)],
        "book_id string, page_id long, brightness int, contrast int, resize_mode string, resize_width int, resize_height int",
    )
    for r in I.adjust_images(df, plan).collect():
        toned = images[r.page_id].copy()
        for y, x, c in np.ndindex(*toned.shape[:2], 3):
            toned[y, x, c] = min(255, max(0, round((int(toned[y, x, c]) - 128) * 0.7 + 128 + 20)))
        assert bytes(r.rgba) == slow_resize(toned, r.img_w, r.img_h).tobytes()


def test_recognition_with_fakes(spark):
    image = np.full((60, 100, 4), 255, dtype=np.uint8)
    rows = [("b", 1, 100, 60, image.tobytes())]
    images = spark.createDataFrame(rows, "book_id string, page_id long, img_w int, img_h int, rgba binary")
    detector = lambda px: [(0.0, 30.0, 90.0, 50.0, 0.5, 2, 2), (0.0, 0.0, 90.0, 20.0, 0.9, 2, 3), (1.0, 0.0, 90.0, 20.0, 0.4, 2, 3)]
    reader = lambda route, crop: f"{route}:{crop.shape[1]}"
    got = recognize_pages(images, detector, reader).orderBy("line_no").collect()
    assert [(r.text, r.edited, r.block_id) for r in got] == [("30:90", False, None), ("50:90", False, None)]
    assert toy_detector(image)


def test_recognition_splits_a_trailing_number(spark):
    image = np.full((400, 60, 4), 255, dtype=np.uint8)
    for i in range(6):
        image[4 + i * 30 : 28 + i * 30, 13:37, :3] = 0
    image[230:242, 16:34, :3] = 0
    images = spark.createDataFrame([("b", 1, 60, 400, image.tobytes())], "book_id string, page_id long, img_w int, img_h int, rgba binary")
    reader = lambda route, crop: "62" if crop.shape[0] < 50 else "章名"
    got = recognize_pages(images, lambda px: [(10.0, 0.0, 40.0, 392.0, 0.9, 2, 3)], reader).orderBy("line_no").collect()
    assert [(r.line_no, r.text) for r in got] == [(0, "章名"), (1, "62")]


def test_recognition_goes_on_after_a_failure(spark):
    rows = [("b", i, 90, 60, np.full((60, 90, 4), i, dtype=np.uint8).tobytes()) for i in range(4)]
    images = spark.createDataFrame(rows, "book_id string, page_id long, img_w int, img_h int, rgba binary")

    def detector(px):
        if px[0, 0, 0] == 1:
            raise RuntimeError("no model")
        return [] if px[0, 0, 0] == 2 else [(0.0, 0.0, 90.0, 20.0, 0.9, 2, 3)]

    def reader(route, crop):
        if crop[0, 0, 0] == 3:
            raise KeyError("letter")
        return "text"

    got = {r.page_id: (r.line_no, r.text, r.error) for r in recognize_pages(images, detector, reader).collect()}
    assert got == {0: (0, "text", None), 1: (None, None, "RuntimeError: no model"), 2: (None, None, None), 3: (None, None, "KeyError: 'letter'")}


def test_audit_and_sources(spark):
    import hashlib

    good = hashlib.sha256(b"ok").hexdigest()
    expected = spark.createDataFrame([(n, good) for n in "abcd"] + [("n", None)], "dest string, sha256 string")
    fetched = spark.createDataFrame(
        [
            ("a", 0, 404, b"", True), ("a", 1, 200, b"ok", True), ("a", 9, 200, b"ok", False),
            ("b", 0, 404, b"", True), ("b", 9, 200, b"ok", False),
            ("c", 0, 200, b"tampered", True), ("c", 9, 404, b"", False),
            ("d", 0, 200, b"ok", True), ("d", 9, 200, b"bad", False),
            ("n", 0, 200, b"anything", True), ("n", 9, 404, b"", False),
        ],
        "dest string, src_no int, http_status int, content binary, official boolean",
    )
    audit = A.source_audit(expected, fetched)
    got = {r.dest: (r.official_dead, r.fully_dead, r.mirror_dead) for r in audit.collect()}
    assert got == {"a": (False, False, False), "b": (True, False, False), "c": (True, True, True), "d": (False, False, True), "n": (False, False, False)}
    assert A.audit_exit_code(audit).first().exit_code == 1
    best = {r.dest: (r.chosen_source, r.reasons) for r in A.first_valid_source(expected, fetched).collect()}
    assert best == {"a": (1, None), "b": (9, None), "c": (None, "0: SHA-256 不一致\n9: HTTP 404"), "d": (0, None), "n": (0, None)}


def test_epub_members(spark):
    pages = spark.createDataFrame([("b", 0, 100, 200), ("b", 1, 300, 400)], "book_id string, ord int, width int, height int")
    exported = spark.createDataFrame(
        [("b", 0, "A & <B>", 0, 1), ("b", 1, "s", 1, 2), ("b", 2, "out", 5, 1)],
        "book_id string, node_no int, title string, page_index int, level int",
    )
    books = spark.createDataFrame([("b", "T", "W", "id", "2024-01-01T00:00:00Z")], "book_id string, title string, author string, identifier string, modified string")
    rows = U.epub_package_rows(books, pages, exported).orderBy("path", "part_no").collect()
    text = {}
    for r in rows:
        text[r.path] = text.get(r.path, "") + r.content
    assert sorted(text) == ["META-INF/container.xml", "OEBPS/content.opf", "OEBPS/nav.xhtml", "OEBPS/text/page-1.xhtml", "OEBPS/text/page-2.xhtml", "mimetype"]
    nav = text["OEBPS/nav.xhtml"]
    assert '<li><a href="text/page-1.xhtml">A &amp; &lt;B&gt;</a>\n        <ol>\n          <li><a href="text/page-2.xhtml">s</a></li>\n        </ol>\n      </li>' in nav
    assert "out" not in nav
    assert text["OEBPS/content.opf"].count("dcterms:modified") == 1 and '<itemref idref="page2"/>' in text["OEBPS/content.opf"]
    assert 'width="300" height="400" alt="page 2"' in text["OEBPS/text/page-2.xhtml"]
    start = U.epub_lists(pages, exported.where("false")).where("list = 'nav'").first()
    assert "Start" in start["items"]


def test_page_moves_and_errors(spark):
    import pytest

    pages = spark.createDataFrame([("b", p, i) for i, p in enumerate("abcd")], "book_id string, page_id string, ord int")

    def moved(source, target):
        df = spark.createDataFrame([("b", source, target)], "book_id string, source_id string, target_id string")
        return "".join(r.page_id for r in P.move_page(pages, df).orderBy("ord").collect())

    assert moved("a", "c") == "bcad"
    assert moved("d", "b") == "adbc"
    listed = spark.createDataFrame([("b", "zz", 0)], "book_id string, page_id string, new_ord int")
    with pytest.raises(Exception, match="page not found"):
        P.reorder_pages(pages, listed).collect()


def test_images_stay_where_they_are(spark):
    """No image moves in a join of a bucketed table with its boxes, and none is sorted."""
    rows = [("a", i, 8, 4, bytes(range(128))) for i in range(20)]
    images = bucketed(spark.createDataFrame(rows, "book_id string, page_id long, img_w int, img_h int, rgba binary"), ["book_id", "page_id"], "images")
    boxes = images.selectExpr("book_id", "page_id", "string(page_id) line_id", "0D x", "0D y", "8D w", "4D h")
    plan = image_ink_profile(images, boxes, ["book_id", "page_id"])._jdf.queryExecution().executedPlan().toString()
    image_side = [line for line in plan.splitlines() if "rgba" in line]
    assert image_side and not any("Exchange" in line or "Sort" in line for line in image_side)
    assert "ShuffledHashJoin" in plan and "SelectedBucketsCount" in plan


def test_ink_from_images_equals_ink_from_pixels(spark):
    rng = np.random.default_rng(6)
    rows, boxes = [], []
    for i in range(12):
        w, h = int(rng.integers(3, 30)), int(rng.integers(3, 40))
        image = rng.choice([0, 40, 200, 255], (h, w, 4), p=[0.1, 0.1, 0.2, 0.6]).astype(np.uint8)
        rows.append(("a", i, w, h, image.tobytes()))
        for k in range(4):
            boxes.append(("a", i, f"{i}/{k}", *(float(v) for v in rng.uniform(-4, 30, 2)), *(float(v) for v in rng.uniform(0.2, 30, 2))))
    boxes.append(("b", 99, "other", 0.0, 0.0, 5.0, 5.0))
    rows.append(("c", 1, 5, 5, b"short"))
    keys = ["book_id", "page_id"]
    images = spark.createDataFrame(rows, "book_id string, page_id long, img_w int, img_h int, rgba binary")
    lines = spark.createDataFrame(boxes, "book_id string, page_id long, line_id string, x double, y double, w double, h double")
    names = [*keys, "line_id", "y", "min_x", "max_x"]
    pixels = image_pixels(images.where("book_id = 'a'"))
    want = ink_profile(pixels, lines, keys).select(*names)
    got = image_ink_profile(images, lines, keys).select(*names)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count()
    runs = [*keys, "line_id", "start_y", "end_y", "min_x", "max_x"]
    want = ink_runs(want, lines, keys).select(*runs)
    assert sorted(map(tuple, image_ink_runs(images, lines, keys).select(*runs).collect())) == sorted(map(tuple, want.collect()))


def test_detector_rows_of_another_length_are_that_pages_error(spark):
    rows = [("a", i, 40, 40, bytes([i]) * 6400) for i in range(3)]
    images = spark.createDataFrame(rows, "book_id string, page_id long, img_w int, img_h int, rgba binary")
    detector = lambda px: [(0.0, 0.0, 30.0, 30.0, 0.9, 2, 3)] + ([(1.0, 2.0)] if px[0, 0, 0] == 1 else [])
    got = {r["page_id"]: (r["text"], r["error"]) for r in recognize_pages(images, detector, lambda route, px: "t").collect()}
    assert got[0] == got[2] == ("t", None) and got[1][0] is None and got[1][1].startswith("ValueError")


def test_levels_from_images_equal_levels_from_pixels(spark):
    rng = np.random.default_rng(9)
    rows = [("a", i, w, h, rng.integers(0, 256, (h, w, 4)).astype(np.uint8).tobytes()) for i, (w, h) in enumerate([(5, 7), (30, 20), (1, 1), (64, 3)])]
    images = spark.createDataFrame([*rows, ("a", 9, 5, 5, b"short"), ("a", 10, 5, 5, None)], "book_id string, page_id long, img_w int, img_h int, rgba binary")
    keys = ["book_id", "page_id"]
    want = auto_levels(image_pixels(images.where("page_id < 9")), keys).collect()
    assert sorted(map(tuple, image_auto_levels(images, keys).collect())) == sorted(map(tuple, want)) and len(want) == 4


def read_books(path):
    return {f.relative_to(path).as_posix(): f.read_bytes().decode() for f in path.rglob("*") if f.is_file()}


def test_one_file_per_book(spark, tmp_path):
    rng = np.random.default_rng(1)
    pages = [("long", i, f"page {i}" if rng.random() < 0.9 else rng.choice(["", None])) for i in range(5000)]
    pages = [(b, i, None if t is None else str(t)) for b, i, t in pages] + [("a/b", 1, "second"), ("a/b", 0, "first\n"), ("blank", 0, ""), ("blank", 1, None), ("nobody", 0, "x")]
    texts = spark.createDataFrame(pages, "book_id string, ord int, text string").repartition(7)
    books = spark.createDataFrame([("long", "Long: title?"), ("a/b", None), ("blank", "B")], "book_id string, title string")
    path = tmp_path / "out"
    write_book_files(texts, books, str(path))
    want = "\n\n".join(t for b, _, t in pages if b == "long" and t)
    assert read_books(path) == {"book-long/Long_ title_.txt": want, "book-a%2Fb/ocr.txt": "first\n\n\nsecond", "book-blank/B.txt": ""}
    write_book_files(texts.where("book_id = 'blank'").withColumn("text", F.lit("now")), books, str(path))
    assert read_books(path)["book-blank/B.txt"] == "now\n\nnow" and len(read_books(path)) == 3


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    texts = spark.range(400).selectExpr("concat('b', id % 4) book_id", "int(id) ord", "if(id = 399, raise_error('bad page'), 'text') text")
    books = spark.createDataFrame([(f"b{i}", f"t{i}") for i in range(4)], "book_id string, title string")
    with pytest.raises(Exception, match="bad page"):
        write_book_files(texts, books, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists() or read_books(tmp_path / "out") == {}


def test_written_files_are_whole(spark, tmp_path):
    rows = [("a/1.bin", b"one"), ("a/b/2.bin", b""), ("3.bin", b"\0" * 100)]
    files = spark.createDataFrame(rows, "path string, content binary")
    for _ in range(2):
        assert sorted(map(tuple, SI.write_files(files, str(tmp_path)).collect())) == sorted((p, len(c)) for p, c in rows)
    assert {f.relative_to(tmp_path).as_posix(): f.read_bytes() for f in tmp_path.rglob("*") if f.is_file()} == dict(rows)


def test_book_text_parts_keep_their_order(spark, tmp_path):
    """Parts of several books in one task, and parts without text before, between and after others."""
    parts = [(f"b{b}", n, "" if (b + n) % 5 == 0 else f"{b}/{n} " + "x" * (97 * n % 300)) for b in range(12) for n in range(40)]
    parts += [("blank", n, "") for n in range(3)]
    texts = spark.createDataFrame(parts, "book_id string, part_no int, text string").repartition(3)
    books = texts.select("book_id", F.col("book_id").alias("title")).distinct()
    ST.write_book_text(texts, books, f"{tmp_path}/texts")
    got = {}
    for file in sorted((tmp_path / "texts").glob("book_id=*/*/part-*"), key=lambda f: f.name):
        book = file.parts[-3].removeprefix("book_id=")
        got[book] = got.get(book, "") + file.read_text()
    want = {b: "\n\n".join(t for book, _, t in parts if book == b and t) + "\n" for b in {p[0] for p in parts}}
    assert got == want


def test_small_files_share_tasks(spark, tmp_path):
    for i in range(160):
        (tmp_path / f"{i}.bmp").write_bytes(b"x")
    with setting(spark, "spark.sql.files.maxPartitionBytes", "4194304"):
        scanned = SI.scan_image_files(spark, str(tmp_path))
        assert scanned.count() == 160 and scanned.rdd.getNumPartitions() < 160


def bitmap(width, height, depth=24):
    """A bitmap whose bytes count up; a negative height is top row first."""
    body = bytes(i % 251 for i in range((width * depth // 8 + 3) // 4 * 4 * abs(height)))
    return b"BM" + struct.pack("<IIIIiiHHIIIIII", 54 + len(body), 0, 54, 40, width, height, 1, depth, 0, 0, 0, 0, 0, 0) + body


def bitmap_folder(tmp_path):
    """Bitmaps in both directions, with and without bytes at the end of a row, and two files that are none."""
    (tmp_path / "in" / "sub").mkdir(parents=True)
    for i, size in enumerate([(4, 3), (4, -3), (5, 2), (7, -1), (1, 1)]):
        (tmp_path / "in" / "sub" / f"{i}.bmp").write_bytes(bitmap(*size))
    (tmp_path / "in" / "short").write_bytes(b"BM")
    (tmp_path / "in" / "text.bmp").write_bytes(b"no image")
    return f"{tmp_path}/in"


def image_rows(rows):
    return sorted((r.path, r.ok, r.width, r.height, r.channels, r.data and bytes(r.data)) for r in rows)


def test_bitmaps_equal_the_image_source(spark, tmp_path):
    folder = bitmap_folder(tmp_path)
    got = SI.decode_images(spark, folder, SI.decode_bitmap)
    assert image_rows(got.collect()) == image_rows(SI.decode_images(spark, folder).withColumn("path", F.replace("path", F.lit("file:///"), F.lit("file:/"))).collect())
    assert got.where("ok").count() == 5


@pytest.mark.parametrize("content", [b"", b"BM", bitmap(4, 3)[:-1], bitmap(4, 3, 32), bitmap(0, 3), bitmap(4, 0), b"\x89PNG" + bytes(60)])
def test_other_files_are_no_plain_bitmaps(content):
    with pytest.raises(ValueError):
        SI.decode_bitmap(content)


def test_stream_import_of_many_small_files(spark, tmp_path):
    """One micro-batch, and a listing of it in at most 64 tasks; the rows are those of the batch form."""
    folder = bitmap_folder(tmp_path)
    for i in range(1100):
        (tmp_path / "in" / f"{i}").write_bytes(bitmap(2, 2))
    batches = []
    frames = stream_import(spark, folder, decode_fn=SI.decode_bitmap)
    with setting(spark, *FEWER_LISTINGS), setting(spark, *LARGER_READS):
        query = frames.writeStream.foreachBatch(lambda b, _: batches.append(b.collect())).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        query.awaitTermination()
    assert len(batches) == 1
    assert image_rows(batches[0]) == image_rows(SI.decode_images(spark, folder, SI.decode_bitmap).collect())
