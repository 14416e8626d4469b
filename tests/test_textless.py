"""Queries over images and files of documents whose text is empty or missing."""

import pytest

from foliospark.catalog import ORACLES, QUERIES
from foliospark.catalog.compare import check, connect
from foliospark.operators import images as I
from foliospark.operators import pixels as X

TEXTS = ["Ein Satz mit dreißig Zeichen, ungefähr. " * (1 + i % 5) for i in range(14)]
ODD = ["", None] * 6
KEYS = ["book_id", "page_id"]
NAMES = [
    "recognize_pages", "adjust_images", "decode_rows", "downscale_images", "export_pages", "decode_images", "image_auto_levels", "image_ink_profile",
    "image_ink_runs", "image_pixels", "merge_spread_images", "stream_import", "scan_image_files", "stream_import_rows",
]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Folders with documents: those with a text, then with missing ones, then with empty ones as well."""
    made = {}
    for name, texts in {"plain": TEXTS, "missing": TEXTS + [None] * 6, "odd": TEXTS + ODD}.items():
        made[name] = str(tmp_path_factory.mktemp(name))
        rows = [(i, text, "s") for i, text in enumerate(texts)]
        spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{made[name]}/documents.parquet")
    return made


def rows(spark, name, folder):
    return {str(r) for r in QUERIES[name](spark, folder).collect()}


@pytest.mark.parametrize("name", NAMES)
def test_other_documents_keep_their_rows(spark, tables, name):
    plain, odd = rows(spark, name, tables["plain"]), rows(spark, name, tables["odd"])
    assert plain and plain <= odd
    if name in ("image_auto_levels", "image_ink_profile", "image_ink_runs", "image_pixels"):
        assert plain == odd
    elif name not in ("recognize_pages", "merge_spread_images", "scan_image_files"):
        assert len(odd) == len(plain) + len(ODD)


@pytest.mark.parametrize("name", [n for n in NAMES if n in ORACLES])
def test_missing_texts_agree_with_sql(spark, tables, name):
    con = connect(tables["missing"])
    con.execute(f"create or replace view documents as select * from '{tables['missing']}/documents.parquet/*.parquet'")
    assert check(spark, con, tables["missing"], name) is None


def test_every_textless_page_has_a_row(spark, tables):
    ids = set(range(len(TEXTS), len(TEXTS) + len(ODD)))
    found = QUERIES["recognize_pages"](spark, tables["odd"]).where(f"page_id >= {len(TEXTS)}").collect()
    assert {r.page_id for r in found} == ids and all(r.error and r.line_no is None for r in found)
    exported = {r.page_id: r for r in QUERIES["export_pages"](spark, tables["odd"]).collect()}
    assert {i for i, r in exported.items() if r.error} == {i for i, text in enumerate(TEXTS + ODD) if text is None}


def test_unreadable_images_are_single_rows(spark):
    """Sizes of a batch with a null are floats; its other images are read as before."""
    good = bytes([0, 0, 0, 255] * 4 + [255] * 16)
    data = [("a", 1, 4, 2, good), ("a", 2, 4, None, None), ("a", 3, 4, 0, b""), ("a", 4, 4, 2, b"short")]
    images = spark.createDataFrame(data, "book_id string, page_id long, img_w int, img_h int, rgba binary").coalesce(1)
    plan = images.selectExpr(*KEYS, "0 brightness", "0 contrast", "'height' resize_mode", "4 resize_width", "2 resize_height")
    sizes = [(1, 4, 2, good), (2, 4, None, None), (3, 4, 0, b""), (4, 4, 2, None)]
    for out in (I.adjust_images(images, plan), I.downscale_images(images, 4)):
        got = [(r.page_id, r.img_w, r.img_h, r.rgba and bytes(r.rgba)) for r in out.orderBy("page_id").collect()]
        assert got[0] == sizes[0] and [g[:3] for g in got] == [s[:3] for s in sizes] and [g[3] is None for g in got] == [False, True, False, True]
    pairs = spark.createDataFrame([("a", 1, 1, 3), ("a", 2, 1, 2)], "book_id string, merged_id long, left_id long, right_id long")
    got = {r.merged_id: (r.img_w, r.img_h, r.rgba is None) for r in I.merge_spread_images(pairs, images).collect()}
    assert got == {1: (8, 2, False), 2: (None, None, True)}
    assert {r.page_id for r in I.image_pixels(images).collect()} == {1} and I.image_pixels(images).count() == 8
    boxes = images.selectExpr(*KEYS, "string(page_id) line_id", "0D x", "0D y", "4D w", "2D h")
    assert [tuple(r)[1:] for r in X.image_ink_profile(images, boxes, KEYS).collect()] == [(1, "1", 0, 0, 3)]
