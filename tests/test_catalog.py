"""Registered queries beside their SQL counterparts on small tables; an empty result is a failure.

By default a choice of queries that covers every module runs; set FOLIO_ALL=1 to run all of them.
"""

import os

import pytest

from foliospark.catalog import ORACLES, QUERIES
from foliospark.catalog.compare import check, connect

SF = "/root/testdata/sf0.01"
CHOICE = [
    "book_text", "guess_title", "toc_page_score", "detect_toc_pages", "remap_chapters", "natural_order_pages",
    "merge_spread_pages", "nms_lines", "auto_levels", "trailing_splits", "greedy_decode", "first_valid_source",
    "add_line", "debounce_adjustments", "confirmed_deletes", "image_pixels", "text_file_name",
]
NAMES = list(QUERIES) if os.environ.get("FOLIO_ALL") else CHOICE

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees(spark, name):
    reason = check(spark, connect(SF), SF, name)
    assert reason is None


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["book_id", "part_no", "text"]
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())
    assert set(QUERIES) - set(ORACLES) == {
        "reading_order", "replay_line_edits", "stateful_line_edits", "export_pages", "recognize_pages",
        "adjust_images", "downscale_images", "merge_spread_images",
    }
