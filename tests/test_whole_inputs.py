"""Queries that give the e-book operators all exported chapters and pages."""

import os

import pytest

from foliospark.catalog import QUERIES
from foliospark.catalog.compare import check, connect

SF = "/root/testdata/sf0.01"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")


@pytest.mark.parametrize("name", ["outline_range_filter_whole", "epub_lists_whole", "epub_package_rows_whole"])
def test_agrees(spark, name):
    assert check(spark, connect(SF), SF, name) is None and check(spark, connect(SF), SF, name.removesuffix("_whole")) is None


def test_every_chapter_stays(spark):
    whole = QUERIES["chapters_to_page_index"](spark, SF)
    rows = QUERIES["outline_range_filter_whole"](spark, SF).select(*whole.columns)
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, whole.collect()))
