"""Column functions for text rules (titles, page numbers, file names, markup)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- Fixed values -------------------------------------------------------------------------------------------------
# White space as ECMAScript defines it (Java's \s is ASCII only).
WS = r"\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
# Characters that may fill the space between a title and its page number.
LEADERS = WS + r".·・…‥⋯_\-–—―"
DOTS = r".·・…‥⋯"
KANJI_DIGITS = "〇一二三四五六七八九"
# Headings that are only a fragment and no title.
FRAGMENT = r"(?i)^(chapter|part|section|page|no|p|第)\.?\z"
# Prefixes of second-level titles: 1.1 / 1-2, 第n節, (1), 1), section n, §.
SECTION_PREFIXES = (
    r"^[0-9]+[.-][0-9]+",
    rf"^第[{WS}]*[0-9一二三四五六七八九十百]+[{WS}]*節",
    rf"^\([{WS}]*[0-9]+[{WS}]*\)",
    r"^[0-9]+\)",
    rf"(?i)^section[{WS}]*[0-9]",
    r"^§",
)
TOC_KEYWORD = r"(?i)^(目次|もくじ|contents|tableofcontents)\z"
DEFAULT_QUALITY = 75
DEFAULT_RESIZE_WIDTH = 1080
DEFAULT_RESIZE_HEIGHT = 1920
MIN_ASSET_BYTES = 1024 * 1024
IMAGE_EXTENSIONS = ("apng", "avif", "bmp", "gif", "jpeg", "jpg", "png", "svg", "tif", "tiff", "webp")
# -------------------------------------------------------------------------------------------------------------------


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def js_trim(col: str | Column) -> Column:
    return F.regexp_replace(_c(col), rf"^[{WS}]+|[{WS}]+\z", "")


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def nfkc(col: str | Column) -> Column:
    """NFKC form. Pure ASCII is its own NFKC form and is not sent to Python."""
    c = _c(col)
    foreign = F.when(c.rlike(r"[^\x00-\x7F]"), c)
    return F.coalesce(_nfkc(foreign), c)


def nfkc_trim(col: str | Column) -> Column:
    return js_trim(nfkc(col))


def is_blank(col: str | Column) -> Column:
    return ~_c(col).rlike(rf"[^{WS}]")


def kanji_digits_to_int(col: str | Column) -> Column:
    """Digit by digit: 二一 is 21. Anything else than kanji digits gives null."""
    c = _c(col)
    digits = F.translate(c, KANJI_DIGITS, "0123456789")
    return F.when(c.rlike(rf"^[{KANJI_DIGITS}]+\z"), digits.try_cast("int"))


def bare_page_number(col: str | Column) -> Column:
    c = _c(col)
    return F.when(c.rlike(r"^[0-9]{1,4}\z"), c.try_cast("int")).when(
        c.rlike(rf"^[{KANJI_DIGITS}]{{1,4}}\z"), kanji_digits_to_int(c)
    )


def clean_title(col: str | Column) -> Column:
    return js_trim(F.regexp_replace(_c(col), rf"[{LEADERS}]+\z", ""))


def toc_tail_number(col: str | Column) -> Column:
    """struct(title, page) of a line that ends in a run of one to four digits, else null."""
    c = _c(col)
    pattern = rf"^([^\n\r\u2028\u2029]*?)(?<![0-9])([0-9]{{1,4}})[{WS}]*\z"
    title = clean_title(F.regexp_extract(c, pattern, 1))
    page = F.regexp_extract(c, pattern, 2).try_cast("int")
    return F.when(c.rlike(pattern), F.struct(title.alias("title"), page.alias("page")))


def is_valid_title(col: str | Column) -> Column:
    c = _c(col)
    return c.rlike(r"\p{L}") & ~c.rlike(FRAGMENT)


def toc_level(col: str | Column) -> Column:
    c = _c(col)
    hit = F.lit(False)
    for prefix in SECTION_PREFIXES:
        hit = hit | c.rlike(prefix)
    return F.when(hit, F.lit(2)).otherwise(F.lit(1))


def trailing_number_text(col: str | Column) -> Column:
    """Text of a split-off page number: white space removed, one to four digits, else null."""
    packed = F.regexp_replace(nfkc(col), rf"[{WS}]+", "")
    return F.when(packed.rlike(rf"^([0-9]{{1,4}}|[{KANJI_DIGITS}]{{1,4}})\z"), packed)


def is_toc_keyword(col: str | Column) -> Column:
    return F.regexp_replace(_c(col), rf"[{WS}]+", "").rlike(TOC_KEYWORD)


def is_leader_line(col: str | Column) -> Column:
    return _c(col).rlike(rf"[{DOTS}]{{2,}}[{WS}]*[0-9]{{1,4}}[{WS}]*\z")


def has_letter_or_number(col: str | Column) -> Column:
    return _c(col).rlike(r"[\p{L}\p{N}]")


def text_file_name(col: str | Column) -> Column:
    base = js_trim(F.regexp_replace(F.coalesce(_c(col), F.lit("")), r'[\\/:*?"<>|\x00-\x1f]', "_"))
    return F.concat(F.when(base.rlike(r"^\.*\z"), F.lit("ocr")).otherwise(base), F.lit(".txt"))


def export_file_name(col: str | Column, suffix: str) -> Column:
    safe = F.regexp_replace(js_trim(F.coalesce(_c(col), F.lit(""))), r'[\\/:*?"<>|]', "_")
    return F.concat(F.coalesce(F.nullif(safe, F.lit("")), F.lit("book")), F.lit("." + suffix))


def display_name(file_name: str | Column, order: str | Column) -> Column:
    return F.coalesce(_c(file_name), F.concat(F.lit("ページ "), (_c(order) + 1).cast("string")))


def natural_sort_key(col: str | Column) -> Column:
    """array<struct<k,n,v>> that compares like the natural order of names.

    k places a chunk against the digits (0 below, 1 digits, 2 above); n is the length of a number without leading
    zeros; v is the number's digits or the chunk itself.
    """
    chunks = F.regexp_extract_all(_c(col), F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))

    def part(chunk: Column) -> Column:
        digits = F.regexp_replace(chunk, r"^0+", "")
        numeric = chunk.rlike(r"^[0-9]+\z")
        return F.struct(
            F.when(numeric, F.lit(1)).when(chunk < F.lit("0"), F.lit(0)).otherwise(F.lit(2)).alias("k"),
            F.when(numeric, F.length(digits)).otherwise(F.lit(0)).alias("n"),
            F.when(numeric, digits).otherwise(chunk).alias("v"),
        )

    return F.transform(chunks, part)


def escape_xml(col: str | Column) -> Column:
    c = _c(col)
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(raw), F.lit(entity))
    return c


def iso_seconds_z(col: str | Column, *, zoned: bool = True) -> Column:
    """UTC time stamp without milliseconds. ``zoned`` says whether the column is an instant or already UTC."""
    c = _c(col)
    utc = F.to_utc_timestamp(c, F.current_timezone()) if zoned else c
    return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def resize_label(mode: str | Column, width: str | Column, height: str | Column) -> Column:
    m, w, h = _c(mode), _c(width), _c(height)
    return F.when((m == "width") & (w > 0), F.concat(F.lit("幅 "), w.cast("string"), F.lit("px"))).when(
        (m == "height") & (h > 0), F.concat(F.lit("高さ "), h.cast("string"), F.lit("px"))
    )


def tone_label(brightness: str | Column, contrast: str | Column) -> Column:
    b, c = _c(brightness), _c(contrast)
    return F.when(
        (b != 0) | (c != 0), F.concat(F.lit("明るさ"), b.cast("string"), F.lit(" コントラスト"), c.cast("string"))
    )


def quality_label(quality: str | Column) -> Column:
    return F.concat(F.lit("画質 "), F.coalesce(_c(quality), F.lit(DEFAULT_QUALITY)).cast("string"))


def content_key(sha256: str | Column, dest: str | Column) -> Column:
    """Content-addressed key, null where the hash is missing or malformed."""
    base = F.regexp_extract(_c(dest), r"([^/]*)/*\z", 1)
    return F.when(_c(sha256).rlike(r"^[0-9a-f]{64}\z"), F.concat(F.lit("models/"), _c(sha256), F.lit("/"), base))


def asset_problem(content: str | Column, content_type: str | Column, min_bytes: int = MIN_ASSET_BYTES) -> Column:
    """Why downloaded bytes cannot be a model file, null when nothing speaks against it."""
    body = _c(content).cast("binary")
    html = _c(content_type).contains("text/html") | (F.substring(body, 1, 1) == F.lit("<").cast("binary"))
    size = F.octet_length(body)
    return F.when(html, F.lit("モデルではなくHTMLが返りました")).when(
        size < min_bytes, F.concat(F.lit("モデルとしては小さすぎます ("), size.cast("string"), F.lit(" バイト)"))
    )


def is_image_name(path: str | Column) -> Column:
    return F.lower(F.regexp_extract(_c(path), r"\.([A-Za-z0-9]+)\z", 1)).isin(*IMAGE_EXTENSIONS)
