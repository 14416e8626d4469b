"""Text members of a fixed-layout e-book as rows, for many books at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.text import escape_xml
from foliospark.operators.chapters import outline_links, outline_range_filter
from foliospark.plans.ordered import number_rows, slot, text_parts
from foliospark.plans.session import stored

ITEMS_PER_PART = 4096
# Parts of a member are numbered section * SECTION + number inside the section.
SECTION = 1_000_000

# ---- Fixed values: the texts of the package format ----
MIMETYPE = "application/epub+zip"
CONTAINER = """<?xml version="1.0" encoding="UTF-8"?>
<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container">
  <rootfiles>
    <rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/>
  </rootfiles>
</container>
"""
PAGE_XHTML = """<?xml version="1.0" encoding="UTF-8"?>
<html xmlns="http://www.w3.org/1999/xhtml">
<head>
  <title>Page {n}</title>
  <meta name="viewport" content="width={w}, height={h}"/>
</head>
<body style="margin:0;padding:0">
  <img src="../images/page-{n}.jpg" width="{w}" height="{h}" alt="page {n}"/>
</body>
</html>
"""
NAV_HEAD = """<?xml version="1.0" encoding="UTF-8"?>
<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops">
<head><title>Navigation</title></head>
<body>
  <nav epub:type="toc">
    <ol>
"""
NAV_TAIL = """
    </ol>
  </nav>
</body>
</html>
"""
NAV_START = '      <li><a href="text/page-1.xhtml">Start</a></li>'
OPF_HEAD = """<?xml version="1.0" encoding="UTF-8"?>
<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="bookid">
  <metadata xmlns:dc="http://purl.org/dc/elements/1.1/">
    <dc:identifier id="bookid">urn:uuid:{identifier}</dc:identifier>
    <dc:title>{title}</dc:title>
    <dc:creator>{author}</dc:creator>
    <dc:language>ja</dc:language>
    <meta property="dcterms:modified">{modified}</meta>
    <meta property="rendition:layout">pre-paginated</meta>
  </metadata>
  <manifest>
    <item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>
"""
OPF_MIDDLE = """
  </manifest>
  <spine>
"""
OPF_TAIL = """
  </spine>
</package>
"""
# --------------------------------------------------------


def _fill(template: str, **values: Column) -> Column:
    """A template as a concatenation of literals and columns."""
    parts: list[Column] = []
    rest = template
    while rest:
        marks = sorted((rest.find("{" + k + "}"), k) for k in values if "{" + k + "}" in rest)
        if not marks:
            parts.append(F.lit(rest))
            break
        at, key = marks[0]
        if at:
            parts.append(F.lit(rest[:at]))
        parts.append(values[key].cast("string"))
        rest = rest[at + len(key) + 2 :]
    return F.concat(*parts)


def page_members(pages: DataFrame) -> DataFrame:
    """One XHTML member per page."""
    n = F.col("ord") + 1
    return pages.select(
        "book_id",
        F.concat(F.lit("OEBPS/text/page-"), n.cast("string"), F.lit(".xhtml")).alias("path"),
        F.lit(0).alias("part_no"),
        _fill(PAGE_XHTML, n=n, w=F.col("width"), h=F.col("height")).alias("content"),
    )


def epub_lists(pages: DataFrame, exported: DataFrame) -> DataFrame:
    """Manifest, spine and navigation items per book as (book_id, list, part_no, items).

    Each list comes in parts of at most 4,096 pages or chapters; parts in order, joined by the separator of the list
    (a newline with the indent of its items), are the whole list. Navigation items are written per outline row, so a
    nested list needs no second level of aggregation.
    """
    n = (F.col("ord") + 1).cast("string")
    manifest = F.concat(
        F.lit('    <item id="img'), n, F.lit('" href="images/page-'), n, F.lit('.jpg" media-type="image/jpeg"/>\n    <item id="page'),
        n, F.lit('" href="text/page-'), n, F.lit('.xhtml" media-type="application/xhtml+xml"/>'),
    )
    spine = F.concat(F.lit('    <itemref idref="page'), n, F.lit('"/>'))
    items = pages.select("book_id", "ord", manifest.alias("manifest"), spine.alias("spine"))

    links = outline_links(stored(_renumbered(outline_range_filter(exported, pages)), "nav-chapters"))
    link = F.concat(
        F.lit('<li><a href="text/page-'), (F.col("page_index") + 1).cast("string"), F.lit('.xhtml">'),
        escape_xml("title"), F.lit("</a>"),
    )
    is_root = F.col("parent_no").isNull()
    opens = is_root & (F.col("n_children") > 0)
    closes = ~is_root & F.col("next_no").isNull()
    nav = (
        F.when(opens, F.concat(F.lit("      "), link, F.lit("\n        <ol>")))
        .when(is_root, F.concat(F.lit("      "), link, F.lit("</li>")))
        .when(closes, F.concat(F.lit("          "), link, F.lit("</li>\n        </ol>\n      </li>")))
        .otherwise(F.concat(F.lit("          "), link, F.lit("</li>")))
    )
    nav_parts = text_parts(
        links.select("book_id", "node_no", nav.alias("item")), ["book_id"], "node_no", "item", "\n", "items",
        per_part=ITEMS_PER_PART,
    )
    start = (
        pages.select("book_id")
        .distinct()
        .join(links.select("book_id").distinct(), "book_id", "left_anti")
        .select("book_id", F.lit(0).alias("part_no"), F.lit(NAV_START).alias("items"))
    )
    out = nav_parts.unionByName(start).withColumn("list", F.lit("nav"))
    for name in ("manifest", "spine"):
        part = text_parts(items, ["book_id"], "ord", name, "\n", "items", per_part=ITEMS_PER_PART)
        out = out.unionByName(part.withColumn("list", F.lit(name)))
    return out.select("book_id", "list", "part_no", "items")


def _renumbered(exported: DataFrame) -> DataFrame:
    """Node numbers without gaps after the range filter."""
    return number_rows(exported, ["book_id"], [slot("node_no")], [F.col("node_no")], "_no").withColumn(
        "node_no", F.col("_no")
    ).drop("_no")


def epub_package_rows(books: DataFrame, pages: DataFrame, exported: DataFrame) -> DataFrame:
    """All text members (book_id, path, part_no, content); the parts of a member in order are its text.

    ``books`` has title, author, identifier and modified (time stamp text). Pages number from 1.
    """
    lists = stored(epub_lists(pages, exported), "epub-lists")
    part = F.col("part_no")
    joined = F.when(part > 0, F.concat(F.lit("\n"), F.col("items"))).otherwise(F.col("items"))

    def fixed(path: str, section: int, content: Column) -> DataFrame:
        return books.select(
            "book_id", F.lit(path).alias("path"), F.lit(section * SECTION).alias("part_no"), content.alias("content")
        )

    def listed(name: str, path: str, section: int) -> DataFrame:
        return lists.where(F.col("list") == name).select(
            "book_id", F.lit(path).alias("path"), (part + section * SECTION).cast("int").alias("part_no"), joined.alias("content")
        )

    opf = "OEBPS/content.opf"
    nav = "OEBPS/nav.xhtml"
    head = _fill(
        OPF_HEAD,
        identifier=F.col("identifier"),
        title=escape_xml("title"),
        author=escape_xml("author"),
        modified=F.col("modified"),
    )
    members = [
        fixed("mimetype", 0, F.lit(MIMETYPE)),
        fixed("META-INF/container.xml", 0, F.lit(CONTAINER)),
        page_members(pages),
        fixed(nav, 0, F.lit(NAV_HEAD)),
        listed("nav", nav, 1),
        fixed(nav, 2, F.lit(NAV_TAIL)),
        fixed(opf, 0, head),
        listed("manifest", opf, 1),
        fixed(opf, 2, F.lit(OPF_MIDDLE)),
        listed("spine", opf, 3),
        fixed(opf, 4, F.lit(OPF_TAIL)),
    ]
    out = members[0]
    for m in members[1:]:
        out = out.unionByName(m)
    return out
