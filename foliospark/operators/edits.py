"""Edits of recognised lines: batches of one kind, and replay of an ordered log."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.plans.ordered import number_rows, slot
from foliospark.plans.session import spread

PAGE = ["book_id", "page_id"]


def update_line(lines: DataFrame, edits: DataFrame) -> DataFrame:
    """Sets text and marks the line as edited (book_id, page_id, line_id, new_text)."""
    return (
        lines.join(edits.select(*PAGE, "line_id", "new_text"), [*PAGE, "line_id"], "left")
        .withColumn("edited", F.col("edited") | F.col("new_text").isNotNull())
        .withColumn("text", F.coalesce("new_text", "text"))
        .drop("new_text")
    )


def _renumber(lines: DataFrame, order: Sequence[str]) -> DataFrame:
    numbered = number_rows(lines, PAGE, [slot("line_no")], [F.col(c) for c in order], "_new")
    return numbered.withColumn("line_no", F.col("_new")).drop("_new")


def delete_line(lines: DataFrame, edits: DataFrame) -> DataFrame:
    """Removes lines; the others close up."""
    return _renumber(lines.join(edits.select(*PAGE, "line_id"), [*PAGE, "line_id"], "left_anti"), ["line_no"])


def add_line(lines: DataFrame, adds: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """Inserts empty edited lines (book_id, page_id, line_id, after_line_id, add_no, x, y, w, h).

    A line goes right after the named line, so of several adds at one place the last comes first; without a known
    line it goes to the end, in order of ``add_no``. ``results`` (book_id, page_id) names recognised pages; on one
    without lines the first new line gets number 0. Adds on pages without a result have no effect.
    """
    anchors = lines.select(*PAGE, F.col("line_id").alias("after_line_id"), F.col("line_no").alias("_at"))
    ends = lines.select(*PAGE, (F.col("line_no") + 1).alias("_end"))
    if results is not None:
        ends = ends.unionByName(results.select(*PAGE, F.lit(0).cast(ends.schema["_end"].dataType).alias("_end")))
    ends = ends.groupBy(*PAGE).agg(F.max("_end").alias("_end"))
    new = (
        adds.join(ends, PAGE)
        .join(anchors, [*PAGE, "after_line_id"], "left")
        .withColumns(
            {
                "line_no": F.coalesce("_at", "_end"),
                "_kind": F.lit(1),
                "_tie": F.when(F.col("_at").isNotNull(), -F.col("add_no")).otherwise(F.col("add_no")),
                "text": F.lit(""),
                "edited": F.lit(True),
                "block_id": F.lit(None).cast("string"),
            }
        )
        .select(*lines.columns, "_kind", "_tie")
    )
    old = lines.withColumns({"_kind": F.lit(0), "_tie": F.lit(0)})
    return _renumber(old.unionByName(new), ["line_no", "_kind", "_tie"]).drop("_kind", "_tie")


def move_line(lines: DataFrame, moves: DataFrame) -> DataFrame:
    """Moves one line per page to an index (book_id, page_id, line_id, to_index), clamped to the list."""
    at = moves.join(lines.select(*PAGE, "line_id", F.col("line_no").alias("_from")), [*PAGE, "line_id"])
    ends = lines.groupBy(*PAGE).agg(F.max("line_no").alias("_last"))
    spots = at.join(ends, PAGE).select(
        *PAGE, "_from", F.greatest(F.lit(0), F.least("to_index", "_last")).cast("int").alias("_to")
    )
    n, a, b = F.col("line_no"), F.col("_from"), F.col("_to")
    place = (
        F.when(a.isNull(), n)
        .when(n == a, b)
        .when((a < b) & (n > a) & (n <= b), n - 1)
        .when((b < a) & (n >= b) & (n < a), n + 1)
        .otherwise(n)
    )
    return lines.join(spots, PAGE, "left").withColumn("line_no", place).drop("_from", "_to")


BLOCK = 512


class PageLines:
    """The lines (line_id, text, edited) of one page while its log is applied.

    Lines stand in blocks of at most ``2 * BLOCK``, blocks in an order, and an index names the blocks that hold an id.
    An edit looks at one block and at the order of blocks, not at all lines. Of lines with one id the first is meant.
    Where blocks and index are kept is up to ``_block``, ``_put``, ``_places`` and ``_put_places``.
    """

    def __init__(self) -> None:
        self.order: list[int] = []
        self.sizes: list[int] = []
        self.made = 0
        self.last_edit: int | None = None
        self._blocks: dict[int, list[tuple]] = {}
        self._where: dict[str | None, list[int]] = {}

    def _block(self, number: int) -> list[tuple]:
        return self._blocks[number]

    def _put(self, number: int, lines: list[tuple]) -> None:
        if lines:
            self._blocks[number] = lines
        else:
            self._blocks.pop(number, None)

    def _places(self, line_id: str | None) -> list[int]:
        """Numbers of the blocks with lines of this id, one for each line."""
        return self._where.get(line_id, [])

    def _put_places(self, line_id: str | None, places: list[int]) -> None:
        if places:
            self._where[line_id] = places
        else:
            self._where.pop(line_id, None)

    def lines(self) -> Iterator[tuple]:
        for number in self.order:
            yield from self._block(number)

    def _find(self, line_id: str | None) -> tuple[int, int] | None:
        """Place of the first line with an id: position of its block, position in the block."""
        places = self._places(line_id)
        if not places:
            return None
        at = min(map(self.order.index, set(places)))
        block = self._block(self.order[at])
        return at, next(i for i, line in enumerate(block) if line[0] == line_id)

    def _at(self, index: int) -> tuple[int, int]:
        """Place at which a line gets this number; beyond the last line, the end."""
        index = max(0, index)
        for at, size in enumerate(self.sizes):
            if index < size or (at == len(self.sizes) - 1 and index >= size):
                return at, min(index, size)
            index -= size
        return 0, 0

    def _insert(self, at: int, i: int, line: tuple) -> None:
        if not self.order:
            self.order.append(self.made)
            self.sizes.append(0)
            self._blocks[self.made] = []
            self.made += 1
        number = self.order[at]
        block = self._block(number)
        block.insert(i, line)
        self._put_places(line[0], [*self._places(line[0]), number])
        if len(block) > 2 * BLOCK:
            rest, new = block[BLOCK:], self.made
            del block[BLOCK:]
            self.made += 1
            self.order.insert(at + 1, new)
            self.sizes.insert(at + 1, len(rest))
            self._put(new, rest)
            for line_id, _, _ in rest:
                places = list(self._places(line_id))
                places[places.index(number)] = new
                self._put_places(line_id, places)
        self.sizes[at] = len(block)
        self._put(number, block)

    def _remove(self, at: int, i: int) -> tuple:
        number = self.order[at]
        block = self._block(number)
        line = block.pop(i)
        places = list(self._places(line[0]))
        places.remove(number)
        self._put_places(line[0], places)
        self.sizes[at] = len(block)
        self._put(number, block)
        if not block:
            del self.order[at], self.sizes[at]
        return line

    def apply(self, op: str, seq: int, line_id: str | None, text: str | None, after: str | None, to_index: int | None) -> None:
        if op == "base":
            self._insert(max(0, len(self.order) - 1), self.sizes[-1] if self.sizes else 0, (line_id, text, bool(to_index)))
            return
        if op not in ("update", "delete", "add", "move"):
            return
        self.last_edit = seq
        if op == "add":
            found = self._find(after)
            at, i = (found[0], found[1] + 1) if found else self._at(sum(self.sizes))
            self._insert(at, i, (line_id, "", True))
            return
        found = self._find(line_id)
        if found is None:
            return
        if op == "update":
            block = self._block(self.order[found[0]])
            block[found[1]] = (line_id, text, True)
            self._put(self.order[found[0]], block)
            return
        line = self._remove(*found)
        if op == "move":
            self._insert(*self._at(int(to_index or 0)), line)


LOG_COLUMNS = ["seq", "op", "line_id", "text", "after_line_id", "to_index"]
REPLAYED = "book_id string, page_id long, line_no int, line_id string, text string, edited boolean, last_edit long"
ROWS = 20_000


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by page and sequence; only the lines of the current page are held."""
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.int64()]
    names = [part.split()[0] for part in REPLAYED.split(", ")]
    current, page, out = None, PageLines(), []

    def leave() -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * len(names)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    def finished() -> Iterator[tuple]:
        if page.order:
            yield from ((*current, i, *line, page.last_edit) for i, line in enumerate(page.lines()))
        elif page.last_edit is not None:
            yield (*current, None, None, None, None, page.last_edit)

    for batch in batches:
        for book, number, seq, op, line_id, text, after, to_index in zip(*[c.to_pylist() for c in batch.columns]):
            if (book, number) != current:
                if current is not None:
                    for row in finished():
                        out.append(row)
                        if len(out) >= ROWS:
                            yield leave()
                current, page = (book, number), PageLines()
            page.apply(op, seq, line_id, text, after, to_index)
    if current is not None:
        for row in finished():
            out.append(row)
            if len(out) >= ROWS:
                yield leave()
    yield leave()


def replay_line_edits(lines: DataFrame, log: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """Applies an ordered edit log (seq, op, line_id, text, after_line_id, to_index) to the lines of each page.

    Before the shuffle, an update that a later update of the same line replaces is dropped; the result is the same,
    and a page that was retyped very often shrinks to its lines. The rest is streamed page by page in sequence order
    through tasks that hold one page's lines, never its log, and spend about the square root of the lines on an edit. ``results`` (book_id, page_id) names recognised pages, so
    that edits of one without lines count; edits of pages with neither have no effect. A page left without lines by
    its edits is one row with ``last_edit`` and nulls for the line.
    """
    latest = (
        log.where(F.col("op") == "update")
        .groupBy(*PAGE, "line_id")
        .agg(F.max_by(F.struct(*[c for c in LOG_COLUMNS if c != "line_id"]), "seq").alias("_u"))
        .select(*PAGE, "line_id", "_u.*")
        .select(*PAGE, *LOG_COLUMNS)
    )
    others = log.where(F.col("op").isin("add", "delete", "move")).select(*PAGE, *LOG_COLUMNS)
    known = lines.select(*PAGE)
    if results is not None:
        known = known.unionByName(results.select(*PAGE))
    edits = latest.unionByName(others).join(known.distinct(), PAGE, "left_semi")
    base = lines.select(
        *PAGE,
        (F.col("line_no").cast("long") - F.lit(2**40)).alias("seq"),
        F.lit("base").alias("op"),
        "line_id",
        "text",
        F.lit(None).cast("string").alias("after_line_id"),
        F.col("edited").cast("int").alias("to_index"),
    )
    rows = spread(base.unionByName(edits), *PAGE).sortWithinPartitions(*PAGE, "seq")
    return rows.select(*PAGE, *LOG_COLUMNS).mapInArrow(_replay, REPLAYED)
