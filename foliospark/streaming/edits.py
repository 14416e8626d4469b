"""Line edits as a stateful stream: keyed state per group of pages, edits applied in sequence order."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from foliospark.operators.edits import LOG_COLUMNS, PAGE, PageLines

PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
# State is nearly all text, of which every store holds two copies: its own files and those of the checkpoint.
SMALLER_STATE = ("spark.sql.streaming.stateStore.rocksdb.compression", "zstd")
OUTPUT = (
    "book_id string, page_id long, kind string, version long, line_no int, line_id string, text string, edited boolean,"
    " last_edit long, late_seq long"
)
NAMES = [part.split()[0] for part in OUTPUT.split(", ")]
ROWS = 10_000


INDEX = 64


def _part(line_id: str | None) -> int:
    """Part of a page's index in which an id stands; the same in every process."""
    return zlib.crc32(b"" if line_id is None else line_id.encode()) % INDEX


class _StoredPage(PageLines):
    """Page lines whose blocks and index lie in map states; a call reads the blocks it touches and writes back changed ones.

    A page of one block is held by its group and needs no index. That of a larger one is stored in ``INDEX`` parts by a
    hash of the ids, as each call to the store takes longer than the work on a line.
    """

    def __init__(self, key: tuple, blocks, index) -> None:
        super().__init__()
        self.key, self.block_state, self.index_state = key, blocks, index
        self.changed: set[int] = set()
        self.parts: set[int] = set()
        self.read: set[int] = set()
        self.indexed = False  # whether the store holds an index
        self.known = 0  # numbers below were blocks in the store

    def _block(self, number: int) -> list[tuple]:
        if number not in self._blocks:
            ids, texts, edited = self.block_state.getValue((*self.key, number))
            self._blocks[number] = list(zip(ids, texts, edited))
        return self._blocks[number]

    def _put(self, number: int, lines: list[tuple]) -> None:
        self._blocks[number] = lines
        self.changed.add(number)

    def open(self) -> None:
        """Makes the index of a page that is stored without one, before its lines change."""
        if not self.indexed:
            self.read.update(range(INDEX))
            for number in self.order:
                for line_id, _, _ in self._block(number):
                    self._where.setdefault(line_id, []).append(number)

    def _read(self, part: int) -> None:
        if part in self.read:
            return
        self.read.add(part)
        key = (*self.key, part)
        if self.index_state.containsKey(key):
            for line_id, numbers in zip(*self.index_state.getValue(key)):
                self._where[line_id] = list(numbers)

    def _places(self, line_id: str | None) -> list[int]:
        self._read(_part(line_id))
        return self._where.get(line_id, [])

    def _put_places(self, line_id: str | None, places: list[int]) -> None:
        self._read(_part(line_id))
        self._where[line_id] = places
        self.parts.add(_part(line_id))

    def save(self) -> None:
        if not self.indexed:
            if len(self.order) <= 1:
                return
            self.changed = set(self.order)
        for number in self.changed:
            lines = self._blocks[number]
            if lines:
                self.block_state.updateValue((*self.key, number), tuple(list(c) for c in zip(*lines)))
            elif number < self.known:
                self.block_state.removeKey((*self.key, number))
        parts = self.parts if self.indexed else set(range(INDEX))
        held: dict[int, list[tuple]] = {part: [] for part in parts}
        for line_id, numbers in self._where.items():
            if numbers and (part := _part(line_id)) in held:
                held[part].append((line_id, numbers))
        for part, rows in held.items():
            if rows:
                self.index_state.updateValue((*self.key, part), tuple(list(c) for c in zip(*rows)))
            elif self.indexed and self.index_state.containsKey((*self.key, part)):
                self.index_state.removeKey((*self.key, part))
        self.indexed = True

    def clear(self) -> None:
        """Removes a page of many blocks from the store."""
        if self.indexed:
            for number in self.order:
                self.block_state.removeKey((*self.key, number))
            for part in range(INDEX):
                if self.index_state.containsKey((*self.key, part)):
                    self.index_state.removeKey((*self.key, part))


class LineEditor(StatefulProcessor):
    """Keeps the lines of the pages of a group and hands out their versions, late edits and edits of unknown pages.

    The heads of a group's pages, and the lines of those of one block, are read and written as one list, as each call to the
    store and each frame has a cost of its own.
    """

    def __init__(self, quiet_ms: int | None):
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        page = "book_id string, page_id long"
        self.blocks = handle.getMapState("blocks", f"{page}, number int", "ids array<string>, texts array<string>, edited array<boolean>")
        self.index = handle.getMapState("where", f"{page}, part int", "ids array<string>, blocks array<array<int>>")
        head = "made int, last_seq long, last_edit long, numbers array<int>, sizes array<int>, indexed boolean, due long"
        self.pages = handle.getListState("pages", f"{page}, {head}, ids array<string>, texts array<string>, edited array<boolean>")
        self.due = handle.getMapState("due", "due long", "books array<string>, pages array<long>")

    def _heads(self) -> dict[tuple, tuple]:
        return {(row[0], row[1]): tuple(row[2:]) for row in self.pages.get()} if self.pages.exists() else {}

    def _put_heads(self, heads: dict[tuple, tuple]) -> None:
        if heads:
            self.pages.put([(*key, *head) for key, head in heads.items()])
        elif self.pages.exists():
            self.pages.clear()

    def _load(self, key: tuple, head: tuple | None) -> tuple[_StoredPage, int | None, int | None]:
        """A page, the number of its last edit and the time at which it is closed."""
        page, last, due = _StoredPage(key, self.blocks, self.index), None, None
        if head is not None:
            page.made, last, page.last_edit, numbers, sizes, page.indexed, due, *lines = head
            page.order, page.sizes, page.known = list(numbers), list(sizes), page.made
            if not page.indexed and page.order:
                page._blocks[page.order[0]] = list(zip(*lines))
        page.open()
        return page, last, due

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # the edits of one page in one micro-batch are sorted together
        edits = pd.concat(list(rows), ignore_index=True)[[*PAGE, *LOG_COLUMNS]]
        edits = edits.astype(object).where(edits.notna(), None).sort_values("seq", kind="stable")
        pages: dict[tuple, list[tuple]] = {}
        for book, number, *edit in edits.itertuples(index=False, name=None):
            pages.setdefault((book, None if number is None else int(number)), []).append(edit)
        due = None if self.quiet_ms is None else timerValues.getCurrentProcessingTimeInMs() + self.quiet_ms
        heads = self._heads()
        yield from _frames(row for page, log in pages.items() for row in self._edit(page, log, due, heads))
        self._put_heads(heads)
        if due is not None:
            books, numbers = self.due.getValue((due,)) if self.due.containsKey((due,)) else ([], [])
            self.due.updateValue((due,), ([*books, *[p[0] for p in pages]], [*numbers, *[p[1] for p in pages]]))
            self.handle.registerTimer(due)

    def _edit(self, key: tuple, log: list[tuple], due: int | None, heads: dict[tuple, tuple]) -> Iterator[tuple]:
        page, last, _ = self._load(key, heads.get(key))
        known, late, changed = last is not None, [], False
        for seq, op, line_id, text, after, to_index in log:
            known = known or op in ("page", "base")
            if not known:
                late.append(("unknown", int(seq)))
            elif last is not None and seq <= last:
                late.append(("late", int(seq)))
            else:
                page.apply(op, int(seq), line_id, text, after, None if to_index is None else int(to_index))
                last, changed = int(seq), True
        if changed:
            page.save()
            lines = ([], [], []) if page.indexed else tuple([line[i] for line in page.lines()] for i in range(3))
            heads[key] = (page.made, last, page.last_edit, list(page.order), list(page.sizes), page.indexed, due, *lines)
            yield from ((*key, *row) for row in _version(page, last, "line"))
        for kind, seq in late:
            yield (*key, kind, None, None, None, None, None, None, seq)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Pages that were quiet leave once more, as closed, and their state goes."""
        time = expiredTimerInfo.getExpiryTimeInMs()
        pages = list(zip(*self.due.getValue((time,)))) if self.due.containsKey((time,)) else []
        heads = self._heads()
        yield from _frames(row for page in pages for row in self._close((page[0], page[1]), time, heads))
        if pages:
            self._put_heads(heads)
            self.due.removeKey((time,))

    def _close(self, key: tuple, time: int, heads: dict[tuple, tuple]) -> Iterator[tuple]:
        page, last, due = self._load(key, heads.get(key))
        if due == time:  # else it was edited since
            yield from ((*key, *row) for row in _version(page, last, "closed"))
            page.clear()
            del heads[key]

    def close(self) -> None:
        pass


def _version(page: PageLines, last: int, kind: str) -> Iterator[tuple]:
    if not page.order:
        yield kind, last, None, None, None, None, page.last_edit, None
    for i, line in enumerate(page.lines()):
        yield kind, last, i, *line, page.last_edit, None


def _frames(found: Iterator[tuple]) -> Iterator[pd.DataFrame]:
    rows = []

    def frame() -> pd.DataFrame:
        made = pd.DataFrame(rows, columns=NAMES)
        made = made.astype({"page_id": "Int64", "line_no": "Int32", "edited": "boolean", "last_edit": "Int64", "late_seq": "Int64", "version": "Int64"})
        rows.clear()
        return made

    for row in found:
        rows.append(row)
        if len(rows) >= ROWS:
            yield frame()
    yield frame()


def stateful_line_edits(events: DataFrame, quiet_ms: int | None = None, groups: int = 4096) -> DataFrame:
    """Pages after each micro-batch, late edits, and edits of unknown pages.

    ``events`` (book_id, page_id, seq, op, line_id, text, after_line_id, to_index); rows with op = base bring the first
    lines, and one with op = page says that a page was recognised, with lines or without. Kinds of rows: ``line`` is a
    line of a page's version (or its emptiness, without a number), the highest version being current; ``late`` and
    ``unknown`` carry the number of an edit that had no effect, for a side table. State holds a
    list of the small pages of a group, which a micro-batch reads and writes as a whole, and blocks of lines and an index of
    ids for larger pages, of which it reads and writes what it changes; give more groups where pages are very many. With ``quiet_ms`` a
    page without edits for so long leaves as ``closed`` and is forgotten; without, pages are remembered for good. The
    state store must be RocksDB (``PROVIDER``); ``SMALLER_STATE`` takes less disk for it. Pages come in ``groups`` by a hash, whose number belongs to a checkpoint;
    the edits of one group in a micro-batch are sorted together, so limit the trigger size for very busy pages.
    """
    grouped = events.withColumn("_group", F.pmod(F.xxhash64(*PAGE), F.lit(groups)))
    return grouped.groupBy("_group").transformWithStateInPandas(
        LineEditor(quiet_ms), OUTPUT, "Update", "None" if quiet_ms is None else "ProcessingTime"
    )


def current_pages(versions: DataFrame) -> DataFrame:
    """The newest version of each page from the written output, as ``replay_line_edits`` gives it.

    Pages are looked up first, by their numbers only. Where none has an older version or repeats one, as after a single
    micro-batch, no line moves; else lines are shuffled once.
    """
    lines = versions.where("kind in ('line', 'closed')")
    counts = F.count(F.lit(1)), F.coalesce(F.max("line_no") + 1, F.lit(1))
    pages = lines.groupBy(*PAGE).agg(F.min("version").alias("_old"), F.max("version").alias("_new"), *[c.alias(n) for c, n in zip(counts, ("_n", "_lines"))])
    if not pages.where("_old < _new or _n > _lines").isEmpty():
        newest = F.max("version").over(Window.partitionBy(*PAGE))
        # a closed page repeats its last version
        lines = lines.withColumn("_new", newest).where("version = _new").dropDuplicates([*PAGE, "line_no"])
    rows = lines.select(*PAGE, "line_no", "line_id", "text", "edited", "last_edit")
    return rows.where("line_no is not null or last_edit is not null")
