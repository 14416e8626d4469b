"""One text file per book, by a data source writer with a commit of its own.

Rows arrive sorted by book and page and are written as they come, so a task holds one row of a book, whatever its size.
A task writes below a folder of its attempt; when all tasks have ended, the driver gives the files their names, and when
the job fails it removes the folder. A repeated or failed task therefore leaves nothing under a book's name.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from foliospark.functions.text import text_file_name

#: between the texts of two pages
PAGE_BREAK = "\n\n"


@dataclass
class Written(WriterCommitMessage):
    """Files of one task: where they lie and what they are to be called."""

    files: list[tuple[str, str]]


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class BookWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path.rstrip("/")
        self.pending = f"_pending-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Written:
        store, root = _store(self.path)
        folder = f"{root}/{self.pending}/{uuid.uuid4().hex}"
        files: list[tuple[str, str]] = []
        current, out, empty = None, None, True
        try:
            for row in iterator:
                if (row.book_id,) != current:
                    if out is not None:
                        out.close()
                    current, empty = (row.book_id,), True
                    # book folders begin with a letter, so they cannot meet the pending one
                    part = f"{folder}/{len(files)}"
                    files.append((part, f"{root}/book-{quote(row.book_id or '', safe='')}/{row.file_name}"))
                    store.create_dir(folder, recursive=True)
                    out = store.open_output_stream(part)
                if row.text:
                    out.write((row.text if empty else PAGE_BREAK + row.text).encode())
                    empty = False
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _store(self.path)
        for message in messages:
            for part, name in message.files if message else []:
                store.create_dir(name.rsplit("/", 1)[0], recursive=True)
                store.move(part, name)
        self._clear(store, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_store(self.path))

    def _clear(self, store, root: str) -> None:
        from pyarrow import fs

        if store.get_file_info(f"{root}/{self.pending}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/{self.pending}")


class BookFiles(DataSource):
    """``format("book_files")``: rows (book_id, file_name, text), sorted by book within a partition."""

    @classmethod
    def name(cls) -> str:
        return "book_files"

    def writer(self, schema: StructType, overwrite: bool) -> BookWriter:
        return BookWriter(self.options["path"])


def write_book_files(texts: DataFrame, books: DataFrame, path: str) -> None:
    """Writes ``path/book-<id>/<title>.txt`` for every book of ``texts`` (book_id, ord, text) that ``books`` has.

    A file is the book's page texts in order, joined by a blank line; pages whose text is null or empty add nothing, and
    a book of such pages is an empty file. Existing files of these books are replaced, others stay.
    """
    texts.sparkSession.dataSource.register(BookFiles)
    named = texts.select("book_id", "ord", "text").join(books.select("book_id", text_file_name("title").alias("file_name")), "book_id")
    (
        named.repartition("book_id")
        .sortWithinPartitions("book_id", "ord")
        .select("book_id", "file_name", "text")
        .write.format("book_files")
        .mode("append")
        .save(path)
    )
