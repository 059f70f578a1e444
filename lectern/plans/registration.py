"""Registering books and changing what is known about them, in the versioned store."""

from __future__ import annotations

import datetime as dt
import time
import uuid
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import reads
from lectern.sources.files import Originals, hash_stream, validated_format
from lectern.sources.store import Store

HINTS = "edition string, publication_year int, isbn string, primary_topic string, language string, framework string, methodology string, notes string, trust_level string, intended_use string"
BOOKS = (
    f"book_id string, title string, author string, {HINTS}, original_filename string, file_format string, storage_path string, checksum string, file_hash string, uploaded_at timestamp"
)
_HINTS = tuple(c.split()[0] for c in HINTS.split(", "))


class DuplicateBook(ValueError):
    """The same bytes are registered already."""

    def __init__(self, book_id: str):
        super().__init__(f"this file is registered as book {book_id}")
        self.book_id = book_id


def books(store: Store) -> DataFrame:
    """Every registered book as it is now."""
    return store.records("books", BOOKS, "book_id")


def register_book(store: Store, path: Path, title: str, author: str, **hints: object) -> str:
    """Check, fingerprint and keep a file and add its book; returns the new id.

    A file whose bytes are registered is refused with the id it has.  If the book can't be added, the kept file goes.
    """
    unknown = sorted(set(hints) - set(_HINTS))
    if unknown:
        raise ValueError(f"no such fields: {', '.join(unknown)}")
    if not title.strip() or not author.strip():
        raise ValueError("a book needs a title and an author")
    fmt = validated_format(path)
    with path.open("rb") as stream:
        file_hash = hash_stream(stream)
        known = books(store).where(F.col("file_hash") == file_hash).select("book_id").first()
        if known:
            raise DuplicateBook(known[0])
        book_id, originals = str(uuid.uuid4()), Originals(store.root)
        stored, checksum = originals.keep(book_id, path.name, stream)
    row = {c.split()[0]: None for c in BOOKS.split(", ")} | {k: v for k, v in hints.items() if v not in (None, "")}
    row |= {
        "book_id": book_id, "title": title, "author": author, "original_filename": Path(stored).name, "file_format": fmt, "storage_path": stored, "checksum": checksum, "file_hash": file_hash,
        "uploaded_at": dt.datetime.now(dt.UTC).replace(tzinfo=None),
    }
    try:
        if row["publication_year"] is not None:
            row["publication_year"] = int(str(row["publication_year"]))
        store.put("books", store.spark.createDataFrame([row], BOOKS), time.time_ns())
    except Exception:
        originals.discard(book_id)
        raise
    return book_id


def update_book(store: Store, book_id: str, **fields: object) -> None:
    """Write a book's changed record under the rules of ``reads.update_metadata``; other books are not touched."""
    row = reads.by_id(books(store), "book_id", book_id)
    store.put("books", reads.update_metadata(row, book_id, **fields), time.time_ns())
