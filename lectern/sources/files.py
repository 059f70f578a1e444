"""Files as tables: registration checks, hashes, parsers, artifacts."""

from __future__ import annotations

import contextlib
import glob
import hashlib
import html
import os
import re
import shutil
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import BinaryIO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Accepted formats with their leading bytes.
MAGIC = {"pdf": b"%PDF", "epub": b"PK\x03\x04"}
CHAIN = ("marker", "pymupdf", "ocr")


class UnsupportedFormat(ValueError):
    """Neither the suffix nor the leading bytes are those of a book."""


class ParseFailure(RuntimeError):
    """No parser of the chain gave text."""


class ParserUnavailable(RuntimeError):
    """A parser's library or program is not there."""


def binary(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(path, modificationTime, length, content)``; files beyond the session's limit are refused, not cut."""
    return spark.read.format("binaryFile").load(path)


def validated_format(path: Path) -> str:
    """``pdf`` or ``epub`` of one file whose suffix and leading bytes agree; raises with the reason where they don't."""
    fmt = path.suffix.lower().lstrip(".")
    if not path.is_file():
        raise UnsupportedFormat(f"no file {path}")
    if fmt not in MAGIC:
        raise UnsupportedFormat(f"{path.name} is neither a .pdf nor an .epub")
    with path.open("rb") as stream:
        if not stream.read(8).startswith(MAGIC[fmt]):
            raise UnsupportedFormat(f"{path.name} does not begin like a {fmt.upper()} file")
    return fmt


def hash_stream(stream: BinaryIO) -> str:
    """SHA-256 of a stream read in pieces; the stream is left at its beginning."""
    digest = hashlib.sha256()
    for piece in iter(lambda: stream.read(1 << 20), b""):
        digest.update(piece)
    stream.seek(0)
    return digest.hexdigest()


class Originals:
    """The files of registered books under a storage root; stored paths are relative to it, so the root may move."""

    def __init__(self, root: str | Path):
        self.root = Path(root)

    def keep(self, book_id: str, filename: str, stream: BinaryIO) -> tuple[str, str]:
        """Copy a file and return its stored path and MD5; a copy that fails leaves nothing behind."""
        stored = Path("books") / book_id / Path(filename).name
        target, md5 = self.root / stored, hashlib.md5(usedforsecurity=False)
        target.parent.mkdir(parents=True, exist_ok=True)
        try:
            with target.open("wb") as out:
                for piece in iter(lambda: stream.read(1 << 20), b""):
                    md5.update(piece)
                    out.write(piece)
        except Exception:
            self.discard(book_id)
            raise
        return str(stored), md5.hexdigest()

    def discard(self, book_id: str) -> None:
        """Remove what was kept for a book whose registration failed."""
        shutil.rmtree(self.root / "books" / book_id, ignore_errors=True)

    def content(self, spark: SparkSession, books: DataFrame) -> DataFrame:
        """``(book_id, file_format, content)`` of registered books; a book whose file is gone has null content."""
        wanted = books.select("book_id", "file_format", storage_path(str(self.root), F.col("storage_path")).alias("at"))
        there = self.root / "books"
        if not there.is_dir():
            return wanted.select("book_id", "file_format", F.lit(None).cast("binary").alias("content"))
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(there))
        # Paths come back percent-encoded, with a scheme.
        path = F.url_decode(F.regexp_replace(F.regexp_replace(F.col("path"), r"\+", "%2B"), "^[a-z]+:/*(?=/)", ""))
        return wanted.join(found.select(path.alias("at"), "content"), "at", "left").select("book_id", "file_format", "content")


def file_format(path: Column, content: Column) -> Column:
    """``pdf`` or ``epub`` where suffix and leading bytes agree, else null."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))
    out = F.lit(None).cast("string")
    for name, magic in MAGIC.items():
        out = F.when((suffix == name) & (F.substring(content, 1, len(magic)) == F.lit(bytearray(magic))), name).otherwise(out)
    return out


def fingerprinted(files: DataFrame) -> DataFrame:
    """Accepted files with format, SHA-256 and MD5; the content itself is dropped."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return files.select(
        "path", name.alias("original_filename"), file_format(F.col("path"), F.col("content")).alias("file_format"), F.sha2("content", 256).alias("file_hash"), F.md5("content").alias("checksum"), "length"
    ).where("file_format is not null")


def storage_path(root: str, stored: Column) -> Column:
    """A stored path under the root; an absolute one stays."""
    return F.when(stored.startswith("/"), stored).otherwise(F.concat_ws("/", F.lit(root.rstrip("/")), stored))


Parser = Callable[[bytes], str]
_PARSERS: dict[str, tuple[frozenset[str], Callable[[], Parser]]] = {}


def register_parser(name: str, formats: set[str], make: Callable[[], Parser]) -> None:
    """Plug in a parser; ``make`` runs once per worker and may raise ImportError where its library is missing."""
    _PARSERS[name] = (frozenset(formats), make)


def _pymupdf() -> Parser:
    import pymupdf  # noqa: PLC0415 - optional
    import pymupdf4llm  # noqa: PLC0415

    return lambda content: pymupdf4llm.to_markdown(pymupdf.open(stream=content))


def _plain() -> Parser:
    """Text and HTML without any library."""

    def parse(content: bytes) -> str:
        text = content.decode("utf-8", errors="replace")
        text = re.sub(r"(?is)<(script|style)\b.*?</\1>", "", text)
        text = re.sub(r"(?i)<h([1-6])\b[^>]*>", lambda m: "\n" + "#" * int(m[1]) + " ", text)
        return html.unescape(re.sub(r"<[^>]+>", "", re.sub(r"(?i)<(br|/p|/h[1-6]|/li)\b[^>]*>", "\n", text))).strip()

    return parse


@contextlib.contextmanager
def _on_disk(content: bytes, suffix: str) -> Iterator[str]:
    """The content as a file of the worker, for parsers that open paths; it goes when the document is read."""
    with tempfile.NamedTemporaryFile(suffix=suffix) as file:
        file.write(content)
        file.flush()
        yield file.name


def _marker() -> Parser:
    """The converter is loaded once for each worker."""
    from marker.converters.pdf import PdfConverter  # noqa: PLC0415 - optional
    from marker.models import create_model_dict  # noqa: PLC0415
    from marker.output import text_from_rendered  # noqa: PLC0415

    converter = PdfConverter(artifact_dict=create_model_dict())

    def parse(content: bytes) -> str:
        with _on_disk(content, ".pdf") as path:
            return str(text_from_rendered(converter(path))[0])

    return parse


# Where language data of the recognition program usually lies.
TESSDATA = ("/opt/homebrew/share/tessdata", "/usr/local/share/tessdata", "/usr/share/tessdata", "/usr/share/tesseract-ocr/*/tessdata")


def find_tessdata() -> str | None:
    """The folder that ``TESSDATA_PREFIX`` names, or the first usual one that exists."""
    named = os.environ.get("TESSDATA_PREFIX")
    found = ([named] if named else []) + [m for pattern in TESSDATA for m in sorted(glob.glob(pattern))]
    return next((f for f in found if os.path.isdir(f)), None)


def _ocr() -> Parser:
    if shutil.which("tesseract") is None:
        raise ParserUnavailable("there is no tesseract program")
    data = find_tessdata()
    if data is None:
        raise ParserUnavailable("no language data; set TESSDATA_PREFIX")
    import pymupdf  # noqa: PLC0415 - optional

    def parse(content: bytes) -> str:
        with pymupdf.open(stream=content, filetype="pdf") as document:
            texts = [page.get_text(textpage=page.get_textpage_ocr(full=True, dpi=300, tessdata=data)).strip() for page in document]
        return "\n\n".join(f"## Page {n}\n\n{t}" for n, t in enumerate(texts, 1) if t)

    return parse


register_parser("marker", {"pdf"}, _marker)
register_parser("ocr", {"pdf"}, _ocr)
register_parser("pymupdf", {"pdf", "epub"}, _pymupdf)
register_parser("plain", {"txt", "html", "md"}, _plain)


def parsed(files: DataFrame, key: str, chain: tuple[str, ...] = (*CHAIN, "plain")) -> DataFrame:
    """``(key, markdown, parser, attempts)``: the first parser of the chain whose output holds a letter or digit.

    ``files`` has key, file_format, content.  Parsers that are not registered or installed, do not take the format, fail
    or give nothing are noted in ``attempts``, the one that succeeds too; where none succeeds markdown is null.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: dict[str, Parser | str] = {}
        for pdf in batches:
            rows = []
            for k, fmt, content in zip(pdf[key], pdf["file_format"], pdf["content"], strict=True):
                attempts, text, used = [], None, None
                for name in chain:
                    formats, make = _PARSERS.get(name, (frozenset(), None))
                    if make is None or fmt not in formats:
                        attempts.append(f"{name}: not registered" if make is None else f"{name}: skipped, takes no {fmt}")
                        continue
                    if content is None:
                        attempts.append(f"{name}: the file is missing")
                        continue
                    if name not in made:
                        try:
                            made[name] = make()
                        except (ImportError, ParserUnavailable) as error:
                            made[name] = f"{name}: unavailable, {error}"
                    if isinstance(made[name], str):
                        attempts.append(made[name])
                        continue
                    try:
                        out = made[name](bytes(content))
                    except Exception as error:  # noqa: BLE001 - the next parser may do better
                        attempts.append(f"{name}: {type(error).__name__}: {error}")
                        continue
                    if any(c.isalnum() for c in out):
                        text, used = out, name
                        attempts.append(f"{name}: succeeded")
                        break
                    attempts.append(f"{name}: no text")
                rows.append((k, text, used, attempts))
            yield pd.DataFrame(rows, columns=[key, "markdown", "parser", "attempts"])

    return files.select(key, "file_format", "content").mapInPandas(run, f"{key} string, markdown string, parser string, attempts array<string>")


def artifacts(pages: DataFrame) -> DataFrame:
    """``(artifact_id, pages, chars_per_page, norm, front)`` out of ``(artifact_id, page_no, text)``."""
    from lectern.functions.text import normalise_source

    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda x: x["text"]), "\n")
    rows = pages.groupBy("artifact_id").agg(F.count("*").alias("pages"), whole.alias("text"), F.sum(F.length("text")).alias("chars"))
    return rows.select("artifact_id", "pages", F.floor(F.col("chars") / F.col("pages")).cast("int").alias("chars_per_page"), normalise_source(F.col("text")).alias("norm"), F.substring("text", 1, 25_000).alias("front"))
