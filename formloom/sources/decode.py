"""Decoding files to page text: the only stage, with remote extraction, that runs Python on rows.

A backend opens documents, renders pages and recognises text. Backends for installed libraries are loaded in the
Python worker on first use; tests pass their own. Probing and reading the text layer are one pass next to the scan.
Pages of scanned documents are dealt out over the cluster by ranges of pages: only paths travel, a worker reads the file of a
range and opens it once. Neither contents nor page images go through an exchange, and a page is recognised once.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formloom.operators import pages as page_ops
from formloom.session import written
from formloom.sources.files import store_of

# Defaults, and what stands in for the text of a page or image that can't be read.
DPI = 150
POINTS_PER_INCH = 72
LANGUAGES = "vie+eng"
ENGINE = "rapidocr"
PAGE_SEGMENTATION = "--psm 3"
NO_ENGINE = "Không tìm thấy Tesseract OCR. Vui lòng cài đặt Tesseract OCR và cấu hình đúng đường dẫn"
PAGE_ERROR = "[Lỗi Trang {page}]: {error}"
IMAGE_ERROR = "[Lỗi OCR File Ảnh]: {error}"
# End of fixed values.

PAGES = "path string, page_num int, text string, status string, error string"
COUNTS = "path string, pages int, digital_pages int, status string, error string"
LAYERS = "path string, pages int, digital_pages int, status string, error string, texts array<string>"


class EngineMissing(RuntimeError):
    """The recognition program isn't installed."""


class Document(Protocol):
    def __len__(self) -> int: ...
    def text(self, page: int) -> str: ...
    def image(self, page: int, zoom: float) -> Any: ...
    def close(self) -> None: ...


class Backend(Protocol):
    """Opens PDFs and images from bytes and recognises text. ``lines`` and ``text`` are the two kinds of engine."""

    def open(self, content: bytes) -> Document: ...
    def open_image(self, content: bytes) -> Any: ...
    def lines(self, image: Any) -> list[str]: ...
    def text(self, image: Any, languages: str, command: str) -> str: ...


class LibraryBackend:
    """PyMuPDF, Pillow, RapidOCR and pytesseract, each imported when first needed and kept for the worker's life."""

    def __init__(self):
        self._engine = None

    def open(self, content: bytes) -> Document:
        fitz = importlib.import_module("fitz")
        doc = fitz.open(stream=content, filetype="pdf")
        image = importlib.import_module("PIL.Image")

        class Pdf:
            def __len__(self):
                return len(doc)

            def text(self, page):
                return doc[page].get_text()

            def image(self, page, zoom):
                raster = doc[page].get_pixmap(matrix=fitz.Matrix(zoom, zoom), alpha=False)
                return image.frombytes("RGB", [raster.width, raster.height], raster.samples)

            def close(self):
                doc.close()

        return Pdf()

    def open_image(self, content: bytes) -> Any:
        import io

        return importlib.import_module("PIL.Image").open(io.BytesIO(content))

    def lines(self, image: Any) -> list[str]:
        import numpy as np

        if self._engine is None:
            self._engine = importlib.import_module("rapidocr_onnxruntime").RapidOCR()
        found, _ = self._engine(np.array(image))
        return [x[1] for x in found or []]

    def text(self, image: Any, languages: str, command: str) -> str:
        tesseract = importlib.import_module("pytesseract")
        if command and command != "tesseract":
            tesseract.pytesseract.tesseract_cmd = command
        try:
            return tesseract.image_to_string(image.convert("L"), lang=languages, config=PAGE_SEGMENTATION)
        except tesseract.TesseractNotFoundError as error:
            raise EngineMissing(str(error)) from error


class TextPages:
    """Text files whose pages are parted by form feeds, as converters of documents write them. Undecodable bytes are an error."""

    def open(self, content: bytes) -> Document:
        # a form feed after the last page ends it
        pages = content.decode().removesuffix("\f").split("\f")

        class Text:
            def __len__(self):
                return len(pages)

            def text(self, page):
                return pages[page]

            def image(self, page, zoom):
                raise ValueError("a text has no images")

            def close(self):
                pass

        return Text()

    def open_image(self, content: bytes) -> Any:
        raise ValueError("a text is no image")

    def lines(self, image: Any) -> list[str]:
        raise ValueError("a text has no images")

    def text(self, image: Any, languages: str, command: str) -> str:
        raise ValueError("a text has no images")


_KEPT: dict[Callable, Backend] = {}


def backend_of(make: Callable[[], Backend]) -> Backend:
    """One backend for each worker."""
    if make not in _KEPT:
        _KEPT[make] = make()
    return _KEPT[make]


def recognise(backend: Backend, image: Any, engine: str, languages: str, command: str) -> str:
    """The engine "rapidocr" gives lines and knows no languages; any other name means the one that gives text."""
    if engine == "rapidocr":
        return "\n".join(backend.lines(image)).strip()
    return backend.text(image, languages, command).strip()


def page_by_image(backend: Backend, doc: Document, page: int, engine: str, dpi: int, languages: str, command: str) -> tuple[str, str, str | None]:
    """Text, status and error of a page (from 0) that is rendered and recognised."""
    try:
        return recognise(backend, doc.image(page, dpi / POINTS_PER_INCH), engine, languages, command), "ok", None
    except EngineMissing as error:
        return NO_ENGINE, "error", str(error)
    except Exception as error:
        return PAGE_ERROR.format(page=page + 1, error=error), "error", str(error)


#: Rows that go back to Spark at once, if a batch of documents gives as many: a row at a time costs more than a small document.
ROWS_AT_ONCE = 500


def _mapped(df: DataFrame, f: Callable[[Any], Iterator[tuple]], schema: str, columns: list[str]) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for row in batch.itertuples(index=False):
                made.extend(f(row))
                if len(made) >= ROWS_AT_ONCE:
                    yield pd.DataFrame(made, columns=names)
                    made = []
            if made:
                yield pd.DataFrame(made, columns=names)

    return df.select(*columns).mapInPandas(run, schema)


def read_bytes(path: str) -> bytes:
    """A file's content, read in a worker: local files, and stores that pyarrow knows."""
    store, place = store_of(path)
    with store.open_input_file(place) as f:
        return f.read()


def text_layers(files: DataFrame, make: Callable[[], Backend] = LibraryBackend, least: int = page_ops.LEAST_CHARS) -> DataFrame:
    """Pages, pages with text, and the texts (not stripped) of each PDF, which is opened once.

    What can't be opened has no pages; where the text layer can't be read, no page counts as having text, so
    that its images are recognised, and the texts are those before the failure.
    """

    def layer(row):
        pages, texts = 0, []
        try:
            doc = backend_of(make).open(row.content)
            try:
                pages = len(doc)
                for page in range(pages):
                    texts.append(doc.text(page))
            finally:
                doc.close()
            yield row.path, pages, sum(len(x.strip()) > least for x in texts), "ok", None, texts
        except Exception as error:  # one bad file must not stop the others
            yield row.path, pages, 0, "error", str(error), texts

    return _mapped(files, layer, LAYERS, ["path", "content"])


def page_counts(files: DataFrame, make: Callable[[], Backend] = LibraryBackend, least: int = page_ops.LEAST_CHARS) -> DataFrame:
    """Pages and pages with text of each PDF."""
    return text_layers(files, make, least).drop("texts")


def text_layer(files: DataFrame, make: Callable[[], Backend] = LibraryBackend) -> DataFrame:
    """The text layer of each page, not stripped. If a page fails, those before it stay and it is a row with the error."""
    layers = text_layers(files, make)
    failed = F.when(F.col("status") == "error", F.array(F.lit(None).cast("string"))).otherwise(F.array().cast("array<string>"))
    rows = layers.select("path", F.posexplode(F.concat("texts", failed)).alias("i", "text"), "status", "error")
    bad = F.col("text").isNull()
    return rows.select("path", (F.col("i") + 1).alias("page_num"), "text", F.when(bad, "error").otherwise("ok").alias("status"), F.when(bad, F.col("error")).alias("error"))


def recognised_pages(counts: DataFrame, make: Callable[[], Backend] = LibraryBackend, dpi: int = DPI, languages: str = LANGUAGES, command: str = "tesseract", engine: str = ENGINE, at_once: int = 8, workers: int | None = None, partitions: int | None = None, read: Callable[[str], bytes] = read_bytes) -> DataFrame:
    """Renders and recognises each page of the documents ``counts`` (path, pages), in ranges that run apart.

    ``read`` gets a file's content from its path, in the worker.
    """
    n = partitions or int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    work = page_ops.page_ranges(counts, at_once, workers).repartition(n, "path", "first")

    def some(row):
        numbers = range(row.first, min(row.pages, row.first + row.n))
        try:
            backend = backend_of(make)
            doc = backend.open(read(row.path))
        except Exception as error:
            for page in numbers:
                yield row.path, page + 1, PAGE_ERROR.format(page=page + 1, error=error), "error", str(error)
            return
        try:
            for page in numbers:
                yield row.path, page + 1, *page_by_image(backend, doc, page, engine, dpi, languages, command)
        finally:
            doc.close()

    return _mapped(work, some, PAGES, ["path", "first", "pages", "n"])


def recognised_images(files: DataFrame, make: Callable[[], Backend] = LibraryBackend, languages: str = LANGUAGES, command: str = "tesseract", engine: str = ENGINE) -> DataFrame:
    """Recognises each image file: one page without a number."""

    def read(row):
        try:
            if row.content is None:
                raise FileNotFoundError(row.path)
            backend = backend_of(make)
            yield row.path, None, recognise(backend, backend.open_image(row.content), engine, languages, command), "ok", None
        except Exception as error:
            yield row.path, None, IMAGE_ERROR.format(error=error), "error", str(error)

    return _mapped(files, read, PAGES.replace("page_num int", "page_num double"), ["path", "content"]).withColumn("page_num", F.col("page_num").cast("int"))


def document_texts(files: DataFrame, make: Callable[[], Backend] = LibraryBackend, force_ocr: bool = False, dpi: int = DPI, languages: str = LANGUAGES, command: str = "tesseract", engine: str = ENGINE, compatible: bool = True, read: Callable[[str], bytes] = read_bytes) -> DataFrame:
    """(path, text, status, error) of every file of ``files`` (path, status, kind, content).

    PDFs are probed and go one way as whole documents; images are recognised. A missing PDF has an empty
    text. With ``compatible`` errors also stand in the text, where they were always; without it
    a page that failed is left out, and ``status`` and ``error`` tell.
    """
    pdf, images = files.where((F.col("status") == "ok") & (F.col("kind") == "pdf")), files.where(F.col("kind") == "image")
    layers = text_layers(pdf, make)
    # read twice, and probing opens every document; without texts, if nothing is taken from them
    layers = written(layers.drop("texts") if force_ocr else layers, "layers")
    probed = layers.withColumn("digital", page_ops.SHARE[1] * F.col("digital_pages") > page_ops.SHARE[0] * F.col("pages"))
    by_layer, by_image = page_ops.route(probed, force_ocr)
    pages = recognised_pages(by_image.select("path", "pages"), make, dpi, languages, command, engine, read=read)
    if not force_ocr:
        digital = by_layer.select("path", F.posexplode("texts").alias("i", "text"))
        pages = pages.unionByName(digital.select("path", (F.col("i") + 1).alias("page_num"), "text", F.lit("ok").alias("status"), F.lit(None).cast("string").alias("error")))
    ok = F.col("status") == "ok"
    texts = pages.groupBy("path").agg(
        page_ops.assembled(where=None if compatible else ok).alias("text"),
        F.max_by("status", ~ok).alias("status"),
        F.array_join(F.array_sort(F.collect_set("error")), "; ").alias("error"),
    )
    pdf_texts = files.where(F.col("kind") == "pdf").select("path", F.col("status").alias("found")).join(texts, "path", "left")
    pdf_texts = pdf_texts.select("path", F.coalesce("text", F.lit("")).alias("text"), F.when(F.col("found") == "missing", "missing").otherwise(F.coalesce("status", F.lit("empty"))).alias("status"), F.nullif("error", F.lit("")).alias("error"))
    image_texts = recognised_images(images, make, languages, command, engine)
    image_texts = image_texts.select("path", (F.col("text") if compatible else F.when(F.col("status") == "ok", F.col("text")).otherwise("")).alias("text"), "status", "error")
    return pdf_texts.unionByName(image_texts)


__all__ = ["Backend", "Document", "EngineMissing", "LibraryBackend", "TextPages", "backend_of", "document_texts", "page_by_image", "page_counts", "read_bytes", "recognise", "recognised_images", "recognised_pages", "text_layer", "text_layers"]
