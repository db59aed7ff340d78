"""The whole way from files to records: a library call, a command line and a small HTTP service."""

from __future__ import annotations

import argparse
import json
import logging
import os
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from email.parser import BytesParser
from email.policy import HTTP
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formloom import sinks
from formloom.metrics import Counts
from formloom.operators.rules import extract
from formloom.plans.catalog import FIELDS, flat_name
from formloom.session import importable, scratch, shared_dir, written
from formloom.sources import decode, files, remote

log = logging.getLogger("formloom")


@contextmanager
def timed(what: str) -> Iterator[dict]:
    """Logs how long something took, also if it fails; the seconds are in the mapping that it gives."""
    measured: dict = {}
    began = time.perf_counter()
    try:
        yield measured
    finally:
        measured["seconds"] = time.perf_counter() - began
        log.info("%s: %.4f s", what, measured["seconds"])


def records_of(documents: DataFrame, transport: remote.Transport | None = None, key: str | None = None, log: str | None = None) -> DataFrame:
    """Records of (path, text, status, error), with status and error; by rules, or remotely if a key and a transport are given.

    Documents without text have no record. What a remote service couldn't do has the defaults and its error. ``log``: where its
    replies are kept, see :func:`~formloom.sources.remote.extract_remote`.
    """
    has_text = documents.where(F.length("text") > 0)
    if transport is not None and remote.usable(key):
        return remote.extract_remote(has_text.select("path", "text"), transport, ["path"], log=log)
    flat = extract(has_text.select("path", "text", "status", "error"), "text")
    return flat.select("path", "status", "error", *(flat_name(f) for f in FIELDS))


def process(spark: SparkSession, paths: list[str] | DataFrame, output: str | None = None, make: Callable[[], decode.Backend] = decode.LibraryBackend, force_ocr: bool = False, dpi: int = decode.DPI, languages: str = decode.LANGUAGES, engine: str = decode.ENGINE, transport: remote.Transport | None = None, key: str | None = None, layout: str = "table", counts: dict[str, Counts] | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, records) of files and folders (a list, or a table of paths), which may be written too.

    ``counts``: a mapping that gets counts by state of "documents", and of "records" once these have been read; they cost no pass of their own.

    ``layout``: with "table" both are written as tables to ``output``, if it is given; with "files" every document with text
    has a text file and a JSON file, in ``output`` or else beside it.
    """
    importable(spark)
    found = files.collect_files(spark, paths)
    # read by both results: written, as a lost executor must not cost recognition again
    counts = {} if counts is None else counts
    counts |= {x: Counts(x) for x in ("documents", "records")}
    texts = decode.document_texts(found, make, force_ocr, dpi, languages, engine=engine)
    documents = written(counts["documents"].of(texts, text="text"), "documents")
    records = counts["records"].of(records_of(documents, transport, key))
    if layout == "files":
        sinks.write_files(sinks.document_files(documents, records, output))
    elif output:
        sinks.write_texts(sinks.named_outputs(documents, output), f"{output.rstrip('/')}/texts")
        sinks.write_records(records, f"{output.rstrip('/')}/records", ["path", "status", "error"])
    return documents, records


def process_one(spark: SparkSession, name: str, content: bytes, **options) -> dict:
    """The record of one file's content as nested mappings; raises if there is no text."""
    with scratch():
        path = f"{shared_dir(spark)}/upload{os.path.splitext(name)[1]}"  # where executors can read it
        store, place = files.store_of(path)
        with store.open_output_stream(place) as out:
            out.write(content)
        documents, records = process(spark, [path], **options)
        row = records.select(sinks.record_json().alias("json")).first()
    if row is None:
        raise ValueError("no text was found")
    return json.loads(row.json)


# The goal of the benchmark, and what a service answers to a failure.
GOAL_SECONDS, GOAL_PAGES = 3.0, 6
SERVICE_ERROR = "Lỗi xử lý OCR: {error}"
# End of fixed values.


def benchmark(spark: SparkSession, path: str, make: Callable[[], decode.Backend] = decode.LibraryBackend, engine: str = decode.ENGINE) -> tuple[DataFrame, bool]:
    """Recognises a PDF twice: (run, seconds, pages, per_page, six_pages) of the cold and the warm run, and whether the warm one meets the goal.

    The goal is three seconds, for the document or, at its speed, for six pages; a document without pages doesn't meet it.
    """
    importable(spark)
    found = files.collect_files(spark, [path])
    runs = []
    for run in ("cold", "warm"):
        with timed(f"{run} run") as measured:
            counts = decode.page_counts(found, make)
            pages = decode.recognised_pages(counts, make, engine=engine).count()
        runs.append((run, measured["seconds"], pages))
    table = spark.createDataFrame(runs, "run string, seconds double, pages long")
    table = table.withColumns({"per_page": F.try_divide("seconds", "pages"), "six_pages": F.try_divide(GOAL_PAGES * F.col("seconds"), "pages")})
    _, seconds, pages = runs[1]
    return table, pages > 0 and (seconds <= GOAL_SECONDS or seconds / pages * GOAL_PAGES <= GOAL_SECONDS)


def health(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT 'healthy' AS status")


def handler(spark: SparkSession, **defaults) -> type[BaseHTTPRequestHandler]:
    """``POST /ocr`` with a form of file, force_ocr, dpi, lang and engine; ``GET /health``."""

    class Service(BaseHTTPRequestHandler):
        def _answer(self, status: int, body: dict) -> None:
            data = json.dumps(body, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Access-Control-Allow-Origin", "*")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            if self.path == "/health":
                self._answer(200, health(spark).first().asDict())
            else:
                self._answer(404, {"detail": "Not Found"})

        def do_POST(self) -> None:
            if self.path != "/ocr":
                self._answer(404, {"detail": "Not Found"})
                return
            body = self.rfile.read(int(self.headers.get("Content-Length", 0)))
            form = BytesParser(policy=HTTP).parsebytes(b"Content-Type: " + self.headers.get("Content-Type", "").encode() + b"\r\n\r\n" + body)
            fields = {p.get_param("name", header="content-disposition"): p for p in form.iter_parts()} if form.is_multipart() else {}
            if "file" not in fields:
                self._answer(422, {"detail": "file is missing"})
                return
            text = lambda k, d: fields[k].get_payload(decode=True).decode().strip() if k in fields else d
            try:
                options = defaults | {"force_ocr": text("force_ocr", "false").lower() in ("true", "1", "on", "yes"), "dpi": int(text("dpi", decode.DPI)), "languages": text("lang", decode.LANGUAGES), "engine": text("engine", decode.ENGINE)}
                self._answer(200, process_one(spark, fields["file"].get_filename() or "", fields["file"].get_payload(decode=True), **options))
            except Exception as error:
                self._answer(500, {"detail": SERVICE_ERROR.format(error=error)})

        def log_message(self, *_) -> None:
            """Requests may name patients: nothing of them is logged."""

    return Service


def serve(spark: SparkSession, host: str = "127.0.0.1", port: int = 8000, **defaults) -> ThreadingHTTPServer:
    return ThreadingHTTPServer((host, port), handler(spark, **defaults))


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description="Texts and records of PDF and image files.")
    parser.add_argument("paths", nargs="+", help="files, or folders that hold them")
    parser.add_argument("-o", "--output-dir", default=None, help="folder for texts and records; without it they go beside each file")
    parser.add_argument("--layout", default="files", choices=["files", "table"], help="two files for each document, or tables; tables need a folder")
    parser.add_argument("-f", "--force-ocr", action="store_true", help="recognise images even where there is a text layer")
    parser.add_argument("-d", "--dpi", type=int, default=decode.DPI)
    parser.add_argument("-l", "--lang", default=decode.LANGUAGES)
    parser.add_argument("-e", "--engine", default=decode.ENGINE, choices=["rapidocr", "tesseract"])
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("formloom").getOrCreate()
    with timed("all files"):
        counts: dict[str, Counts] = {}
        process(spark, given.paths, given.output_dir, force_ocr=given.force_ocr, dpi=given.dpi, languages=given.lang, engine=given.engine, layout=given.layout, counts=counts)
        for state, n in counts["documents"].by_state().items():
            print(state, n)
        print("records", counts["records"].get()["rows"])
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
