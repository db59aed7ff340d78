"""Writing document texts and records."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formloom.plans.catalog import FIELDS, SECTIONS, flat_name, of_section
from formloom.session import written
from formloom.sources.files import base_name, store_of, without_extension

# What is appended to the names of outputs.
TEXT_SUFFIX = "_extracted.txt"
FIELDS_SUFFIX = "_extracted_fields.json"
# End of fixed values.


def output_name(path: Column, folder: str | None = None, suffix: str = TEXT_SUFFIX) -> Column:
    """Beside the file, or in ``folder`` by its base name; files that differ in extension or folder only may then collide."""
    stem = without_extension(path)
    return F.concat(stem, F.lit(suffix)) if folder is None else F.concat(F.lit(folder.rstrip("/") + "/"), base_name(stem), F.lit(suffix))


def named_outputs(documents: DataFrame, folder: str | None = None, path: str = "path") -> DataFrame:
    """Adds out_name, collides, and unique_name, which keeps the extension where names collide and the folder's hash if that doesn't help.

    Counts by name combine before the shuffle.
    """
    named = documents.withColumn("out_name", output_name(F.col(path), folder))
    counts = named.groupBy("out_name").agg(F.count("*").alias("_n"))
    with_extension = output_name(F.concat(F.col(path), F.lit(".")), folder) if folder is None else F.concat(F.lit(folder.rstrip("/") + "/"), base_name(F.col(path)), F.lit("-"), F.substring(F.sha2(path, 256), 1, 12), F.lit(TEXT_SUFFIX))
    if folder is None:
        with_extension = F.concat(F.col(path), F.lit(TEXT_SUFFIX))
    joined = named.join(counts, "out_name").withColumn("collides", F.col("_n") > 1).drop("_n")
    return joined.withColumn("unique_name", F.when(F.col("collides"), with_extension).otherwise(F.col("out_name")))


def record_json(pretty: bool = False) -> Column:
    """The flat record as JSON with every key, nulls included, by sections."""
    sections = [F.struct(*(F.col(flat_name(f)).alias(f.name) for f in of_section(s))).alias(s) for s in SECTIONS]
    return F.to_json(F.struct(*sections), {"ignoreNullFields": "false", "pretty": str(pretty).lower()})


def write_texts(documents: DataFrame, target: str, path: str = "path", text: str = "text") -> None:
    """Non-empty texts as Parquet (path, out_name, text), one row for each document."""
    kept = documents.where(F.length(text) > 0)
    kept.select(path, F.col("out_name") if "out_name" in documents.columns else output_name(F.col(path)).alias("out_name"), text).write.mode("overwrite").parquet(target)


def write_records(flat: DataFrame, target: str, keep: list[str], layout: str = "json") -> None:
    """Records as JSON lines with all keys ("json"), or as Parquet in flat layout ("flat")."""
    if layout == "flat":
        flat.select(*keep, *(flat_name(f) for f in FIELDS)).write.mode("overwrite").parquet(target)
    else:
        flat.select(*keep, record_json().alias("record")).write.mode("overwrite").option("ignoreNullFields", "false").json(target)


def document_files(documents: DataFrame, records: DataFrame, folder: str | None = None) -> DataFrame:
    """(file, content): a text file of each document with text, and a JSON file of its record; beside the document, or in ``folder``.

    Files whose names collide have names of their own (:func:`named_outputs`).
    """
    named = named_outputs(documents.where(F.length("text") > 0), folder).select("path", "text", F.when(F.col("collides"), F.col("unique_name")).otherwise(F.col("out_name")).alias("file"))
    fields = named.join(records.select("path", record_json().alias("content")), "path")
    stem = F.substring(F.col("file"), F.lit(1), F.length("file") - len(TEXT_SUFFIX))
    return named.select("file", F.col("text").alias("content")).unionByName(fields.select(F.concat(stem, F.lit(FIELDS_SUFFIX)).alias("file"), "content"))


STAGED = "file string, staged string"


def _parts(batches: Iterator[pd.DataFrame], run: str) -> Iterator[pd.DataFrame]:
    """Writes contents to files of their own in a hidden folder beside where they belong; what a failing task has written goes."""
    made: list[tuple] = []
    try:
        for batch in batches:
            rows = []
            for name, content in zip(batch["file"], batch["content"], strict=True):
                if name.endswith(".json"):
                    content = json.dumps(json.loads(content), indent=2, ensure_ascii=False)
                folder = f"{name.rpartition('/')[0]}/.{run}"
                store, place = store_of(folder)
                store.create_dir(place, recursive=True)
                part = uuid.uuid4().hex
                made.append((store, f"{place}/{part}"))
                with store.open_output_stream(f"{place}/{part}") as out:
                    out.write(content.encode())
                rows.append((name, f"{folder}/{part}"))
            yield pd.DataFrame(rows, columns=["file", "staged"])
    except BaseException:
        for store, place in made:
            if store.get_file_info(place).type.name == "File":
                store.delete_file(place)
        raise


def staged_files(files: DataFrame) -> DataFrame:
    """(file, staged): each content (JSON with an indent of two) in a file of its own that no listing shows. Nothing has its name yet."""
    run = f"formloom-{uuid.uuid4().hex}"
    try:
        return written(files.mapInPandas(lambda batches: _parts(batches, run), STAGED), "staged")
    except Exception:
        _swept(files.select(F.regexp_replace("file", "/[^/]*$", f"/.{run}").alias("folder")))
        raise


def _swept(folders: DataFrame) -> None:
    """Removes folders of staged files, whatever is in them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for folder in batch["folder"]:
                store, place = store_of(folder)
                if store.get_file_info(place).type.name == "Directory":
                    store.delete_dir(place)
            yield batch

    folders.distinct().mapInPandas(run, "folder string").write.format("noop").mode("overwrite").save()


def commit_files(staged: DataFrame) -> int:
    """Gives staged files their names, from the workers, and returns how many; may run again if it fails."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, part in zip(batch["file"], batch["staged"], strict=True):
                store, place = store_of(part)
                if store.get_file_info(place).type.name == "File":  # else an attempt before this one has moved it
                    store.move(place, store_of(name)[1])
            yield pd.DataFrame({"n": [len(batch)]})

    n = staged.mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    _swept(staged.select(F.regexp_replace("staged", "/[^/]*$", "").alias("folder")))
    return n


def write_files(files: DataFrame) -> int:
    """Writes each content to its file and returns how many: all of them, or none if a task fails.

    First all contents are staged, then all are renamed; the list of staged files stands in a written table in between, and renaming
    goes on from that wherever it stopped. Neither step has the driver touch a file.
    """
    return commit_files(staged_files(files))


def error_rows(documents: DataFrame, path: str = "path") -> DataFrame:
    """What a service would answer with an error: documents without text or that failed."""
    return documents.where((F.length("text") == 0) | (F.col("status") != "ok")).select(path, "status", F.coalesce("error", F.lit("no text")).alias("error"))
