"""Files that land in a folder as a stream of records.

Each document is worked on by itself, so no state and no watermark is needed. The checkpoint remembers which files have been
read, and a batch is written under its number, so that a restart neither loses nor repeats records.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from formloom.metrics import Counts
from formloom.operators.rules import extract
from formloom.session import scratch, written
from formloom.sinks import error_rows
from formloom.sources.files import FILES, kind

#: A batch of files (path, status, kind, length, content) -> (path, text, ...)
Decoder = Callable[[DataFrame], DataFrame]


def landed(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """The stream of files that land in ``folder``."""
    found = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", per_trigger).load(folder)
    return found.select("path", F.lit("ok").alias("status"), kind(F.col("path")).alias("kind"), "length", "content")


def text_files(files: DataFrame) -> DataFrame:
    """The simplest decoder: the content is the text, as UTF-8; what isn't is an error."""
    text = F.col("content").cast("string")
    good = F.is_valid_utf8(text)
    return files.select("path", F.when(good, text).otherwise("").alias("text"), F.when(good, "ok").otherwise("error").alias("status"), F.when(~good, "not UTF-8").alias("error"))


def _with_state(documents: DataFrame) -> DataFrame:
    """Documents of a decoder that doesn't tell how it went are all right."""
    for name, value in (("status", F.lit("ok")), ("error", F.lit(None).cast("string"))):
        documents = documents if name in documents.columns else documents.withColumn(name, value)
    return documents.select("path", F.coalesce("text", F.lit("")).alias("text"), "status", "error")


def stream_records(spark: SparkSession, folder: str, target: str, checkpoint: str, decode: Decoder = text_files, reference_year: int | None = None, per_trigger: int = 1000, quarantine: str | None = None, log: str | None = None) -> StreamingQuery:
    """Extracts every file that has landed, once, and stops; records go to ``target``/batch=N as Parquet.

    With ``quarantine``, documents without text and those that failed go there (path, status, error) by the same numbers instead, and have no record.
    With ``log``, the number of a batch is written there when all of it has been written, with its counts: :func:`read_batches` then shows
    the records and the failures of a batch, or neither. A batch that was cut short is written again under its number.
    """
    options = {} if reference_year is None else {"reference_year": reference_year}

    def write(batch: DataFrame, number: int) -> None:
        place = lambda of: f"{of.rstrip('/')}/batch={number}"
        with scratch():
            documents = _with_state(decode(batch))
            counts = Counts(f"batch {number}")
            if quarantine:
                documents = written(counts.of(documents), "documents")
                error_rows(documents).write.mode("overwrite").parquet(place(quarantine))
                documents = documents.where((F.length("text") > 0) & (F.col("status") == "ok"))
            else:
                documents = counts.of(documents)
            extract(documents.select("path", "text"), "text", **options).write.mode("overwrite").parquet(place(target))
            if log:
                found = counts.get()
                spark.createDataFrame([(found["rows"], found["ok"])], "documents long, ok long").coalesce(1).write.mode("overwrite").json(place(log))

    return landed(spark, folder, per_trigger).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_batches(spark: SparkSession, target: str, log: str) -> DataFrame:
    """The rows of ``target`` (records or quarantine) of batches that are whole by the log."""
    done = spark.read.json(log).select("batch").distinct()
    return spark.read.parquet(target).join(F.broadcast(done), "batch", "left_semi")
