"""The query of pages read by ranges, with DuckDB SQL; a part of :mod:`formloom.catalogue_queries`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formloom.session import load, shared_dir, tasks
from formloom.sinks import write_files
from formloom.sources import decode, ranges

#: Pages that the query asks for, and how many a range has.
ASKED, AT_ONCE = (2, 5), 2


def conversation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content) of a text file for each conversation, with a page for each turn; written first."""
    folder = shared_dir(spark)
    page = F.struct("turn", F.translate(F.coalesce("text", F.lit("")), "\f", " ").alias("text"))
    pages = F.transform(F.array_sort(F.collect_list(page)), lambda x: F.concat(x["text"], F.lit("\f")))
    documents = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(pages, "").alias("content"))
    write_files(documents.select(F.concat(F.lit(f"{folder}/"), F.coalesce(F.col("conv_id").cast("string"), F.lit("none")), F.lit(".txt")).alias("file"), "content"))
    # Spark takes 4 MB for the cost of opening a file, and so would have a task for a few small files each
    return spark.read.format("binaryFile").load(folder).select("path", "content").coalesce(tasks(spark))


def page_source_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some pages of every document, through the data source: only ranges that hold them are read."""
    counts = decode.page_counts(conversation_files(spark, sf_dir), decode.TextPages)
    found = ranges.pages_of(counts, decode.TextPages, AT_ONCE).where(F.col("page_num").between(*ASKED))
    return found.select(F.regexp_extract("path", r"([^/]+)\.txt$", 1).try_cast("bigint").alias("conv_id"), "page_num", "text", "status")


QUERIES = {"page_source_ranges": page_source_ranges}
ORACLES = {
    "page_source_ranges": f"""
        SELECT conv_id, page_num, text, 'ok' AS status FROM (
          SELECT conv_id, replace(coalesce(text, ''), chr(12), ' ') AS text, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(text, '')))::INTEGER AS page_num FROM conversations)
        WHERE page_num BETWEEN {ASKED[0]} AND {ASKED[1]}""",
}
