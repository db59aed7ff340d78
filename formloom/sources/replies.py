"""Replies of a remote service, each request sent once: a log in a shared store.

A request is known by the SHA-256 of its body, so equal documents are one request. The log is a folder:

    replies/   Parquet: digest, http_status, body, error, sent_at; appended to by each run that sends
    pending/   a file for each reply of a run that hasn't been appended yet

Requests that the log knows aren't sent. A task keeps each reply as a file as soon as it has it; a task that runs
again, or a run after one that failed, takes it from there. When a run's replies are in ``replies``, its files go.
Only a call whose reply was on its way when its worker died is made again. One run writes to a log at a time.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formloom.sources.files import store_of

#: (body of the request, seconds to wait) -> (HTTP status, body of the reply)
Transport = Callable[[str, float], tuple[int, str]]

REPLY = "digest string, http_status int, body string, error string, sent_at double"
#: Calls that a task has on their way at once.
IN_FLIGHT = 4


def digest(body: Column) -> Column:
    return F.sha2(body.cast("binary"), 256)


def _folder(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def read_log(spark: SparkSession, log: str) -> DataFrame:
    """The last reply to each request."""
    store, place = _folder(spark, f"{log}/replies")
    if not store.exists(place):
        return spark.createDataFrame([], REPLY)
    found = spark.read.schema(REPLY).parquet(f"{log}/replies")
    last = found.groupBy("digest").agg(F.max_by(F.struct("http_status", "body", "error", "sent_at"), "sent_at").alias("r"))
    return last.select("digest", "r.*")


def send_once(requests: DataFrame, transport: Transport, log: str, body: str = "request", timeout: float = 30.0, in_flight: int = IN_FLIGHT, tasks: int | None = None, again: bool = False) -> DataFrame:
    """Sends the requests that the log doesn't know, from ``tasks`` tasks with ``in_flight`` calls each; returns the log's replies.

    What fails is logged too, with the name of the error only, as its text may hold secrets; with ``again`` requests whose last reply isn't of
    status 200 are sent again. Null requests aren't sent.
    """
    spark = requests.sparkSession
    known = read_log(spark, log)
    known = known.where(F.col("http_status") == 200) if again else known
    asked = requests.select(digest(F.col(body)).alias("digest"), F.col(body).alias("request")).where(F.col(body).isNotNull()).dropDuplicates(["digest"])
    todo = asked.join(known.select("digest"), "digest", "left_anti")
    # by number, as small requests would else meet in few tasks, and it is waiting that takes time
    todo = todo.repartition(tasks or int(spark.conf.get("spark.sql.shuffle.partitions")), "digest")

    def one(row) -> tuple:
        store, place = store_of(f"{log}/pending/{row.digest}")
        try:
            with store.open_input_file(place) as f:
                return tuple(json.loads(f.read()))
        except FileNotFoundError:
            pass
        try:
            reply = (row.digest, *transport(row.request, timeout), None, time.time())
        except Exception as error:
            reply = (row.digest, None, None, type(error).__name__, time.time())
        store.create_dir(place.rpartition("/")[0], recursive=True)
        part = f"{place}.{uuid.uuid4().hex}"
        with store.open_output_stream(part) as out:
            out.write(json.dumps(reply).encode())
        store.move(part, place)
        return reply

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(in_flight) as pool:
            for batch in batches:
                for at in range(0, len(batch), 64 * in_flight):
                    rows = list(pool.map(one, batch[at : at + 64 * in_flight].itertuples(index=False)))
                    yield pd.DataFrame(rows, columns=["digest", "http_status", "body", "error", "sent_at"]).astype({"http_status": "Int32"})

    if again:  # what was kept of failures must not stand in for a new call
        _cleared(spark, log)
    todo.mapInPandas(run, REPLY).write.mode("append").parquet(f"{log}/replies")
    _cleared(spark, log)
    return read_log(spark, log)


def _cleared(spark: SparkSession, log: str) -> None:
    store, place = _folder(spark, f"{log}/pending")
    store.delete(place, True)
