"""Session helpers: table loading and the shared working folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: The folder that holds this package.
HOME = str(Path(__file__).resolve().parent.parent)


#: Bytes of an Arrow batch on its way to Python, unless the session says otherwise: texts can be long, and
#: both sides hold whole batches.
ARROW_BATCH = "8m"
_ARROW_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it, and bounds what they get at once.

    On a cluster the package is installed or shipped; then the path changes nothing. The size of
    batches is left alone if it has been set.
    """
    if spark.conf.get(_ARROW_SETTING, None) is None:  # not set: Spark would take 64 MB
        spark.conf.set(_ARROW_SETTING, ARROW_BATCH)
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if HOME not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([HOME, *filter(None, paths)])


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The table ``{sf_dir}/{table}.parquet`` (a file or a folder of parts)."""
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tasks(spark: SparkSession) -> int:
    """How many tasks work is dealt to: as many as the session shuffles to, and one for each core at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt evenly over :func:`tasks`, before work that is dear for each row.

    A small file has one row group or few, and a row group is one task, however many rows of a few bytes it holds.
    """
    return df.repartition(tasks(df.sparkSession))


def shared_dir(spark: SparkSession) -> str:
    """A new folder under the one that driver and executors share; it is deleted when the application ends.

    The folder is the session's ``spark.checkpoint.dir``. Only a local session
    without that setting (unit tests) gets a temporary folder; a cluster without
    it is an error, because executors would write where nobody else can read.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        base = f"file://{tempfile.mkdtemp(prefix='formloom-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/formloom-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(place)
    store.deleteOnExit(place)
    # with its scheme: other readers have other defaults
    return re.sub("^file:/(?!/)", "file:///", store.makeQualified(place).toUri().toString())


_SCOPES: ContextVar[tuple[list, ...]] = ContextVar("scopes", default=())


@contextmanager
def scratch() -> Iterator[None]:
    """Deletes at its end the tables that :func:`written` made within; what outlives it must not read them."""
    made: list = []
    mark = _SCOPES.set((*_SCOPES.get(), made))
    try:
        yield
    finally:
        _SCOPES.reset(mark)
        for store, place in made:
            store.delete(place, True)


def written(df: DataFrame, name: str = "table", outer: bool = False) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    This cuts the lineage: a lost executor costs a reread, not a recomputation,
    and what was not deterministic (partition numbers) is now fixed. The table lasts as long as the
    :func:`scratch` around it, or with ``outer`` as the one around that; without one, until the application ends.
    """
    spark = df.sparkSession
    folder = shared_dir(spark)
    path = f"{folder}/{name}"
    scopes = _SCOPES.get()[: -1 if outer else None]
    if scopes:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        scopes[-1].append((place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
