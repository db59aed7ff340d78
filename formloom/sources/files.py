"""Files: what to process, of which kind, and reading them as a table.

Paths come as a list, as a command line has them, or as a table of any size (:func:`looked_up`, :func:`listed`, :func:`collected`): then tasks look
them up, list folders and read files, and the driver sees none of them.
"""

from __future__ import annotations

import os
import urllib.parse
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from formloom.session import written

# Extensions that a folder is searched for, and those of images; all else is taken for a PDF.
EXTENSIONS = ("pdf", "png", "jpg", "jpeg", "bmp", "tiff")
IMAGES = (".png", ".jpg", ".jpeg", ".bmp", ".tiff")
# End of fixed values.

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def extension(path: Column) -> Column:
    """The lower-case extension with its dot; empty without one, or if the name begins with the only dot."""
    return F.lower(F.regexp_extract(path, r"(?<=[^/.])(\.[^./]*)$", 1))


def kind(path: Column) -> Column:
    return F.when(extension(path).isin(*IMAGES), "image").otherwise("pdf")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def without_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"(?<=[^/.])\.[^./]*$", "")


def _glob() -> str:
    """Lower or upper case, not mixed."""
    return "*.{" + ",".join(x for e in EXTENSIONS for x in (e, e.upper())) + "}"


def store_of(path: str):
    """The pyarrow file system and the place in it of a path as Spark shows it: local, or of a store that pyarrow knows."""
    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    if not rest or len(scheme) < 2 or scheme == "file":
        return fs.LocalFileSystem(), f"/{rest.lstrip('/')}" if scheme == "file" else path
    return fs.FileSystem.from_uri(urllib.parse.quote(path, safe=":/"))


def read_files(spark: SparkSession, folders: list[str], content: bool = True) -> DataFrame:
    """The files of folders, not of folders in them; ``content`` is only read if asked for.

    Hidden files, which begin with a dot or an underscore, and files of length zero are not listed.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", _glob()).option("recursiveFileLookup", "false").load(folders)
    return found if content else found.drop("content")


def requested(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, is_folder, found, qualified) of what a user names: each once, in order. Listing goes through Spark's file systems.

    ``qualified``: the path with its scheme, as other readers and listings have it.
    """
    rows = []
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in sorted(set(paths)):
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(conf)
        there = fs.exists(p)
        rows.append((path, bool(there and fs.getFileStatus(p).isDirectory()), bool(there), fs.makeQualified(p).toString()))
    return spark.createDataFrame(rows, "path string, is_folder boolean, found boolean, qualified string")


def _listed(path: str) -> bool:
    """Whether the listing of a file's folder has it, by its name."""
    name = path.rsplit("/", 1)[-1]
    end = name.rsplit(".", 1)[-1] if "." in name else ""
    return name[0] not in "._" and end.lower() in EXTENSIONS and end in (end.lower(), end.upper())


def _qualified(path: str, place: str) -> str:
    """A path as Spark's listings show it."""
    return f"file:{os.path.abspath(place)}" if "://" not in path or path.startswith("file:") else path.rstrip("/")


def looked_up(paths: DataFrame, path: str = "path", tasks: int | None = None) -> DataFrame:
    """(path, found, is_folder, qualified) of each different path of a table; null paths are left out.

    Tasks ask the stores, for many paths at once. Stores are those that pyarrow knows (local, HDFS, S3, GCS).
    """

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            stores: dict = {}
            for one in batch["path"]:
                store, place = store_of(one)
                stores.setdefault(store.type_name, (store, []))[1].append((one, place))
            for store, asked in stores.values():
                kinds = [x.type for x in store.get_file_info([place for _, place in asked])]
                yield pd.DataFrame({"path": [one for one, _ in asked], "found": [k != fs.FileType.NotFound for k in kinds], "is_folder": [k == fs.FileType.Directory for k in kinds], "qualified": [_qualified(*x) for x in asked]})

    different = paths.select(F.col(path).alias("path")).where(F.col("path").isNotNull()).distinct()
    n = tasks or int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return different.repartition(n, "path").mapInPandas(look, "path string, found boolean, is_folder boolean, qualified string")


def listed(folders: DataFrame, folder: str = "qualified") -> DataFrame:
    """(path) of the files of each folder that :func:`read_files` would list."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            for one in batch["folder"]:
                store, place = store_of(one)
                infos = store.get_file_info(fs.FileSelector(place, recursive=False))
                names = [x.base_name for x in infos if x.type == fs.FileType.File and x.size and _listed(x.base_name)]
                yield pd.DataFrame({"path": [f"{one.rstrip('/')}/{name}" for name in names]})

    return folders.select(F.col(folder).alias("folder")).mapInPandas(run, "path string")


def collected(paths: DataFrame, path: str = "path", tasks: int | None = None) -> DataFrame:
    """What :func:`collect_files` gives, for a table of paths.

    Paths are made distinct and dealt out before any file is read; contents go through no exchange.
    """
    asked = written(looked_up(paths, path, tasks), "asked")  # read three times
    n = tasks or int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    there = asked.where("found AND NOT is_folder").select(F.col("qualified").alias("path"))
    different = there.union(listed(asked.where("is_folder"))).distinct().repartition(n, "path")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for one in batch["path"]:  # one at a time: contents may be large
                store, place = store_of(one)
                with store.open_input_file(place) as f:
                    content = f.read()
                yield pd.DataFrame({"path": [one], "status": ["ok"], "length": [len(content)], "content": [content]})

    found = different.mapInPandas(read, "path string, status string, length bigint, content binary")
    gone = asked.where("NOT found").select("path", F.lit("missing").alias("status"), F.lit(None).cast("bigint").alias("length"), F.lit(None).cast("binary").alias("content"))
    return found.unionByName(gone).withColumn("kind", kind(F.col("path")))


def collect_files(spark: SparkSession, paths: list[str] | DataFrame) -> DataFrame:
    """path, status ("ok" or "missing"), kind, length, content: files of folders and files named, each once.

    A file named is taken whatever its extension; one that doesn't exist becomes a row of its own. A list is looked up
    by the driver, a table (``path``) by tasks.
    """
    if isinstance(paths, DataFrame):
        return collected(paths)
    asked = requested(spark, paths).collect()  # as many as the user names
    folders = sorted({r.qualified for r in asked if r.is_folder})
    files = sorted({r.qualified for r in asked if r.found and not r.is_folder})
    # a file that is named and in a folder that is named is listed there; so paths are distinct without comparing rows
    files = [x for x in files if x.rsplit("/", 1)[0] not in folders or not _listed(x)]
    missing = [(r.path,) for r in asked if not r.found]
    parts = []
    if folders:
        parts.append(read_files(spark, folders))
    if files:
        parts.append(spark.read.format("binaryFile").load(files))
    found = None
    for part in parts:
        found = part if found is None else found.unionByName(part)
    found = spark.createDataFrame([], FILES) if found is None else found
    found = found.select("path", F.lit("ok").alias("status"), "length", "content")
    gone = spark.createDataFrame(missing, "path string").select("path", F.lit("missing").alias("status"), F.lit(None).cast("bigint").alias("length"), F.lit(None).cast("binary").alias("content"))
    return found.unionByName(gone).withColumn("kind", kind(F.col("path")))


def distinct_sorted(paths: DataFrame, path: str = "path") -> DataFrame:
    """Each path once, in order of code points."""
    return paths.select(path).distinct().orderBy(path)


def missing(requested_paths: DataFrame, listing: DataFrame, path: str = "path") -> DataFrame:
    """The requested rows that the listing hasn't."""
    return requested_paths.join(listing.select(path).distinct(), path, "left_anti")


def with_progress(files: DataFrame, path: str = "path") -> DataFrame:
    """Adds idx (from 1, in order of paths) and total, as a progress report shows them.

    Ranks are global: rows are sorted by ranges, and only the sizes of ranges meet in one place.
    """
    ordered = written(files.repartitionByRange(path).withColumn("_part", F.spark_partition_id()), "ordered")
    total = ordered.count()
    sizes = ordered.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    nth = F.row_number().over(W.partitionBy("_part").orderBy(path))
    return ordered.withColumn("_nth", nth).join(before, "_part").select(*files.columns, (F.col("_nth") + F.col("_before")).alias("idx"), F.lit(total).cast("long").alias("total"))
