"""Pages as a Python data source: ``spark.read.format("page_ranges")`` opens documents by ranges of pages.

The table that it loads has a row for each range (path, first_page, last_page; pages count from 1), as :func:`write_ranges` writes it: sorted, in
row groups of ``per_task`` ranges. Each row group is one input partition, so the driver reads footers and no rows, and it keeps as many entries as
there are tasks. Filters on path and page_num are pushed: row groups whose bounds exclude them are no partitions, ranges and pages that they exclude are
neither opened nor read. Other filters stay with Spark.

Options: ``backend`` ("module:name" of what makes a backend), ``by`` ("layer": the text layer, not stripped; "image": recognition, with
``engine``, ``dpi``, ``languages``, ``command``). A document that can't be opened gives an error for each page asked for; a page that
fails gives one for itself. Null paths and ranges without pages have no rows; repeated rows repeat their pages.
"""

from __future__ import annotations

import importlib
import operator
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from formloom.operators import pages as page_ops
from formloom.session import importable, shared_dir, tasks, written
from formloom.sources import decode
from formloom.sources.files import store_of

FORMAT = "page_ranges"
#: Ranges that a task works on; where all would be more tasks than the session deals work to, it is more ranges.
PER_TASK = 16
#: Footers that the driver reads at once.
FOOTERS = 16
_COLUMNS = ("path", "page_num")
_COMPARED = {EqualTo: operator.eq, LessThan: operator.lt, LessThanOrEqual: operator.le, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge}


def write_ranges(counts: DataFrame, target: str, at_once: int = 8, workers: int | None = None, per_task: int = PER_TASK) -> None:
    """Writes the ranges of the documents ``counts`` (path, pages) as the source reads them."""
    ranges = page_ops.page_ranges(counts.where(F.col("path").isNotNull()), at_once, workers)
    ranges = ranges.select("path", (F.col("first") + 1).alias("first_page"), F.least("pages", F.col("first") + F.col("n")).alias("last_page"))
    # sorted, so that the bounds of a row group are narrow
    ranges = ranges.repartitionByRange("path", "first_page").sortWithinPartitions("path", "first_page")
    ranges.write.option("parquet.block.row.count.limit", per_task).parquet(target)


@dataclass
class RowGroup(InputPartition):
    """A row group of the table of ranges."""

    file: str
    group: int


def _may_hold(kept: Sequence[Filter], column: str, low: Any, high: Any) -> bool:
    """Whether values from ``low`` to ``high`` can pass the filters on a column."""

    def one(f: Filter) -> bool:
        if isinstance(f, In):
            return any(low <= x <= high for x in f.value)
        if isinstance(f, EqualTo):
            return low <= f.value <= high
        return _COMPARED[type(f)](low if isinstance(f, LessThan | LessThanOrEqual) else high, f.value)

    return all(one(f) for f in kept if f.attribute == (column,))


class PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options, self.kept = dict(options), []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            value = getattr(f, "value", None)
            known = isinstance(f, In) and None not in f.value or type(f) in _COMPARED and value is not None
            if known and f.attribute in [(c,) for c in _COLUMNS]:
                self.kept.append(f)
            else:
                yield f

    def _groups(self, file: str) -> list[RowGroup]:
        from pyarrow import parquet

        store, place = store_of(file)
        with store.open_input_file(place) as f:
            meta = parquet.ParquetFile(f).metadata
        at = {meta.schema.column(i).name: i for i in range(meta.num_columns)}
        found = []
        for group in range(meta.num_row_groups):
            path, first, last = (meta.row_group(group).column(at[c]).statistics for c in ("path", "first_page", "last_page"))
            bounds = [("path", path, path), ("page_num", first, last)]
            # without statistics nothing is known, and nothing excluded
            if all(not (a and b and a.has_min_max and b.has_min_max) or _may_hold(self.kept, c, a.min, b.max) for c, a, b in bounds):
                found.append(RowGroup(file, group))
        return found

    def partitions(self) -> list[RowGroup]:
        from pyarrow import fs

        table = self.options["path"].rstrip("/")
        store, place = store_of(table)
        names = sorted(x.base_name for x in store.get_file_info(fs.FileSelector(place)) if x.type == fs.FileType.File and x.base_name[0] not in "._")
        with ThreadPoolExecutor(FOOTERS) as pool:
            found = [g for groups in pool.map(self._groups, (f"{table}/{name}" for name in names)) for g in groups]
        return found or [RowGroup("", 0)]  # Spark asks for one at least

    def _page(self, backend: decode.Backend, doc: decode.Document, page: int) -> tuple:
        get = self.options.get
        if get("by", "layer") == "image":
            return decode.page_by_image(backend, doc, page, get("engine", decode.ENGINE), int(get("dpi", decode.DPI)), get("languages", decode.LANGUAGES), get("command", "tesseract"))
        try:
            return doc.text(page), "ok", None
        except Exception as error:  # one bad page must not stop the others
            return None, "error", str(error)

    def read(self, partition: RowGroup) -> Iterator[tuple]:
        from pyarrow import parquet

        if not partition.file:
            return
        store, place = store_of(partition.file)
        with store.open_input_file(place) as f:
            rows = parquet.ParquetFile(f).read_row_group(partition.group, columns=["path", "first_page", "last_page"]).to_pylist()
        asked: dict[str, list[int]] = {}
        for row in rows:
            if row["path"] is not None and _may_hold(self.kept, "path", row["path"], row["path"]):
                numbers = [n for n in range(row["first_page"], row["last_page"] + 1) if _may_hold(self.kept, "page_num", n, n)]
                asked.setdefault(row["path"], []).extend(numbers)
        backend = _made(self.options["backend"])
        for path, numbers in asked.items():
            if not numbers:
                continue
            try:
                doc = backend.open(decode.read_bytes(path))
            except Exception as error:
                for n in numbers:
                    yield path, n, None, "error", str(error)
                continue
            try:
                for n in numbers:
                    yield path, n, *self._page(backend, doc, n - 1)
            finally:
                doc.close()


class PageRanges(DataSource):
    """The format ``page_ranges``, to be registered with ``spark.dataSource.register``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return decode.PAGES

    def reader(self, schema) -> PageReader:
        return PageReader(self.options)


def _made(name: str) -> decode.Backend:
    """One backend for each worker."""
    module, _, attribute = name.partition(":")
    return decode.backend_of(getattr(importlib.import_module(module), attribute))


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, and has Spark push filters to Python data sources, which it doesn't by itself."""
    importable(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PageRanges)


def pages_of(counts: DataFrame, make: Callable[[], decode.Backend] = decode.LibraryBackend, at_once: int = 8, workers: int | None = None, per_task: int | None = None, **options: Any) -> DataFrame:
    """(path, page_num, text, status, error) of the documents ``counts`` (path, pages): writes their ranges and reads by them.

    ``make`` must be a name of a module that workers can import. Without ``per_task`` there are no more tasks than
    :func:`~formloom.session.tasks` says, or so, since starting one costs more than a range of a small document.
    """
    spark = counts.sparkSession
    register(spark)
    target = f"{shared_dir(spark)}/ranges"
    counts = written(counts.select("path", "pages"), "counts")  # sorting reads it twice, and counting opens every document
    if per_task is None:
        per_task = max(PER_TASK, -(-page_ops.page_ranges(counts.where(F.col("path").isNotNull()), at_once, workers).count() // tasks(spark)))
    write_ranges(counts, target, at_once, workers, per_task)
    return spark.read.format(FORMAT).options(backend=f"{make.__module__}:{make.__qualname__}", **options).load(target)
