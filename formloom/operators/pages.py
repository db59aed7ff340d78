"""Pages of documents: the probe for a text layer, routing and assembly.

Pages are rows (path, page_num from 1, text). Groups are documents; a probe counts before the shuffle. Assembly gathers a
document's pages in one row, because the document's text is one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formloom.functions.text import strip

# The least length of a page's text, the share of such pages, and the page header.
LEAST_CHARS = 10
SHARE = (4, 5)
HEADER = ("=== TRANG ", " ===\n")
# End of fixed values.


def has_text(text: Column, least: int = LEAST_CHARS) -> Column:
    """More than ``least`` characters besides white space at the ends."""
    return F.coalesce(F.length(strip(text)) > least, F.lit(False))


def probe(pages: DataFrame, path: str = "path", text: str = "text", least: int = LEAST_CHARS) -> DataFrame:
    """path, pages, digital_pages, share and digital: more than four of five pages have text."""
    counts = pages.groupBy(path).agg(F.count("*").alias("pages"), F.count_if(has_text(F.col(text), least)).alias("digital_pages"))
    return counts.withColumns({"share": F.try_divide("digital_pages", "pages"), "digital": SHARE[1] * F.col("digital_pages") > SHARE[0] * F.col("pages")})


def route(probed: DataFrame, force_ocr: bool = False) -> tuple[DataFrame, DataFrame]:
    """The documents whose text layer is read, and those whose images are. Whole documents go one way."""
    digital = F.lit(False) if force_ocr else F.coalesce(F.col("digital"), F.lit(False))
    return probed.where(digital), probed.where(~digital)


def route_pages(pages: DataFrame, text: str = "text", least: int = LEAST_CHARS) -> Column:
    """Per page instead, by choice: pages without text go to OCR whatever the rest of the document has."""
    return F.when(has_text(F.col(text), least), "digital").otherwise("ocr")


def assembled(page_num: str = "page_num", text: str = "text", where: Column | None = None) -> Column:
    """An aggregate: the text of a document's pages in numeric order, each under its header; a null page is empty; ``where`` says which pages count."""
    part = F.struct(F.col(page_num).cast("int").alias("n"), F.concat(F.lit(HEADER[0]), F.col(page_num).cast("int").cast("string"), F.lit(HEADER[1]), F.coalesce(F.col(text), F.lit("")), F.lit("\n")).alias("t"))
    part = part if where is None else F.when(where, part)
    return F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"]), "\n")


def assemble(pages: DataFrame, path: str = "path", page_num: str = "page_num", text: str = "text") -> DataFrame:
    """(path, text) of each document."""
    return pages.groupBy(path).agg(assembled(page_num, text).alias("text"))


def page_ranges(documents: DataFrame, at_once: int = 8, workers: int | None = None, path: str = "path", pages: str = "pages") -> DataFrame:
    """(path, first, pages, n): ranges of ``n`` pages, from page ``first`` counted from 0, that are worked on apart.

    With ``workers`` a document has as many ranges as pages or workers, whichever are fewer; else ranges have ``at_once`` pages.
    """
    n = F.lit(at_once) if workers is None else F.ceil(F.col(pages) / F.least(F.col(pages), F.lit(workers))).cast("int")
    some = documents.where(F.col(pages) > 0).select(path, F.col(pages).cast("int").alias("pages"), n.alias("n"))
    return some.select(path, F.explode(F.sequence(F.lit(0), F.col("pages") - 1, F.col("n"))).alias("first"), "pages", "n")


def as_map(pages: DataFrame, path: str = "path", page_num: str = "page_num", text: str = "text") -> DataFrame:
    """(path, pages): a map from page number to text."""
    return pages.groupBy(path).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(page_num).cast("int"), text)))).alias("pages"))


def from_map(documents: DataFrame, path: str = "path", pages: str = "pages") -> DataFrame:
    return documents.select(path, F.explode(pages).alias("page_num", "text"))


def number_pages(documents: DataFrame, path: str = "path", texts: str = "texts") -> DataFrame:
    """Pages, numbered from 1, of an array of texts."""
    return documents.select(path, F.posexplode(texts).alias("i", "text")).select(path, (F.col("i") + 1).alias("page_num"), "text")


def join_lines(lines: Column) -> Column:
    """Recognised lines as a page's text; no lines give an empty text."""
    return F.coalesce(strip(F.array_join(lines, "\n")), F.lit(""))


def seconds_per_page(runs: DataFrame, seconds: str = "seconds", pages: str = "pages") -> DataFrame:
    """Total seconds, pages, seconds a page and what six pages would take."""
    totals = runs.agg(F.sum(seconds).alias("seconds"), F.sum(pages).alias("pages"))
    return totals.withColumns({"per_page": F.try_divide("seconds", "pages"), "six_pages": F.try_divide(6 * F.col("seconds"), "pages")})
