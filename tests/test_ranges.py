"""The data source of page ranges: partitions, pushed filters, errors, and pages equal to those of whole documents."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, LessThanOrEqual

from formloom.sources import decode, ranges
from test_files_job import FakeBackend

SCHEMA = "path string, pages int"


class CountedPages(decode.TextPages):
    """Notes each document that it opens and each page that it reads beside the file, in a file of its own."""

    def open(self, content):
        import uuid
        from pathlib import Path

        doc = super().open(content)
        notes = Path(doc.text(0))
        (notes / f"open-{uuid.uuid4().hex}").touch()

        class Counted(type(doc)):
            def text(self, page):
                (notes / f"page-{page + 1}-{uuid.uuid4().hex}").touch()
                return doc.text(page)

        return Counted()


def document(path, pages):
    path.write_text("".join(f"{path.stem} {i + 1}\f" for i in range(pages)))
    return f"file:{path}", pages


@pytest.fixture()
def counts(spark, tmp_path):
    rows = [document(tmp_path / f"{name}.txt", n) for name, n in zip("abcdef", (5, 1, 12, 2, 7, 3), strict=True)]
    return spark.createDataFrame([*rows, (None, 3), (f"file:{tmp_path}/none.txt", 0)], SCHEMA)


def rows(df):
    return sorted((r.path.rsplit("/", 1)[-1], r.page_num, r.text, r.status) for r in df.collect())


def want(**pages):
    return sorted((f"{d}.txt", n, f"{d} {n}", "ok") for d, numbers in pages.items() for n in numbers)


def test_every_page_once(spark, counts):
    whole = want(a=range(1, 6), b=[1], c=range(1, 13), d=[1, 2], e=range(1, 8), f=[1, 2, 3])
    for options in ({}, {"at_once": 2, "per_task": 1}, {"workers": 3}, {"at_once": 1, "per_task": 5}):
        assert rows(ranges.pages_of(counts, decode.TextPages, **options)) == whole


def test_a_partition_for_each_range_and_pruned_ranges(spark, counts, tmp_path):
    target = str(tmp_path / "ranges")
    ranges.write_ranges(counts, target, at_once=2, per_task=1)

    def groups(*filters):
        reader = ranges.PageReader({"path": target, "backend": "-"})
        left = list(reader.pushFilters(list(filters)))
        return len([g for g in reader.partitions() if g.file]), left

    assert groups() == (3 + 1 + 6 + 1 + 4 + 2, [])
    c = f"file:{tmp_path}/c.txt"
    assert groups(EqualTo(("path",), c)) == (6, [])
    assert groups(EqualTo(("path",), c), GreaterThan(("page_num",), 8)) == (2, [])
    assert groups(In(("page_num",), (7, 11)), LessThanOrEqual(("page_num",), 9)) == (2, [])
    assert groups(EqualTo(("path",), "x")) == (0, [])
    other = [IsNotNull(("path",)), EqualTo(("text",), "c 1")]
    assert groups(*other) == (17, other)

    ranges.register(spark)
    load = lambda: spark.read.format("page_ranges").option("backend", "formloom.sources.decode:TextPages").load(target)
    found = load().where((F.col("path") == c) & (F.col("page_num") > 8) & F.col("text").endswith("1"))
    assert rows(found) == want(c=[11]) and found.rdd.getNumPartitions() == 2
    assert load().rdd.getNumPartitions() == 17
    assert rows(load().where("path = 'x'")) == [] and rows(load().where("page_num IS NULL")) == []
    assert rows(load().where("page_num IN (2, 7) OR page_num = 12")) == want(a=[2], c=[2, 7, 12], d=[2], e=[2, 7], f=[2])
    assert rows(load().where("page_num NOT IN (1, 2, 3, 4, 5, 6, 7)")) == want(c=range(8, 13))


def test_tasks_hold_several_ranges(spark, counts, tmp_path):
    target = str(tmp_path / "ranges")
    ranges.write_ranges(counts.coalesce(1), target, at_once=1, per_task=8)
    groups = ranges.PageReader({"path": target}).partitions()
    assert -(-30 // 8) <= len(groups) <= 30 // 8 + 4  # four files at most, and what is left in each


def test_only_pages_asked_for_are_read(spark, tmp_path):
    notes = tmp_path / "notes"
    notes.mkdir()
    path = tmp_path / "long.txt"
    path.write_text("".join(f"{notes}\f" for _ in range(40)))
    counts = spark.createDataFrame([(f"file:{path}", 40)], SCHEMA)
    found = ranges.pages_of(counts, CountedPages, at_once=5, per_task=1).where("page_num IN (3, 4, 33)")
    assert sorted(r.page_num for r in found.collect()) == [3, 4, 33]
    assert len(list(notes.glob("open-*"))) == 2 and sorted(x.name.split("-")[1] for x in notes.glob("page-*")) == ["3", "33", "4"]


def test_errors_and_recognition(spark, tmp_path):
    given = {"a.pdf": "one|boom|scan:x/y", "broken.pdf": "broken", "b.pdf": "scan:fail|scan:z"}
    for name, content in given.items():
        (tmp_path / name).write_text(content)
    counts = spark.createDataFrame([(f"file:{tmp_path}/{name}", content.count("|") + 1) for name, content in given.items()] + [(f"file:{tmp_path}/gone.pdf", 2)], SCHEMA)
    layer = {(r[0], r[1]): r[2:] for r in rows(ranges.pages_of(counts, FakeBackend, per_task=2))}
    assert layer == {("a.pdf", 1): ("one", "ok"), ("a.pdf", 2): (None, "error"), ("a.pdf", 3): ("", "ok"), ("b.pdf", 1): ("", "ok"), ("b.pdf", 2): ("", "ok"), ("broken.pdf", 1): (None, "error"), ("gone.pdf", 1): (None, "error"), ("gone.pdf", 2): (None, "error")}
    image = ranges.pages_of(counts.where("path LIKE '%/b.pdf'"), FakeBackend, by="image")
    by_task = decode.recognised_pages(counts.where("path LIKE '%/b.pdf'"), FakeBackend)
    assert rows(image) == rows(by_task) and [r[3] for r in rows(image)] == ["error", "ok"]


def test_empty_table(spark):
    assert ranges.pages_of(spark.createDataFrame([], SCHEMA), decode.TextPages).collect() == []


def test_text_pages():
    pages = lambda b: [d.text(i) for d in [decode.TextPages().open(b)] for i in range(len(d))]
    assert pages(b"a\fb\f") == ["a", "b"] == pages(b"a\fb") and pages(b"\f") == [""] and pages(b"a\f\f") == ["a", ""]
    with pytest.raises(UnicodeDecodeError):
        pages(b"\xff\f")


def test_many_small_documents_are_few_tasks(spark, tmp_path):
    rows_ = [document(tmp_path / f"d{i:03}.txt", 3) for i in range(300)]
    counts = spark.createDataFrame(rows_, SCHEMA)
    found = ranges.pages_of(counts, decode.TextPages, at_once=1)
    assert found.rdd.getNumPartitions() <= 4 + 4  # 900 ranges: 57 tasks of 16; four tasks, and what is left in each of four files
    assert rows(found) == sorted((f"d{i:03}.txt", n, f"d{i:03} {n}", "ok") for i in range(300) for n in (1, 2, 3))


def test_files_of_the_query_are_few_tasks(spark, monkeypatch):
    from formloom import page_queries

    monkeypatch.setattr(page_queries, "load", lambda *_: spark.range(200).selectExpr("id AS conv_id", "0 AS turn", "'x' AS text"))
    files = page_queries.conversation_files(spark, "")
    assert files.rdd.getNumPartitions() == 4 and files.count() == 200
