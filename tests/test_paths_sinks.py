"""Tables of paths, files that are written whole or not at all, counts from the same pass, and a stream with a quarantine."""

import os

import pytest
from pyspark.sql import functions as F
from test_files_job import FakeBackend

from formloom import job, sinks
from formloom.metrics import Counts
from formloom.sources import files
from formloom.streaming import landing


@pytest.fixture
def folder(tmp_path):
    place = tmp_path / "in put"
    (place / "inner").mkdir(parents=True)
    for name, text in {"a.pdf": "Họ tên: An ngồi đây", "b.PDF": "Họ tên: Bé ngồi đây", "c.png": "Họ tên: Chi", "_d.pdf": "x", ".e.pdf": "x", "f.txt": "Họ tên: Phú ngồi đây", "g.Pdf": "x", "empty.pdf": "", "inner/h.pdf": "x"}.items():
        (place / name).write_text(text)
    return place


def names(df):
    return sorted((r.path.rsplit("/", 1)[-1], r.status, r.kind) for r in df.select("path", "status", "kind").collect())


def test_a_table_of_paths_is_read_like_a_list(spark, folder, monkeypatch):
    asked = [str(folder), f"file://{folder}/a.pdf", f"{folder}/f.txt", f"{folder}/gone.png", f"{folder}/inner", f"{folder}/f.txt"]
    want = names(files.collect_files(spark, asked))
    monkeypatch.setattr(files, "requested", None)  # the driver looks nothing up
    table = spark.createDataFrame([(x,) for x in [*asked, None]], "path string")
    found = files.collect_files(spark, table)
    assert names(found) == want == [("a.pdf", "ok", "pdf"), ("b.PDF", "ok", "pdf"), ("c.png", "ok", "image"), ("f.txt", "ok", "pdf"), ("gone.png", "missing", "image"), ("h.pdf", "ok", "pdf")]
    assert {r.path.rsplit("/", 1)[-1]: bytes(r.content).decode() for r in found.where("status = 'ok'").collect()}["f.txt"] == "Họ tên: Phú ngồi đây"
    documents, _ = job.process(spark, table, make=FakeBackend)
    assert documents.where("status = 'missing' OR path like '%gone.png'").count() == 1
    assert files.collect_files(spark, table.where("false")).collect() == []


def test_a_hundred_thousand_paths(spark, folder, monkeypatch):
    monkeypatch.setattr(files, "requested", None)
    table = spark.range(100_000).select(F.concat(F.lit(f"{folder}/"), F.when(F.col("id") % 20_000 == 0, "a.pdf").otherwise(F.concat(F.col("id").cast("string"), F.lit(".pdf")))).alias("path"))
    found = files.looked_up(table)
    row = found.agg(F.count("*").alias("n"), F.count_if("found").alias("there")).first()
    assert (row.n, row.there) == (99_996, 1)


def outputs(spark, rows):
    return spark.createDataFrame(rows, "file string, content string").repartition(3)


def test_files_are_all_written_or_none(spark, tmp_path):
    out = tmp_path / "out"
    rows = [(f"{out}/{i % 2}/{i}.txt", f"text {i}") for i in range(20)] + [(f"{out}/1/x.json", '{"é": [1]}')]
    with pytest.raises(Exception):
        sinks.write_files(outputs(spark, [*rows, (f"{out}/0/bad.json", "{")]))
    assert [f for _, _, found in os.walk(out) for f in found] == [] and not any(d.startswith(".formloom") for _, ds, _ in os.walk(out) for d in ds)
    assert sinks.write_files(outputs(spark, rows)) == 21
    assert sorted(f for _, _, found in os.walk(out) for f in found) == sorted([*(f"{i}.txt" for i in range(20)), "x.json"])
    assert (out / "1" / "x.json").read_text() == '{\n  "é": [\n    1\n  ]\n}' and (out / "0" / "4.txt").read_text() == "text 4"
    assert not any(d.startswith(".") for _, ds, _ in os.walk(out) for d in ds)


def test_a_commit_that_was_cut_short_goes_on(spark, tmp_path):
    staged = sinks.staged_files(outputs(spark, [(f"{tmp_path}/o/{i}.txt", str(i)) for i in range(6)]))
    assert [f for _, ds, found in os.walk(tmp_path / "o") for f in found if f.endswith(".txt")] == []
    one = staged.orderBy("file").first()
    os.rename(one.staged, one.file)  # as if an attempt had come so far
    assert sinks.commit_files(staged) == 6
    assert sorted(os.listdir(tmp_path / "o")) == [f"{i}.txt" for i in range(6)]


def test_counts_come_with_the_result(spark, folder, capsys):
    counts = {}
    documents, records = job.process(spark, [str(folder), f"{folder}/gone.pdf"], make=FakeBackend, counts=counts)
    plain = {r.status: r["count"] for r in documents.groupBy("status").count().collect()}
    assert counts["documents"].by_state() == plain and counts["documents"].get()["chars"] == documents.agg(F.sum(F.length("text"))).first()[0]
    assert records.count() == counts["records"].get()["rows"] == 3
    with pytest.raises(ValueError):
        Counts("never").get()


def test_no_job_of_their_own(spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("counted", "counted")
    try:
        counts = Counts("one")
        df = counts.of(spark.createDataFrame([("ok",), ("odd",), (None,), ("error",)], "status string"))
        df.write.format("noop").mode("overwrite").save()
        assert counts.get() == {"rows": 4, "ok": 1, "error": 1, "empty": 0, "missing": 0, "other": 2} and counts.by_state() == {"error": 1, "ok": 1, "other": 2}
        assert len(tracker.getJobIdsForGroup("counted")) == 1
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_stream_with_quarantine(spark, tmp_path, monkeypatch):
    """A run that stops between the two writes shows nothing of its batch; the next writes it under the same number."""
    place = tmp_path / "in"
    place.mkdir()
    paths = {k: f"file://{tmp_path}/{k}" for k in ("in", "out", "bad", "log", "checkpoint")}
    run = lambda: landing.stream_records(spark, paths["in"], paths["out"], paths["checkpoint"], quarantine=paths["bad"], log=paths["log"]).awaitTermination(120)
    read = lambda of: landing.read_batches(spark, paths[of], paths["log"])
    (place / "a.txt").write_text("Họ tên: An")
    (place / "b.txt").write_bytes(b"\xff\xfe")
    run()
    assert read("out").count() == 1 and [r.error for r in read("bad").collect()] == ["not UTF-8"]
    (place / "c.txt").write_text("Họ tên: Chi")
    (place / "d.txt").write_text("")
    (place / "e.txt").write_bytes(b"\xff")
    whole = landing.extract
    monkeypatch.setattr(landing, "extract", lambda *a, **b: 1 / 0)
    with pytest.raises(Exception):
        run()
    assert spark.read.parquet(paths["bad"]).count() > 1  # written, but not shown
    assert read("out").count() == 1 and read("bad").count() == 1
    monkeypatch.setattr(landing, "extract", whole)
    run()
    run()
    assert sorted(r["thong_tin_ca_nhan__ho_va_ten"] for r in read("out").collect()) == ["An", "Chi"] and read("bad").count() == 2
    assert spark.read.parquet(paths["bad"]).count() == 2 and sorted((r.documents, r.ok) for r in spark.read.json(paths["log"]).collect()) == [(2, 1), (2, 1)]
