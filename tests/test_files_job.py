"""Files, decoding with a stand-in backend, remote extraction, sinks, streaming and the service."""

import http.client
import json
import threading

import pytest
from pyspark.sql import functions as F

from formloom import job, sinks
from formloom.plans import catalog
from formloom.sources import decode, files, remote
from formloom.streaming import landing

NAME = "thong_tin_ca_nhan__ho_va_ten"


class FakeDocument:
    def __init__(self, content):
        self.pages = content.decode().split("|")

    def __len__(self):
        return len(self.pages) if self.pages != ["none"] else 0

    def text(self, page):
        if self.pages[page] == "boom":
            raise ValueError("bad page")
        return "" if self.pages[page].startswith("scan:") else self.pages[page]

    def image(self, page, zoom):
        return self.pages[page], zoom

    def close(self):
        pass


class FakeBackend:
    def open(self, content):
        if content.startswith(b"broken"):
            raise ValueError("not a pdf")
        return FakeDocument(content)

    def open_image(self, content):
        return content.decode(), 1.0

    def lines(self, image):
        if "fail" in image[0]:
            raise ValueError("no luck")
        return [f" {x}" for x in image[0].removeprefix("scan:").split("/") if x]

    def text(self, image, languages, command):
        if command == "absent":
            raise decode.EngineMissing("absent")
        return f" {image[0]} {languages} "


@pytest.fixture()
def folder(tmp_path):
    given = {
        "a.pdf": "Họ tên: An\nTuổi: 5|second page with text",
        "b.PDF": "scan:Họ tên: Bé/Tuổi: 6|scan:|scan:fail",
        "c.png": "Họ tên: Chi/x",
        "d.pdf": "broken",
        "e.pdf": "none",
        "empty.pdf": "",
        "mixed.Pdf": "not listed, mixed case",
        "f.txt": "not listed",
        "g.pdf": "long enough text here|boom",
    }
    for name, text in given.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "deeper").mkdir()
    (tmp_path / "deeper/h.pdf").write_text("not listed either")
    return tmp_path


def base(rows):
    return {r.path.rsplit("/", 1)[-1]: r for r in rows}


def test_kinds(spark):
    df = spark.createDataFrame([("a/x.TIFF",), ("x.tif",), ("x.Pdf",), ("x",), ("a.b/x",), ("/d/.pdf",), ("x.tar.gz",)], "path string")
    got = {r[0]: (r[1], r[2]) for r in df.select("path", files.extension(F.col("path")), files.kind(F.col("path"))).collect()}
    assert got == {"a/x.TIFF": (".tiff", "image"), "x.tif": (".tif", "pdf"), "x.Pdf": (".pdf", "pdf"), "x": ("", "pdf"), "a.b/x": ("", "pdf"), "/d/.pdf": ("", "pdf"), "x.tar.gz": (".gz", "pdf")}


def test_collect(spark, folder):
    found = base(files.collect_files(spark, [str(folder), str(folder), f"file:{folder}/mixed.Pdf", f"{folder}/gone.pdf"]).collect())
    assert sorted(found) == ["a.pdf", "b.PDF", "c.png", "d.pdf", "e.pdf", "g.pdf", "gone.pdf", "mixed.Pdf"]
    assert found["gone.pdf"].status == "missing" and found["c.png"].kind == "image" and found["a.pdf"].content.decode().startswith("Họ")
    assert files.collect_files(spark, []).count() == 0


def test_content_is_pruned(spark, folder):
    plan = files.read_files(spark, [str(folder)], content=False)._jdf.queryExecution().optimizedPlan().toString()
    assert files.read_files(spark, [str(folder)], content=False).columns == ["path", "modificationTime", "length"] and "content" not in plan.splitlines()[0]


def test_documents(spark, folder):
    found = files.collect_files(spark, [str(folder), f"{folder}/gone.pdf"])
    texts = base(decode.document_texts(found, FakeBackend).collect())
    assert texts["a.pdf"].text == "=== TRANG 1 ===\nHọ tên: An\nTuổi: 5\n\n=== TRANG 2 ===\nsecond page with text\n"
    assert texts["b.PDF"].text == "=== TRANG 1 ===\nHọ tên: Bé\n Tuổi: 6\n\n=== TRANG 2 ===\n\n\n=== TRANG 3 ===\n[Lỗi Trang 3]: no luck\n"
    assert texts["b.PDF"].status == "error" and texts["b.PDF"].error == "no luck" and texts["a.pdf"].status == "ok"
    assert texts["c.png"].text == "Họ tên: Chi\n x"
    assert texts["d.pdf"].text == texts["e.pdf"].text == texts["gone.pdf"].text == "" and texts["gone.pdf"].status == "missing"
    strict = base(decode.document_texts(found, FakeBackend, compatible=False).collect())
    assert "Lỗi" not in strict["b.PDF"].text and strict["b.PDF"].status == "error"


def test_probe_failure_means_images(spark, folder):
    """A document whose text layer can't be read has its images recognised."""
    texts = base(decode.document_texts(files.collect_files(spark, [str(folder)]), FakeBackend).collect())
    assert texts["g.pdf"].text == "=== TRANG 1 ===\nlong enough text here\n\n=== TRANG 2 ===\nboom\n" and texts["g.pdf"].status == "ok"


def test_engines(spark, folder):
    found = files.collect_files(spark, [f"{folder}/c.png", f"{folder}/a.pdf"])
    texts = base(decode.document_texts(found, FakeBackend, force_ocr=True, engine="tesseract").collect())
    assert texts["c.png"].text == "Họ tên: Chi/x vie+eng" and texts["a.pdf"].text.count("vie+eng") == 2
    texts = base(decode.document_texts(found, FakeBackend, force_ocr=True, engine="other", command="absent").collect())
    assert decode.NO_ENGINE in texts["a.pdf"].text and texts["a.pdf"].status == "error" and texts["c.png"].text == "[Lỗi OCR File Ảnh]: absent"


def test_library_backend_says_what_is_missing(spark, folder):
    try:
        import fitz  # noqa: F401
    except ImportError:
        rows = decode.page_counts(files.collect_files(spark, [f"{folder}/a.pdf"])).collect()
        assert rows[0].status == "error" and "fitz" in rows[0].error


def test_records(spark, folder, tmp_path):
    out = tmp_path / "out"
    documents, records = job.process(spark, [str(folder)], f"file://{out}", FakeBackend)
    found = base(records.collect())
    assert {k: v[NAME] for k, v in found.items()} == {"a.pdf": "An", "b.PDF": "Bé", "c.png": "Chi", "g.pdf": None}
    written = spark.read.parquet(f"file://{out}/texts")
    assert written.count() == 4 and {r.out_name.rsplit("/", 1)[-1] for r in written.collect()} == {"a_extracted.txt", "b_extracted.txt", "c_extracted.txt", "g_extracted.txt"}
    one = json.loads(spark.read.json(f"file://{out}/records").where("path like '%a.pdf'").first().record)
    assert len(one) == 8 and one["THONG_TIN_CA_NHAN"]["cccd_cmnd"] is None and sum(map(len, one.values())) == 39
    assert base(sinks.error_rows(documents).collect()).keys() == {"b.PDF", "d.pdf", "e.pdf"}



def test_collisions(spark):
    df = spark.createDataFrame([("x/a.pdf",), ("x/a.png",), ("y/a.pdf",), ("y/b.pdf",)], "path string")
    got = {r.path: r for r in sinks.named_outputs(df, "out").collect()}
    assert got["x/a.pdf"].out_name == got["y/a.pdf"].out_name == "out/a_extracted.txt" and not got["y/b.pdf"].collides
    assert len({r.unique_name for r in got.values()}) == 4
    beside = {r.path: r for r in sinks.named_outputs(df).collect()}
    assert beside["x/a.pdf"].collides and not beside["y/a.pdf"].collides and len({r.unique_name for r in beside.values()}) == 4


def test_progress(spark):
    df = spark.createDataFrame([(f"{i:03d}",) for i in range(50)], "path string").repartition(7)
    rows = files.with_progress(df).collect()
    assert sorted((r.path, r.idx, r.total) for r in rows) == [(f"{i:03d}", i + 1, 50) for i in range(50)]
    assert files.with_progress(df.where("false")).count() == 0


def reply(text):
    return json.dumps({"candidates": [{"content": {"parts": [{"text": text}]}}]})


def fake_transport(body, timeout):
    text = json.loads(body)["contents"][0]["parts"][0]["text"]
    assert timeout == 30 and text.startswith(remote.PROMPT)
    case = text.removeprefix(remote.PROMPT)
    if case == "down":
        raise ConnectionError("https://service/?key=secret")
    return {"good": (200, reply('{"THONG_TIN_CA_NHAN": {"ho_va_ten": "An"}}')), "500": (500, "oops"), "none": (200, "{}"), "empty": (200, reply("")), "bad": (200, reply("{x"))}[case]


def test_remote(spark):
    df = spark.createDataFrame([(x,) for x in ("good", "500", "none", "empty", "bad", "down")], "text string").withColumn("path", F.col("text"))
    rows = {r.path: r for r in remote.extract_remote(df, fake_transport, ["path"]).collect()}
    assert rows["good"].status == "ok" and rows["good"][NAME] == "An" and rows["good"]["phan_loai_benh_nen__has_underlying_disease"] is False
    assert rows["500"].error == "Lỗi gọi API (Status 500)" and rows["none"].error == remote.EMPTY_REPLY
    assert rows["empty"].error == rows["bad"].error == remote.FAILED and rows["down"].error == f"{remote.FAILED}: ConnectionError"
    assert all("secret" not in str(r) for r in rows.values())


def test_remote_is_off_without_key(spark, tmp_path, monkeypatch):
    monkeypatch.delenv("EXTRACTION_API_KEY", raising=False)
    assert not remote.usable(remote.api_key()) and not remote.usable("")
    (tmp_path / "key").write_text(" k1 \n")
    assert remote.api_key(file=str(tmp_path / "key")) == "k1" and remote.usable("k1")
    docs = spark.createDataFrame([("p", "Họ tên: A", "ok", None)], "path string, text string, status string, error string")
    assert job.records_of(docs, fake_transport, remote.api_key()).first()[NAME] == "A"
    with pytest.raises(FileNotFoundError, match="schema"):
        remote.read_catalogue(str(tmp_path / "no.json"))
    (tmp_path / "c.json").write_text(json.dumps(catalog.as_mapping(), ensure_ascii=False))
    assert remote.read_catalogue(str(tmp_path / "c.json")) == catalog.as_mapping()


def test_stream_reads_each_file_once(spark, tmp_path):
    landing_folder, out, checkpoint = tmp_path / "in", tmp_path / "out", tmp_path / "checkpoint"
    landing_folder.mkdir()
    run = lambda: landing.stream_records(spark, f"file://{landing_folder}", f"file://{out}", f"file://{checkpoint}").awaitTermination(120)
    (landing_folder / "a.txt").write_text("Họ tên: An")
    run()
    (landing_folder / "b.txt").write_text("Họ tên: Bé")
    run()
    run()
    assert sorted(r[NAME] for r in spark.read.parquet(f"file://{out}").collect()) == ["An", "Bé"]


def test_service(spark):
    server = job.serve(spark, port=0, make=FakeBackend)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        ask = lambda *a, **b: (c := http.client.HTTPConnection(*server.server_address), c.request(*a, **b), c.getresponse())[-1]
        assert json.loads(ask("GET", "/health").read()) == {"status": "healthy"}
        form = lambda text, **more: ("--B\r\n" + "".join(f'Content-Disposition: form-data; name="{k}"\r\n\r\n{v}\r\n--B\r\n' for k, v in more.items()) + f'Content-Disposition: form-data; name="file"; filename="x.pdf"\r\n\r\n{text}\r\n--B--\r\n').encode()
        head = {"Content-Type": "multipart/form-data; boundary=B"}
        answer = ask("POST", "/ocr", body=form("Họ tên: An ngồi đây", dpi=200, force_ocr="true"), headers=head)
        assert answer.status == 200 and json.loads(answer.read())["THONG_TIN_CA_NHAN"]["ho_va_ten"] == "An ngồi đây"
        assert ask("POST", "/ocr", body=form("broken"), headers=head).status == 500
        assert ask("POST", "/ocr", body=b"", headers=head).status == 422 and ask("GET", "/x").status == 404
    finally:
        server.shutdown()


def test_benchmark(spark, folder):
    table, met = job.benchmark(spark, f"{folder}/a.pdf", FakeBackend)
    rows = table.collect()
    assert [(r.run, r.pages) for r in rows] == [("cold", 2), ("warm", 2)] and rows[0].six_pages == pytest.approx(3 * rows[0].seconds) and isinstance(met, bool)
    table, met = job.benchmark(spark, f"{folder}/e.pdf", FakeBackend)
    assert not met and table.first().per_page is None


def test_timer_measures_failures():
    with pytest.raises(ValueError), job.timed("x") as measured:
        raise ValueError
    assert measured["seconds"] >= 0


def test_command_line_options():
    with pytest.raises(SystemExit):
        job.main(["x.pdf", "-e", "unknown"])


class CountingBackend(FakeBackend):
    """Notes every page that is recognised and every file that is opened, in files that all workers append to."""

    def __init__(self, folder):
        self.folder = folder

    def _note(self, name, what):
        with open(f"{self.folder}/{name}", "a") as f:
            f.write(f"{what}\n")

    def open(self, content):
        self._note("opened", content.decode().split("|")[0])
        return super().open(content)

    def lines(self, image):
        self._note("recognised", image[0])
        return super().lines(image)


class Counting:
    def __init__(self, folder):
        self.folder = folder

    def __call__(self):
        return CountingBackend(self.folder)

    def __eq__(self, other):
        return isinstance(other, Counting) and self.folder == other.folder

    def __hash__(self):
        return hash(self.folder)


def test_pages_are_recognised_once(spark, folder, tmp_path_factory):
    """One recognition a page, and one opening to probe and one for each range of pages."""
    notes = tmp_path_factory.mktemp("notes")
    (folder / "long.pdf").write_text("|".join(f"scan:page {i}" for i in range(19)))
    found = files.collect_files(spark, [str(folder)])
    texts = base(job.process(spark, [str(folder)], make=Counting(str(notes)))[0].collect())
    assert texts["long.pdf"].text.count("=== TRANG") == 19 and found.count() == 7
    recognised = (notes / "recognised").read_text().split("\n")[:-1]
    assert sorted(recognised) == sorted([f"scan:page {i}" for i in range(19)] + ["scan:Họ tên: Bé/Tuổi: 6", "scan:", "scan:fail", "long enough text here", "boom", "Họ tên: Chi/x"])
    opened = (notes / "opened").read_text().split("\n")[:-1]
    assert opened.count("scan:page 0") == 1 + 3  # the probe, and ranges of eight


def test_contents_are_not_exchanged(spark, folder):
    """No exchange of the plan, or of what it reads, carries file contents."""
    found = files.collect_files(spark, [str(folder), f"{folder}/a.pdf"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan and found.count() == 6
    seen = []

    def walk(node):
        if "Exchange" in node.nodeName():
            seen.append(node.output().toString())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(decode.document_texts(found, FakeBackend)._jdf.queryExecution().sparkPlan())
    job.process(spark, [str(folder)], make=FakeBackend)
    walk(decode.document_texts(found, FakeBackend)._jdf.queryExecution().executedPlan().initialPlan())
    assert len(seen) >= 2 and not any("content" in x for x in seen)


def test_files_for_each_document(spark, folder, tmp_path):
    """A text file and a JSON file by the documents' names, in a folder or beside them."""
    out = tmp_path / "out files"
    job.process(spark, [str(folder)], str(out), FakeBackend, layout="files")
    assert sorted(x.name for x in out.iterdir()) == sorted(f"{n}_extracted{e}" for n in "abcg" for e in (".txt", "_fields.json"))
    assert (out / "a_extracted.txt").read_text().startswith("=== TRANG 1 ===\nHọ tên: An")
    text = (out / "a_extracted_fields.json").read_text()
    assert json.loads(text)["THONG_TIN_CA_NHAN"]["ho_va_ten"] == "An" and text.startswith('{\n  "') and "Họ" not in text.split("\n")[0]
    job.process(spark, [f"{folder}/a.pdf"], None, FakeBackend, layout="files")
    assert (folder / "a_extracted.txt").exists() and (folder / "a_extracted_fields.json").exists()
    (folder / "a.png").write_text("Họ tên: Em")
    job.process(spark, [f"{folder}/a.pdf", f"{folder}/a.png"], str(tmp_path / "clash"), FakeBackend, layout="files")
    assert len(list((tmp_path / "clash").iterdir())) == 4


def test_worker_bound(spark):
    from formloom.operators import pages

    df = spark.createDataFrame([("a", 3), ("b", 20), ("c", 0), ("d", 1)], "path string, pages int")
    got = {}
    for r in pages.page_ranges(df, workers=4).collect():
        got.setdefault(r.path, []).append((r.first, r.n))
    assert {k: sorted(v) for k, v in got.items()} == {"a": [(0, 1), (1, 1), (2, 1)], "b": [(0, 5), (5, 5), (10, 5), (15, 5)], "d": [(0, 1)]}
    assert pages.page_ranges(df, at_once=8).where("path = 'b'").count() == 3
