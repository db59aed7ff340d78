"""Filling records, and pages: probe, routing, assembly."""

import json

import pytest
from pyspark.sql import functions as F

from formloom.operators import fill, pages
from formloom.plans import catalog

SMOKE, AGE, STATE = "chi_so_sinh_ly__hut_thuoc_la", "chi_so_sinh_ly__tuoi", "thong_tin_ca_nhan__trang_thai_ho_so"


def filled(spark, *texts, typed=True):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, js string")
    return {r.id: r for r in fill.filled(df, "js", ["id"], typed).collect()}


def test_not_objects(spark):
    for row in filled(spark, "{}", "[1]", "null", None, "", "no json", '"text"', '{"A_CHI_SO_SINH_LY_CO_BAN": 3}', '{"A_CHI_SO_SINH_LY_CO_BAN": [1]}').values():
        values = [row[catalog.flat_name(f)] for f in catalog.FIELDS]
        assert values.count(False) == 16 and values.count(None) == 23 and row[STATE] is None


def test_null_missing_and_mistyped(spark):
    text = json.dumps({"A_CHI_SO_SINH_LY_CO_BAN": {"hut_thuoc_la": None, "tuoi": "45", "x": 1}, "unknown": {}})
    assert (r := filled(spark, text)[0])[SMOKE] is None and r[AGE] == 45
    assert (r := filled(spark, text, typed=False)[0])[SMOKE] is None and r[AGE] == "45"
    assert filled(spark, '{"A_CHI_SO_SINH_LY_CO_BAN": {"tuoi": "x"}}')[0][AGE] is None


def test_one_bad_section_leaves_others(spark):
    row = filled(spark, '{"A_CHI_SO_SINH_LY_CO_BAN": 3, "CHI_SO_AND_TIEN_SU_SUC_KHOE": {"chieu_cao": 170}}')[0]
    assert row["chi_so_tien_su__chieu_cao"] == 170 and row[SMOKE] is False


def test_fill_is_idempotent(spark):
    from formloom.sinks import record_json

    df = spark.createDataFrame([(1, '{"A_CHI_SO_SINH_LY_CO_BAN": {"tuoi": 45}}')], "id int, js string")
    once = fill.filled(df, "js", ["id"])
    again = fill.filled(once.select("id", record_json().alias("js")), "js", ["id"])
    assert once.first() == again.first()


def test_fill_rows_agree(spark):
    given = spark.createDataFrame([("a", "THONG_TIN_CA_NHAN", "email", "drop"), ("a", "A_CHI_SO_SINH_LY_CO_BAN", "tuoi", "4"), ("a", "A_CHI_SO_SINH_LY_CO_BAN", "hut_thuoc_la", None)], "id string, section string, field string, value string")
    rows = {(r.section, r.field): r.value for r in fill.filled_rows(catalog.catalog_table(spark), given, "id").collect()}
    assert len(rows) == 39 and rows["A_CHI_SO_SINH_LY_CO_BAN", "tuoi"] == "4" and rows["A_CHI_SO_SINH_LY_CO_BAN", "hut_thuoc_la"] is None
    assert sum(v == "false" for v in rows.values()) == 15


def page_rows(spark, *texts):
    return spark.createDataFrame([("p", i + 1, t) for i, t in enumerate(texts)], "path string, page_num int, text string")


@pytest.mark.parametrize(("texts", "digital"), [(["x" * 11] * 4 + ["x" * 10], False), (["x" * 11] * 5 + [""], True), ([" " * 12], False), ([None], False), ([" " * 5 + "x" * 10 + "\n"], False), (["x" * 11], True)])
def test_probe(spark, texts, digital):
    assert pages.probe(page_rows(spark, *texts)).first().digital is digital


def test_probe_of_nothing(spark):
    assert pages.probe(spark.createDataFrame([], "path string, page_num int, text string")).count() == 0


def test_route(spark):
    probed = spark.createDataFrame([("a", True), ("b", False), ("c", None)], "path string, digital boolean")
    by_layer, by_image = pages.route(probed)
    assert [r.path for r in by_layer.collect()] == ["a"] and sorted(r.path for r in by_image.collect()) == ["b", "c"]
    by_layer, by_image = pages.route(probed, force_ocr=True)
    assert by_layer.count() == 0 and by_image.count() == 3


def test_assemble_in_numeric_order(spark):
    rows = spark.createDataFrame([("p", 10, "j"), ("p", 2, "b"), ("p", 1, "a"), ("q", 1, None)], "path string, page_num int, text string")
    made = {r.path: r.text for r in pages.assemble(rows).collect()}
    assert made == {"p": "=== TRANG 1 ===\na\n\n=== TRANG 2 ===\nb\n\n=== TRANG 10 ===\nj\n", "q": "=== TRANG 1 ===\n\n"}


def test_map_and_back(spark):
    rows = page_rows(spark, "a", "b", "")
    assert sorted(pages.from_map(pages.as_map(rows)).collect()) == sorted(rows.collect())


def test_lines_and_numbers(spark):
    df = spark.createDataFrame([("p", [" a", "b "]), ("q", []), ("r", None)], "path string, lines array<string>")
    assert {r.path: r.t for r in df.select("path", pages.join_lines(F.col("lines")).alias("t")).collect()} == {"p": "a\nb", "q": "", "r": ""}
    assert pages.number_pages(df, texts="lines").orderBy("page_num").collect()[0].page_num == 1


def test_seconds(spark):
    df = spark.createDataFrame([(3.0, 6), (1.0, 2)], "seconds double, pages int")
    assert tuple(pages.seconds_per_page(df).first()) == (4.0, 8, 0.5, 3.0)
    assert pages.seconds_per_page(df.where("false")).first().per_page is None


def test_last_of_repeated_keys(spark):
    name = "thong_tin_ca_nhan__ho_va_ten"
    rows = filled(spark, '{"THONG_TIN_CA_NHAN": {"ho_va_ten": "a", "ho_va_ten": "b"}}', '{"THONG_TIN_CA_NHAN": {"ho_va_ten": "a"}, "THONG_TIN_CA_NHAN": {}}', '{"THONG_TIN_CA_NHAN": {"ho_va_ten": "a", "ho_va_ten": null}}')
    assert [rows[i][name] for i in range(3)] == ["b", None, None]


def test_booleans_are_true_or_false(spark):
    text = '{"CHI_SO_SINH_LY": 1, "A_CHI_SO_SINH_LY_CO_BAN": {"hut_thuoc_la": %s}}'
    rows = filled(spark, *(text % x for x in ("true", "false", '"true"', '"yes"', "1", '"t"')))
    assert [rows[i][SMOKE] for i in range(6)] == [True, False, True, None, None, None]
    assert filled(spark, text % '"yes"', typed=False)[0][SMOKE] == "yes"
