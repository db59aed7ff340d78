"""Hand-derived cases of the extraction rules, layouts and their plan."""

import pytest
from pyspark.sql import functions as F

from formloom.operators import rules
from formloom.plans import catalog

NAME, AGE, SEX, SEX2 = "thong_tin_ca_nhan__ho_va_ten", "chi_so_sinh_ly__tuoi", "thong_tin_ca_nhan__gioi_tinh", "chi_so_sinh_ly__gioi_tinh"
BORN, ADDRESS, PROVINCE = "thong_tin_ca_nhan__ngay_sinh", "lien_he_dia_chi__dia_chi_day_du", "lien_he_dia_chi__tinh_thanh_pho"
PHONE, EMAIL, HEIGHT, WEIGHT = "lien_he_dia_chi__so_dien_thoai", "lien_he_dia_chi__email", "chi_so_tien_su__chieu_cao", "chi_so_tien_su__can_nang"
ILL, UNDER = "chi_so_tien_su__tien_su_benh_ly", "phan_loai_benh_nen__has_underlying_disease"
CHOL, HIGH, HDL = "chi_so_sinh_ly__cholesterol_toan_phan", "benh_ly_man_tinh__tang_cholesterol_mau_gia_dinh", "chi_so_sinh_ly__hdl_cholesterol"
D = "benh_ly_man_tinh__"

CASES = {
    "labelled": ("Họ và tên: Nguyễn Văn A\nGiới tính: Nam\nNgày sinh: 21/07/2000", {NAME: "Nguyễn Văn A", SEX: "Nam", SEX2: "Nam", BORN: "21/07/2000", AGE: 26}),
    "capitals": ("=== TRANG 1 ===\nTRAN VAN BINH - BN000123\nNS: 1958", {NAME: "TRAN VAN BINH", BORN: "01/01/1958", AGE: 68}),
    "capital not in class": ("NGUYỄN THỊ HỢP - BN000801164", {NAME: None}),
    "next line": ("Họ tên: \nGiới tính: Nam", {NAME: "Giới tính: Nam"}),
    "empty name": ("Họ tên: ", {NAME: ""}),
    "sixth line": ("a1\na2\na3\na4\na5\nTRAN VAN A", {NAME: None}),
    "fifth line": ("a1\na2\na3\na4\n  TRAN  VAN A \r", {NAME: "TRAN VAN A"}),
    "year zero": ("NS: 0000\nTuổi: 40", {BORN: "01/01/0", AGE: 40}),
    "leading zero": ("NS: 0950", {BORN: "01/01/950", AGE: 1076}),
    "no year after label": ("NS: 12/05/1970\nTuổi: 55", {BORN: None, AGE: 55}),
    "date unknown": ("Ngày sinh: không rõ\nTuổi: 61", {BORN: "không rõ", AGE: 61}),
    "sex": ("GT: nữ", {SEX: "Nữ", SEX2: "Nữ"}),
    "sex in capitals": ("GIỚI TÍNH: KHÁC", {SEX: "Khác", SEX2: "Khác"}),
    "address": ("Địa chỉ:\n12 Lê Lợi, Tỉnh Bắc Ninh", {ADDRESS: "12 Lê Lợi, Tỉnh Bắc Ninh", PROVINCE: "Bắc Ninh"}),
    "comma after province": ("Địa chỉ: 12 Lê Lợi, Tỉnh Bắc Ninh, VN", {PROVINCE: None}),
    "phone over lines": ("SĐT: 0912\n345 Lê Lợi", {PHONE: "0912 345"}),
    "phone empty": ("SĐT: +84912", {PHONE: ""}),
    "phone none": ("SĐT:+84912", {PHONE: None}),
    "email": ("write to a.b+1@ab-c.vn.", {EMAIL: "a.b+1@ab-c.vn."}),
    "size": ("Chiều cao (cm): 170.5\nNặng: 65.9", {HEIGHT: 170, WEIGHT: 65}),
    "unanchored": ("Huyết áp cao: 150", {HEIGHT: 150}),
    "no negation": ("Chẩn đoán: Không đái tháo đường", {D + "dai_thao_duong": True, UNDER: True, ILL: "Không đái tháo đường"}),
    "coronary": ("Chẩn đoán: Hội chứng mạch vành cấp", {D + "benh_ly_mach_vanh": True, D + "hoi_chung_vanh_cap": False, UNDER: True}),
    "kidney": ("Chẩn đoán: Suy thận mạn", {UNDER: True, D + "dai_thao_duong": False, D + "dot_quy_nao": False}),
    "not the diagnosis": ("Ghi chú: đái tháo đường", {UNDER: False, D + "dai_thao_duong": False, ILL: None}),
    "flag line": ("Cholesterol toàn phần*\nH\n6.15", {CHOL: 6.15, HIGH: True, UNDER: False}),
    "limit": ("Cholesterol toàn phần\n5.2", {CHOL: 5.2, HIGH: False}),
    "comma": ("Cholesterol toàn phần\n6,15", {CHOL: 6.0, HIGH: True}),
    "same line": ("Cholesterol toàn phần: 6.15\n3.9 - 5.2", {CHOL: 3.9, HIGH: False}),
    "non-hdl": ("Non-HDL-Cholesterol\n4.1\nHDL-Cholesterol\n1.5", {HDL: 4.1}),
    "truncated": ("eGFR (CKD-EPI)\n72.9\nACR\n15.8", {D + "egfr": 72, D + "acr": 15}),
    "egfr on its line": ("eGFR: 72\nml/min", {D + "egfr": None}),
    "pressure and group": ("SBP: 145\nMã nhóm chăm sóc: DG8F2K9Q1M", {"chi_so_sinh_ly__huyet_ap_tam_thu_sbp": 145, "nhom_cham_soc__ma_nhom_cham_soc": "DG8F2K9Q1M"}),
    "no-break space": ("Họ tên:\u00a0Lê\u00a0 B", {NAME: "Lê B"}),
    "information separators": ("Họ tên:\x1c\x1dLê\x1f B", {NAME: "Lê B"}),
    "carriage return": ("Họ tên: Lê B\r\nTuổi: 7\r\n", {NAME: "Lê B", AGE: 7}),
    "too large": ("Tuổi: 99999999999999999999", {AGE: None}),
    "decomposed": ("Ho\u0323 te\u0302n: A", {NAME: None}),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = spark.createDataFrame([(k, t) for k, (t, _) in CASES.items()] + [("empty", ""), ("null", None)], "id string, text string")
    return {r.id: r for r in rules.extract(rows, "text").collect()}


@pytest.mark.parametrize("case", CASES)
def test_case(found, case):
    assert {k: found[case][k] for k in CASES[case][1]} == CASES[case][1]


def test_defaults(found):
    wanted = {catalog.flat_name(f): f.default for f in catalog.FIELDS}
    for case in ("empty", "null"):
        assert {k: found[case][k] for k in wanted} == wanted


def test_counts():
    kinds = [f.type for f in catalog.FIELDS]
    assert [kinds.count(k) for k in ("boolean", "integer", "float", "string")] == [16, 6, 2, 15]
    assert len({catalog.flat_name(f) for f in catalog.FIELDS}) == 39 and len(catalog.SECTIONS) == 8


def test_reference_year(spark):
    df = spark.createDataFrame([("NS: 2000",)], "text string")
    assert rules.extract(df, "text", reference_year=2030).first()[AGE] == 30


def test_layouts(spark):
    df = spark.createDataFrame([(1, "Họ tên: A"), (2, None)], "id int, text string")
    flat = rules.extract(df, "text")
    back = rules.unnested(rules.nested(flat, ["id"]), ["id"])
    assert sorted(back.collect()) == sorted(flat.collect())
    rows = rules.long(flat, ["id"])
    assert rows.count() == 78 and rows.columns == ["id", "section", "field", "ordinal", "value"]
    assert rows.where("field = 'trang_thai_ho_so'").select("value").distinct().first().value == "Hoạt động"
    assert rules.nested(flat, ["id"], section_names=False).schema["record"].dataType.names == list(catalog.SECTIONS.values())
    assert [f.name for f in catalog.record_type()] == list(catalog.SECTIONS)


def test_plan(spark):
    df = spark.createDataFrame([(1, "x")], "id int, text string")
    full = rules.extract(df, "text")
    plan = full._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
    one = full.select("id", EMAIL)._jdf.queryExecution().optimizedPlan().toString()
    assert one.count("regexp_extract(") == 1


def test_same_for_any_partitions(spark):
    rows = spark.createDataFrame([(k, t) for k, (t, _) in CASES.items()], "id string, text string")
    flat = lambda n: sorted(map(str, rules.extract(rows.repartition(n), "text").collect()))
    assert flat(1) == flat(7)


def test_request_schema():
    made = catalog.request_schema(catalog.as_mapping())
    assert made["type"] == "OBJECT" and list(made["properties"]) == list(catalog.SECTIONS)
    sex = made["properties"]["A_CHI_SO_SINH_LY_CO_BAN"]["properties"]["gioi_tinh"]
    assert sex == {"type": "STRING", "description": "Giới tính của bệnh nhân", "enum": ["Nam", "Nữ"]}
    assert catalog.request_schema({"s": {"f": {"type": "Odd"}, "g": {}, "h": {"type": "FLOAT", "unit": "x"}}})["properties"]["s"]["properties"] == {"f": {"type": "STRING"}, "g": {"type": "STRING"}, "h": {"type": "NUMBER"}}


def test_catalog_rows(spark):
    rows = catalog.catalog_table(spark)
    assert rows.count() == 39 and rows.where(F.col("required")).count() == 8


def test_columns_of_the_table_may_have_any_name(spark):
    df = spark.createDataFrame([(1, "a", "b", "Địa chỉ: 1 Lê Lợi\nNS: 1980", 4)], "_t int, _address string, `_text` string, text string, `a.b` int")
    row = rules.extract(df, "text").first()
    assert tuple(row)[:4] == (1, "a", "b", 4) and row["lien_he_dia_chi__dia_chi_day_du"] == "1 Lê Lợi" and row["chi_so_sinh_ly__tuoi"] == 46
