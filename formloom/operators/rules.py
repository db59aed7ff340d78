"""Field extraction from document text: one projection, no Python code and no shuffle.

Every rule reads one text column and gives the first match of its pattern, null without a
match. Labels are not anchored, and white space after a label may include line breaks.
Patterns and word lists are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formloom.functions.text import contains_any, first_group, fresh, named, pattern, squish, strip, to_double, to_long, truncated
from formloom.plans.catalog import FIELDS, SECTIONS, FieldSpec, flat_name, of_section, spark_type

# The patterns of labelled fields.
NAME = r"(?:Họ và tên|Họ tên):\s*([^\n]+)"
NAME_LINE = r"^([A-ZÀÁÂÃÈÉÊÌÍÒÓÔÕÙÚÝĂĐĨŨƠƯ\s]+)(?:\s+-\s+BN\d+)?$"
GENDER = r"(?:GT|Giới tính):\s*(Nam|Nữ|Khác)"
BIRTH_YEAR = r"(?:NS|Năm sinh):\s*(\d{4})"
BIRTH_DATE = r"Ngày sinh:\s*([^\n]+)"
YEAR_AT_END = r"(\d{4})$"
AGE = r"Tuổi:\s*(\d+)"
ADDRESS = r"Địa chỉ:\s*\n?\s*([^\n]+)"
PROVINCE = r"(?:Tỉnh|TP)\s+([a-zA-ZÀ-ỹ\s]+)(?:-|$)"
PHONE = r"(?:Số điện thoại|SĐT|Điện thoại):\s*([0-9\s]+)"
EMAIL = r"([a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+)"
HEIGHT = r"(?:Chiều cao|Cao)\s*(?:\(cm\))?:\s*(\d+)"
WEIGHT = r"(?:Cân nặng|Nặng)\s*(?:\(kg\))?:\s*(\d+)"
DIAGNOSIS = r"Chẩn đoán:\s*\n?\s*([^\n]+)"
ON_LATER_LINE = r"[^\n]*\n(?:[A-Z\s]*\n)?\s*(\d+(?:\.\d+)?)"
CHOLESTEROL = "Cholesterol toàn phần" + ON_LATER_LINE
HDL = r"HDL(?:-|\s*)Cholesterol" + ON_LATER_LINE
EGFR = "(?:eGFR|Độ thanh thải cầu thận)" + ON_LATER_LINE
ACR = "(?:ACR|Tỷ lệ Albumin/Creatinin)" + ON_LATER_LINE
SYSTOLIC = r"(?:Huyết áp tâm thu|SBP):\s*(\d+)"
CARE_GROUP = r"(?:Care Group Code|Mã nhóm chăm sóc):\s*([a-zA-Z0-9]+)"
# What in a diagnosis sets a disease; the last sets no field of its own.
DISEASES = {
    "vua_xo_mach_mau": ["xơ vữa", "xo vua", "vữa xơ", "vữa sơ"],
    "dai_thao_duong": ["đái tháo đường", "đái đường", "tiểu đường", "diabetes"],
    "dot_quy_nao": ["đột quỵ", "tai biến mạch máu não", "stroke"],
    "nhoi_mau_co_tim": ["nhồi máu cơ tim"],
    "benh_ly_mach_vanh": ["mạch vành", "cơn đau thắt ngực", "ngực crnn"],
    None: ["suy thận"],
}
CHOLESTEROL_LIMIT = 5.2
HEAD_LINES = 5
REFERENCE_YEAR = 2026
# End of fixed values.


def labelled_name(text: Column) -> Column:
    return squish(first_group(text, NAME))


def head_line_name(text: Column, lines: int = HEAD_LINES) -> Column:
    """The first of the first lines that consists of capitals."""
    head = F.slice(F.split(text, "\n", -1), 1, lines)
    found = F.filter(F.transform(head, lambda x: F.regexp_extract(strip(x), pattern(NAME_LINE), 1)), lambda x: x != "")
    return squish(F.get(found, F.lit(0)))


def name(text: Column) -> Column:
    return F.coalesce(labelled_name(text), head_line_name(text))


def gender(text: Column) -> Column:
    found = F.lower(first_group(text, GENDER))
    return F.when(found == "nữ", "Nữ").when(found == "nam", "Nam").when(found.isNotNull(), "Khác")


def birth_year_label(text: Column) -> Column:
    return to_long(first_group(text, BIRTH_YEAR))


def stated_birth_date(text: Column) -> Column:
    return squish(first_group(text, BIRTH_DATE))


def birth_date(year: Column, stated: Column) -> Column:
    """From the year after its label, if there is one, else as stated."""
    return F.when(year.isNotNull(), F.concat(F.lit("01/01/"), year.cast("string"))).otherwise(stated)


def as_date(birth: Column) -> Column:
    """A date of birth as a date, null if it isn't one of day, month and year."""
    return F.try_to_date(birth, "dd/MM/yyyy")


def age(text: Column, year: Column, stated: Column, reference_year: int = REFERENCE_YEAR) -> Column:
    """From the year of birth, if there is one and it isn't 0, else as stated."""
    known = F.coalesce(year, to_long(first_group(stated, YEAR_AT_END, ignore_case=False)))
    return F.when(known != 0, F.lit(reference_year).cast("bigint") - known).otherwise(to_long(first_group(text, AGE)))


def address(text: Column) -> Column:
    return squish(first_group(text, ADDRESS))


def province(address_column: Column) -> Column:
    return squish(first_group(address_column, PROVINCE))


def phone(text: Column) -> Column:
    return squish(first_group(text, PHONE))


def email(text: Column) -> Column:
    # most text has no such sign, and looking for it is much cheaper than the pattern
    found = F.when(F.contains(text, F.lit("@")), F.regexp_extract(text, pattern(EMAIL), 1))
    return F.nullif(found, F.lit(""))


def height(text: Column) -> Column:
    return to_long(first_group(text, HEIGHT))


def weight(text: Column) -> Column:
    return to_long(first_group(text, WEIGHT))


def diagnosis(text: Column) -> Column:
    return squish(first_group(text, DIAGNOSIS))


def disease(diagnosis_column: Column, field: str | None) -> Column:
    return contains_any(F.lower(F.coalesce(diagnosis_column, F.lit(""))), DISEASES[field])


def underlying(diagnosis_column: Column) -> Column:
    return contains_any(F.lower(F.coalesce(diagnosis_column, F.lit(""))), [x for parts in DISEASES.values() for x in parts])


def extract(df: DataFrame, text: str = "text", reference_year: int = REFERENCE_YEAR, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all but the text) and the record in flat layout, one row for each row of ``df``.

    A null text is an empty one. Texts of intermediate results (address, diagnosis, birth year,
    cholesterol) feed several fields and are computed once.
    """
    keep = [c for c in df.columns if c != text] if keep is None else keep
    t = F.coalesce(named(text), F.lit(""))
    # what several fields need, once, under names that no kept column has
    several = {"address": address(t), "diagnosis": diagnosis(t), "gender": gender(t), "year": birth_year_label(t), "born": stated_birth_date(t), "cholesterol": to_double(first_group(t, CHOLESTEROL)), "text": t}
    names = {n: fresh(df, f"_{n}") for n in several}
    base = df.select(*map(named, keep), *(c.alias(names[n]) for n, c in several.items()))
    of = lambda n: F.col(names[n])
    t = of("text")
    rules: dict[str, Column] = {
        "has_underlying_disease": underlying(of("diagnosis")),
        "tuoi": age(t, of("year"), of("born"), reference_year),
        "gioi_tinh": of("gender"),
        "huyet_ap_tam_thu_sbp": to_long(first_group(t, SYSTOLIC)),
        "cholesterol_toan_phan": of("cholesterol"),
        "hdl_cholesterol": to_double(first_group(t, HDL)),
        "egfr": truncated(first_group(t, EGFR)),
        "acr": truncated(first_group(t, ACR)),
        "tang_cholesterol_mau_gia_dinh": F.coalesce(of("cholesterol") > CHOLESTEROL_LIMIT, F.lit(False)),
        "ho_va_ten": name(t),
        "ngay_sinh": birth_date(of("year"), of("born")),
        "so_dien_thoai": phone(t),
        "email": email(t),
        "tinh_thanh_pho": province(of("address")),
        "dia_chi_day_du": of("address"),
        "chieu_cao": height(t),
        "can_nang": weight(t),
        "tien_su_benh_ly": of("diagnosis"),
        "ma_nhom_cham_soc": first_group(t, CARE_GROUP),
    } | {field: disease(of("diagnosis"), field) for field in DISEASES if field}

    def value(f: FieldSpec) -> Column:
        return rules.get(f.name, F.lit(f.default)).cast(spark_type(f.type)).alias(flat_name(f))

    return base.select(*map(named, keep), *(value(f) for f in FIELDS))


def nested(flat: DataFrame, keep: list[str], section_names: bool = True, column: str = "record") -> DataFrame:
    """The record as a struct of sections."""
    sections = [F.struct(*(F.col(flat_name(f)).alias(f.name) for f in of_section(s))).alias(s if section_names else short) for s, short in SECTIONS.items()]
    return flat.select(*keep, F.struct(*sections).alias(column))


def long(flat: DataFrame, keep: list[str]) -> DataFrame:
    """One row for each field: section, field, ordinal and the value as text."""
    rows = F.array(*(F.struct(F.lit(f.section).alias("section"), F.lit(f.name).alias("field"), F.lit(i).alias("ordinal"), F.col(flat_name(f)).cast("string").alias("value")) for i, f in enumerate(FIELDS)))
    return flat.select(*keep, F.explode(rows).alias("r")).select(*keep, "r.*")


def unnested(records: DataFrame, keep: list[str], column: str = "record") -> DataFrame:
    """The flat layout of a struct of sections."""
    return records.select(*keep, *(F.col(f"{column}.{f.section}.{f.name}").alias(flat_name(f)) for f in FIELDS))
