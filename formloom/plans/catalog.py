"""The field catalogue: sections, fields and types, and the schemas made from it.

:func:`compiled` makes a :class:`Catalogue` of any JSON catalogue: sections of fields, and fields that are objects with
``properties`` of their own, to any depth. Filling, layouts and requests take one; :data:`CATALOGUE` is the built-in.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formloom.functions.text import named


@dataclass(frozen=True)
class FieldSpec:
    section: str
    name: str
    type: str  # boolean, integer, float or string
    description: str
    unit: str | None = None
    required: bool | None = None
    format: str | None = None
    enum: tuple[str, ...] | None = None
    #: What rule-based extraction gives without a match.
    default: bool | str | None = None


# Names, types, descriptions, units and enumerations of the record, in its order.
SECTIONS = {
    "PHAN_LOAI_BENH_LY_NEN": "phan_loai_benh_nen",
    "A_CHI_SO_SINH_LY_CO_BAN": "chi_so_sinh_ly",
    "TON_THUONG_CO_QUAN_DICH": "ton_thuong_co_quan",
    "C_BENH_LY_MAN_TINH_KEM_THEO": "benh_ly_man_tinh",
    "THONG_TIN_CA_NHAN": "thong_tin_ca_nhan",
    "THONG_TIN_LIEN_HE_AND_DIA_CHI": "lien_he_dia_chi",
    "CHI_SO_AND_TIEN_SU_SUC_KHOE": "chi_so_tien_su",
    "D_THONG_TIN_NHOM_CHAM_SOC": "nhom_cham_soc",
}
_B, _I, _F, _S = "boolean", "integer", "float", "string"
FIELDS = (
    FieldSpec("PHAN_LOAI_BENH_LY_NEN", "has_underlying_disease", _B, "True nếu 'Có bệnh lý nền', False nếu 'Không có bệnh lý nền'", default=False),
    FieldSpec("A_CHI_SO_SINH_LY_CO_BAN", "tuoi", _I, "Tuổi của bệnh nhân", unit="tuổi", required=True),
    FieldSpec("A_CHI_SO_SINH_LY_CO_BAN", "gioi_tinh", _S, "Giới tính của bệnh nhân", enum=("Nam", "Nữ"), required=True),
    FieldSpec("A_CHI_SO_SINH_LY_CO_BAN", "hut_thuoc_la", _B, "True nếu có hút thuốc lá (đang hút), False nếu không", required=True, default=False),
    FieldSpec("A_CHI_SO_SINH_LY_CO_BAN", "huyet_ap_tam_thu_sbp", _I, "Huyết áp tâm thu (SBP)", unit="mmHg", required=True),
    FieldSpec("A_CHI_SO_SINH_LY_CO_BAN", "cholesterol_toan_phan", _F, "Chỉ số Cholesterol toàn phần", unit="mmol/L", required=True),
    FieldSpec("A_CHI_SO_SINH_LY_CO_BAN", "hdl_cholesterol", _F, "Chỉ số HDL-Cholesterol", unit="mmol/L", required=True),
    FieldSpec("TON_THUONG_CO_QUAN_DICH", "phi_dai_that_trai", _B, "Có phì đại thất trái hay không", default=False),
    FieldSpec("TON_THUONG_CO_QUAN_DICH", "ton_thuong_day_mat", _B, "Có tổn thương đáy mắt hay không", default=False),
    FieldSpec("TON_THUONG_CO_QUAN_DICH", "albumin_microalbumin_nieu", _B, "Có Albumin / Microalbumin niệu hay không", default=False),
    FieldSpec("TON_THUONG_CO_QUAN_DICH", "ton_thuong_tham_lang_tren_nao", _B, "Có tổn thương thầm lặng trên não hay không", default=False),
    FieldSpec("C_BENH_LY_MAN_TINH_KEM_THEO", "egfr", _I, "Độ thanh thải cầu thận (eGFR)", unit="mL/min/1.73m²"),
    FieldSpec("C_BENH_LY_MAN_TINH_KEM_THEO", "acr", _I, "Tỷ lệ Albumin/Creatinin (ACR)", unit="mg/g"),
    FieldSpec("C_BENH_LY_MAN_TINH_KEM_THEO", "dai_thao_duong", _B, "Bệnh đái tháo đường (Diabetes)", default=False),
    FieldSpec("C_BENH_LY_MAN_TINH_KEM_THEO", "nhoi_mau_co_tim", _B, "Bệnh nhồi máu cơ tim", default=False),
    FieldSpec("C_BENH_LY_MAN_TINH_KEM_THEO", "benh_ly_mach_vanh", _B, "Bệnh lý mạch vành", default=False),
    FieldSpec("C_BENH_LY_MAN_TINH_KEM_THEO", "phinh_dong_mach_chu", _B, "Phình động mạch chủ", default=False),
    FieldSpec("C_BENH_LY_MAN_TINH_KEM_THEO", "vua_xo_mach_mau", _B, "Vữa xơ mạch máu", default=False),
    FieldSpec("C_BENH_LY_MAN_TINH_KEM_THEO", "dot_quy_nao", _B, "Đột quỵ não (Stroke)", default=False),
    FieldSpec("C_BENH_LY_MAN_TINH_KEM_THEO", "hoi_chung_vanh_cap", _B, "Hội chứng vành cấp", default=False),
    FieldSpec("C_BENH_LY_MAN_TINH_KEM_THEO", "thieu_mau_cuc_bo_nao_thoang_qua_tia", _B, "Thiếu máu cục bộ não thoáng qua (TIA)", default=False),
    FieldSpec("C_BENH_LY_MAN_TINH_KEM_THEO", "benh_mach_mau_ngoai_vi", _B, "Bệnh mạch máu ngoại vi", default=False),
    FieldSpec("C_BENH_LY_MAN_TINH_KEM_THEO", "tang_cholesterol_mau_gia_dinh", _B, "Tăng Cholesterol máu gia đình", default=False),
    FieldSpec("THONG_TIN_CA_NHAN", "ho_va_ten", _S, "Họ và tên bệnh nhân", required=True),
    FieldSpec("THONG_TIN_CA_NHAN", "ngay_sinh", _S, "Ngày sinh", format="dd/mm/yyyy"),
    FieldSpec("THONG_TIN_CA_NHAN", "gioi_tinh", _S, "Giới tính", enum=("Nam", "Nữ", "Khác")),
    FieldSpec("THONG_TIN_CA_NHAN", "cccd_cmnd", _S, "Mã số định danh CCCD/CMND"),
    FieldSpec("THONG_TIN_CA_NHAN", "trang_thai_ho_so", _S, "Trạng thái hồ sơ", enum=("Hoạt động", "Tạm dừng"), required=True, default="Hoạt động"),
    FieldSpec("THONG_TIN_LIEN_HE_AND_DIA_CHI", "so_dien_thoai", _S, "Số điện thoại liên hệ"),
    FieldSpec("THONG_TIN_LIEN_HE_AND_DIA_CHI", "email", _S, "Địa chỉ Email", format="email"),
    FieldSpec("THONG_TIN_LIEN_HE_AND_DIA_CHI", "tinh_thanh_pho", _S, "Tỉnh / Thành phố"),
    FieldSpec("THONG_TIN_LIEN_HE_AND_DIA_CHI", "quan_huyen", _S, "Quận / Huyện"),
    FieldSpec("THONG_TIN_LIEN_HE_AND_DIA_CHI", "so_nha_ten_duong", _S, "Số nhà, tên đường (Thôn, xóm)"),
    FieldSpec("THONG_TIN_LIEN_HE_AND_DIA_CHI", "dia_chi_day_du", _S, "Địa chỉ đầy đủ (tùy chỉnh hoặc kết hợp)"),
    FieldSpec("CHI_SO_AND_TIEN_SU_SUC_KHOE", "chieu_cao", _I, "Chiều cao", unit="cm"),
    FieldSpec("CHI_SO_AND_TIEN_SU_SUC_KHOE", "can_nang", _I, "Cân nặng", unit="kg"),
    FieldSpec("CHI_SO_AND_TIEN_SU_SUC_KHOE", "nhom_mau", _S, "Nhóm máu", enum=("A+", "A-", "B+", "B-", "O+", "O-", "AB+", "AB-")),
    FieldSpec("CHI_SO_AND_TIEN_SU_SUC_KHOE", "tien_su_benh_ly", _S, "Tiền sử bệnh / Bệnh lý hiện tại"),
    FieldSpec("D_THONG_TIN_NHOM_CHAM_SOC", "ma_nhom_cham_soc", _S, "Mã nhóm chăm sóc (Care Group Code) - Tùy chọn"),
)
#: Field types as a request for structured output names them; any other type is a string.
REQUEST_TYPES = {"string": "STRING", "integer": "INTEGER", "boolean": "BOOLEAN", "float": "NUMBER", "number": "NUMBER"}
# End of fixed values.

SPARK_TYPES = {"boolean": T.BooleanType(), "integer": T.LongType(), "float": T.DoubleType(), "number": T.DoubleType()}


def spark_type(kind: str) -> T.DataType:
    return SPARK_TYPES.get(kind.lower(), T.StringType())


def flat_name(field: FieldSpec) -> str:
    """The column of a field in the flat layout: two sections share a field name."""
    return f"{SECTIONS[field.section]}__{field.name}"


def of_section(section: str) -> list[FieldSpec]:
    return [f for f in FIELDS if f.section == section]


def record_type(section_names: bool = True) -> T.StructType:
    """A struct of sections; ``section_names=False`` gives the short names."""
    of = lambda s: T.StructType([T.StructField(f.name, spark_type(f.type), True, {k: v for k, v in (("unit", f.unit), ("format", f.format), ("enum", f.enum and list(f.enum))) if v}) for f in of_section(s)])
    return T.StructType([T.StructField(s if section_names else short, of(s)) for s, short in SECTIONS.items()])


def as_mapping() -> dict[str, dict[str, dict]]:
    """The catalogue as nested mappings: section, field, properties."""
    out: dict[str, dict[str, dict]] = {s: {} for s in SECTIONS}
    for f in FIELDS:
        given = {"type": f.type, "unit": f.unit, "required": f.required, "format": f.format, "enum": f.enum and list(f.enum), "description": f.description}
        out[f.section][f.name] = {k: v for k, v in given.items() if v is not None}
    return out


@dataclass(frozen=True)
class Entry:
    """A field of a compiled catalogue: where it stands in a record, its type, its column in the flat layout, and what the catalogue says of it."""

    path: tuple[str, ...]
    type: str
    column: str
    given: Mapping

    @property
    def field(self) -> str:
        """The name within the section; names of nested objects are parted by dots."""
        return ".".join(self.path[1:])


class Catalogue:
    """A compiled catalogue. ``tree``: sections, in them fields (:class:`Entry`) or nested objects, each a mapping."""

    def __init__(self, tree: dict):
        self.tree = tree
        self.entries = tuple(self._leaves(tree))
        names = [e.column.lower() for e in self.entries]
        if twice := sorted({n for n in names if names.count(n) > 1}):
            raise ValueError(f"several fields would be the column {twice[0]}; give sections other short names")

    @classmethod
    def _leaves(cls, tree: Mapping) -> Iterator[Entry]:
        for node in tree.values():
            if isinstance(node, Entry):
                yield node
            else:
                yield from cls._leaves(node)

    def objects(self) -> list[tuple[str, ...]]:
        """The paths of sections and nested objects, outer ones first."""
        found, todo = [], [((), self.tree)]
        for path, node in todo:
            inner = [((*path, name), x) for name, x in node.items() if not isinstance(x, Entry)]
            found += [p for p, _ in inner]
            todo += inner
        return found

    def request(self) -> dict:
        """A response schema for a remote extractor: types are mapped, descriptions and enumerations kept, the rest dropped."""

        def schema(node) -> dict:
            if isinstance(node, Entry):
                return {"type": REQUEST_TYPES.get(node.type.lower(), "STRING")} | {k: node.given[k] for k in ("description", "enum") if k in node.given}
            return {"type": "OBJECT", "properties": {name: schema(inner) for name, inner in node.items()}}

        return schema(self.tree)

    def struct(self) -> Column:
        """The nested record of the flat columns."""

        def column(node) -> Column:
            return named(node.column) if isinstance(node, Entry) else F.struct(*(column(inner).alias(name) for name, inner in node.items()))

        return column(self.tree)

    def record_type(self) -> T.StructType:
        def kind(node) -> T.DataType:
            return spark_type(node.type) if isinstance(node, Entry) else T.StructType([T.StructField(name, kind(inner)) for name, inner in node.items()])

        return kind(self.tree)

    def rows(self) -> Column:
        """An array with a row for each field of the flat columns: section, field, ordinal and the value as text."""
        return F.array(*(F.struct(F.lit(e.path[0]).alias("section"), F.lit(e.field).alias("field"), F.lit(i).alias("ordinal"), named(e.column).cast("string").alias("value")) for i, e in enumerate(self.entries)))


def compiled(catalogue: Mapping, short: Mapping[str, str] | None = None) -> Catalogue:
    """Compiles a JSON catalogue: section, field, properties. ``short``: names of sections in the names of flat columns.

    A field without a type is a string; a field with ``properties`` is a nested object. What isn't an object where one
    is needed, a type that isn't a text, and two fields of one column are errors.
    """

    def fields(path: tuple[str, ...], given) -> dict:
        if not isinstance(given, Mapping):
            raise ValueError(f"{'.'.join(path) or 'the catalogue'} is not an object")
        return {name: field((*path, name), inner) for name, inner in given.items()}

    def field(path: tuple[str, ...], given) -> Entry | dict:
        if len(path) == 1:
            return fields(path, given)
        if isinstance(given, Mapping) and isinstance(given.get("properties"), Mapping):
            return fields(path, given["properties"])
        if not isinstance(given, Mapping) or not isinstance(given.get("type", "string"), str):
            raise ValueError(f"{'.'.join(path)} has no type")
        return Entry(path, given.get("type", "string"), "__".join(((short or {}).get(path[0], path[0]), *path[1:])), given)

    return Catalogue(fields((), catalogue))


#: The built-in catalogue.
CATALOGUE = compiled(as_mapping(), SECTIONS)


def request_schema(catalogue: Mapping) -> dict:
    """The response schema of a JSON catalogue."""
    return compiled(catalogue).request()


CATALOG_TYPE = "section string, field string, ordinal int, type string, unit string, required boolean, format string, enum array<string>, description string"


def catalog_table(spark: SparkSession) -> DataFrame:
    """The catalogue as rows."""
    return spark.createDataFrame([(f.section, f.name, i, f.type, f.unit, f.required, f.format, f.enum and list(f.enum), f.description) for i, f in enumerate(FIELDS)], CATALOG_TYPE)
