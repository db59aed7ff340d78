"""Synthetic forms: document text made from the columns of ``customer``, to run the rules on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def form_text() -> Column:
    """The form of a row of ``customer``; k is its key."""
    k = F.col("c_custkey")
    s = lambda c: c.cast("string")
    case = lambda n, *options: F.element_at(F.array(*(o if isinstance(o, Column) else F.lit(o) for o in options)), (k % n + 1).cast("int"))
    year = s(F.lit(1940) + k % 60)
    illness = F.create_map(*(F.lit(x) for pair in {"BUILDING": "Xơ vữa động mạch", "AUTOMOBILE": "Đái tháo đường type 2", "MACHINERY": "Đột quỵ, nhồi máu cơ tim", "HOUSEHOLD": "Suy thận mạn", "FURNITURE": "Khỏe mạnh"}.items() for x in pair))
    tenths = k % 80 + 20
    lines = [
        F.lit("=== TRANG 1 ==="),
        case(2, F.concat(F.lit("Họ và tên: "), "c_name"), F.concat(F.lit("TRAN VAN BINH - BN"), s(k))),
        case(4, "GT: Nam", "Giới tính: nữ", "GIỚI TÍNH: KHÁC", "Giới tính: ?"),
        case(3, F.concat(F.lit("NS: "), year), F.concat(F.lit("Ngày sinh: 21/07/"), year), F.concat(F.lit("Tuổi: "), s(k % 90 + 1))),
        F.concat(F.lit("Địa chỉ: "), s(k), F.lit(" Lê Lợi - TP "), "c_mktsegment"),
        F.concat(F.lit("SĐT: 09"), F.lpad(s(k), 8, "0")),
        F.concat(F.lit("Email: u"), s(k), F.lit("@mail.example.com")),
        F.concat(F.lit("Chiều cao (cm): "), s(F.lit(140) + k % 50)),
        F.concat(F.lit("Cân nặng (kg): "), s(F.lit(40) + k % 60)),
        F.concat(F.lit("Huyết áp tâm thu: "), s(F.lit(100) + k % 80)),
        F.concat(F.lit("Chẩn đoán: "), F.coalesce(F.element_at(illness, F.col("c_mktsegment")), F.lit("?"))),
        F.lit("Cholesterol toàn phần*"),
        F.lit("H"),
        F.concat(s(F.expr("(c_custkey % 80 + 20) div 10")), F.lit("."), s(tenths % 10)),
        F.lit("HDL-Cholesterol"),
        F.concat(F.lit("1."), s(k % 10)),
        F.lit("eGFR"),
        F.concat(s(F.lit(30) + k % 90), F.lit(".9")),
        F.lit("ACR"),
        s(k % 300),
        F.concat(F.lit("Mã nhóm chăm sóc: G"), s(k)),
    ]
    return F.concat_ws("\n", *lines)


def forms(customer: DataFrame) -> DataFrame:
    """(c_custkey, text) of every customer."""
    return customer.select("c_custkey", form_text().alias("text"))
