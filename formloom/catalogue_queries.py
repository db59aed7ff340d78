"""Queries that show each operator on the given tables, with DuckDB SQL for all that SQL can express.

Forms are made from ``customer`` and read back by the rules; the SQL takes the expected values from
the columns that the forms were made of, so that it does not depend on any pattern.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formloom import page_queries, record_queries
from formloom.functions.text import first_group, pattern, squish, strip
from formloom.operators import fill, forms, pages, rules
from formloom.plans import catalog
from formloom.session import load, spread
from formloom.sources import decode, files, remote

KEY = "c_custkey"


def _flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.extract(forms.forms(spread(load(spark, sf_dir, "customer"))), "text")


def _fields(**columns: str):
    """A query of some fields of the record: result name = flat name."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _flat(spark, sf_dir).select(KEY, *(F.col(flat).alias(name) for name, flat in columns.items()))

    return query


# What the record should hold, by flat name, in terms of the columns of customer (k: the key).
_ILL = "CASE c_mktsegment WHEN 'BUILDING' THEN 'Xơ vữa động mạch' WHEN 'AUTOMOBILE' THEN 'Đái tháo đường type 2' WHEN 'MACHINERY' THEN 'Đột quỵ, nhồi máu cơ tim' WHEN 'HOUSEHOLD' THEN 'Suy thận mạn' WHEN 'FURNITURE' THEN 'Khỏe mạnh' ELSE '?' END"
_SEX = "CASE k % 4 WHEN 0 THEN 'Nam' WHEN 1 THEN 'Nữ' WHEN 2 THEN 'Khác' END"
_EXPECTED = {
    "phan_loai_benh_nen__has_underlying_disease": "c_mktsegment IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY', 'HOUSEHOLD')",
    "chi_so_sinh_ly__tuoi": "CASE WHEN k % 3 = 2 THEN k % 90 + 1 ELSE 2026 - (1940 + k % 60) END",
    "chi_so_sinh_ly__gioi_tinh": _SEX,
    "chi_so_sinh_ly__huyet_ap_tam_thu_sbp": "100 + k % 80",
    "chi_so_sinh_ly__cholesterol_toan_phan": "(k % 80 + 20) / 10.0::DOUBLE",
    "chi_so_sinh_ly__hdl_cholesterol": "('1.' || (k % 10))::DOUBLE",
    "benh_ly_man_tinh__egfr": "30 + k % 90",
    "benh_ly_man_tinh__acr": "k % 300",
    "benh_ly_man_tinh__dai_thao_duong": "c_mktsegment = 'AUTOMOBILE'",
    "benh_ly_man_tinh__nhoi_mau_co_tim": "c_mktsegment = 'MACHINERY'",
    "benh_ly_man_tinh__benh_ly_mach_vanh": "FALSE",
    "benh_ly_man_tinh__vua_xo_mach_mau": "c_mktsegment = 'BUILDING'",
    "benh_ly_man_tinh__dot_quy_nao": "c_mktsegment = 'MACHINERY'",
    "benh_ly_man_tinh__tang_cholesterol_mau_gia_dinh": "k % 80 + 20 > 52",
    "thong_tin_ca_nhan__ho_va_ten": "CASE WHEN k % 2 = 0 THEN c_name ELSE 'TRAN VAN BINH' END",
    "thong_tin_ca_nhan__ngay_sinh": "CASE k % 3 WHEN 0 THEN '01/01/' || (1940 + k % 60) WHEN 1 THEN '21/07/' || (1940 + k % 60) END",
    "thong_tin_ca_nhan__gioi_tinh": _SEX,
    "thong_tin_ca_nhan__trang_thai_ho_so": "'Hoạt động'",
    "lien_he_dia_chi__so_dien_thoai": "'09' || lpad(k::VARCHAR, 8, '0')",
    "lien_he_dia_chi__email": "'u' || k || '@mail.example.com'",
    "lien_he_dia_chi__tinh_thanh_pho": "c_mktsegment",
    "lien_he_dia_chi__dia_chi_day_du": "k || ' Lê Lợi - TP ' || c_mktsegment",
    "chi_so_tien_su__chieu_cao": "140 + k % 50",
    "chi_so_tien_su__can_nang": "40 + k % 60",
    "chi_so_tien_su__tien_su_benh_ly": _ILL,
    "nhom_cham_soc__ma_nhom_cham_soc": "'G' || k",
}
_SQL_TYPES = {"boolean": "BOOLEAN", "integer": "BIGINT", "float": "DOUBLE", "string": "VARCHAR"}


def _expected(flat: str) -> str:
    spec = next(f for f in catalog.FIELDS if catalog.flat_name(f) == flat)
    plain = "FALSE" if spec.default is False else "NULL"
    return f"CAST({_EXPECTED.get(flat, plain)} AS {_SQL_TYPES[spec.type]})"


def _fields_sql(**columns: str) -> str:
    return f"SELECT {KEY}, " + ", ".join(f"{_expected(flat)} AS {name}" for name, flat in columns.items()) + f" FROM (SELECT *, {KEY} AS k FROM customer)"


_BY_RULE = {
    "form_name": {"ho_va_ten": "thong_tin_ca_nhan__ho_va_ten"},
    "form_gender": {"gioi_tinh": "thong_tin_ca_nhan__gioi_tinh", "gioi_tinh_sinh_ly": "chi_so_sinh_ly__gioi_tinh"},
    "form_birth_age": {"ngay_sinh": "thong_tin_ca_nhan__ngay_sinh", "tuoi": "chi_so_sinh_ly__tuoi"},
    "form_address_province": {"dia_chi_day_du": "lien_he_dia_chi__dia_chi_day_du", "tinh_thanh_pho": "lien_he_dia_chi__tinh_thanh_pho"},
    "form_contact": {"so_dien_thoai": "lien_he_dia_chi__so_dien_thoai", "email": "lien_he_dia_chi__email"},
    "form_height_weight": {"chieu_cao": "chi_so_tien_su__chieu_cao", "can_nang": "chi_so_tien_su__can_nang"},
    "form_diagnosis_flags": {"tien_su_benh_ly": "chi_so_tien_su__tien_su_benh_ly", "has_underlying_disease": "phan_loai_benh_nen__has_underlying_disease"} | {f: f"benh_ly_man_tinh__{f}" for f in rules.DISEASES if f},
    "form_labs": {"cholesterol": "chi_so_sinh_ly__cholesterol_toan_phan", "hdl": "chi_so_sinh_ly__hdl_cholesterol", "egfr": "benh_ly_man_tinh__egfr", "acr": "benh_ly_man_tinh__acr", "high_cholesterol": "benh_ly_man_tinh__tang_cholesterol_mau_gia_dinh"},
    "form_sbp_caregroup": {"sbp": "chi_so_sinh_ly__huyet_ap_tam_thu_sbp", "ma_nhom_cham_soc": "nhom_cham_soc__ma_nhom_cham_soc"},
    "form_record_flat": {catalog.flat_name(f): catalog.flat_name(f) for f in catalog.FIELDS},
}


def form_name_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name by capitals alone: odd forms have such a line, even ones only the labelled name."""
    return forms.forms(spread(load(spark, sf_dir, "customer"))).select(KEY, rules.head_line_name(F.col("text")).alias("ho_va_ten"))


def form_record_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each customer and field."""
    return rules.long(_flat(spark, sf_dir), [KEY])


def _long_sql() -> str:
    one = "SELECT {key}, '{s}' AS section, '{f}' AS field, {i}::INTEGER AS ordinal, CAST({v} AS VARCHAR) AS value FROM c"
    rows = [one.format(key=KEY, s=f.section, f=f.name, i=i, v=_expected(catalog.flat_name(f))) for i, f in enumerate(catalog.FIELDS)]
    return f"WITH c AS (SELECT *, {KEY} AS k FROM customer) " + " UNION ALL ".join(rows)


def form_record_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested record and back: flat columns again."""
    return rules.unnested(rules.nested(_flat(spark, sf_dir), [KEY]), [KEY]).select(KEY, "thong_tin_ca_nhan__ho_va_ten", "chi_so_sinh_ly__tuoi", "benh_ly_man_tinh__egfr")


def form_birth_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of birth as dates, and whether a date was given."""
    born = F.col("thong_tin_ca_nhan__ngay_sinh")
    return _flat(spark, sf_dir).select(KEY, rules.as_date(born).alias("born"), born.isNotNull().alias("given"))


def doc_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", rules.email(F.col("text")).alias("email")).where(F.col("email").isNotNull())


def doc_allcaps_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line of capitals among the first five of each document, punctuation aside."""
    return load(spark, sf_dir, "documents").select("doc_id", rules.head_line_name(F.translate("text", "!.,", "")).alias("head")).where(F.col("head").isNotNull())


def doc_squish(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return load(spark, sf_dir, "documents").select("doc_id", F.length(squish(text)).cast("long").alias("squished"), F.md5(squish(text).cast("binary")).alias("digest"), F.length(strip(text)).cast("long").alias("stripped"))


def doc_lines_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five lines of every document, numbered from 1."""
    head = load(spark, sf_dir, "documents").select("doc_id", F.slice(F.split("text", "\n", -1), 1, rules.HEAD_LINES).alias("texts"))
    return pages.number_pages(head, "doc_id").select("doc_id", F.col("page_num").alias("line"), "text")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("path"), (F.col("turn") + 1).cast("int").alias("page_num"), "text")


def page_digital_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.probe(_pages(spark, sf_dir), least=200)


def page_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.assemble(_pages(spark, sf_dir)).select("path", F.length("text").cast("long").alias("chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


def page_map_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.from_map(pages.as_map(_pages(spark, sf_dir)))


def route_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_layer, by_image = pages.route(pages.probe(_pages(spark, sf_dir), least=200))
    return by_layer.select("path", F.lit("digital").alias("route")).unionByName(by_image.select("path", F.lit("ocr").alias("route")))


def route_single_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routing by page, as may be chosen instead."""
    return _pages(spark, sf_dir).select("path", "page_num", pages.route_pages(F.col("text"), least=200).alias("route"))


def ocr_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised lines (here: those of turns) as a page's text."""
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", F.length(pages.join_lines(F.split("text", "\n", -1))).cast("long").alias("chars"))


def page_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds a page and for six pages by the whole time that pages took: each event is a page, and its value the seconds."""
    events = load(spark, sf_dir, "events").select("user_id", F.round(F.col("value") * 100).cast("long").alias("hundredths"))
    runs = events.groupBy("user_id").agg(F.count("*").cast("int").alias("pages"), (F.sum("hundredths") / 100).alias("seconds"))
    return pages.seconds_per_page(runs.select("pages", F.round("seconds").alias("seconds")))


_JSON = """concat('{', '"A_CHI_SO_SINH_LY_CO_BAN":',
    CASE k % 5 WHEN 0 THEN '3' WHEN 1 THEN '{}' WHEN 2 THEN concat('{"tuoi":"', CAST(k AS STRING), '","x":NaN}') ELSE concat('{"tuoi":', CAST(k AS STRING), ',"hut_thuoc_la":', CASE WHEN k % 5 = 3 THEN 'null' WHEN k % 10 = 4 THEN 'true' ELSE '"yes"' END, '}') END,
    CASE WHEN k % 7 = 1 THEN ',"THONG_TIN_CA_NHAN":{"ho_va_ten":"of a section before"}' ELSE '' END,
    ',"THONG_TIN_CA_NHAN":{', CASE WHEN k % 7 IN (1, 2) THEN '"ho_va_ten":"first",' ELSE '' END, '"ho_va_ten":"', c_name, '"}}', CASE k % 11 WHEN 5 THEN ' zz' WHEN 6 THEN ' \\n' ELSE '' END)"""


def _json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(load(spark, sf_dir, "customer")).withColumn("k", F.col(KEY)).select(KEY, F.expr(_JSON).alias("json"))


def fill_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with missing, null, mistyped, unknown and repeated fields and repeated sections, and texts that only Python or only others take for JSON, filled."""
    return fill.filled(_json(spark, sf_dir), "json", [KEY]).select(KEY, F.col("chi_so_sinh_ly__tuoi").alias("tuoi"), F.col("chi_so_sinh_ly__hut_thuoc_la").alias("hut_thuoc_la"), F.col("thong_tin_ca_nhan__ho_va_ten").alias("ho_va_ten"), F.col("thong_tin_ca_nhan__trang_thai_ho_so").alias("trang_thai"), F.col("benh_ly_man_tinh__dot_quy_nao").alias("dot_quy_nao"))


def fill_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a join of the catalogue with given fields: counts of filled values by field."""
    given = load(spark, sf_dir, "customer").select(KEY, F.lit("THONG_TIN_CA_NHAN").alias("section"), F.when(F.col(KEY) % 2 == 0, "ho_va_ten").otherwise("unknown").alias("field"), F.col("c_name").alias("value"))
    rows = fill.filled_rows(catalog.catalog_table(spark), given, KEY)
    return rows.groupBy("section", "field").agg(F.count("*").alias("n"), F.count("value").alias("n_set"))


def props_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of events as a section of the record, where some have a field of the catalogue: counts by type of event."""
    section = F.concat(F.lit('{"A_CHI_SO_SINH_LY_CO_BAN":'), F.when(F.col("value") > 20, F.replace("props", F.lit('"k"'), F.lit('"tuoi"'))).otherwise(F.col("props")), F.lit("}"))
    flat = fill.filled(spread(load(spark, sf_dir, "events")).select("event_type", section.alias("record")), "record", ["event_type"])
    age = F.col("chi_so_sinh_ly__tuoi")
    return flat.groupBy("event_type").agg(F.count("*").alias("n"), F.count(age).alias("n_tuoi"), F.sum(age).alias("sum_tuoi"), F.count_if(~F.col("chi_so_sinh_ly__hut_thuoc_la")).alias("n_false"))


def catalog_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type that a request names for what a catalogue says, by a lookup with a default; here segments and types of parts stand in it, too."""
    lookup = F.create_map(*(F.lit(x) for pair in catalog.REQUEST_TYPES.items() for x in pair))
    names = F.array(*map(F.lit, ("Integer", "FLOAT", "string", "boolean", "number", "odd")), F.col("c_mktsegment"), F.lit(None).cast("string"))
    said = load(spark, sf_dir, "customer").select(KEY, F.element_at(names, (F.col(KEY) % 8 + 1).cast("int")).alias("said"))
    return said.select(KEY, "said", F.coalesce(F.element_at(lookup, F.lower("said")), F.lit("STRING")).alias("request_type"))


_PATHS = "concat('d/', CAST(c_custkey AS STRING), element_at(array('.pdf', '.PDF', '.Png', '.TIFF', '.tif', '.jpeg', '', '.tar.gz'), CAST(c_custkey % 8 + 1 AS INT)))"


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").select(KEY, F.expr(_PATHS).alias("path"))


def file_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths, listed twice and then once, with extension, kind and output name."""
    listed = _paths(spark, sf_dir).select("path")
    once = files.distinct_sorted(listed.union(listed))
    return once.select("path", files.extension(F.col("path")).alias("ext"), files.kind(F.col("path")).alias("kind"), files.base_name(F.col("path")).alias("base"))


def output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of outputs, where a third of the files collide with the one before by extension only."""
    from formloom import sinks

    k = F.col(KEY)
    named = load(spark, sf_dir, "customer").select(F.concat(F.lit("in/"), (k - k % 3 / 2).cast("long").cast("string"), F.when(k % 3 == 2, ".png").otherwise(".pdf")).alias("path"))
    return sinks.named_outputs(named, "out").select("path", "out_name", "collides")


def dataset_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.with_progress(load(spark, sf_dir, "customer").select(F.col("c_name").alias("path")))


def missing_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without label, as requested paths without file."""
    return files.missing(load(spark, sf_dir, "documents").select("doc_id"), load(spark, sf_dir, "labels").select("doc_id"), "doc_id")


def paths_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of a table, looked up by tasks: two of the given tables, and one that doesn't exist for every third customer."""
    k = F.col(KEY)
    name = F.when(k % 3 == 0, "customer.parquet").when(k % 3 == 1, "orders.parquet").otherwise(F.concat(F.lit("gone-"), k.cast("string"), F.lit(".pdf")))
    asked = load(spark, sf_dir, "customer").select(F.concat(F.lit(f"{sf_dir}/"), name).alias("path"))
    return files.looked_up(asked).select(files.base_name(F.col("path")).alias("name"), "found")


def record_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with an address in their text, by quality label."""
    docs = load(spark, sf_dir, "documents").select("doc_id", rules.email(F.col("text")).isNotNull().alias("has_email"))
    joined = docs.join(load(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return joined.groupBy("quality").agg(F.count("*").alias("documents"), F.count_if("has_email").alias("with_email"))


def any_underlying(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether any record of a segment has an underlying disease."""
    found = _flat(spark, sf_dir).join(load(spark, sf_dir, "customer").select(KEY, "c_mktsegment"), KEY)
    return found.groupBy("c_mktsegment").agg(F.bool_or("phan_loai_benh_nen__has_underlying_disease").alias("any_underlying"), F.count("*").alias("records"))


def scaled_zoom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The zoom of a page rendered at a resolution."""
    return load(spark, sf_dir, "customer").select(KEY, ((F.lit(72) + F.col(KEY) % 150).cast("double") / decode.POINTS_PER_INCH).alias("zoom"))


def label_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule on real text: the first number after a colon, if any."""
    return load(spark, sf_dir, "documents").select("doc_id", first_group(F.col("text"), r":\s*(\d+)").alias("number"), F.col("text").rlike(pattern(r":\s*\d")).alias("matches"))


def doc_allcaps_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents under a line of capitals, which stands first, fourth or sixth (too late) for a third of them each, with a number after it or not."""
    line = F.concat(F.lit("  TRAN VĂN "), F.element_at(F.array(F.lit("AN"), F.lit("  BA  LÊ"), F.lit("Ơ - BN12")), (F.col("doc_id") % 3 + 1).cast("int")))
    before = F.element_at(F.array(F.lit(""), F.lit("a\n1\n?\n"), F.lit("a\nb\nc\nd\ne\n")), (F.col("doc_id") % 9 / 3 + 1).cast("int"))
    marked = load(spark, sf_dir, "documents").select("doc_id", F.concat(before, line, F.lit("\nx\n"), "text").alias("text"))
    return marked.select("doc_id", rules.head_line_name(F.col("text")).alias("head"))


def page_probe_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The probe at its own threshold, on texts cut to 0 to 20 characters."""
    cut = _pages(spark, sf_dir).withColumn("text", F.substring(F.col("text"), F.lit(1), ((F.col("path") + F.col("page_num")) % 21).cast("int")))
    return pages.probe(cut)


def page_worker_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of pages by workers: as many as pages or workers, whichever are fewer."""
    counts = load(spark, sf_dir, "customer").select(F.col(KEY).alias("path"), (F.col(KEY) % 23).cast("int").alias("pages"))
    return pages.page_ranges(counts, workers=4).select("path", "first", "n")


def remote_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The body of the request for a text with quotes, breaks and letters beyond ASCII."""
    text = F.concat(F.lit('Họ tên: "'), "c_name", F.lit('"\n\\\t'))
    body = remote.request_body(text)
    return load(spark, sf_dir, "customer").select(KEY, F.length(body).cast("long").alias("chars"), F.md5(body.cast("binary")).alias("digest"))


_REPLIES = """CASE k % 10 WHEN 0 THEN concat('{"candidates":[{"content":{"parts":[{"text":"{\\\\"THONG_TIN_CA_NHAN\\\\":{\\\\"ho_va_ten\\\\":\\\\"', c_name, '\\\\"}}"}]}}]}')
    WHEN 1 THEN 'oops' WHEN 2 THEN '{"candidates":[]}' WHEN 3 THEN '{"candidates":[{"content":{"parts":[{"text":""}]}}]}' WHEN 4 THEN '{"candidates":[{"content":{"parts":[{"text":"{x"}]}}]}' WHEN 5 THEN NULL
    WHEN 6 THEN concat('{"candidates":0,"candidates":[{"content":{"parts":[{"text":"{\\\\"THONG_TIN_CA_NHAN\\\\":3,\\\\"THONG_TIN_CA_NHAN\\\\":{\\\\"ho_va_ten\\\\":\\\\"x\\\\",\\\\"ho_va_ten\\\\":\\\\"', c_name, '\\\\"}}"}]}}]}')
    WHEN 7 THEN concat('{"candidates":[{"content":{"parts":[{"text":"{\\\\"THONG_TIN_CA_NHAN\\\\":{\\\\"ho_va_ten\\\\":\\\\"', c_name, '\\\\"}} zz"}]}}]}')
    WHEN 8 THEN concat('{"candidates":[{"content":{"parts":[{"text":"{\\\\"A_CHI_SO_SINH_LY_CO_BAN\\\\":{\\\\"cholesterol_toan_phan\\\\":NaN,\\\\"tuoi\\\\":', CAST(k AS STRING), '}}"}]}}]}')
    ELSE '{"candidates":[{"content":{"parts":[{"text":"[1]"}]}}]}' END"""


def remote_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of a service unpacked: good, a status of error, none, empty, not JSON, not connected, repeated keys, text after the JSON, NaN, JSON that is no record."""
    k = F.col(KEY)
    replies = spread(load(spark, sf_dir, "customer")).withColumn("k", k).select(KEY, F.when(k % 10 == 1, 500 + k % 4).when(k % 10 != 5, 200).cast("int").alias("http_status"), F.expr(_REPLIES).alias("body"), F.when(k % 10 == 5, "Timeout").alias("error"))
    found = remote.unpacked(replies, [KEY])
    return found.select(KEY, "status", "error", F.col("thong_tin_ca_nhan__ho_va_ten").alias("ho_va_ten"), F.col("phan_loai_benh_nen__has_underlying_disease").alias("has_underlying_disease"), F.col("chi_so_sinh_ly__tuoi").alias("tuoi"))


def record_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record as JSON with every key, nulls included."""
    from formloom import sinks

    text = sinks.record_json()
    return _flat(spark, sf_dir).select(KEY, F.length(text).cast("long").alias("chars"), F.md5(text.cast("binary")).alias("digest"))


def output_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a service answers with an error: documents without text or that failed."""
    from formloom import sinks

    k = F.col("doc_id")
    docs = load(spark, sf_dir, "documents").select(k.cast("string").alias("path"), F.when(k % 5 != 0, F.col("text")).otherwise("").alias("text"), F.when(k % 3 == 0, "error").otherwise("ok").alias("status"), F.when(k % 6 == 0, "no luck").alias("error"))
    return sinks.error_rows(docs)


_WORDS = [w for words in rules.DISEASES.values() for w in words]


def form_diseases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word that sets a disease, in turn, in lower or upper case, in a diagnosis on the label's line or the next."""
    k = F.col(KEY)
    word = F.element_at(F.array(*map(F.lit, _WORDS)), (k % len(_WORDS) + 1).cast("int"))
    word = F.when(k % 2 == 0, word).otherwise(F.upper(word))
    text = F.concat(F.lit("Chẩn đoán:"), F.when(k % 3 == 0, "\n").otherwise(" "), F.lit("theo dõi "), word, F.lit(" nhẹ\nTuổi: 5"))
    flat = rules.extract(load(spark, sf_dir, "customer").select(KEY, text.alias("text")), "text")
    return flat.select(KEY, F.col("phan_loai_benh_nen__has_underlying_disease").alias("has_underlying_disease"), *(F.col(f"benh_ly_man_tinh__{f}").alias(f) for f in rules.DISEASES if f))


_LABELS = {
    "ho_va_ten": (["Họ và tên: ", "Họ tên: ", "HỌ TÊN:"], "thong_tin_ca_nhan__ho_va_ten"),
    "gioi_tinh": (["GT: ", "Giới tính: ", "gt:"], "thong_tin_ca_nhan__gioi_tinh"),
    "so_dien_thoai": (["Số điện thoại: ", "SĐT: ", "Điện thoại:"], "lien_he_dia_chi__so_dien_thoai"),
    "chieu_cao": (["Chiều cao (cm): ", "Cao: ", "Cao (cm):"], "chi_so_tien_su__chieu_cao"),
    "can_nang": (["Cân nặng (kg): ", "Nặng: ", "Cân nặng:"], "chi_so_tien_su__can_nang"),
    "sbp": (["Huyết áp tâm thu: ", "SBP: ", "sbp:"], "chi_so_sinh_ly__huyet_ap_tam_thu_sbp"),
    "ma_nhom_cham_soc": (["Mã nhóm chăm sóc: ", "Care Group Code: ", "care group code:"], "nhom_cham_soc__ma_nhom_cham_soc"),
    "tinh_thanh_pho": (["Địa chỉ: 1 Lê Lợi - TP ", "Địa chỉ: 1 Lê Lợi - Tỉnh ", "Địa chỉ:\n1 Lê Lợi - tỉnh "], "lien_he_dia_chi__tinh_thanh_pho"),
}
_VALUES = {"ho_va_ten": "c_name", "gioi_tinh": "CASE WHEN k % 2 = 0 THEN 'Nam' ELSE 'Khác' END", "so_dien_thoai": "'09' || lpad(CAST(k AS VARCHAR(9)), 8, '0')", "chieu_cao": "140 + k % 50", "can_nang": "40 + k % 60", "sbp": "100 + k % 80", "ma_nhom_cham_soc": "'G' || k", "tinh_thanh_pho": "'Cao ' || c_mktsegment"}


def form_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every wording of the labels that have several, in turn, with and without a space and in other cases."""
    customers = load(spark, sf_dir, "customer").withColumn("k", F.col(KEY))
    lines = [F.concat(F.element_at(F.array(*map(F.lit, labels)), (F.col("k") % 3 + 1).cast("int")), F.expr(_VALUES[name]).cast("string")) for name, (labels, _) in _LABELS.items()]
    flat = rules.extract(customers.select(KEY, F.concat_ws("\n", *lines).alias("text")), "text")
    return flat.select(KEY, *(F.col(flat_name).alias(name) for name, (_, flat_name) in _LABELS.items()))


def service_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each source of documents: healthy if all of its documents have a text, with what a service answers."""
    from formloom.job import health

    found = load(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("documents"), F.count_if(F.length("text") > 0).alias("with_text"))
    return found.join(F.broadcast(health(spark)), F.col("documents") == F.col("with_text"), "left").withColumn("status", F.coalesce("status", F.lit("incomplete")))


QUERIES = {name: _fields(**columns) for name, columns in _BY_RULE.items()} | {
    f.__name__: f
    for f in (
        form_name_fallback, form_record_long, form_record_nested, form_birth_dates, doc_emails, doc_allcaps_head, doc_squish, doc_lines_topk, page_digital_ratio, page_assemble, page_map_roundtrip, route_documents,
        route_single_pages, ocr_lines, page_seconds, fill_defaults, fill_rows, props_fill, catalog_types, file_kind, output_names, dataset_progress, missing_paths, paths_found, record_quality, any_underlying, scaled_zoom, label_lookup, service_health,
        doc_allcaps_marked, page_probe_default, page_worker_ranges, remote_request, remote_replies, record_json, output_errors, form_diseases, form_labels,
    )
}

_WHITE = r"[\s\p{Z}]"
_EMAIL = rules.EMAIL
_CAPS = rules.NAME_LINE.replace(r"\s", r"\s\p{Z}").replace(r"(?:\s\p{Z}+-\s\p{Z}+BN\d+)", r"(?:[\s\p{Z}]+-[\s\p{Z}]+BN\d+)")
_PROBE = "SELECT conv_id AS path, count(*) AS pages, count(*) FILTER (WHERE length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) > 200) AS digital_pages FROM conversations GROUP BY 1"


def _request_sql() -> str:
    """The request as text: JSON escapes what stands before and after a name."""
    import json

    quote = lambda x: "'" + x.replace("'", "''") + "'"
    before, after = (json.dumps(x, ensure_ascii=False)[1:-1] for x in (remote.PROMPT + 'Họ tên: "', '"\n\\\t'))
    schema = json.dumps(catalog.request_schema(catalog.as_mapping()), ensure_ascii=False)
    return " || ".join((quote('{"contents":[{"parts":[{"text":"' + before), "c_name", quote(after + '"}]}],"generationConfig":{"responseMimeType":"application/json","responseSchema":' + schema + "}}")))


def _record_sql() -> str:
    """The record's JSON, member by member."""

    def member(f: catalog.FieldSpec) -> str:
        value = _expected(catalog.flat_name(f))
        text = f"'\"' || {value} || '\"'" if f.type == "string" else f"CAST({value} AS VARCHAR)"
        return f"'\"{f.name}\":' || coalesce({text}, 'null')"

    sections = ["'\"" + s + "\":{' || " + " || ',' || ".join(member(f) for f in catalog.of_section(s)) + " || '}'" for s in catalog.SECTIONS]
    return "'{' || " + " || ',' || ".join(sections) + " || '}'"


def _diseases_sql() -> str:
    """Which disease a customer's word sets, by its place in the list of words."""
    at, columns = 0, []
    for field, words in rules.DISEASES.items():
        if field:
            columns.append(f"c_custkey % {len(_WORDS)} BETWEEN {at} AND {at + len(words) - 1} AS {field}")
        at += len(words)
    return f"SELECT {KEY}, TRUE AS has_underlying_disease, {', '.join(columns)} FROM customer"


QUERIES |= record_queries.QUERIES | page_queries.QUERIES

ORACLES = {name: _fields_sql(**columns) for name, columns in _BY_RULE.items()} | {
    "form_name_fallback": f"SELECT {KEY}, CASE WHEN {KEY} % 2 = 1 THEN 'TRAN VAN BINH' END AS ho_va_ten FROM customer",
    "form_record_long": _long_sql(),
    "form_record_nested": _fields_sql(**{x: x for x in ("thong_tin_ca_nhan__ho_va_ten", "chi_so_sinh_ly__tuoi", "benh_ly_man_tinh__egfr")}),
    "form_birth_dates": f"SELECT {KEY}, CASE {KEY} % 3 WHEN 0 THEN make_date(1940 + {KEY} % 60, 1, 1) WHEN 1 THEN make_date(1940 + {KEY} % 60, 7, 21) END AS born, {KEY} % 3 <> 2 AS given FROM customer",
    "doc_emails": f"SELECT doc_id, regexp_extract(text, '{_EMAIL}', 1) AS email FROM documents WHERE regexp_matches(text, '{_EMAIL}')",
    "doc_allcaps_head": f"""
        WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(translate(text, '!.,', ''), chr(10))[1:5], lambda x: regexp_extract(regexp_replace(x, '^{_WHITE}+|{_WHITE}+$', '', 'g'), '{_CAPS}', 1)), lambda x: x <> '') AS h FROM documents)
        SELECT doc_id, trim(regexp_replace(h[1], '{_WHITE}+', ' ', 'g')) AS head FROM l WHERE len(h) > 0""",
    "doc_squish": f"""
        SELECT doc_id, length(s)::BIGINT AS squished, md5(s) AS digest, length(regexp_replace(text, '^{_WHITE}+|{_WHITE}+$', '', 'g'))::BIGINT AS stripped
        FROM (SELECT *, trim(regexp_replace(text, '{_WHITE}+', ' ', 'g')) AS s FROM documents)""",
    "doc_lines_topk": "SELECT doc_id, generate_subscripts(x, 1)::INTEGER AS line, unnest(x) AS text FROM (SELECT doc_id, string_split(text, chr(10))[1:5] AS x FROM documents)",
    "page_digital_ratio": f"SELECT *, digital_pages / pages::DOUBLE AS share, 5 * digital_pages > 4 * pages AS digital FROM ({_PROBE})",
    "page_assemble": """
        SELECT conv_id AS path, length(t)::BIGINT AS chars, md5(t) AS digest FROM (
          SELECT conv_id, string_agg('=== TRANG ' || (turn + 1) || ' ===' || chr(10) || text || chr(10), chr(10) ORDER BY turn) AS t FROM conversations GROUP BY 1)""",
    "page_map_roundtrip": "SELECT conv_id AS path, (turn + 1)::INTEGER AS page_num, text FROM conversations",
    "route_documents": f"SELECT path, CASE WHEN 5 * digital_pages > 4 * pages THEN 'digital' ELSE 'ocr' END AS route FROM ({_PROBE})",
    "route_single_pages": "SELECT conv_id AS path, (turn + 1)::INTEGER AS page_num, CASE WHEN length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) > 200 THEN 'digital' ELSE 'ocr' END AS route FROM conversations",
    "ocr_lines": "SELECT conv_id, turn, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))::BIGINT AS chars FROM conversations",
    "page_seconds": """
        SELECT sum(s) AS seconds, sum(p)::BIGINT AS pages, sum(s) / sum(p) AS per_page, 6 * sum(s) / sum(p) AS six_pages
        FROM (SELECT count(*) AS p, round(sum(round(value * 100)::BIGINT) / 100) AS s FROM events GROUP BY user_id)""",
    "fill_defaults": """
        SELECT c_custkey, CASE WHEN c_custkey % 5 IN (0, 1) OR c_custkey % 11 = 5 THEN NULL ELSE c_custkey END AS tuoi,
          CASE WHEN c_custkey % 11 = 5 THEN FALSE WHEN c_custkey % 5 = 3 THEN NULL WHEN c_custkey % 10 = 4 THEN TRUE WHEN c_custkey % 10 = 9 THEN NULL ELSE FALSE END AS hut_thuoc_la,
          CASE WHEN c_custkey % 11 <> 5 THEN c_name END AS ho_va_ten, NULL::VARCHAR AS trang_thai, FALSE AS dot_quy_nao FROM customer""",
    "fill_rows": "SELECT * FROM (VALUES " + ", ".join(f"('{f.section}', '{f.name}', {1 if f.type == 'boolean' else 2 if (f.section, f.name) == ('THONG_TIN_CA_NHAN', 'ho_va_ten') else 0})" for f in catalog.FIELDS) + ") v(section, field, how), (SELECT count(*) AS n, count(*) FILTER (WHERE c_custkey % 2 = 0) AS even FROM customer)",
    "props_fill": """
        SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 20) AS n_tuoi, sum(regexp_extract(props, '\\d+')::BIGINT) FILTER (WHERE value > 20)::BIGINT AS sum_tuoi, count(*) AS n_false FROM events GROUP BY 1""",
    "catalog_types": """
        SELECT c_custkey, said, CASE lower(said) WHEN 'integer' THEN 'INTEGER' WHEN 'float' THEN 'NUMBER' WHEN 'number' THEN 'NUMBER' WHEN 'boolean' THEN 'BOOLEAN' ELSE 'STRING' END AS request_type
        FROM (SELECT c_custkey, ['Integer', 'FLOAT', 'string', 'boolean', 'number', 'odd', c_mktsegment, NULL][c_custkey % 8 + 1] AS said FROM customer)""",
    "file_kind": """
        SELECT 'd/' || base AS path, lower(CASE k % 8 WHEN 7 THEN '.gz' ELSE e END) AS ext, CASE WHEN k % 8 IN (2, 3, 5) THEN 'image' ELSE 'pdf' END AS kind, base
        FROM (SELECT k, e, k || e AS base FROM (SELECT c_custkey AS k, ['.pdf', '.PDF', '.Png', '.TIFF', '.tif', '.jpeg', '', '.tar.gz'][c_custkey % 8 + 1] AS e FROM customer))""",
    "output_names": """
        WITH p AS (SELECT trunc(c_custkey - (c_custkey % 3) / 2.0)::BIGINT AS stem, CASE WHEN c_custkey % 3 = 2 THEN '.png' ELSE '.pdf' END AS e FROM customer)
        SELECT 'in/' || stem || e AS path, 'out/' || stem || '_extracted.txt' AS out_name, count(*) OVER (PARTITION BY stem) > 1 AS collides FROM p""",
    "dataset_progress": "SELECT c_name AS path, row_number() OVER (ORDER BY c_name) AS idx, count(*) OVER () AS total FROM customer",
    "missing_paths": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "paths_found": "SELECT DISTINCT CASE c_custkey % 3 WHEN 0 THEN 'customer.parquet' WHEN 1 THEN 'orders.parquet' ELSE 'gone-' || c_custkey || '.pdf' END AS name, c_custkey % 3 <> 2 AS found FROM customer",
    "record_quality": f"SELECT quality, count(*) AS documents, count(*) FILTER (WHERE regexp_matches(text, '{_EMAIL}')) AS with_email FROM documents LEFT JOIN labels USING (doc_id) GROUP BY quality",
    "any_underlying": f"SELECT c_mktsegment, bool_or({_EXPECTED['phan_loai_benh_nen__has_underlying_disease']}) AS any_underlying, count(*) AS records FROM customer GROUP BY 1",
    "scaled_zoom": f"SELECT {KEY}, (72 + {KEY} % 150)::DOUBLE / 72 AS zoom FROM customer",
    "label_lookup": f"SELECT doc_id, CASE WHEN regexp_matches(text, ':{_WHITE}*\\d') THEN regexp_extract(text, ':{_WHITE}*(\\d+)', 1) END AS number, regexp_matches(text, ':{_WHITE}*\\d') AS matches FROM documents",
    "service_health": "SELECT source, count(*) AS documents, count(*) FILTER (WHERE text <> '') AS with_text, CASE WHEN count(*) = count(*) FILTER (WHERE text <> '') THEN 'healthy' ELSE 'incomplete' END AS status FROM documents GROUP BY 1",
    "doc_allcaps_marked": "SELECT doc_id, CASE WHEN doc_id % 9 < 6 THEN ['TRAN VĂN AN', 'TRAN VĂN BA LÊ', 'TRAN VĂN Ơ'][doc_id % 3 + 1] END AS head FROM documents",
    "page_probe_default": "SELECT *, digital_pages / pages::DOUBLE AS share, 5 * digital_pages > 4 * pages AS digital FROM (SELECT conv_id AS path, count(*) AS pages, count(*) FILTER (WHERE length(regexp_replace(substr(text, 1, ((conv_id + turn + 1) % 21)::INTEGER), '^\\s+|\\s+$', '', 'g')) > 10) AS digital_pages FROM conversations GROUP BY 1)",
    "page_worker_ranges": """
        SELECT path, unnest(generate_series(0, pages - 1, n))::INTEGER AS first, n
        FROM (SELECT c_custkey AS path, (c_custkey % 23)::INTEGER AS pages, ceil((c_custkey % 23) / least(c_custkey % 23, 4)::DOUBLE)::INTEGER AS n FROM customer WHERE c_custkey % 23 > 0)""",
    "remote_request": "SELECT c_custkey, length(b)::BIGINT AS chars, md5(b) AS digest FROM (SELECT c_custkey, " + _request_sql() + " AS b FROM customer)",
    "remote_replies": f"""
        SELECT c_custkey, CASE WHEN c_custkey % 10 IN (0, 6, 8, 9) THEN 'ok' ELSE 'error' END AS status,
          CASE c_custkey % 10 WHEN 1 THEN 'Lỗi gọi API (Status ' || (500 + c_custkey % 4) || ')' WHEN 2 THEN '{remote.EMPTY_REPLY}' WHEN 3 THEN '{remote.FAILED}' WHEN 4 THEN '{remote.FAILED}' WHEN 5 THEN '{remote.FAILED}: Timeout' WHEN 7 THEN '{remote.FAILED}' END AS error,
          CASE WHEN c_custkey % 10 IN (0, 6) THEN c_name END AS ho_va_ten, FALSE AS has_underlying_disease, CASE WHEN c_custkey % 10 = 8 THEN c_custkey END AS tuoi FROM customer""",
    "record_json": "SELECT c_custkey, length(j)::BIGINT AS chars, md5(j) AS digest FROM (SELECT c_custkey, " + _record_sql() + " AS j FROM (SELECT *, c_custkey AS k FROM customer))",
    "output_errors": "SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 3 = 0 THEN 'error' ELSE 'ok' END AS status, CASE WHEN doc_id % 6 = 0 THEN 'no luck' ELSE 'no text' END AS error FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 = 0 OR text = ''",
    "form_diseases": _diseases_sql(),
    "form_labels": "SELECT c_custkey, " + ", ".join(f"CAST({_VALUES[n]} AS {'BIGINT' if n in ('chieu_cao', 'can_nang', 'sbp') else 'VARCHAR'}) AS {n}" for n in _LABELS) + " FROM (SELECT *, c_custkey AS k FROM customer)",
}
ORACLES["fill_rows"] = ORACLES["fill_rows"].replace("SELECT *", "SELECT section, field, n, CASE how WHEN 1 THEN n WHEN 2 THEN even ELSE 0 END AS n_set", 1)
ORACLES |= record_queries.ORACLES | page_queries.ORACLES
