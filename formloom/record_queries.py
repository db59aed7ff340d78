"""Queries of filling by a user's catalogue, with DuckDB SQL; a part of :mod:`formloom.catalogue_queries`.

The records are made from ``events``: in turn its own ``props``, a whole record with nested objects, an object where there should be another,
repeated keys, text after the JSON, and numbers that only Python takes for JSON.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formloom.functions.text import named
from formloom.operators import fill
from formloom.plans import catalog
from formloom.session import load, spread
from formloom.sources import remote

KEY = "event_id"
USER_CATALOGUE = {
    "EVENT": {
        "k": {"type": "integer", "description": "A number"},
        "kind": {"type": "String", "enum": ["click", "view"]},
        "seen": {"type": "boolean"},
        "value": {"type": "float", "unit": "s"},
    },
    "PERSON": {
        "profile": {"type": "object", "properties": {"id": {"type": "integer"}, "address": {"properties": {"city": {}, "known": {"type": "Boolean"}}}}},
        "note": {"type": "odd"},
    },
}
_SHORT = {"EVENT": "event", "PERSON": "person"}

_JSON = """CASE k % 6 WHEN 0 THEN concat('{"EVENT":', props, '}')
    WHEN 1 THEN concat('{"PERSON" : {"profile":{"address":{"known":true,"city":"c', CAST(user_id AS STRING), '"},"id":', CAST(user_id AS STRING), '},"note":[1.50, {"a":null}]},"EVENT":{"seen":true,"kind":"', event_type, '","k":"7","value":1.250}}')
    WHEN 2 THEN '{"PERSON":{"profile":3,"note":1e2},"EVENT":{"seen":"true","k":1.5}}'
    WHEN 3 THEN concat('{"EVENT":{"k":1},"PERSON":{"profile":{"id":1,"address":{"city":"a","known":null,"city":"', event_type, '"}}},"EVENT":{"k":2,"k":', CAST(k AS STRING), '}}')
    WHEN 4 THEN concat('{"EVENT":', props, '} zz')
    ELSE '{"EVENT":{"value":NaN,"seen":0,"k":null},"PERSON":{"note":true}}\\n' END"""


def user_catalogue() -> catalog.Catalogue:
    return catalog.compiled(USER_CATALOGUE, _SHORT)


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(load(spark, sf_dir, "events")).withColumn("k", F.col(KEY)).select(KEY, F.expr(_JSON).alias("json"))


def fill_user_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed columns by another catalogue than the built-in, with nested objects."""
    flat = fill.filled(_records(spark, sf_dir), "json", [KEY], catalogue=user_catalogue())
    value = F.col("event__value")
    return flat.select(KEY, *(F.col(e.column) for e in user_catalogue().entries if e.field != "value"), F.when(F.isnan(value), "NaN").otherwise(value.cast("decimal(9, 3)").cast("string")).alias("event__value"))


def fill_user_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as rows of text, from the columns of text."""
    catalogue = user_catalogue()
    return fill.filled(_records(spark, sf_dir), "json", [KEY], False, catalogue).select(KEY, F.inline(catalogue.rows()))


def fill_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type and the text of each value, as the JSON has them."""
    return fill.filled_values(_records(spark, sf_dir), "json", [KEY], user_catalogue())


def fill_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VARIANT columns: types and texts of mistyped values, a path into one, and nulls."""
    flat = fill.filled_variants(_records(spark, sf_dir), "json", [KEY], user_catalogue())
    k, seen, note = F.col("event__k"), F.col("event__seen"), F.col("person__note")
    return flat.select(
        KEY,
        F.schema_of_variant(k).alias("k_type"),
        k.cast("string").alias("k_text"),
        F.schema_of_variant(seen).alias("seen_type"),
        F.try_variant_get(seen, "$", "boolean").alias("seen"),
        F.is_variant_null(note).alias("no_note"),
        F.try_variant_get(note, "$[0]", "double").alias("first_of_note"),
    )


def record_json_verbatim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as JSON with all fields of the catalogue, where mistyped values keep their types."""
    flat = fill.filled_variants(_records(spark, sf_dir).where(F.col(KEY) % 6 != 5), "json", [KEY], user_catalogue())
    return flat.select(KEY, F.to_json(user_catalogue().struct(), {"ignoreNullFields": "false"}).alias("record"))


_PROMPT = 'Fill "all":\n'


def remote_request_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The request by another catalogue and with another prompt."""
    body = remote.request_body(F.col("props"), USER_CATALOGUE, _PROMPT)
    return load(spark, sf_dir, "events").select(KEY, F.md5(body.cast("binary")).alias("digest"))


def remote_replies_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies unpacked by another catalogue."""
    text = F.to_json(F.struct(F.col("json").alias("text")))
    body = F.concat(F.lit('{"candidates":[{"content":{"parts":['), text, F.lit("]}}]}"))
    replies = _records(spark, sf_dir).select(KEY, F.lit(200).alias("http_status"), body.alias("body"), F.lit(None).cast("string").alias("error"))
    found = remote.unpacked(replies, [KEY], catalogue=USER_CATALOGUE)
    return found.select(KEY, "status", *(named(c) for c in ("EVENT__k", "PERSON__profile__address__city", "PERSON__profile__address__known")))


QUERIES = {f.__name__: f for f in (fill_user_catalogue, fill_user_rows, fill_values, fill_variants, record_json_verbatim, remote_request_catalogue, remote_replies_catalogue)}

# What each field holds, by the six kinds of records in turn: (present, type, text), SQL of events; a single value: absent.
_PROPS_K = "regexp_extract(props, '\\d+')"
_FALSE, _NONE = ("FALSE", "'boolean'", "'false'"), ("FALSE", "'null'", "NULL")
_HELD = {
    "k": [("TRUE", "'integer'", _PROPS_K), ("TRUE", "'string'", "'7'"), ("TRUE", "'float'", "'1.5'"), ("TRUE", "'integer'", "event_id::VARCHAR"), _NONE, ("TRUE", "'null'", "NULL")],
    "kind": [_NONE, ("TRUE", "'string'", "event_type"), _NONE, _NONE, _NONE, _NONE],
    "seen": [_FALSE, ("TRUE", "'boolean'", "'true'"), ("TRUE", "'string'", "'true'"), _FALSE, _FALSE, ("TRUE", "'integer'", "'0'")],
    "value": [_NONE, ("TRUE", "'float'", "'1.250'"), _NONE, _NONE, _NONE, ("TRUE", "'float'", "'NaN'")],
    "profile.id": [_NONE, ("TRUE", "'integer'", "user_id::VARCHAR"), _NONE, ("TRUE", "'integer'", "'1'"), _NONE, _NONE],
    "profile.address.city": [_NONE, ("TRUE", "'string'", "'c' || user_id"), _NONE, ("TRUE", "'string'", "event_type"), _NONE, _NONE],
    "profile.address.known": [_FALSE, ("TRUE", "'boolean'", "'true'"), _FALSE, ("TRUE", "'null'", "NULL"), _FALSE, _FALSE],
    "note": [_NONE, ("TRUE", "'array'", """'[1.50,{"a":null}]'"""), ("TRUE", "'float'", "'1e2'"), _NONE, _NONE, ("TRUE", "'boolean'", "'true'")],
}


def _case(field: str, part: int) -> str:
    return "CASE event_id % 6 " + " ".join(f"WHEN {i} THEN {held[part]}" for i, held in enumerate(_HELD[field])) + " END"


def _rows_sql(columns: str) -> str:
    parts = []
    for i, field in enumerate(_HELD):
        section = "EVENT" if i < 4 else "PERSON"
        parts.append(f"SELECT event_id, '{section}' AS section, '{field}' AS field, {i}::INTEGER AS ordinal, {_case(field, 0)} AS present, {_case(field, 1)} AS type, {_case(field, 2)}::VARCHAR AS value FROM events")
    return f"SELECT {columns} FROM ({' UNION ALL '.join(parts)})"


def _request_sql() -> str:
    fields = lambda **x: {"type": "OBJECT", "properties": x}
    schema = fields(
        EVENT=fields(k={"type": "INTEGER", "description": "A number"}, kind={"type": "STRING", "enum": ["click", "view"]}, seen={"type": "BOOLEAN"}, value={"type": "NUMBER"}),
        PERSON=fields(profile=fields(id={"type": "INTEGER"}, address=fields(city={"type": "STRING"}, known={"type": "BOOLEAN"})), note={"type": "STRING"}),
    )
    before, after = '{"contents":[{"parts":[{"text":"' + json.dumps(_PROMPT)[1:-1], '"}]}],"generationConfig":{"responseMimeType":"application/json","responseSchema":' + json.dumps(schema) + "}}"
    return f"SELECT event_id, md5('{before}' || replace(props, '\"', '\\\"') || '{after}') AS digest FROM events"


_CITY = _case("profile.address.city", 2)
_KNOWN = "CASE event_id % 6 WHEN 1 THEN TRUE WHEN 3 THEN NULL ELSE FALSE END"
_K = f"CASE WHEN event_id % 6 <> 2 THEN TRY_CAST({_case('k', 2)} AS BIGINT) END"
ORACLES = {
    "fill_user_catalogue": f"""
        SELECT event_id, {_K} AS event__k, {_case("kind", 2)} AS event__kind, CASE WHEN event_id % 6 = 5 THEN NULL ELSE event_id % 6 IN (1, 2) END AS event__seen,
          {_case("profile.id", 2)}::BIGINT AS person__profile__id, {_CITY} AS person__profile__address__city, {_KNOWN} AS person__profile__address__known, {_case("note", 2)} AS person__note,
          {_case("value", 2)} AS event__value FROM events""",
    "fill_user_rows": _rows_sql("event_id, section, field, ordinal, value"),
    "fill_values": _rows_sql("*"),
    "fill_variants": f"""
        SELECT event_id, CASE event_id % 6 WHEN 1 THEN 'STRING' WHEN 2 THEN 'DECIMAL(2,1)' WHEN 4 THEN 'VOID' WHEN 5 THEN 'VOID' ELSE 'BIGINT' END AS k_type, {_case("k", 2)} AS k_text,
          CASE event_id % 6 WHEN 2 THEN 'STRING' WHEN 5 THEN 'BIGINT' ELSE 'BOOLEAN' END AS seen_type, event_id % 6 IN (1, 2) AS seen, event_id % 6 IN (0, 3, 4) AS no_note,
          CASE WHEN event_id % 6 = 1 THEN 1.5::DOUBLE END AS first_of_note FROM events""",
    "record_json_verbatim": f"""
        SELECT event_id, '{{"EVENT":{{"k":' || CASE event_id % 6 WHEN 0 THEN {_PROPS_K} WHEN 1 THEN '"7"' WHEN 2 THEN '1.5' WHEN 3 THEN event_id::VARCHAR ELSE 'null' END
          || ',"kind":' || CASE event_id % 6 WHEN 1 THEN '"' || event_type || '"' ELSE 'null' END || ',"seen":' || CASE event_id % 6 WHEN 1 THEN 'true' WHEN 2 THEN '"true"' ELSE 'false' END
          || ',"value":' || CASE event_id % 6 WHEN 1 THEN '1.25' ELSE 'null' END || '}},"PERSON":{{"profile":{{"id":' || coalesce({_case("profile.id", 2)}, 'null')
          || ',"address":{{"city":' || coalesce('"' || {_CITY} || '"', 'null') || ',"known":' || coalesce(({_KNOWN})::VARCHAR, 'null') || '}}}},"note":'
          || CASE event_id % 6 WHEN 1 THEN '[1.5,{{"a":null}}]' WHEN 2 THEN '100.0' ELSE 'null' END || '}}}}' AS record FROM events WHERE event_id % 6 <> 5""",
    "remote_request_catalogue": _request_sql(),
    "remote_replies_catalogue": f"""
        SELECT event_id, CASE WHEN event_id % 6 = 4 THEN 'error' ELSE 'ok' END AS status, {_K} AS "EVENT__k", {_CITY} AS "PERSON__profile__address__city", {_KNOWN} AS "PERSON__profile__address__known" FROM events""",
}
