"""Filling a JSON record so that it has exactly a catalogue's fields.

A field that is present keeps its value, whatever it is, an explicit null included; an absent one
is false if it is a boolean and null otherwise; unknown fields are dropped. A document, a section
or a nested object that isn't an object counts as empty, and so does a text that isn't JSON as Python reads it
(:mod:`formloom.functions.json`). Of a key that is repeated in an object, the last counts, for sections too.

Three layouts: values cast to the fields' types or as text (:func:`filled`), as VARIANT, which keeps the type that the JSON
gave (:func:`filled_variants`), and as rows with the type and the spelling of each value (:func:`filled_values`).
Each object is taken apart once, whatever the number of its fields.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formloom.functions import json as J
from formloom.functions.text import fresh, named
from formloom.plans.catalog import CATALOGUE, Catalogue, Entry, spark_type


#: A field, and SQL that says whether it is there and what its value with marks is.
Held = tuple[Entry, str, str]


def _quoted(*columns: str) -> list[str]:
    return ["`" + c.replace("`", "``") + "`" for c in columns]


def _taken_apart(df: DataFrame, json: str, keep: list[str], catalogue: Catalogue, checked: bool = False) -> tuple[DataFrame, list[Held]]:
    """``keep`` and columns for each field of the catalogue.

    Each step is a projection of its own, since what it makes is read several times in the next.
    """
    kept = df.select(*map(named, keep))
    whole, root = fresh(kept, "_whole"), fresh(kept, "_object")
    out = df.select(*map(named, keep), J.marked(named(json), checked).alias(whole))
    out = out.selectExpr(*_quoted(*keep), f"{J.members(whole)} AS {root}")
    objects = {(): root}
    paths = catalogue.objects()
    for depth in range(1, max(map(len, paths), default=0) + 1):
        level = [(p, fresh(out, f"_text{i}"), fresh(out, f"_object{i}")) for i, p in enumerate(paths) if len(p) == depth]
        out = out.selectExpr("*", *(f"{J.member(objects[p[:-1]], p[-1])} AS {text}" for p, text, _ in level))
        out = out.selectExpr("*", *(f"{J.members(text)} AS {name}" for _, text, name in level))
        objects |= {p: name for p, _, name in level}
    fields = [(e, fresh(out, f"_there{i}"), fresh(out, f"_value{i}")) for i, e in enumerate(catalogue.entries)]
    held = [column for e, there, value in fields for column in (f"{J.has(objects[e.path[:-1]], e.path[-1])} AS {there}", f"{J.member(objects[e.path[:-1]], e.path[-1])} AS {value}")]
    return out.selectExpr(*_quoted(*keep), *held), fields


def _is_boolean(e: Entry) -> bool:
    return e.type.lower() == "boolean"


def _kind(e: Entry, there: str, value: str) -> str:
    """The type of the field's value, the default's if it is absent."""
    return f"CASE WHEN {there} THEN {J.kind_of(value)} ELSE 'boolean' END" if _is_boolean(e) else J.kind_of(value)


def _text(e: Entry, there: str, value: str) -> str:
    """The text of the field's value, the default's if it is absent."""
    return f"CASE WHEN {there} THEN {J.text_of(value)} ELSE 'false' END" if _is_boolean(e) else J.text_of(value)


def filled(df: DataFrame, json: str, keep: list[str], typed: bool = True, catalogue: Catalogue = CATALOGUE, checked: bool = False) -> DataFrame:
    """``keep`` and the flat record of the JSON column; ``checked``: its texts are known to be JSON, or null.

    Values are text, spelled as in the JSON, with ``typed=False``; else they are cast to the field's type, null if that
    can't be; a boolean is ``true`` or ``false``, also as text, and nothing else.
    """
    out, fields = _taken_apart(df, json, keep, catalogue, checked)
    columns = _quoted(*(e.column for e in catalogue.entries))
    texts = out.selectExpr(*_quoted(*keep), *(f"{_text(*f)} AS {c}" for f, c in zip(fields, columns, strict=True)))
    if not typed:
        return texts

    def value(e: Entry, c: str) -> str:
        return f"{f"CASE WHEN {c} IN ('true', 'false') THEN {c} = 'true' END" if _is_boolean(e) else f'TRY_CAST({c} AS {spark_type(e.type).simpleString()})'} AS {c}"

    return texts.selectExpr(*_quoted(*keep), *map(value, catalogue.entries, columns))


def filled_variants(df: DataFrame, json: str, keep: list[str], catalogue: Catalogue = CATALOGUE) -> DataFrame:
    """``keep`` and the flat record with VARIANT columns: each value has the type that the JSON gave it, mistyped ones too.

    What is null or absent is the null of VARIANT (``is_variant_null``), an absent boolean is false.
    """
    out, fields = _taken_apart(df, json, keep, catalogue)
    names = [(fresh(out, f"_kind{i}"), fresh(out, f"_text{i}")) for i in range(len(fields))]
    read = [column for f, (kind, text) in zip(fields, names, strict=True) for column in (f"{_kind(*f)} AS {kind}", f"{_text(*f)} AS {text}")]
    made = [f"{J.as_variant(*own)} AS {c}" for own, c in zip(names, _quoted(*(e.column for e in catalogue.entries)), strict=True)]
    return out.selectExpr(*_quoted(*keep), *read).selectExpr(*_quoted(*keep), *made)


def filled_values(df: DataFrame, json: str, keep: list[str], catalogue: Catalogue = CATALOGUE) -> DataFrame:
    """``keep`` and a row for each field: section, field, ordinal, whether it was present, and the type and text of its value.

    Types: string, integer, float, boolean, object, array and null. Texts are spelled as in the JSON.
    """
    out, fields = _taken_apart(df, json, keep, catalogue)
    rows = [f"named_struct('section', {J.literal(e.path[0])}, 'field', {J.literal(e.field)}, 'ordinal', {i}, 'present', {there}, 'type', {_kind(e, there, value)}, 'value', {_text(e, there, value)})" for i, (e, there, value) in enumerate(fields)]
    return out.selectExpr(*_quoted(*keep), f"inline(array({', '.join(rows)}))")


def filled_rows(catalog: DataFrame, values: DataFrame, key: str, catalogue: Catalogue = CATALOGUE) -> DataFrame:
    """The same on long tables: every document of ``values`` (key, section, field, value) with every field of the catalogue.

    The catalogue has a fixed number of rows, and so has each document's result; no row of ``values`` is paired with another.
    """
    wanted = [F.struct(F.lit(e.path[0]).alias("section"), F.lit(e.field).alias("field"), F.lit(e.type).alias("type"), F.lit(i).alias("ordinal")) for i, e in enumerate(catalogue.entries)]
    documents = values.select(key).distinct().select(key, F.explode(F.array(*wanted)).alias("w")).select(key, "w.*")
    known = catalog.select("section", "field")  # unknown fields go
    present = values.join(F.broadcast(known), ["section", "field"], "left_semi").withColumn("present", F.lit(True))
    joined = documents.join(present, [key, "section", "field"], "left")
    absent = F.when(F.lower("type") == "boolean", "false")
    return joined.select(key, "section", "field", "ordinal", F.when(F.col("present"), F.col("value")).otherwise(absent).alias("value"))
