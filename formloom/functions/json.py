"""JSON as Python's ``json.loads`` reads it, in Column expressions.

Spark's readers differ from it: they accept what follows a value, refuse repeated keys or take the first, refuse ``NaN``, and
rewrite numbers. Here a text is checked as a whole (:func:`is_json`), and then *marked*: every string, key, number, ``true`` and
``false`` becomes a string with two control characters, so that a reader hands on each value's type and spelling. ``null`` stays.

Rules: of a repeated key the last counts, at every level that is read; ``NaN``, ``Infinity`` and ``-Infinity`` are numbers; strings hold no
raw control characters; only blank, tab, newline and carriage return part tokens; deeper than :data:`DEEPEST` levels isn't read.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEEPEST = 1000

_BODY = r"[^\"\\\x00-\x1f]*+(?:\\(?:[\"\\/bfnrt]|u[0-9a-fA-F]{4})[^\"\\\x00-\x1f]*+)*+"
_STRING = f'"{_BODY}"'
_NUMBER = r"-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][+-]?[0-9]++)?+|NaN|-?Infinity"
#: Looks whether one of these can begin, before each is tried.
_BEGIN = "[-0-9NItfn]"
_TOKENS = rf"\A(?:[ \t\n\r{{}}\[\],:]|{_STRING}|{_NUMBER}|true|false|null)*+\z"
#: Innermost objects and arrays, where strings are a quotation mark and other values a nought.
_INNERMOST = r'\{(?:":["0](?:,":["0])*+)?+\}|\[(?:["0](?:,["0])*+)?+\]'

#: Around a string's content; a number, ``true`` or ``false`` stands after both.
_BEFORE, _AFTER = "\x01", "\x02"
_MARKS = (r"\\u0001", r"\\u0002")


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value evaluated once and written once, however often it is used.

    The optimiser puts expressions into each other where a filter goes below a projection; without this they would grow with each step.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def is_json(text: Column) -> Column:
    """Whether a text is one JSON value and nothing else; null if the text is."""

    def whole(shape: Column) -> Column:
        brackets = lambda which: F.length(shape) - F.length(F.translate(shape, which, ""))
        # one level goes at a time, from within
        smaller = lambda acc, _: F.when(F.length(acc) > 1, F.regexp_replace(acc, _INNERMOST, "0")).otherwise(acc)
        levels = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(brackets("[{"), F.lit(DEEPEST))))
        return F.when(brackets("[{") != brackets("]}"), False).otherwise(F.aggregate(levels, shape, smaller).isin("0", '"'))

    def checked(t: Column) -> Column:
        shape = F.regexp_replace(t, _STRING, '"')
        shape = F.regexp_replace(shape, f"(?={_BEGIN})(?:{_NUMBER}|true|false|null)", "0")
        return F.when(~t.rlike(_TOKENS), False).otherwise(_with(F.regexp_replace(shape, "[ \t\n\r]++", ""), whole))

    return _with(text, checked)


def marked(text: Column, checked: bool = False) -> Column:
    """A text that :func:`is_json`, with marks; null if it isn't. ``checked``: it is known to be one, or null."""
    with_marks = lambda t: F.regexp_replace(t, rf'"({_BODY})"|(?={_BEGIN})({_NUMBER}|true|false)', rf'"{_MARKS[0]}$1{_MARKS[1]}$2"')
    return with_marks(text) if checked else _with(text, lambda t: F.when(is_json(t), with_marks(t)))


def single_path(marked_text: Column, names: Sequence[str]) -> Column:
    """The value, with marks, at ``outer[0].held.inner[0].last``, by the four names.

    One parse instead of one for each step, where that gives the same; null elsewhere, even if there is a value: where a name
    occurs again, as the last of repeated keys counts, or where what the path goes through isn't what it should be.
    """
    key = lambda name: _BEFORE + name + _AFTER
    outer, held, inner, last = names
    schema = T.StructType().add(key(outer), T.ArrayType(T.StructType().add(key(held), T.StructType().add(key(inner), T.ArrayType(T.StructType().add(key(last), T.StringType()))))))

    def once(text: Column, name: str) -> Column:
        written = f'"{_MARKS[0][1:]}{name}{_MARKS[1][1:]}"'
        return F.length(text) - F.length(F.replace(text, F.lit(written))) == len(written)

    def value(text: Column) -> Column:
        found = F.get(F.from_json(text, schema)[key(outer)], 0)[key(held)][key(inner)]
        return F.when(reduce(operator.and_, (once(text, n) for n in names)), F.get(found, 0)[key(last)])

    return _with(marked_text, value)


# The functions below take SQL text and give SQL text: a record has many fields, and expressions that are put together call by call take
# longer than the work on small tables.


def literal(text: str) -> str:
    """A text as SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _once(value: str, use: str) -> str:
    """``use`` of v, which is ``value``, evaluated once."""
    return f"get(transform(array({value}), v -> {use}), 0)"


def is_object(marked_text: str) -> str:
    return f"coalesce(startswith(btrim({marked_text}, ' \\t\\n\\r'), '{{'), false)"


def members(marked_text: str) -> str:
    """A struct of keys and values: the members of an object, the last first; none if it isn't an object."""
    entries = _once(marked_text, f"map_entries(CASE WHEN {is_object('v')} THEN from_json(v, 'map<string,string>') END)")
    entries = f"reverse(coalesce({entries}, CAST(array() AS ARRAY<STRUCT<key: STRING, value: STRING>>)))"
    return _once(entries, "named_struct('keys', v.key, 'values', v.value)")


def elements(marked_text: str) -> str:
    """The elements of an array, with marks; null if it isn't one."""
    return _once(marked_text, "CASE WHEN startswith(btrim(v, ' \\t\\n\\r'), '[') THEN from_json(v, 'array<string>') END")


def has(found: str, name: str) -> str:
    """Whether an object of :func:`members` has a member."""
    return f"array_contains({found}.keys, {literal(_BEFORE + name + _AFTER)})"


def member(found: str, name: str) -> str:
    """The value of a member, with marks: null if there is none, or if it is ``null``. Of a repeated key the last."""
    return _once(found, f"get(v.values, CAST(array_position(v.keys, {literal(_BEFORE + name + _AFTER)}) AS INT) - 1)")


def is_string(value: str) -> str:
    return _once(value, f"startswith(v, '{_BEFORE}') AND endswith(v, '{_AFTER}')")


def kind_of(value: str) -> str:
    """The type of a marked value: string, integer, float, boolean, object, array or null."""
    return _once(
        value,
        f"""CASE WHEN v IS NULL THEN 'null' WHEN NOT startswith(v, '{_BEFORE}') THEN CASE WHEN startswith(v, '{{') THEN 'object' ELSE 'array' END
            WHEN endswith(v, '{_AFTER}') THEN 'string' WHEN substring(v, 3, 1) IN ('t', 'f') THEN 'boolean' WHEN v RLIKE r'^..-?[0-9]+$' THEN 'integer' ELSE 'float' END""",
    )


def text_of(value: str) -> str:
    """A marked value as text: what a string says, and all else as it is spelled; null for ``null``.

    Objects and arrays are written without blanks, with the spelling of what they hold.
    """
    scalars = rf"""regexp_replace(v, r'"{_MARKS[0]}{_MARKS[1]}([^"\\]++)"', '$1')"""
    nested = rf"""regexp_replace({scalars}, r'"{_MARKS[0]}((?:[^"\\]|\\.)*?){_MARKS[1]}"', '"$1"')"""
    return _once(value, f"CASE WHEN NOT startswith(v, '{_BEFORE}') THEN {nested} WHEN endswith(v, '{_AFTER}') THEN substring(v, 2, length(v) - 2) ELSE substring(v, 3) END")


def as_variant(kind: str, text: str) -> str:
    """What :func:`kind_of` and :func:`text_of` say of a value as VARIANT: ``null`` is the null of VARIANT, not of SQL.

    VARIANT has neither ``NaN`` within objects and arrays nor repeated keys in them; such a value is the text that it was spelled with.
    """
    odd = "CASE WHEN v.t IN ('NaN', 'Infinity', '-Infinity') THEN CAST(CAST(v.t AS DOUBLE) AS VARIANT) ELSE CAST(v.t AS VARIANT) END"
    parsed = "try_parse_json(CASE WHEN v.k = 'null' THEN 'null' ELSE v.t END)"
    return _once(f"named_struct('k', {kind}, 't', {text})", f"CASE WHEN v.k = 'string' THEN CAST(v.t AS VARIANT) ELSE coalesce({parsed}, {odd}) END")
