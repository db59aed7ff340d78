"""Fill-in-middle transformation by DuckDB inside tasks (operator 13).

A text is cut into units (runs of A-Z and a-z, and every other code point alone). Two cuts, chosen by a hash of the identifier,
part it into prefix, middle and suffix; the middle goes to the end. What decides is ``sha256`` of a seed and the identifier, so
a document has the same form wherever and however often it is processed.

Each Arrow batch is registered as a view of a DuckDB connection that lives as long as the task, with one thread; one SQL statement
makes all results (``regexp_extract_all``, ``list_slice``, ``array_to_string``, ``sha256``) and they go back as Arrow.
No Python code sees a row. A batch is given to DuckDB in portions of about :data:`PORTION` bytes, since a list of
units is up to 40 times as large as its text; a longer text is a portion of its own. Rows stay where they are: no exchange.

Forms: ``psm`` is <P>prefix<S>suffix<M>middle, ``spm`` is <S>suffix<P>prefix<M>middle, ``plain`` the text as it was. As a text
with a marker in it stays plain and markers can't overlap themselves, an output reads back in one way (:func:`restored`).

Defined results: a null or empty text is plain and empty; bytes that are not UTF-8 become U+FFFD first; a null identifier hashes
as the seed alone; repeated rows are kept, and equal identifiers get equal cuts only for equal numbers of units; an empty table
gives no rows. The columns of the table stay, whatever their names, and an output column that exists already is an error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formloom.llm.arrow import fresh, named
from formloom.session import load

MARKERS = ("<P>", "<S>", "<M>")
UNITS = "[A-Za-z]+|[^A-Za-z]"
#: Of a hundred documents, how many are transformed, and how many of these start with the suffix.
TRANSFORMED, SUFFIX_FIRST = 90, 20
SEED = "1:"
#: Bytes of text that DuckDB gets at once.
PORTION = 1 << 20

#: What can be returned, with its type and SQL.
COLUMNS = {
    "n": ("long", "n"),
    "form": ("string", "form"),
    "prefix_chars": ("long", "CASE WHEN form <> 'plain' THEN length(prefix) END"),
    "middle_chars": ("long", "CASE WHEN form <> 'plain' THEN length(middle) END"),
    "output": ("string", "output"),
    "restored": ("string", "restored"),
    "output_sha256": ("string", "sha256(output)"),
    "restored_sha256": ("string", "sha256(restored)"),
}


def _sql(columns: list[str], markers: tuple[str, str, str], transformed: int, suffix_first: int, seed: str) -> str:
    """The statement over a view ``batch`` (i, id, text)."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    p, s, m = map(quote, markers)
    any_of = quote("|".join(map(re.escape, markers)))
    group = lambda k: f"('0x' || substr(h, {8 * k + 1}, 8))::UBIGINT"
    return f"""
        WITH cut AS (SELECT i, text, regexp_extract_all(text, '{UNITS}') AS units, sha256({quote(seed)} || coalesce(id::VARCHAR, '')) AS h FROM batch),
        counted AS (SELECT *, len(units)::BIGINT AS n, {group(0)} % (len(units) + 1)::UBIGINT AS x, {group(1)} % (len(units) + 1)::UBIGINT AS y FROM cut),
        chosen AS (SELECT *, least(x, y)::BIGINT AS a, greatest(x, y)::BIGINT AS b,
            CASE WHEN n = 0 OR contains(text, {p}) OR contains(text, {s}) OR contains(text, {m}) OR {group(2)} % 100 >= {transformed} THEN 'plain'
                WHEN {group(3)} % 100 < {suffix_first} THEN 'spm' ELSE 'psm' END AS form FROM counted),
        parted AS (SELECT *, array_to_string(list_slice(units, 1, a), '') AS prefix, array_to_string(list_slice(units, a + 1, b), '') AS middle,
            array_to_string(list_slice(units, b + 1, n), '') AS suffix FROM chosen),
        made AS (SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN {p} || prefix || {s} || suffix || {m} || middle
            ELSE {s} || suffix || {p} || prefix || {m} || middle END AS output FROM parted),
        reread AS (SELECT *, CASE WHEN form <> 'plain' THEN string_split_regex(output, {any_of}) END AS parts FROM made),
        result AS (SELECT *, CASE form WHEN 'plain' THEN output WHEN 'psm' THEN parts[2] || parts[4] || parts[3] ELSE parts[3] || parts[4] || parts[2] END AS restored FROM reread)
        SELECT i, {", ".join(f"{COLUMNS[c][1]} AS {c}" for c in columns)} FROM result"""


def _portions(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(start, rows) of portions of about :data:`PORTION` bytes."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
    start = 0
    while start < len(ends):
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + PORTION, side="right")))
        yield start, stop - start
        start = stop


def _check(markers: tuple[str, str, str]) -> None:
    """Raises unless outputs can be read back: markers differ, and none can begin within another or within itself."""
    for i, a in enumerate(markers):
        for j, b in enumerate(markers):
            overlap = any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b))))
            if not a or overlap or i != j and a in b:
                raise ValueError("markers must be different, and none may overlap another or itself")


def fill_in_middle(df: DataFrame, text: str = "text", doc_id: str = "doc_id", columns: tuple[str, ...] = ("n", "form", "prefix_chars", "middle_chars", "output"), keep: list[str] | None = None, markers: tuple[str, str, str] = MARKERS, transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST, seed: str = SEED) -> DataFrame:
    """The columns ``keep`` (all, if not given) and of :data:`COLUMNS` those in ``columns``, for each row.

    ``markers``: three different strings, of prefix, suffix and middle, none of which has its own beginning or another's at its end.
    """
    _check(markers)
    keep = df.columns if keep is None else keep
    fresh(df.select(*map(named, keep)), *columns)
    whole = F.make_valid_utf8(F.coalesce(named(text).cast("string"), F.lit("")))
    rows = df.select(*(named(c).alias(f"c{i}") for i, c in enumerate(keep)), named(doc_id).cast("long").alias("id"), whole.alias("text"))
    made = T.StructType([T.StructField(f"o{i}", T.LongType() if COLUMNS[c][0] == "long" else T.StringType()) for i, c in enumerate(columns)])
    schema = T.StructType([*rows.schema.fields[: len(keep)], *made.fields])
    statement = _sql(list(columns), markers, transformed, suffix_first, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds, n = to_arrow_schema(schema), len(keep)
        with duckdb.connect(":memory:", config={"threads": 1}) as db:
            for batch in batches:
                for start, count in _portions(batch.column(n + 1)):
                    part = batch.slice(start, count)
                    numbers = pa.array(range(count), type=pa.int64())
                    db.register("batch", pa.Table.from_arrays([numbers, part.column(n), part.column(n + 1)], names=["i", "id", "text"]))
                    found = db.sql(statement).to_arrow_table().combine_chunks()
                    db.unregister("batch")
                    if not found.column("i").combine_chunks().equals(numbers):
                        found = found.sort_by("i")
                    arrays = [*part.columns[:n], *found.columns[1:]]
                    table = pa.Table.from_arrays([a if a.type == kinds.field(k).type else a.cast(kinds.field(k).type) for k, a in enumerate(arrays)], names=kinds.names)
                    yield from table.combine_chunks().to_batches()

    return rows.mapInArrow(run, schema).toDF(*keep, *columns)


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that an output of :func:`fill_in_middle` was made of, as a Column expression."""
    parts = F.split(output, "|".join(map(re.escape, markers)), -1)
    psm, spm = (F.concat(*(F.get(parts, F.lit(k)) for k in order)) for order in ((1, 3, 2), (2, 3, 1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's form, lengths of parts, and digests of its output and of the text read back from that."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return fill_in_middle(docs, columns=("n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"), keep=["doc_id"])


OP13_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, sha256('1:' || doc_id) AS h FROM documents),
u AS (SELECT *, length(regexp_replace(x, '[A-Za-z]+|[^A-Za-z]', '.', 'gs'))::BIGINT AS n FROM t),
c AS (SELECT *, list_sort([('0x' || h[1:8])::HUGEINT % (n + 1), ('0x' || h[9:16])::HUGEINT % (n + 1)])::BIGINT[] AS cuts,
    x = '' OR regexp_matches(x, '<[PSM]>') OR ('0x' || h[17:24])::HUGEINT % 100 >= 90 AS plain, ('0x' || h[25:32])::HUGEINT % 100 < 20 AS spm FROM u),
k AS (SELECT doc_id, generate_subscripts(w, 1) AS nth, unnest(w) AS unit FROM (SELECT doc_id, regexp_extract_all(x, '[A-Za-z]+|[^A-Za-z]') AS w FROM c WHERE NOT plain)),
p AS (SELECT doc_id, coalesce(string_agg(unit, '' ORDER BY nth) FILTER (WHERE nth <= cuts[1]), '') AS a,
    coalesce(string_agg(unit, '' ORDER BY nth) FILTER (WHERE nth > cuts[1] AND nth <= cuts[2]), '') AS b,
    coalesce(string_agg(unit, '' ORDER BY nth) FILTER (WHERE nth > cuts[2]), '') AS z FROM k JOIN c USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form, length(a)::BIGINT AS prefix_chars, length(b)::BIGINT AS middle_chars,
  sha256(CASE WHEN plain THEN x WHEN spm THEN '<S>' || z || '<P>' || a || '<M>' || b ELSE '<P>' || a || '<S>' || z || '<M>' || b END) AS output_sha256, sha256(x) AS restored_sha256
FROM c LEFT JOIN p USING (doc_id)
"""
