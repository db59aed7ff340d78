"""Running a function of one text over a table with Arrow, in batches of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of output gathered before a batch goes back to Spark.
BATCH_BYTES = 8 << 20


def named(column: str) -> Column:
    """A column by its name, whatever characters that has."""
    return F.col("`" + column.replace("`", "``") + "`")


def fresh(df: DataFrame, *names: str) -> None:
    """Raises if the table has columns with the names of the operator's outputs."""
    taken = {c.lower() for c in df.columns}
    if clash := [n for n in names if n.lower() in taken]:
        raise ValueError(f"columns {clash} exist already; rename them or choose other output names")


def per_row(
    df: DataFrame,
    column: str,
    out: T.StructType,
    make: Callable[[], Callable[[bytes | None], tuple]],
    size: Callable[[tuple], int] | None = None,
    keep: list[str] | None = None,
    same: bool = True,
) -> DataFrame:
    """The columns ``keep`` (all, if not given) and ``out`` of each row, ``out`` from the bytes of ``column``.

    ``make`` runs in the worker and returns the function. Equal values within a
    batch are computed once if ``same``. Rows go out in batches of about
    :data:`BATCH_BYTES`, so that memory does not grow with the partition.
    """
    keep = df.columns if keep is None else keep
    # by number on the way: names may hold dots, which the functions for Arrow batches can't take
    rows = df.select(*(named(c).alias(f"c{i}") for i, c in enumerate(keep)), named(column).cast("binary").alias("value"))
    schema = T.StructType([*rows.schema.fields[:-1], *(T.StructField(f"o{i}", f.dataType, f.nullable) for i, f in enumerate(out.fields))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds, f, n = to_arrow_schema(schema), make(), len(keep)

        def batch_of(kept, found, start):
            made = [pa.array(x, type=kinds.field(n + i).type) for i, x in enumerate(zip(*found, strict=True))]
            return pa.RecordBatch.from_arrays([*(c.slice(start, len(found)) for c in kept), *made], names=kinds.names)

        for batch in batches:
            kept = [c if c.type == kinds.field(i).type else c.cast(kinds.field(i).type) for i, c in enumerate(batch.columns[:n])]
            found, start, held = [], 0, 0
            seen: dict = {}
            for i, value in enumerate(batch.column(n)):
                value = value.as_py()
                row = seen.get(value) if same else None
                if row is None:
                    row = f(value)
                    if same:
                        seen[value] = row
                found.append(row)
                held += size(row) if size else 64
                if held >= BATCH_BYTES:
                    yield batch_of(kept, found, start)
                    found, start, held, seen = [], i + 1, 0, {}
            if found:
                yield batch_of(kept, found, start)

    return rows.mapInArrow(run, schema).toDF(*keep, *out.names)
