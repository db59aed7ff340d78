"""Exact deduplication by a tree-merge of sorted digest runs (operator 9).

Every partition turns its texts into a sorted run of entries: a 48-byte key, the row that
stays so far and a count. A run is cut by key into slices of equal share (keys are hashes). Runs of a
slice meet in binomial rounds: in each exchange the runs whose numbers agree but for
the lowest bits come together and are merged two by two, round after round: the place of each entry of one run is searched in the
other, entries of one key become one, and nothing is sorted again. A run that isn't sorted is an error. The
key holds the SHA-256 digest, the length and an independent hash of the
text, and only entries that agree in all three are taken as equal, at every level. So a group of
copies, however large, is one entry of each run before anything moves, and no task
gets more than the distinct keys of its slice.

Texts are equal if they are identical after lower-casing A-Z only; null is an empty text.
Of equal texts one row stays: that with the largest ``doc_id`` (or the smallest, by parameter); among rows that
repeat this identifier, the first as read. A row without identifier stays only
if no copy has one. An empty table gives no rows.

What brings a result back to the rows of a group (:func:`joined_by_group`) doesn't rest on the optimiser: groups that hold
a thousandth of all rows or more, of which there are a thousand at most, are broadcast; the others meet in a sort-merge join.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from formloom.llm.arrow import fresh
from formloom.session import load, scratch, written

#: Runs that meet in one exchange: this many binomial rounds at once.
ROUNDS = 3
#: Exchanges of one job: after so many, runs are written, so that a lost executor costs no more than these.
CHAINED = 3
#: Distinct keys that a slice should have at most, if all texts differ.
SLICE_ROWS = 200_000
KEY_BYTES = 48

_ENTRY = np.dtype([("key", f"S{KEY_BYTES}"), ("none", "u1"), ("doc_id", "<i8"), ("row", "<i8"), ("n", "<i8")])
_RUN = "slice int, run long, entries binary"


@arrow_udf(T.BinaryType())
def digest_key(values: pa.Array) -> pa.Array:
    """SHA-256, length and XXH64 of each text with A-Z lower-cased."""
    import xxhash

    def one(value: bytes) -> bytes:
        low = value.lower()  # of bytes: A-Z only
        return hashlib.sha256(low).digest() + struct.pack(">QQ", len(low), xxhash.xxh64_intdigest(low))

    seen: dict[bytes, bytes] = {}
    made = []
    for value in values:
        value = value.as_py() or b""
        key = seen.get(value)
        if key is None:
            key = seen[value] = one(value)
        made.append(key)
    return pa.array(made, type=pa.binary())


# else the optimiser may compute a key twice, once to see that it isn't null
digest_key = digest_key.asNondeterministic()


def _thin(entries: np.ndarray, largest: bool) -> np.ndarray:
    """Entries of a batch as a run: sorted by key, one entry for each, with the row that stays and the sum of counts."""
    if not len(entries):
        return entries
    best = ~entries["doc_id"] if largest else entries["doc_id"]
    entries = entries[np.lexsort((entries["row"], best, entries["none"], entries["key"]))]
    first = np.flatnonzero(np.r_[True, entries["key"][1:] != entries["key"][:-1]])
    out = entries[first]
    out["n"] = np.add.reduceat(entries["n"], first)
    return out


def _run(packed: bytes) -> np.ndarray:
    """A run's entries; raises unless they are sorted and each key stands once."""
    entries = np.frombuffer(packed, dtype=_ENTRY)
    if len(entries) > 1 and not (entries["key"][1:] > entries["key"][:-1]).all():
        raise ValueError("a run is not sorted")
    return entries


def _merge(a: np.ndarray, b: np.ndarray, largest: bool) -> np.ndarray:
    """Two sorted runs as one: an entry for each key, with the row that stays and the sum of counts."""
    if len(a) < len(b):
        a, b = b, a
    at = np.searchsorted(a["key"], b["key"])
    same = at < len(a)
    same[same] = a["key"][at[same]] == b["key"][same]
    out, i = a.copy(), at[same]
    x, y = a[i], b[same]
    nearer = y["doc_id"] > x["doc_id"] if largest else y["doc_id"] < x["doc_id"]
    alike = (y["none"] == x["none"]) & (y["doc_id"] == x["doc_id"])
    wins = (y["none"] < x["none"]) | (y["none"] == x["none"]) & nearer | alike & (y["row"] < x["row"])
    out[i[wins]] = y[wins]
    out["n"][i] = x["n"] + y["n"]
    return np.insert(out, at[~same], b[~same]) if not same.all() else out


def merge_sorted(runs: list[np.ndarray], largest: bool) -> np.ndarray:
    """Sorted runs as one, two by two in rounds."""
    while len(runs) > 1:
        pairs = [_merge(a, b, largest) for a, b in zip(runs[::2], runs[1::2])]
        runs = pairs + runs[2 * len(pairs) :]
    return runs[0]


def _slice_of(keys: np.ndarray, slices: int) -> np.ndarray:
    head = np.frombuffer(keys.tobytes(), dtype=">u4").reshape(len(keys), KEY_BYTES // 4)[:, 0].astype(np.uint64)
    return (head * np.uint64(slices) >> np.uint64(32)).astype(np.int64)


def _first_runs(keyed: DataFrame, slices: int, largest: bool) -> DataFrame:
    """A sorted run of each partition, cut into slices."""

    def run(batches):
        from pyspark import TaskContext

        number, held = TaskContext.get().partitionId(), []
        for batch in batches:
            part = np.zeros(batch.num_rows, dtype=_ENTRY)
            ids = batch.column(0)
            part["doc_id"], part["none"] = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)
            part["key"] = np.array(batch.column(1).to_pylist(), dtype=f"S{KEY_BYTES}")
            part["row"], part["n"] = batch.column(2).to_numpy(zero_copy_only=False), 1
            held.append(_thin(part, largest))
        if not held:
            return
        entries = merge_sorted(held, largest)
        bounds = np.searchsorted(_slice_of(entries["key"], slices), np.arange(slices + 1))
        for a in range(0, slices, 256):
            cut = [(s, number, entries[bounds[s] : bounds[s + 1]].tobytes()) for s in range(a, min(slices, a + 256)) if bounds[s + 1] > bounds[s]]
            if cut:
                yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*cut, strict=True), (pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["slice", "run", "entries"])

    return keyed.select("doc_id", "key", "row").mapInArrow(run, _RUN)


def _merged(runs: DataFrame, largest: bool, all_runs: bool = False) -> DataFrame:
    """One exchange: runs whose numbers agree above the lowest bits become one; with ``all_runs`` all of a slice."""

    def merge(table: pa.Table) -> pa.Table:
        entries = merge_sorted([_run(x.as_py()) for x in table["entries"]], largest)
        return pa.table({"slice": [table["slice"][0].as_py()], "run": [table["up"][0].as_py()], "entries": [entries.tobytes()]}, schema=pa.schema([("slice", pa.int32()), ("run", pa.int64()), ("entries", pa.binary())]))

    return runs.withColumn("up", F.shiftright("run", 63 if all_runs else ROUNDS)).groupBy("slice", "up").applyInArrow(merge, _RUN)


def _entries(runs: DataFrame) -> DataFrame:
    def rows(batches):
        for batch in batches:
            for packed in batch.column(0):
                entries = np.frombuffer(packed.as_py(), dtype=_ENTRY)
                keys = pa.Array.from_buffers(pa.binary(KEY_BYTES), len(entries), [None, pa.py_buffer(np.ascontiguousarray(entries["key"]).tobytes())]).cast(pa.binary())
                ids = pa.array(entries["doc_id"], mask=entries["none"].astype(bool))
                yield pa.RecordBatch.from_arrays([keys, ids, pa.array(entries["row"]), pa.array(entries["n"])], names=["key", "keep_id", "keep_row", "group_size"])

    return runs.select("entries").mapInArrow(rows, "key binary, keep_id long, keep_row long, group_size long")


def merge_runs(keyed: DataFrame, keep: str = "max") -> DataFrame:
    """One row for each distinct key of ``keyed`` (doc_id, key, row; written): keep_id, keep_row and group_size.

    A run is a partition of ``keyed``; the last exchange takes all runs of a slice, whatever their numbers.
    """
    if keep not in ("max", "min"):
        raise ValueError("keep is max or min")
    spark = keyed.sparkSession
    n, last = keyed.select(F.spark_partition_id().alias("run")).agg(F.count("*"), F.max("run")).first()
    slices = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // SLICE_ROWS))
    runs, exchanges = _first_runs(keyed, slices, keep == "max"), 0
    while last:
        last >>= ROUNDS
        runs, exchanges = _merged(runs, keep == "max", not last), exchanges + 1
        if last and exchanges % CHAINED == 0:
            runs = written(runs, "runs")
    return _entries(runs)


#: Groups with at least one in so many of all rows are broadcast where rows meet their groups: so many at most.
LARGE = 1000


def joined_by_group(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` with the columns of their group; ``groups`` has each ``key`` once and in ``size`` how many of the ``total`` rows have it."""
    large = F.col(size) * LARGE >= total
    few, rest = groups.where(large), groups.where(~large)
    meet = rows.join(F.broadcast(few.select(key)), key, "left_anti").join(rest.hint("merge"), key)
    return rows.join(F.broadcast(few), key).unionByName(meet)


def exact_groups(df: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: str = "max") -> DataFrame:
    """For every row of ``df``: doc_id, keep_id, group_size, kept and text_sha256."""
    keyed = written(df.select(F.col(doc_id).cast("long").alias("doc_id"), digest_key(F.col(text).cast("binary")).alias("key"), F.monotonically_increasing_id().alias("row")), "keys")
    groups = written(merge_runs(keyed, keep), "groups")  # read three times
    found = joined_by_group(keyed, groups, "key", "group_size", keyed.count())
    return found.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex(F.substring("key", 1, 32))).alias("text_sha256"))


def keep_rows(df: DataFrame, stay: DataFrame, keys: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``df`` that ``stay`` (doc_id, key) names, each once, all columns as they were.

    ``keys``: doc_id and key of every row of ``df``, written; the result doesn't read them. They tell whether rows repeat identifier and text; if
    none do, a semi-join is all. Only repeated rows are thinned to one, by a sum that each task starts before the
    exchange; those that are a thousandth of all rows or more, a thousand at most, are found by a broadcast join.
    """
    at = "__key__"
    fresh(df, at)
    again = written(keys.groupBy("doc_id", "key").agg(F.count("*").alias("n")).where("n > 1"), "again", outer=True)
    rows = df.withColumn(at, digest_key(F.col(text).cast("binary")))

    def joined(left: DataFrame, right: DataFrame, how: str, small: bool = False) -> DataFrame:
        right = right.select(F.col("doc_id").alias("__id__"), F.col("key").alias("__other__"))
        right = F.broadcast(right) if small else right
        return left.join(right, (F.col(at) == F.col("__other__")) & F.col(doc_id).cast("long").eqNullSafe(F.col("__id__")), how)

    if again.isEmpty():
        return joined(rows, stay, "left_semi").drop(at)
    large = F.col("n") * LARGE >= keys.count()
    many, some = again.where(large), again.where(~large)
    single = joined(rows, many, "left_anti", True)
    repeated = joined(rows, many, "left_semi", True).unionByName(joined(single, some, "left_semi")).dropDuplicates([at, doc_id])
    single = joined(single, some, "left_anti")
    return joined(single.unionByName(repeated), stay, "left_semi").drop(at)


def drop_exact_copies(df: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: str = "max") -> DataFrame:
    """``df`` with one row of each group of equal texts, all columns as they were.

    Only identifiers and keys go through the merge; the rows that stay are found by both.
    """
    keys = df.select(F.col(doc_id).cast("long").alias("doc_id"), digest_key(F.col(text).cast("binary")).alias("key"), F.monotonically_increasing_id().alias("row"))
    with scratch():
        keys = written(keys, "keys")
        stay = written(merge_runs(keys, keep).select(F.col("keep_id").alias("doc_id"), "key"), "stay", outer=True)
        return keep_rows(df, stay, keys, text, doc_id)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, with the one of its group that stays."""
    return exact_groups(load(spark, sf_dir, "documents").select("doc_id", "text"))


OP9_SQL = """
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
