"""Best-fit packing of documents into fixed-length sequences (operator 2).

Pattern packing by non-negative least squares. The plan is made from the histogram of
piece lengths alone, which has at most ``capacity`` entries however many documents there are:

1. Lengths are rounded up to :data:`GRID` steps, and every pattern of at most
   :data:`DEPTH` steps that fills a sequence exactly is enumerated.
2. Non-negative least squares (active set) fits how often each pattern is used.
3. The counts are rounded down and turned into runs of sequences of exact lengths. The
   smallest place of a pattern stays open for the next step, so that what rounding up has
   lost is used again.
4. What is left is packed by best fit, longest first, into the room of open sequences and
   then into new ones; equal lengths and equal sequences are handled as counts.

The plan says for each length which of its pieces, by rank, go to which run of sequences.
Ranks are given out without gathering the pieces of a length anywhere: each task numbers
its pieces by length as it cuts them, and only counts by (task, length) are summed up.
A plan has a number of entries that depends on the capacity, not on the data.

Defined results: a null or empty text is one piece that holds the end id only; repeated rows are
packed as often as they come; an empty table gives no rows; the table's other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, insort

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from formloom.llm.tokens import piece_encoder, portions, text_of
from formloom.session import load, written

#: Steps that lengths are rounded up to, and pieces in a pattern.
GRID, DEPTH = 256, 3
#: Pieces of text whose ids a worker keeps.
KNOWN = 300_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, seq long"


def cut_pieces(docs: DataFrame, tokenizer: str, words: bool, end_id: int, capacity: int, text: str = "text", doc_id: str = "doc_id", known: int = KNOWN) -> DataFrame:
    """Tokenizes every document and cuts it into pieces of at most ``capacity`` ids.

    ``known``: pieces of text whose ids a worker keeps.

    ``task`` and ``seq``: which task cut the piece, and its number there among the pieces of this length.
    The result must be written before it is used twice, as tasks may be cut otherwise when run again.
    """

    def run(batches):
        encoder, end, most = piece_encoder(tokenizer, words, known), struct.pack("<I", end_id), 4 * capacity
        task, counts = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            rows, keys, values = [], batch.column(0).to_pylist(), (x.as_py() for x in batch.column(1))
            for at, some in portions(values):
                texts = list(dict.fromkeys(some))
                cuts = {}
                for value, packed in zip(texts, encoder.encode_many([text_of(x) for x in texts]), strict=True):
                    ids = packed + end
                    cuts[value] = [(k, a // 4, len(x) // 4, zlib.crc32(x)) for k, a in enumerate(range(0, len(ids), most)) if (x := ids[a : a + most])]
                for key, value in zip(keys[at : at + len(some)], some, strict=True):
                    for k, start, length, crc in cuts[value]:
                        rows.append((key, k, start, length, crc, task, counts[length]))
                        counts[length] += 1
            if rows:
                columns = zip(*rows, strict=True)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "seq"])

    return docs.select(F.col(doc_id).cast("long").alias("k"), F.col(text).cast("binary").alias("v")).mapInArrow(run, PIECES)


def patterns_of(grid: int = GRID, depth: int = DEPTH) -> np.ndarray:
    """Every way to fill ``grid`` steps with at most ``depth`` pieces, longest first; 0 where there is no piece."""
    found = [(grid, 0, 0)]
    if depth >= 2:
        found += [(a, grid - a, 0) for a in range((grid + 1) // 2, grid)]
    if depth >= 3:
        found += [(a, b, grid - a - b) for a in range(1, grid - 1) for b in range(1, min(a, grid - a - 1) + 1) if grid - a - b <= b]
    return np.array(found)


def fit_counts(patterns: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """Non-negative least squares by an active set: how often to use each pattern so that ``histogram`` is met.

    ``histogram[k]``: pieces of k steps; entry 0 is not used. The columns of the system hold
    a pattern's pieces by length, so a pattern's gradient is a sum of at most three residuals.
    """
    grid = len(histogram) - 1
    goal = histogram.astype(float).copy()
    goal[0] = 0
    scale = max(1.0, goal.max())
    goal /= scale
    x = np.zeros(len(patterns))
    on: list[int] = []
    columns = np.zeros((grid + 1, 0))
    gram = np.zeros((0, 0))

    def column(p):
        c = np.zeros(grid + 1)
        np.add.at(c, patterns[p][patterns[p] > 0], 1.0)
        return c

    rest = goal.copy()
    for _ in range(6 * grid):
        rest[0] = 0
        gain = rest[patterns].sum(axis=1) / np.sqrt((patterns > 0).sum(axis=1))
        if on:
            gain[on] = -1
        best = int(gain.argmax())
        if gain[best] <= 1e-7:
            break
        c = column(best)
        dots = columns.T @ c
        gram = np.block([[gram, dots[:, None]], [dots[None, :], np.array([[c @ c]])]])
        columns = np.column_stack([columns, c])
        on.append(best)
        while True:
            target = columns.T @ goal
            z = np.linalg.solve(gram + 1e-10 * np.eye(len(on)), target)
            if (z > 1e-12).all():
                x[on] = z
                break
            now = x[on]
            low = np.flatnonzero(z <= 1e-12)
            step = min(1.0, float(np.min(now[low] / np.maximum(now[low] - z[low], 1e-300))))
            now = now + step * (z - now)
            keep = now > 1e-12
            keep[low[np.argmin(now[low])]] = False
            x[on] = np.where(keep, now, 0)
            on = [p for p, k in zip(on, keep, strict=True) if k]
            columns, gram = columns[:, keep], gram[np.ix_(keep, keep)]
            if not on:
                break
        rest = goal - (columns @ x[on] if on else 0)
    return x * scale


class Plan:
    """Runs of equal sequences: ``runs`` has [lengths with counts, room left, number of sequences]."""

    def __init__(self, capacity: int):
        self.capacity, self.runs = capacity, []
        self.open: dict[int, list[int]] = {}
        self.rooms: list[int] = []

    def _opened(self, run: int) -> None:
        room = self.runs[run][1]
        if room > 0:
            if room not in self.open:
                self.open[room] = []
                insort(self.rooms, room)
            self.open[room].append(run)

    def add(self, lengths: list[tuple[int, int]], times: int) -> None:
        """``times`` sequences that hold these (length, count) each."""
        self.runs.append([lengths, self.capacity - sum(a * n for a, n in lengths), times])
        self._opened(len(self.runs) - 1)

    def best_fit(self, length: int, count: int) -> None:
        """Packs ``count`` pieces of a length, each into the smallest room that holds it."""
        while count:
            at = bisect_left(self.rooms, length)
            if at == len(self.rooms):
                each = self.capacity // length
                if whole := count // each:
                    self.add([(length, each)], whole)
                if left := count % each:
                    self.add([(length, left)], 1)
                return
            room = self.rooms[at]
            run = self.open[room].pop()
            if not self.open[room]:
                del self.open[room]
                self.rooms.pop(at)
            lengths, _, times = self.runs[run]
            each = room // length
            whole, left = divmod(count, each)
            full = min(times, whole)
            part = [x for x in ((full, each), (1, left) if full < times and left and full == whole else (0, 0)) if x[0]]
            for many, n in part:
                self.add([*lengths, (length, n)], many)
                count -= many * n
            if rest := times - sum(x[0] for x in part):
                self.runs[run][2] = rest
                self._opened(run)
            else:
                self.runs[run][2] = 0


def make_plan(histogram: dict[int, int], capacity: int, grid: int = GRID, depth: int = DEPTH) -> Plan:
    """Packs a histogram of lengths: patterns first, the rest by best fit."""
    step = -(-capacity // grid)
    steps = -(-capacity // step)
    left = {k: n for k, n in histogram.items() if n}
    plan = Plan(capacity)
    if left.pop(capacity, 0):
        plan.add([(capacity, 1)], histogram[capacity])
    by_step: dict[int, list[int]] = {}
    for length in sorted(left):
        by_step.setdefault(-(-length // step), []).append(length)
    counts = np.zeros(steps + 1, dtype=np.int64)
    for k, lengths in by_step.items():
        counts[k] = sum(left[x] for x in lengths)
    patterns = patterns_of(steps, depth)
    for pattern, times in zip(patterns, np.floor(fit_counts(patterns, counts) + 1e-6).astype(np.int64), strict=True):
        places = [int(k) for k in pattern if k]
        if times < 1 or len(places) < 2:
            continue
        todo = int(times)
        while todo:  # runs of sequences that hold the same exact lengths in all places but the smallest
            chosen: list[tuple[int, int]] = []
            for k in places[:-1]:
                taken = {a: n for a, n in chosen}
                length = next((x for x in reversed(by_step.get(k, [])) if left[x] > taken.get(x, 0)), None)
                if length is None:
                    break
                taken[length] = taken.get(length, 0) + 1
                chosen = list(taken.items())
            if sum(n for _, n in chosen) < len(places) - 1:
                break
            many = min(todo, *(left[a] // n for a, n in chosen))
            plan.add(chosen, many)
            for a, n in chosen:
                left[a] -= many * n
                if not left[a]:
                    by_step[-(-a // step)].remove(a)
            todo -= many
    for length in sorted(left, reverse=True):
        plan.best_fit(length, left[length])
    plan.runs = [r for r in plan.runs if r[2]]
    return plan


def slots(plan: Plan) -> dict[str, np.ndarray]:
    """For each length, in order of rank: the first rank of a run's places, its first sequence, the offset there and how many of the length a sequence holds."""
    found, sequence = [], 0
    for lengths, _, times in plan.runs:
        offset = 0
        for length, each in lengths:
            found.append((length, times * each, sequence, offset, each))
            offset += length * each
        sequence += times
    found.sort()
    out = {k: np.array([x[i] for x in found], dtype=np.int64) for i, k in enumerate(("length", "places", "sequence", "offset", "each"))}
    ends = np.cumsum(out["places"])
    starts = ends - out["places"]
    first = np.searchsorted(out["length"], out["length"], side="left")
    out["rank"] = starts - starts[first] if len(found) else starts
    return out


def pack(docs: DataFrame, tokenizer: str, words: bool, end_id: int, capacity: int = 4096, text: str = "text", doc_id: str = "doc_id", known: int = KNOWN) -> DataFrame:
    """Packs every document; one row for each piece with its sequence and its place there."""
    pieces = written(cut_pieces(docs, tokenizer, words, end_id, capacity, text, doc_id, known), "pieces")
    counts = written(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    spots = slots(make_plan(histogram, capacity))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    ranked = pieces.join(before.hint("merge"), ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("seq")).alias("rank"))
    wide = int(max(spots["rank"], default=0) + max(histogram.values(), default=0) + 1)
    keys = spots["length"] * wide + spots["rank"]

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            at = np.searchsorted(keys, length * wide + rank, side="right") - 1
            which, within = np.divmod(rank - spots["rank"][at], spots["each"][at])
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(spots["sequence"][at] + which), pa.array(spots["offset"][at] + within * length)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, packed into sequences of 4096 ids."""
    return pack(load(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), words=True, end_id=1)
