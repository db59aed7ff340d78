"""Approximate nearest neighbours by a forest of random-projection trees (operator 3).

Nearness is the largest inner product, in double precision. Inner products become angles by
one more coordinate, which gives all vectors the length of the longest (queries have 0 there).

* Fit: on a sample of at most :data:`SAMPLE` distinct vectors, the driver grows :data:`TREES` trees. A node
  splits by the difference of two of its vectors, drawn at random, at the median projection, until
  leaves would hold about :data:`LEAF` rows of the whole table.
* Index: every row goes down every tree. It is stored once, in the region of its leaf in the first tree, with its
  leaves in all trees. Regions are runs of leaves of about :data:`GROUP` rows, larger ones are cut into chunks by hash; which
  regions have rows of a leaf is a table of bits, whose size has a bound.
* Search: one priority queue holds the open branches of all trees, nearest margin first,
  and gives the leaves to visit. How many is measured: for :data:`ASKED_FIRST` queries, chosen by hash, all true neighbours are
  found by comparing them with every row, and ``probes`` is the least number of leaves that has the share ``recall``
  of these. Rows without structure need many leaves, clustered ones few, whatever their number.
* Rerank: queries go to the regions that have rows of their leaves, at most :data:`QUERIES` in a group. A group
  looks up the rows of a query's leaves by their numbers, so that a row in many of them is scored once,
  exactly, and returns the best few of each query, which are merged.

Equal vectors are one class, searched once; its smallest identifiers are kept, as
many as a result can use. A group of copies therefore costs as much as one vector.

Defined results: vectors that are null, zero, of another length than most, or that hold a null or a
non-finite component take no part, as queries or candidates, nor do rows without identifier; rows
that repeat an identifier and a vector count once, and rows of the query's own identifier are no candidates; an
identifier with different vectors is asked with each of them, and each has its ranks, and it is found once for each;
ties go to the smaller identifier; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from formloom.session import load, written

TREES, LEAF = 16, 256
#: The index is fitted on at most this many vectors, chosen by hash, and at most so many components.
SAMPLE, SAMPLE_VALUES, LEAF_LEAST = 32_768, 1 << 22, 4
#: Queries that are compared with every row to choose the number of leaves, and the share of true neighbours it has to reach.
ASKED_FIRST, RECALL = 128, 0.97
#: Rows of a region or of a chunk of it, about; regions at most; queries that meet a chunk in one group, about.
GROUP, REGIONS, QUERIES = 4096, 1024, 1024
#: Queries that are scored at once.
BLOCK = 64
#: Rounding of the first pass, as a share of the product of lengths: what lies within it of the cut-off stays.
ROUNDING = 1e-12


class Forest:
    """Trees as arrays: node -> (plane, children); a child below 0 is leaf number -child - 1 of its tree."""

    def __init__(self, sample: np.ndarray, trees: int, leaf: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        planes, cuts, children, self.roots, self.leaves = [], [], [], [], []
        for _ in range(trees):
            count = 0
            todo, root = [(np.arange(len(sample)), None)], None
            while todo:
                rows, up = todo.pop()
                made = self._split(sample, rows, leaf, rng)
                if made is None:
                    here, count = -count - 1, count + 1
                else:
                    plane, cut, low, high = made
                    here = len(planes)
                    planes.append(plane)
                    cuts.append(cut)
                    children.append([0, 0])
                    todo += [(high, (here, 1)), (low, (here, 0))]  # low first, so that leaves are numbered in order
                if up is None:
                    root = here
                else:
                    children[up[0]][up[1]] = here
            self.roots.append(root)
            self.leaves.append(count)
        width = sample.shape[1] if sample.ndim == 2 else 1
        self.planes = np.array(planes, dtype=np.float32).reshape(-1, width)
        self.cuts = np.array(cuts, dtype=np.float32)
        self.children = np.array(children, dtype=np.int32).reshape(-1, 2)
        #: Leaves are numbered through all trees: the first number of each tree.
        self.first = np.r_[0, np.cumsum(self.leaves)].astype(np.int32)

    @staticmethod
    def _split(sample, rows, leaf, rng):
        if len(rows) <= leaf:
            return None
        for _ in range(3):
            a, b = rng.choice(rows, 2, replace=False)
            plane = sample[a] - sample[b]
            norm = np.linalg.norm(plane)
            if norm > 1e-12:
                plane = (plane / norm).astype(np.float32)
                along = sample[rows] @ plane
                cut = np.float32(np.median(along))
                high = along > cut
                if high.any() and not high.all():
                    return plane, cut, rows[~high], rows[high]
        return None

    def place(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree, numbered through all trees."""
        out = np.empty((len(vectors), len(self.roots)), dtype=np.int32)
        for t, root in enumerate(self.roots):
            at = np.full(len(vectors), root, dtype=np.int32)
            while len(open_rows := np.flatnonzero(at >= 0)):
                nodes = at[open_rows]
                side = np.einsum("ij,ij->i", vectors[open_rows], self.planes[nodes]) > self.cuts[nodes]
                at[open_rows] = self.children[nodes, side.astype(np.int32)]
            out[:, t] = self.first[t] - at - 1
        return out

    def search(self, query: np.ndarray, probes: int) -> np.ndarray:
        """The nearest leaves of a query. A margin is computed when its node is reached, or all at once if there are few."""
        planes, cuts, children, first = self.planes, self.cuts, self.children, self.first
        margins = (planes @ query - cuts).tolist() if len(cuts) <= 16 * probes else None
        queue = [(0.0, t, root) for t, root in enumerate(self.roots)]
        heapq.heapify(queue)
        found: list[int] = []
        while queue and len(found) < probes:
            far, tree, node = heapq.heappop(queue)
            while node >= 0:
                m = margins[node] if margins else float(planes[node] @ query - cuts[node])
                low, high = children[node].tolist()
                near, other = (high, low) if m > 0 else (low, high)
                heapq.heappush(queue, (max(far, abs(m)), tree, other))
                node = near
            found.append(int(first[tree]) - node - 1)
        return np.array(found, dtype=np.int32)

    def margins_of_leaves(self, queries: np.ndarray) -> np.ndarray:
        """For each query and leaf, the margin at which the queue gives it: a row for each query."""
        out = np.empty((len(queries), int(self.first[-1])), dtype=np.float32)
        margins = queries @ self.planes.T - self.cuts if len(self.cuts) else np.zeros((len(queries), 0), dtype=np.float32)
        for t, root in enumerate(self.roots):
            nodes, far = np.array([root]), np.zeros((len(queries), 1), dtype=np.float32)
            while len(nodes):
                done = nodes < 0
                out[:, self.first[t] - nodes[done] - 1] = far[:, done]
                nodes, far = nodes[~done], far[:, ~done]
                m = margins[:, nodes]
                high = np.maximum(far, np.where(m > 0, 0, np.abs(m)))
                low = np.maximum(far, np.where(m > 0, np.abs(m), 0))
                nodes, far = np.r_[self.children[nodes, 0], self.children[nodes, 1]], np.column_stack([low, high])
        return out


def usable(vector: Column) -> Column:
    """Whether a vector has only finite components, not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _classes(rows: DataFrame, k: int) -> DataFrame:
    """One row for each distinct vector: its smallest identifiers, at most k + 1."""
    ranked = rows.withColumn("nth", F.dense_rank().over(W.partitionBy("vector").orderBy("vec_id"))).where(F.col("nth") <= k + 1)
    found = ranked.groupBy("vector").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
    return found.select(F.col("ids")[0].alias("class"), "vector", "ids")


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat, dtype=np.float32 if flat.dtype == np.float32 else np.float64).reshape(len(column), -1)


def _lengthened(vectors: np.ndarray, longest: float) -> np.ndarray:
    x = vectors.astype(np.float64)
    rest = np.sqrt(np.maximum(0.0, longest * longest - np.einsum("ij,ij->i", x, x)))
    return np.column_stack([x, rest]).astype(np.float32) if longest else x.astype(np.float32)


def _turned(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Queries as long as the longest vector, in single precision."""
    x = vectors.astype(np.float64)
    lengths = np.sqrt(np.einsum("ij,ij->i", x, x))
    return np.column_stack([x / lengths[:, None] * longest, np.zeros(len(x))]).astype(np.float32)


def _best(scores: np.ndarray, most: int, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ``most`` best finite scores of each row and of all that tie with the last."""
    if scores.shape[1] > most:
        cut = -np.partition(-scores, most - 1, axis=1)[:, most - 1]
        return np.nonzero((scores >= (cut - near)[:, None]) & (scores > -np.inf))
    return np.nonzero(scores > -np.inf)


def _cut_off(owner: np.ndarray, ids: np.ndarray, scores: np.ndarray, most: int) -> np.ndarray:
    """Which entries to keep, best first within each owner, ties to the smaller identifier."""
    order = np.lexsort((ids, -scores, owner))
    owner = owner[order]
    return order[np.arange(len(owner)) - np.searchsorted(owner, owner, side="left") < most]


def _true_neighbours(placed: DataFrame, asked: np.ndarray, classes: np.ndarray, k: int) -> DataFrame:
    """(query, class, score, leaves) of the ``k`` best rows of each of a few queries, by comparing them with all rows; ``query`` is its number."""
    out = "query int, class long, score double, leaves binary"

    def run(batches):
        held = [np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0), np.empty(0, dtype=object)]
        for batch in batches:
            x, ids = _matrix(batch.column(1)).astype(np.float64), batch.column(0).to_numpy()
            leaves = np.array(batch.column(2).to_pylist(), dtype=object)
            for at in range(0, len(x), 8192):
                scores = asked @ x[at : at + 8192].T
                scores[classes[:, None] == ids[None, at : at + 8192]] = -np.inf  # itself
                who, which = _best(scores, k, np.zeros(len(asked)))
                more = [who, ids[at + which], scores[who, which], leaves[at + which]]
                held = [np.concatenate(p) for p in zip(held, more, strict=True)]
                keep = _cut_off(held[0], held[1], held[2], k)
                held = [p[keep] for p in held]
        if len(held[0]):
            kinds = (pa.int32(), pa.int64(), pa.float64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(p, type=t) for p, t in zip(held, kinds, strict=True)], names=["query", "class", "score", "leaves"])

    found = placed.select("class", "vector", "leaves").mapInArrow(run, out)
    nth = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "class"))
    return found.withColumn("nth", nth).where(F.col("nth") <= k).select("query", "leaves")


def _enough(forest: Forest, asked: np.ndarray, true: list, recall: float) -> int:
    """The least number of probes that visits the share ``recall`` of the true neighbours, given as (query, leaves)."""
    if not true:
        return 1
    far = forest.margins_of_leaves(asked)
    in_order = np.sort(far, axis=1)
    who = np.array([r.query for r in true])
    leaves = np.array([np.frombuffer(r.leaves, dtype="<i4") for r in true])
    at = far[who[:, None], leaves].min(axis=1)
    needed = np.array([np.searchsorted(in_order[q], m, side="right") for q, m in zip(who, at, strict=True)])
    return int(np.sort(needed)[min(len(needed), int(np.ceil(recall * len(needed)))) - 1])


def _regions(sizes: np.ndarray, group: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of leaves of about ``group`` rows, ``most`` at most: the region of each leaf, and the chunks of each region."""
    group_of = max(group, -(-int(sizes.sum()) // most))
    region = np.minimum((np.cumsum(sizes) - sizes) // group_of, most - 1)
    _, region = np.unique(region, return_inverse=True)
    rows = np.bincount(region, weights=sizes)
    return region.astype(np.int32), np.maximum(1, -(-rows // (2 * group))).astype(np.int32)


def nearest(df: DataFrame, queries: Column, k: int, vec_id: str = "vec_id", vector: str = "embedding", trees: int = TREES, leaf: int = LEAF, probes: int = 1, sample: int = SAMPLE, recall: float | None = RECALL, group: int = GROUP) -> DataFrame:
    """For every row of ``df`` where ``queries`` (of column vec_id) holds, its ``k`` nearest others found: query_id, rank, vec_id, score.

    A query visits ``probes`` leaves or, unless it is null, as many as reach ``recall`` on the first queries, if that is more.
    """
    out = "query_id long, rank int, vec_id long, score double"
    spark = df.sparkSession
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector")).where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    size = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if size is None:
        return spark.createDataFrame([], out)
    rows = rows.where(F.size("vector") == size.d)
    classes = written(_classes(rows, k), "classes")
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    total, longest = classes.agg(F.count("*"), F.max(norm)).first()
    chosen = classes.orderBy(F.xxhash64("class"), "class").limit(min(sample, max(1024, SAMPLE_VALUES // size.d))).select("vector").toPandas()["vector"]
    points = _lengthened(np.array([np.asarray(x) for x in chosen], dtype=np.float64), longest)
    grown = Forest(points, trees, max(LEAF_LEAST, leaf * len(points) // total))
    forest = spark.sparkContext.broadcast(grown)

    def place(batches):
        for batch in batches:
            leaves = forest.value.place(_lengthened(_matrix(batch.column(1)), longest))
            packed = [row.tobytes() for row in leaves.astype("<i4")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(packed, type=pa.binary()), pa.array(leaves[:, 0])], names=["class", "vector", "leaves", "home"])

    kind = dict(classes.dtypes)["vector"]
    placed = written(classes.select("class", "vector").mapInArrow(place, f"class long, vector {kind}, leaves binary, home int"), "placed")
    sizes = np.zeros(grown.leaves[0], dtype=np.int64)
    for r in placed.groupBy("home").agg(F.count("*").alias("n")).collect():  # leaves of one tree: a bounded number
        sizes[r.home] = r.n
    region_of, chunks = _regions(sizes, group, REGIONS)

    asking = rows.where(queries).select("vec_id", "vector")
    asked = written(asking.join(classes.select("class", "vector"), "vector").select("vec_id", "class").distinct(), "asked")
    sought = written(classes.join(asked.select("class").distinct(), "class", "left_semi").select("class", "vector"), "sought")
    if recall is not None:
        first = sought.orderBy(F.xxhash64("class", F.lit(1)), "class").limit(ASKED_FIRST).collect()
        if not first:
            return spark.createDataFrame([], out)
        few = np.array([r.vector for r in first], dtype=np.float64)
        true = _true_neighbours(placed, few, np.array([r["class"] for r in first]), k).collect()  # k rows for each
        probes = max(probes, _enough(grown, _turned(few, longest), true, recall))

    def touched(batches):
        """(leaf, word, bits): regions that have rows of a leaf, 64 in a word."""
        seen = np.empty(0, dtype=np.int64)
        for batch in batches:
            leaves = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype="<i4").reshape(batch.num_rows, -1).astype(np.int64)
            seen = np.union1d(seen, leaves * REGIONS + region_of[leaves[:, :1]])
        if len(seen):
            word, bit = seen // 64, np.uint64(1) << (seen % 64).astype(np.uint64)
            at = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            yield pa.RecordBatch.from_arrays([pa.array(word[at]), pa.array(np.bitwise_or.reduceat(bit, at).view(np.int64))], names=["word", "bits"])

    table = np.zeros(sum(grown.leaves) * REGIONS // 64, dtype=np.int64)
    words = placed.select("leaves").mapInArrow(touched, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    table[words["word"].to_numpy()] = words["bits"].to_numpy()
    table = spark.sparkContext.broadcast(table.reshape(-1, REGIONS // 64))

    def search(batches):
        f, bits = forest.value, table.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                found = [f.search(q, probes) for q in _turned(_matrix(some.column(1)), longest)]
                regions = [np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(bits[x], axis=0).view(np.uint8), bitorder="little")).astype(np.int32) for x in found]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array([x.astype("<i4").tobytes() for x in found], type=pa.binary()), pa.array(regions, type=pa.list_(pa.int32()))], names=["class", "vector", "probed", "regions"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = written(sought.repartition(parts, "class").mapInArrow(search, f"class long, vector {kind}, probed binary, regions array<int>"), "sent")
    meets = np.zeros(len(chunks), dtype=np.int64)
    for r in sent.select(F.explode("regions").alias("region")).groupBy("region").agg(F.count("*").alias("n")).collect():  # at most REGIONS rows
        meets[r.region] = r.n
    splits = np.maximum(1, -(-meets // QUERIES)).astype(np.int32)
    # every row is in one chunk, and there once for each split; every query is in one split of all chunks of its regions
    number = lambda values, i: F.element_at(F.lit(values.tolist()), i + 1)
    dealt = placed.withColumn("region", number(region_of, F.col("home")))
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("class", F.lit(2)), number(chunks, F.col("region"))).cast("int"))
    dealt = dealt.select("region", "chunk", F.explode(F.sequence(F.lit(0), number(splits, F.col("region")) - 1)).alias("split"), "class", "vector", "leaves")
    there = sent.select(F.explode("regions").alias("region"), "class", "vector", "probed")
    there = there.withColumn("split", F.pmod(F.xxhash64("class", F.lit(3)), number(splits, F.col("region"))).cast("int"))
    there = there.select("region", F.explode(F.sequence(F.lit(0), number(chunks, F.col("region")) - 1)).alias("chunk"), "split", "class", "vector", "probed")
    most = k + 1

    def rerank(here: pa.Table, asks: pa.Table) -> pa.Table:
        kinds = pa.schema([("query", pa.int64()), ("class", pa.int64()), ("score", pa.float64())])
        if not len(here) or not len(asks):
            return kinds.empty_table()
        x, ids = _matrix(here["vector"].combine_chunks()).astype(np.float64), here["class"].to_numpy()
        leaves = np.frombuffer(b"".join(here["leaves"].to_pylist()), dtype="<i4")
        order = np.argsort(leaves, kind="stable")
        in_order, owner = leaves[order], order // trees
        q, who = _matrix(asks["vector"].combine_chunks()).astype(np.float64), asks["class"].to_numpy()
        probed = [np.frombuffer(p, dtype="<i4") for p in asks["probed"].to_pylist()]
        alike = np.argsort([p[0] for p in probed], kind="stable")  # queries of one leaf share most of their rows
        lengths, norms = np.linalg.norm(x, axis=1).max(), np.linalg.norm(q, axis=1)
        best = []
        for at in range(0, len(q), BLOCK):
            block = alike[at : at + BLOCK]
            mask = np.zeros((len(block), len(x)), dtype=bool)
            for i, own in enumerate(block):
                start, stop = (np.searchsorted(in_order, probed[own], side) for side in ("left", "right"))
                n = stop - start
                mask[i, owner[np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())]] = True
            used = np.flatnonzero(mask.any(axis=0))
            if not len(used):
                continue
            scores = np.where(mask[:, used], q[block] @ x[used].T, -np.inf)
            a, b = _best(scores, most, ROUNDING * norms[block] * lengths)
            a, b = block[a], used[b]
            exact = np.einsum("ij,ij->i", q[a], x[b])
            keep = _cut_off(a, ids[b], exact, most)
            best.append((who[a[keep]], ids[b[keep]], exact[keep]))
        return pa.table([np.concatenate(c) for c in zip(*best, strict=True)], schema=kinds) if best else kinds.empty_table()

    by = ("region", "chunk", "split")
    best = dealt.groupBy(*by).cogroup(there.groupBy(*by)).applyInArrow(rerank, "query long, class long, score double")
    best = best.withColumn("nth", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "class"))).where(F.col("nth") <= most)
    with_ids = best.join(classes.select("class", "ids"), "class").select("query", "score", F.explode("ids").alias("id"))
    lists = with_ids.groupBy("query").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))).alias("found"))
    others = F.slice(F.filter("found", lambda x: x["id"] != F.col("vec_id")), 1, k)
    done = asked.join(lists, asked["class"] == lists["query"]).select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("i", "x"))
    return done.select("query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.s")).alias("score"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every 20th vector."""
    return nearest(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)
