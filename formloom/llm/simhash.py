"""SimHash near-dedup with deletion-variant signatures (operator 6).

A text's fingerprint has 64 bits; each is set if more than half of the hashes of its word shingles
(repeats included) have it. Two fingerprints link if at most ``bits`` = 2 bits differ.

Search: a fingerprint is cut into two segments of 32 bits, fewer than differing bits plus one,
so that of two linked fingerprints one segment differs by one bit at most. Of each
segment all variants with one bit as a wildcard are indexed; fingerprints meet in an equality join on
(segment, wildcard, the rest of the segment), and each pair is verified and reported at one of the
places where it meets. Only distinct fingerprints enter, so copies cost nothing.

A variant that more than :data:`HOT` distinct fingerprints share is not joined with itself. There
both segments are known to agree but for the wildcard, so the rest of the difference lies in the other
segment, and every variant of it with the wildcards that remain is a key that at most four
fingerprints share. They link to the smallest of them. That finds the
same links up to connection, at a cost in proportion to the number of fingerprints.

Words are runs of other bytes than space and 0x09-0x0D, after A-Z are lower-cased; a text of fewer
words than a shingle is one shingle; without words (null, empty) the fingerprint is zero and
links like any other. Repeated rows are kept. A component's identifier is the smallest ``doc_id``
in it; it is null only if all of its rows lack one. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from formloom.llm.components import components
from formloom.llm.exact import digest_key, joined_by_group, keep_rows
from formloom.session import load, scratch, written

#: Distinct fingerprints that may share a variant and still be compared pair by pair.
HOT = 512
#: Hashes whose bits are counted at once.
BLOCK = 1 << 15


def hashed_shingles(text: bytes, words: int, seed: int):
    """The hashes of a text's word shingles in order, repeats included, in arrays of at most :data:`BLOCK`."""
    from xxhash import xxh64_intdigest

    found = text.lower().split()  # of bytes: A-Z, and white space of ASCII
    if not found:
        return
    n = max(1, len(found) - words + 1)
    line = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1][:n].tolist()
    stops = ends[min(words, len(found)) - 1 :].tolist()
    for at in range(0, n, BLOCK):
        yield np.array([xxh64_intdigest(line[a:b], seed) for a, b in zip(starts[at : at + BLOCK], stops[at : at + BLOCK], strict=True)], dtype="<u8")


def fingerprint_of(text: bytes, words: int = 3, seed: int = 42) -> int:
    """The 64-bit fingerprint of a text's bytes."""
    counts, n = np.zeros(64, dtype=np.int64), 0
    for hashes in hashed_shingles(text, words, seed):
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprint_udf(words: int = 3, seed: int = 42):
    """A column function: the fingerprint of a binary column, as a signed long."""

    @arrow_udf(T.LongType())
    def fingerprint(values: pa.Array) -> pa.Array:
        seen: dict[bytes, int] = {}
        made = []
        for value in values:
            value = value.as_py() or b""
            found = seen.get(value)
            if found is None:
                found = fingerprint_of(value, words, seed)
                found = seen[value] = found - (1 << 64) if found >> 63 else found
            made.append(found)
        return pa.array(made, type=pa.int64())

    return fingerprint


def links(prints: DataFrame, hot: int = HOT) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp``; within hot variants, enough of them to connect the same."""
    fp = F.col("fp")
    high, low = F.shiftrightunsigned(fp, 32), fp.bitwiseAND(F.lit(0xFFFFFFFF))
    segments = F.array(F.struct(F.lit(0).cast("long").alias("s"), high.alias("own"), low.alias("other")), F.struct(F.lit(1).cast("long").alias("s"), low.alias("own"), high.alias("other")))
    # each row becomes 64: dealt out evenly before, however few files it came from
    spread = prints.select("fp").repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    cut = spread.select("fp", F.explode(segments).alias("x")).select("fp", "x.*", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("i"))
    # one number for segment, wildcard and the rest: 1 + 5 + 32 bits
    keyed = cut.withColumn("key", F.expr("shiftleft(s, 40) | shiftleft(cast(i AS long), 33) | (own & ~shiftleft(1L, i))"))
    crowds = written(keyed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "crowds")
    met = written(keyed.select("key", "fp").join(crowds.where(F.col("m") <= hot).select("key").hint("merge"), "key", "left_semi"), "met")
    a, b = met.select("key", F.col("fp").alias("a")), met.select("key", F.col("fp").alias("b"))
    # a pair meets at every wildcard of an equal segment: it counts at the first segment that
    # qualifies, and there at the bit that differs, or at wildcard 0 if none does
    place = """
        shiftrightunsigned(key, 40) = if(bit_count(shiftrightunsigned(a ^ b, 32)) <= 1, 0, 1)
        AND if(shiftrightunsigned(key, 40) = 0, shiftrightunsigned(a ^ b, 32), (a ^ b) & 4294967295L)
            IN (shiftleft(1L, cast(shiftrightunsigned(key, 33) & 31 AS int)), if(shiftrightunsigned(key, 33) & 31 = 0, 0L, -1L))
    """
    joined = a.join(b.hint("merge"), "key").where("a < b AND bit_count(a ^ b) <= 2").where(place).select("a", "b")
    crowded = crowds.where(F.col("m") > hot).select("key")
    return joined if crowded.isEmpty() else joined.union(_hot_links(keyed, crowded))


def _hot_links(keyed: DataFrame, hot: DataFrame) -> DataFrame:
    """Links within variants that many fingerprints share, by variants of the other segment."""
    rows = written(keyed.join(hot, "key", "left_semi").select("key", "fp", "s", "own", "other", "i"), "hot")
    # the wildcard bit may differ, and one bit of the other segment
    one = rows.select("fp", "key", "other", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("j"))
    one = one.select("fp", "key", "j", F.lit(-1).alias("k"), F.expr("other & ~shiftleft(1L, j)").alias("rest"))
    # the segment agrees in full, and two bits of the other may differ: wildcard 0 stands for all
    two = rows.where("i = 0").select("fp", F.expr("shiftleft(1L, 50) | shiftleft(s, 40) | own").alias("key"), "other", F.explode(F.sequence(F.lit(0), F.lit(30))).alias("j"))
    two = two.select("fp", "key", "other", "j", F.explode(F.expr("sequence(j + 1, 31)")).alias("k"))
    two = two.select("fp", "key", "j", "k", F.expr("other & ~shiftleft(1L, j) & ~shiftleft(1L, k)").alias("rest"))
    met = one.union(two)  # at most four distinct fingerprints agree in all of this
    return met.withColumn("a", F.min("fp").over(W.partitionBy("key", "j", "k", "rest"))).where("a != fp").select("a", F.col("fp").alias("b"))


def fingerprint_components(prints: DataFrame, hot: int = HOT) -> DataFrame:
    """(fp, root) for each distinct ``fp``: root is the smallest fingerprint that links reach."""
    distinct = written(prints.select("fp").distinct(), "prints")
    roots = components(links(distinct, hot))
    return distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"))


def simhash_components(df: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 3, seed: int = 42) -> DataFrame:
    """For every row: doc_id, fingerprint (16 hexadecimal digits) and component_id."""
    prints = written(df.select(F.col(doc_id).cast("long").alias("doc_id"), fingerprint_udf(words, seed)(F.col(text).cast("binary")).alias("fp")), "fingerprints")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    rooted = written(classes.join(fingerprint_components(prints), "fp"), "classes")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_print = rooted.join(least, "root").select("fp", "component_id", "n")
    return joined_by_group(prints, by_print, "fp", "n", prints.count()).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(df: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 3, seed: int = 42) -> DataFrame:
    """``df`` with one row of each component, that of the smallest ``doc_id``; all columns as they were."""
    raw = F.col(text).cast("binary")
    prints = df.select(F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).cast("long").alias("doc_id"), digest_key(raw).alias("key")).alias("row"), fingerprint_udf(words, seed)(raw).alias("fp"))
    with scratch():
        prints = written(prints, "fingerprints")
        classes = prints.groupBy("fp").agg(F.min("row").alias("row")).join(fingerprint_components(prints), "fp")
        stay = written(classes.groupBy("root").agg(F.min("row").alias("row")).select("row.doc_id", "row.key"), "stay", outer=True)
        return keep_rows(df, stay, prints.select("row.doc_id", "row.key"), text, doc_id)


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and the smallest document of its component."""
    return simhash_components(load(spark, sf_dir, "documents").select("doc_id", "text"))
