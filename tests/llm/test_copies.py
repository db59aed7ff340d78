"""Exact dedup (9), SimHash (6) and components against brute force."""

import hashlib
import random
import re

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from formloom.llm import exact, simhash
from formloom.llm.components import components

SF = "/root/testdata/sf0.001"


def low(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(links, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a == b:
            continue
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aB cÉé\n\t\x0b \x1c", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint_of(text.encode()) == brute_fingerprint(text)


@pytest.mark.parametrize("keep", ["max", "min"])
def test_exact_groups(spark, keep):
    rng = random.Random(1)
    texts = [None, "", "A b", "a B", "a  b", "É", "é", "x" * 10_000, *(f"t{rng.randint(0, 9)}" for _ in range(300))]
    rows = list(enumerate(texts)) + [(None, "only"), (None, "A b"), (2, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit(True)).withColumn("key", F.lit(1))
    groups: dict = {}
    for i, t in rows:
        groups.setdefault(low(t), []).append(i)
    got = exact.exact_groups(df.repartition(9), keep=keep).collect()
    assert len(got) == len(rows)
    by_hash = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    kept: dict = {}
    for r in got:
        ids = by_hash[r.text_sha256]
        known = [i for i in ids if i is not None]
        assert r.group_size == len(ids) and r.keep_id == ((max if keep == "max" else min)(known) if known else None)
        assert not r.kept or r.doc_id == r.keep_id
        kept[r.text_sha256] = kept.get(r.text_sha256, 0) + r.kept
    assert set(kept.values()) == {1}
    left = exact.drop_exact_copies(df.repartition(9), keep=keep)
    assert left.columns == df.columns and left.count() == len(groups)
    assert {low(r.text) for r in left.collect()} == set(groups)


def test_exact_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert exact.exact_groups(df).count() == 0 and exact.drop_exact_copies(df).count() == 0
    with pytest.raises(ValueError, match="__key__"):
        exact.drop_exact_copies(df.withColumn("__key__", F.lit(1)))


def test_many_rounds(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), (F.col("id") % 700).cast("string")).alias("text")).repartition(90)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        got = exact.exact_groups(df).where("kept").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(r.keep_id for r in got) == sorted(max(range(k, 3000, 700)) for k in range(700))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components(spark, links):
    nodes = {x for a, b in links if a != b for x in (a, b)}
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == brute_components(links, nodes)


def test_chain_component(spark):
    links = [(i, i + 1) for i in range(60)] + [(-5, 60)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert set(got.values()) == {-5} and len(got) == 62


@pytest.mark.parametrize("hot", [512, 1])
def test_links_of_planted_neighbours(spark, hot):
    rng = random.Random(hot)
    prints = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        prints |= {base} | {base ^ 1 << rng.randrange(64) for _ in range(4)} | {base ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for _ in range(4)} | {base ^ rng.getrandbits(32)}
    prints |= {0, 3, (1 << 64) - 1, 1 << 63, 7 << 32}
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    near = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 2]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    got = {r.fp: r.root for r in simhash.fingerprint_components(df, hot).collect()}
    assert got == brute_components(near, signed)
    found = {tuple(sorted((r.a, r.b))) for r in simhash.links(df, hot).collect()}
    assert found <= {tuple(sorted(x)) for x in near} and (hot == 1 or len(found) == len(near))


def check_simhash(rows, texts):
    prints = {i: brute_fingerprint(t) for i, t in texts.items()}
    ids = sorted(texts)
    near = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if bin(prints[a] ^ prints[b]).count("1") <= 2]
    root = brute_components(near, ids)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{prints[i]:016x}", root[i]) for i in ids}
    return root


def test_simhash_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    check_simhash(simhash.op6_simhash_dedup(spark, SF).collect(), texts)


def test_simhash_edges(spark):
    long = " ".join(f"w{i}" for i in range(400))
    texts = {9: None, 4: "", 7: " \n", 1: "one", 2: "ONE", 3: "one two", 5: long, 6: long + " end", 8: long.upper()}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("fp", F.lit(1)).withColumn("root", F.lit("x"))
    root = check_simhash(simhash.simhash_components(df).collect(), texts)
    left = simhash.drop_near_copies(df.union(df))
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == sorted(set(root.values()))
    none = spark.createDataFrame([(None, "q w e"), (None, "q w e")], "doc_id long, text string")
    assert [r.component_id for r in simhash.simhash_components(none).collect()] == [None, None] and simhash.drop_near_copies(none).count() == 1
    assert simhash.simhash_components(df.where("false")).count() == 0 and simhash.drop_near_copies(df.where("false")).count() == 0


def entries(rows):
    """A run of (key, doc_id, row, n)."""
    import numpy as np

    made = np.zeros(len(rows), dtype=exact._ENTRY)
    for i, (key, doc_id, row, n) in enumerate(rows):
        made[i] = (key.encode().ljust(exact.KEY_BYTES, b"."), doc_id is None, doc_id or 0, row, n)
    return made


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from("abcdefgh"), st.sampled_from([None, 1, 2, 3]), st.integers(0, 50)), max_size=12), min_size=1, max_size=6), st.booleans())
def test_merge_of_runs(parts, largest):
    """Merging sorted runs gives what sorting everything gives."""
    import numpy as np

    numbered = [[(k, i, 100 * row + 10 * a + b, 1) for b, (k, i, row) in enumerate(part)] for a, part in enumerate(parts)]
    runs = [exact._thin(entries(part), largest) for part in numbered]
    want = exact._thin(entries([x for part in numbered for x in part]), largest)
    assert np.array_equal(exact.merge_sorted([exact._run(r.tobytes()) for r in runs], largest), want)


def test_runs_must_be_sorted(spark):
    with pytest.raises(ValueError, match="sorted"):
        exact._run(entries([("b", 1, 1, 1), ("a", 1, 2, 1)]).tobytes())
    with pytest.raises(ValueError, match="sorted"):
        exact._run(entries([("a", 1, 1, 1), ("a", 1, 2, 1)]).tobytes())
    bad = spark.createDataFrame([(0, 0, bytearray(entries([("b", 1, 1, 1), ("a", 1, 2, 1)]).tobytes())), (0, 1, bytearray(entries([("a", 1, 3, 1)]).tobytes()))], exact._RUN)
    with pytest.raises(Exception, match="not sorted"):
        exact._merged(bad, True).collect()


@pytest.mark.parametrize("chained", [1, 3])
def test_merge_over_many_runs(spark, monkeypatch, request, chained):
    """70 runs take three exchanges, whether runs are written between them or not."""
    monkeypatch.setattr(exact, "CHAINED", chained)
    monkeypatch.setattr(exact, "SLICE_ROWS", 100)
    count, merged = [], exact._merged
    monkeypatch.setattr(exact, "_merged", lambda *a: count.append(1) or merged(*a))
    setting = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "4k")  # a partition for each file
    request.addfinalizer(lambda: spark.conf.set(setting, before))
    made = spark.range(0, 2100, 1, 70).select(F.col("id").alias("doc_id"), F.concat(F.lit("T"), (F.col("id") % 300).cast("string")).alias("text"))
    got = {r.doc_id: r for r in exact.exact_groups(made).collect()}
    assert len(got) == 2100 and all(r.keep_id == 1800 + i % 300 and r.group_size == 7 and r.kept == (i == r.keep_id) for i, r in got.items())
    assert len(count) == 3


def test_large_and_small_groups(spark, monkeypatch):
    """Rows meet their groups the same way whether groups are broadcast or not, and repeated rows stay once."""
    monkeypatch.setattr(exact, "LARGE", 4)
    rows = [(1, "same", i) for i in range(40)] + [(2, "Same", 0)] + [(10 + i, f"t{i % 30}", i) for i in range(60)] + [(99, "t0", 1), (99, "t0", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, extra int").repartition(5)
    got = exact.exact_groups(df).collect()
    sizes = {}
    for _, t, _ in rows:
        sizes[low(t)] = sizes.get(low(t), 0) + 1
    assert len(got) == len(rows) and sorted(r.group_size for r in got) == sorted(sizes[low(t)] for _, t, _ in rows)
    assert {r.doc_id: r.keep_id for r in got}[1] == 2
    left = sorted(tuple(r)[:2] for r in exact.drop_exact_copies(df).collect())
    assert left == sorted({(max(i for i, t, _ in rows if low(t) == k), next(t for i, t, _ in sorted(rows, key=lambda r: -r[0]) if low(t) == k)) for k in sizes})
    assert sorted(tuple(r)[:2] for r in exact.drop_exact_copies(df, keep="min").collect())[0] == (1, "same")
