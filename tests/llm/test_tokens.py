"""Tokenizers, byte-level BPE (1), packing (2) and token shards (10) against the libraries themselves."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.fs
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from formloom.llm import bpe, packing, sstable
from formloom.llm.tokens import PieceEncoder, portions, rank_encoder, safe_chunks
from formloom.session import shared_dir

RANKS, PATTERN = public_tokenizers.path(bpe.RANKS), public_tokenizers.PATTERN
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", " ", "\n", " \n x", "don't 'll 's it''s", "0 0 00 12 a0b", "!!! 0 \n\n x  y ", "é" * 70 + " " + "z" * 65, "日本語 text", "\t\ta b", "<|endoftext|> <|startoftext|>", "Ça va, l'été?\r\n", "x" * 200, "The the the THE", "İstanbul ﬁ é"]


def packed(ids):
    return np.array(ids, dtype="<u4").tobytes()


@pytest.fixture(scope="module")
def encoders():
    return {words: PieceEncoder(path, words, most=50) for path, words in ((BYTES, False), (WORDS, True))}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.text(alphabet="ab'stréÉ 0,!\n\t", max_size=40), st.sampled_from(TEXTS)), max_size=6))
def test_pieces_give_the_library_s_ids(encoders, texts):
    for encoder in encoders.values():
        library = [packed(x.ids) for x in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert encoder.encode_many(texts) == library


def test_portions():
    values = [b"x" * n for n in (0, 3, 5, 1, 9, 2)] + [None]
    found = list(portions(iter(values), 6))
    assert [x for _, some in found for x in some] == values and [at for at, _ in found] == [0, 3, 5][: len(found)]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab é'0!\n\t.", max_size=400))
def test_safe_chunks_change_no_id(text):
    encoder = rank_encoder(RANKS, PATTERN)
    whole = encoder.encoding.encode_ordinary(text)
    chunks = list(safe_chunks(text, 7))
    assert "".join(chunks) == text and [i for x in chunks for i in encoder.encoding.encode_ordinary(x)] == whole


def test_long_texts():
    encoder = rank_encoder(RANKS, PATTERN)
    for text in ("word " * 40_000, "a" * 100_000, "ab\n" * 50_000 + "é" * 1000):
        ids = encoder.encode(text)
        assert ids == packed(encoder.encoding.encode_ordinary(text)) and encoder.decode(ids) == text.encode()


def test_bpe_table(spark):
    rows = [(i, t, i) for i, t in enumerate(TEXTS)] + [(None, None, 1), (0, "", 0), (5, TEXTS[5], 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int")
    made = bpe.bpe_decode(bpe.bpe_encode(df, RANKS, PATTERN), RANKS, PATTERN)
    assert made.columns == ["doc_id", "text", "n", "ids", "decoded"] and made.count() == len(rows)
    encoder = rank_encoder(RANKS, PATTERN)
    for r in made.collect():
        assert bytes(r.ids) == packed(encoder.encoding.encode_ordinary(r.text or "")) and bytes(r.decoded) == (r.text or "").encode()
    assert bpe.bpe_encode(df.where("false"), RANKS, PATTERN).count() == 0
    odd = df.withColumnRenamed("n", "n.a")
    assert bpe.bpe_encode(odd, RANKS, PATTERN).columns == ["doc_id", "text", "n.a", "ids"] and bpe.bpe_encode(odd, RANKS, PATTERN).count() == len(rows)
    with pytest.raises(ValueError, match="ids"):
        bpe.bpe_encode(df.withColumn("IDS", F.lit(1)), RANKS, PATTERN)


def test_bpe_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    encoder = rank_encoder(RANKS, PATTERN)
    want = {}
    for r in docs.collect():
        ids = encoder.encoding.encode_ordinary(r.text)
        want[r.doc_id] = (len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest())
    assert {r.doc_id: tuple(r)[1:] for r in bpe.op1_bpe_encode(spark, "/root/testdata/sf0.001").collect()} == want


# -- packing


def plain_best_fit(lengths, capacity):
    rooms: list[int] = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(capacity - n)
    return len(rooms)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120))
def test_plan_holds_each_piece_once(lengths):
    plan = packing.make_plan(Counter(lengths), 64, grid=16)
    held = Counter()
    for parts, room, times in plan.runs:
        assert sum(a * n for a, n in parts) + room == 64 and room >= 0 and times > 0
        for a, n in parts:
            held[a] += n * times
    assert held == Counter(lengths)
    spots = packing.slots(plan)
    for length, n in Counter(lengths).items():
        assert spots["places"][spots["length"] == length].sum() == n


@pytest.mark.parametrize("seed", range(4))
def test_plan_is_as_good_as_best_fit(seed):
    rng = random.Random(seed)
    lengths = [min(512, max(1, int(rng.lognormvariate(4.2, 1.0)))) for _ in range(3000)]
    plan = packing.make_plan(Counter(lengths), 512)
    n = sum(r[2] for r in plan.runs)
    assert n <= math.ceil(1.005 * plain_best_fit(lengths, 512)) and n >= math.ceil(sum(lengths) / 512)


def test_fit_meets_a_histogram_that_patterns_make():
    patterns = packing.patterns_of(24, 3)
    assert len({tuple(p) for p in patterns}) == len(patterns) and (patterns.sum(axis=1) == 24).all()
    times = np.zeros(len(patterns))
    times[[3, 20, 40]] = 700, 50, 333
    histogram = np.bincount(patterns.ravel(), weights=np.repeat(times, 3), minlength=25)
    histogram[0] = 0
    found = packing.fit_counts(patterns, histogram)
    made = np.bincount(patterns.ravel(), weights=np.repeat(found, 3), minlength=25)
    assert (found >= 0).all() and np.allclose(made[1:], histogram[1:], atol=1e-3)


def check_packing(rows, texts, capacity, words=True, end=1):
    encoder = PieceEncoder(WORDS if words else BYTES, words)
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append(r)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    for doc_id, text in texts.items():
        ids = encoder.encode(text or "") + packed([end])
        pieces = sorted(by_doc.pop(doc_id), key=lambda r: r.piece)
        cut = [ids[a : a + 4 * capacity] for a in range(0, len(ids), 4 * capacity)]
        assert [(p.piece, p.start, p.length, p.ids_crc32) for p in pieces] == [(k, k * capacity, len(x) // 4, zlib.crc32(x)) for k, x in enumerate(cut)]
    assert not by_doc
    return len(by_sequence)


def test_packing_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = packing.op2_best_fit_packing(spark, "/root/testdata/sf0.001").collect()
    n = check_packing(rows, docs, 4096)
    assert n <= plain_best_fit([r.length for r in rows], 4096) + 1


def test_packing_edges(spark):
    texts = {1: None, 2: "", 3: "a b c " * 500, 4: "x", 5: "same text", 6: "same text", 7: "word " * 63, 8: "word " * 64}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("length", F.lit(1)).withColumn("task", F.lit("clash"))
    rows = packing.pack(df.repartition(3), WORDS, True, 1, capacity=64).collect()
    check_packing(rows, texts, 64)
    assert packing.pack(df.where("false"), WORDS, True, 1).count() == 0
    twice = packing.pack(df.union(df), WORDS, True, 1, capacity=64).collect()
    assert len(twice) == 2 * len(rows)


# -- token shards


def test_keys_sort_as_identifiers():
    ids = [None, -(1 << 63), -5, 0, 3, (1 << 63) - 1]
    assert sorted(map(sstable.key_of, ids)) == list(map(sstable.key_of, ids)) and [sstable.id_of(sstable.key_of(i)) for i in ids] == ids


def test_shards(spark):
    texts = [(3, "c c c"), (None, "no id"), (-4, None), (7, "word " * 30_000), (3, "again"), (12, "")] + [(1000 + i, f"text number {i}") for i in range(300)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("n_ids", F.lit(1)).repartition(5)
    path = f"{shared_dir(spark)}/t"
    sstable.write_table(df, path, BYTES, end_id=0, vocabulary=50_257, shards=3)
    rows = sorted(sstable.read_table(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((t[0] for t in texts), key=lambda x: (x is not None, x or 0))
    encoder, at = PieceEncoder(BYTES, False), 0
    want = Counter((i, encoder.encode(t or "") + packed([0])) for i, t in texts)
    for r in rows:
        assert r.start == at and r.n_ids == len(r.ids) // 4
        at += r.n_ids
    assert Counter((r.doc_id, bytes(r.ids)) for r in rows) == want
    assert sorted(sstable.lookup(spark, path, 3)) == sorted(np.frombuffer(p, "<u4").tolist() for (i, p), n in want.items() if i == 3 for _ in range(n))
    assert len(sstable.lookup(spark, path, None)) == 1 and sstable.lookup(spark, path, 999) == [] and sstable.lookup(spark, path, 1299)[0][-1] == 0


def test_empty_table(spark):
    path = f"{shared_dir(spark)}/t"
    manifest = sstable.write_table(spark.createDataFrame([], "doc_id long, text string"), path, BYTES, end_id=0)
    assert manifest.count() == 0 and sstable.read_table(spark, path).count() == 0 and sstable.lookup(spark, path, 1) == []


def test_damage_is_found(tmp_path):
    file = tmp_path / "s"
    store = pyarrow.fs.LocalFileSystem()
    with store.open_output_stream(str(file)) as out:
        writer = sstable.ShardWriter(out, 4)
        for i in range(2000):
            writer.add(sstable.key_of(i), packed(range(i % 50)))
        writer.close()
        with pytest.raises(ValueError, match="ascend"):
            writer.add(sstable.key_of(5), b"")
    data = file.read_bytes()
    with store.open_input_file(str(file)) as f:
        reader = sstable.ShardReader(f)
        assert len(reader.blocks) > 1 and [len(x) // 4 for _, x in reader] == [i % 50 for i in range(2000)]
        assert reader.get(sstable.key_of(1777)) == [packed(range(27))] and reader.get(sstable.key_of(5000)) == []
    for place, match in ((10, "block"), (len(data) - sstable.FOOTER.size - 9, "index"), (len(data) - 1, "shard")):
        file.write_bytes(data[:place] + bytes([data[place] ^ 255]) + data[place + 1 :])
        with store.open_input_file(str(file)) as f, pytest.raises(ValueError, match=match):
            list(sstable.ShardReader(f))


def test_shard_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    encoder, at, want = PieceEncoder(BYTES, False), 0, {}
    for r in docs:
        ids = encoder.encode(r.text) + packed([0])
        want[r.doc_id] = (at, len(ids) // 4, zlib.crc32(ids))
        at += len(ids) // 4
    assert {r.doc_id: tuple(r)[1:] for r in sstable.op10_token_shards(spark, "/root/testdata/sf0.001").collect()} == want


def test_repeated_identifiers_spread_and_keep_their_places(spark):
    """One identifier on most rows: its rows spread over shards, and what is read back doesn't depend on how rows came in."""
    rows = [(5, f"text {i % 400} of one identifier") for i in range(900)] + [(i, f"other {i}") for i in range(200)] + [(None, "none"), (5, None)] * 20
    df = spark.createDataFrame(rows, "doc_id long, text string")
    read = []
    for some in (df.repartition(7), df.orderBy(F.desc("text")).coalesce(1)):
        path = f"{shared_dir(spark)}/t"
        manifest = sstable.write_table(some, path, BYTES, end_id=0, vocabulary=50_257, shards=6).orderBy("shard").collect()
        five = sstable.key_of(5)
        assert len(manifest) == 6 and sum(r.first_key <= five <= r.last_key for r in manifest) >= 4 and max(r.n_docs for r in manifest) < 500
        assert len(sstable.lookup(spark, path, 5)) == 921
        read.append([(r.doc_id, r.start, bytes(r.ids)) for r in sstable.read_table(spark, path).orderBy("start").collect()])
    assert read[0] == read[1] and len(read[0]) == len(rows)


def test_shards_follow_the_size(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "word " * 200) for i in range(100)], "doc_id long, text string")
    rows = docs.select(F.col("doc_id").alias("k"), F.col("text").cast("binary").alias("v"))
    assert sstable._number_of_shards(rows) == 1
    monkeypatch.setattr(sstable, "SHARD_LEAST", 40_000)
    assert sstable._number_of_shards(rows) == 3
    monkeypatch.setattr(sstable, "SHARD_BYTES", 1000)
    assert sstable._number_of_shards(rows) == 100


def test_only_ids_are_exchanged(spark, monkeypatch):
    """No exchange below the writer carries texts."""
    plans = []
    write = type(spark.range(1).write).parquet
    monkeypatch.setattr(type(spark.range(1).write), "parquet", lambda self, path, *a, **b: plans.append(self._df._jdf.queryExecution().optimizedPlan().toString()) or write(self, path, *a, **b))
    sstable.write_table(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string"), f"{shared_dir(spark)}/t", BYTES, end_id=0)
    plan = next(p for p in plans if "RepartitionBy" in p)
    assert plan.count("MapInArrow") == 2 and plan[plan.index("RepartitionBy") :].count("MapInArrow") == 1


@pytest.mark.parametrize("parts", [1, 2, 8])
def test_only_ids_are_exchanged_into_four_shards(spark, monkeypatch, parts):
    """Also where the table comes in fewer parts than there are cores; and rows that are all alike spread evenly."""
    plans = []
    write = type(spark.range(1).write).parquet
    monkeypatch.setattr(type(spark.range(1).write), "parquet", lambda self, path, *a, **b: plans.append(self._df._jdf.queryExecution().optimizedPlan().toString()) or write(self, path, *a, **b))
    rows = spark.createDataFrame([(7, "a text that all rows have")] * 4000, "doc_id long, text string")
    df = spark.read.parquet(_saved(spark, rows.coalesce(1) if parts == 1 else rows.repartition(parts)))
    manifest = sstable.write_table(df, f"{shared_dir(spark)}/t", BYTES, end_id=0, shards=4)
    plan = next(p for p in plans if "RepartitionBy" in p and "MapInArrow" in p)
    assert plan.count("Repartition") == 1 and plan.count("MapInArrow") == 2 and plan[plan.index("RepartitionBy") :].count("MapInArrow") == 1
    docs = [r.n_docs for r in manifest.collect()]
    assert len(docs) == 4 and sum(docs) == 4000 and max(docs) < 1300
    assert len(sstable.lookup(spark, manifest.inputFiles()[0].rsplit("/manifest", 1)[0], 7)) == 4000


def _saved(spark, df):
    path = f"{shared_dir(spark)}/rows"
    df.write.parquet(path)
    return path


def test_shards_against_the_library(spark):
    """Ids, places and checksums of the query by the tokenizers library itself."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    at, want = 0, {}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 0]
        want[r.doc_id] = (at, len(ids), zlib.crc32(packed(ids)))
        at += len(ids)
    assert {r.doc_id: tuple(r)[1:] for r in sstable.op10_token_shards(spark, "/root/testdata/sf0.001").collect()} == want


def test_packing_against_the_library(spark):
    """Pieces of the query by the tokenizers library itself."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 1]
        for piece, start in enumerate(range(0, len(ids), 4096)):
            own = ids[start : start + 4096]
            want[r.doc_id, piece] = (start, len(own), zlib.crc32(packed(own)))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in packing.op2_best_fit_packing(spark, "/root/testdata/sf0.001").collect()} == want
