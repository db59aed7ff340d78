"""Spelling variants (12) against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from formloom.llm import spelling

SF = "/root/testdata/sf0.001"


def corpus(rows):
    n = Counter()
    for doc_id, text in rows:
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def near(a, b):
    """Exactly one inserted, deleted or replaced code point, read from the definition."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(n):
    close, form = {w: [x for x in n if near(w, x)] for w in n}, {}
    for w, others in close.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        if best and n[best] >= 10 * n[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w) or "", root(w), n[w], len(close[w]), n.get(form.get(w), 0)) for w in n)


def rows_of(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in df.collect())


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="abÀ×", min_size=4, max_size=14), st.data())
def test_near_words_share_a_key(word, data):
    """Whatever the counts of bigrams."""
    counts = [0] * spelling.SLOTS
    for a in "abÀ×":
        for b in "abÀ×":
            counts[spelling._slot(a + b, 0)] = data.draw(st.integers(0, 3))
    at, kind, x = data.draw(st.integers(0, len(word) - 1)), data.draw(st.sampled_from("idr")), data.draw(st.sampled_from("abÀ×"))
    other = {"i": word[:at] + x + word[at:], "d": word[:at] + word[at + 1 :], "r": word[:at] + x + word[at + 1 :]}[kind]
    if other == word or len(other) < 4:
        return
    shorter = min(len(word), len(other))
    keys = [spelling.keys_of(w, spelling.rarest(w, counts), shorter) for w in (word, other)]
    assert keys[0] & keys[1]


def test_words_against_brute_force(spark):
    rng = random.Random(12)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 9))): rng.choice((2, 3, 25, 300, 4000)) for _ in range(700)}
    words |= {"x" * 5000: 2, "x" * 5001: 30, "x" * 4999 + "y": 400, "日本語四文": 2, "日本語四丈": 20}
    df = spark.createDataFrame(list(words.items()), "word string, n long").withColumn("near", F.lit(1))
    want = {w: k for w, k in words.items() if len(w) >= 4}
    got = rows_of(spelling.variant_groups(df))
    assert [r for r in got if len(r[0]) >= 4] == brute(want)
    assert all(r[1:3] == ("", r[0]) and r[4] == 0 for r in got if len(r[0]) < 4)


def test_paths_of_forms(spark):
    words = {"abcdefgh" + "x" * i: 2 * 10**i for i in range(9)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert {r.root for r in spelling.variant_groups(df).collect()} == {"abcdefghxxxxxxxx"}


def test_ties(spark):
    df = spark.createDataFrame([("abcdefg", 1), ("abcdefé", 10), ("abcdefz", 10), ("abcdefga", 9)], "word string, n long")
    assert {r.word: (r.form, r.n_near) for r in spelling.variant_groups(df).collect()} == {"abcdefg": ("abcdefz", 3), "abcdefé": (None, 2), "abcdefz": (None, 2), "abcdefga": (None, 1)}


def test_documents(spark):
    """Nulls, empty and long texts, repeated rows, signs within words, upper case beyond ASCII, other columns."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice(("la", "ti", "É", "ö", "ne")) for _ in range(rng.randint(2, 6))) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(vocabulary).upper() if rng.random() < 0.1 else rng.choice(vocabulary) for _ in range(rng.randint(0, 90)))) for i in range(150)]
    rows += [(None, rows[3][1]), (None, None), (200, None), (201, ""), (202, "Straße's straße×s straße×s straße×sĀabcdefgh"), (202, rows[5][1]), (202, rows[5][1]), (203, "abcdefg" * 100_000), (204, "abcdefg" * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("x")).withColumn("n", F.lit(1)).withColumn("key", F.lit(2))
    words = spelling.corpus_words(df)
    want = corpus(rows)
    assert {r.word: r.n for r in words.collect()} == want
    assert rows_of(spelling.variant_groups(words)) == brute(want)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variant_groups(spelling.corpus_words(df)).collect() == []
    with pytest.raises(ValueError):
        spelling.variant_groups(spelling.corpus_words(df), ratio=1)


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    df = spelling.op12_spelling_variants(spark, SF)
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert rows_of(df) == brute(corpus(rows))
