"""Language identification (11): lists and distances against a plain version, held-out accuracy, odd inputs."""

import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from formloom.llm import language

SF = "/root/testdata/sf0.01"


def plain_grams(text):
    words = [w for w in re.split(r"[\W\d_]+", text.lower()) if w]
    joined = f" {' '.join(words)} "
    found = (joined[i : i + n] for n in range(1, 6) for i in range(len(joined) - n + 1))
    return Counter(g for g in found if g != " " and " " not in g[1:-1])


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aAbÉß 1_.-𝒳\n²", max_size=60), st.integers(1, 9))
def test_grams(text, segment):
    ready = language.normalised(text)
    before, language.SEGMENT = language.SEGMENT, segment
    try:
        numbers, counts, places, lengths = language.grams(ready)
    finally:
        language.SEGMENT = before
    assert list(numbers) == sorted(set(numbers))
    got = {ready[a : a + n]: c for a, n, c in zip(places.tolist(), lengths.tolist(), counts.tolist(), strict=True)}
    assert got == (plain_grams(text) if any(map(str.isalpha, text)) else {})


def plain_distances(text, lists, size):
    counts = plain_grams(text)
    assert len(counts) <= size
    ordered = sorted(counts.values(), reverse=True)
    place = {g: (ordered.index(n) + len(ordered) - 1 - ordered[::-1].index(n)) / 2 for g, n in counts.items()}
    return [sum(abs(own.index(g) - place[g]) if g in own else size for g in counts) / (size * len(counts)) for own in lists]


def test_distances():
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 4))) for _ in range(30)]
    lists = {x: [g for g, _ in plain_grams(" ".join(rng.choice(words) for _ in range(200))).most_common(400)] for x in "xyz"}
    profiles = language.Profiles(lists)
    for _ in range(50):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 25)))
        assert profiles.distances(text) == pytest.approx(plain_distances(text, [lists[x] for x in profiles.languages], 400))


def test_profile_is_the_order_of_frequency(spark):
    rows = [(i, "ab abc", "x") for i in range(5)] + [(9, "xyz " * 3, "y"), (10, None, "y"), (11, "qqq", None), (None, "rrr", "y")]
    profiles = language.fit_profiles(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    counts = plain_grams("ab abc")  # equal texts count once
    assert profiles.lists["x"] == sorted(counts, key=lambda g: (-counts[g], g))
    assert profiles.languages == ["x", "y"] and not any("q" in g or "r" in g for own in profiles.lists.values() for g in own)


def test_odd_inputs(spark):
    rng = random.Random(1)
    say = lambda syllables: " ".join("".join(rng.choice(syllables) for _ in range(3)) for _ in range(30))
    train = spark.createDataFrame([(i, say("la ti no".split()) if i % 2 else say("ck sch ung".split()), "i" if i % 2 else "d") for i in range(40)], "doc_id long, text string, lang string")
    profiles = language.fit_profiles(train)
    texts = [None, "", " 12 ²_.", "Ξ", "la", "LATINO", "schung " * 300_000, "latino" * 200_000, "1", "latino", "latino"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("c0", F.lit(1)).withColumn("lang.x", F.lit(1))
    rows = {r.doc_id: r for r in language.detect(df, profiles).collect()}
    assert [rows[i].lang_pred for i in range(len(texts))] == ["und", "und", "und", "d", "i", "i", "d", "i", "und", "i", "i"]
    assert rows[3].score == 0.5 and rows[0].score == 0 and all(0 <= r.score <= 1 for r in rows.values())
    with pytest.raises(ValueError):
        language.detect(df.withColumn("Score", F.lit(1)), profiles)
    assert language.detect(df.limit(0), profiles).collect() == []
    empty = language.fit_profiles(train.limit(0))
    assert {(r.lang_pred, r.score) for r in language.detect(df, empty).collect()} == {("und", 0.0)}


def test_query_on_held_out_documents(spark):
    df = language.op11_language_id(spark, SF)
    assert df.columns == ["doc_id", "held_out", "lang_pred", "score"]
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = df.collect()
    assert len(rows) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.99 * len(held)
