"""Spelling variants of words by a rare-first q-gram prefix filter (operator 12).

Two words are near if one inserted, deleted or replaced code point makes one of the other. Near words are found without
comparing all words:

* A word's bigrams are ordered by how many words have the bigram (rarest first), then by the bigram, then by place. One edit
  breaks at most two bigrams of either word, and those that it leaves have the same order in both. So the first bigram that is left
  stands among the three rarest of both words, at places that differ by one at most.
* That bigram lies before the edit or after it. Before it, the words agree from their start to the bigram's end; after it, from the
  bigram's start to their end. What is left in between holds the edit, in its first half or its second; if in the first, the words agree in the
  second. So what is left is halved, both ways, until the edit is known to within :data:`WINDOW` places, or a quarter of a long word. A key of the join is the length of the shorter word
  and the parts on which the words agree. Position limits and the limit on lengths are in the key, which is compared for equality.
* Pairs that share a key are verified by the edit distance, within the join, and each pair is kept once.

The keys spread, as they hold all of a word but a few places: a bigram that many words have doesn't gather them. What skew stays is left to adaptive execution, which splits large partitions of a sort-merge join.
Rows of the join are words, each of which is there once, however often the texts have it. Counts are summed up by tasks before they pass on.

A word's form is its near word that occurs most, if that occurs ``ratio`` times as often or more; its root is where the forms lead.
Forms grow in number at each step, so paths end, after as many steps at most as the largest count has powers of ``ratio``.

Defined results: null and empty texts have no words; a null identifier counts as empty; repeated rows count as often as they
stand there; of near words that occur equally often the smallest in order of code points is the form; words are compared by code points,
without normalisation; words of fewer than :data:`SHORTEST` code points have no near words (an edit can break all their
bigrams); an empty table gives no rows; other columns of the table are not read, whatever their names.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formloom.llm.arrow import named
from formloom.llm.tokens import text_of
from formloom.session import load, scratch, written

#: Letters of words, after A-Z have been lower-cased.
LETTERS = "a-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
#: One in so many words of a document loses a code point.
SPOILT = 31
#: Bigrams of a word that are looked at.
RAREST = 3
#: Places to which the edit is narrowed down; a quarter of a long word, so that no word has more keys than a few dozen.
WINDOW = 3
#: The least number of code points of which an edit leaves a bigram.
SHORTEST = 4
#: Numbers of bigrams, which their counts are kept by: exact for letters below U+0100, shared by some of others.
SLOTS = 1 << 16
#: Different words that a task sums up before it passes them on.
HELD = 200_000


def _counted(counts: dict, kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(counts.keys(), type=kind), pa.array(counts.values(), type=pa.int64())], names=["key", "n"])


def corpus_words(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, spoilt: int | None = SPOILT) -> DataFrame:
    """(word, n): words of at least so many code points that occur at least so often in all whole texts.

    Words are runs of :data:`LETTERS`, A-Z lower-cased. With ``spoilt``, a word of a document loses the code point h % length if that
    number divides h, the CRC-32 of identifier, colon and word: misspellings that are known, to measure with.
    """
    find = re.compile(f"[{LETTERS}]{{{least_length},}}").findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}
        for batch in batches:
            for own, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                value = value.as_py()
                if not value:
                    continue
                before = zlib.crc32(f"{'' if own is None else own}:".encode())
                for word, n in Counter(find(text_of(value.lower()))).items():  # of bytes: A-Z only
                    if spoilt:
                        h = zlib.crc32(word.encode(), before)
                        if h % spoilt == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < least_length:
                                continue
                    counts[word] = counts.get(word, 0) + n
                if len(counts) > HELD:
                    yield _counted(counts, pa.string())
                    counts = {}
        if counts:
            yield _counted(counts, pa.string())

    parts = docs.select(named(doc_id).cast("long"), named(text).cast("binary")).mapInArrow(run, "key string, n long")
    return parts.groupBy(F.col("key").alias("word")).agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _slot(word: str, at: int) -> int:
    return (ord(word[at]) * 256 + ord(word[at + 1])) % SLOTS


def bigram_counts(words: DataFrame) -> list[int]:
    """How many times the words have bigrams of each slot. At most :data:`SLOTS` numbers come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        for batch in batches:
            for word in batch.column(0).to_pylist():
                for i in range(len(word) - 1):
                    s = _slot(word, i)
                    counts[s] = counts.get(s, 0) + 1
        if counts:
            yield _counted(counts, pa.int64())

    found = [0] * SLOTS
    for r in words.select("word").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect():
        found[r.key] = r.n
    return found


def rarest(word: str, counts: list[int]) -> list[int]:
    """The places of the word's three rarest bigrams."""
    return [i for *_, i in sorted((counts[_slot(word, i)], word[i : i + 2], i) for i in range(len(word) - 1))[:RAREST]]


def keys_of(word: str, places: list[int], shorter: int) -> set[str]:
    """What a word and a near one have in common if the shorter of them has ``shorter`` code points and they share a bigram at one of ``places``.

    Words agree in the first x code points and the last y. As one edit parts them, the parts on which they agree make up at least ``shorter`` - 1:
    if the first of them isn't longer than x by half of what is left, the last is longer than y by that.
    """
    n, keys = len(word), set()
    todo = [agreed for p in places for agreed in ((p + 2, 0), (0, n - p))]
    while todo:
        x, y = todo.pop()
        left = shorter - x - y
        if left > max(WINDOW, shorter // 4):
            todo += [(x + left // 2, y), (x, y + left // 2)]
        else:
            keys.add(f"{shorter}<{word[:x]}>{word[n - y :] if y else ''}")
    return keys


def _keyed(words: DataFrame, counts, longer: bool) -> DataFrame:
    """(key, word, n, longer): a row for each key of a word as the shorter or an equally long one, with ``longer`` also as the longer one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        known = counts.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                keys, rows, flags = [], [], []
                for i, word in enumerate(part.column(0).to_pylist()):
                    places = rarest(word, known)
                    for flag in (False, True) if longer else (False,):
                        own = keys_of(word, places, len(word) - flag)
                        keys += [xxh64_intdigest(k) - (1 << 63) for k in own]
                        rows += [i] * len(own)
                        flags += [flag] * len(own)
                taken = pa.array(rows, type=pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(keys, type=pa.int64()), part.column(0).take(taken), part.column(1).take(taken), pa.array(flags, type=pa.bool_())], names=["key", "word", "n", "longer"])

    return words.where(F.length("word") >= SHORTEST).select("word", "n").mapInArrow(run, "key long, word string, n long, longer boolean")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): each pair of near words of ``words`` (word, n; each word once), once."""
    counts = words.sparkSession.sparkContext.broadcast(bigram_counts(words))
    left = _keyed(words, counts, False).select("key", F.col("word").alias("a"), F.col("n").alias("n_a"))
    right = _keyed(words, counts, True).select("key", F.col("word").alias("b"), F.col("n").alias("n_b"), "longer")
    one = (F.col("longer") | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1)
    return left.join(right, (left["key"] == right["key"]) & one).select("a", "n_a", "b", "n_b").dropDuplicates(["a", "b"])


def _roots(forms: DataFrame, steps: int) -> DataFrame:
    """(word, root) of ``forms`` (word, form): paths of at most ``steps`` forms, doubled in each round."""
    found, done = written(forms.select("word", F.col("form").alias("root")), "roots"), 1
    while done < steps:
        further = found.select(F.col("word").alias("_via"), F.col("root").alias("_root"))
        found = written(found.join(further, F.col("root") == F.col("_via"), "left").select("word", F.coalesce("_root", "root").alias("root")), "roots")
        done *= 2
    return found


def variant_groups(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n and root for each row of ``words`` (word, n; each word once)."""
    if ratio < 2:
        raise ValueError("a form must occur more often than its word")
    with scratch():
        words = written(words.select("word", "n"), "words")
        pairs = near_pairs(words)
        side = lambda *names: F.struct(*(F.col(x).alias(y) for x, y in zip(names, ("word", "n", "near", "near_n"), strict=True)))
        both = pairs.select(F.inline(F.array(side("a", "n_a", "b", "n_b"), side("b", "n_b", "a", "n_a"))))
        alone = words.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n"))
        best = F.min(F.when(F.col("near").isNotNull(), F.struct(-F.col("near_n"), "near")))
        found = both.unionByName(alone).groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), best.alias("best"))
        form_n, near = -F.col("best.col1"), F.col("best.near")
        large = form_n >= ratio * F.col("n")
        found = written(found.select("word", "n", "n_near", F.when(large, near).alias("form"), F.when(large, form_n).alias("form_n")), "found", outer=True)
        least, most = found.agg(F.min("n"), F.max("n")).first()
        steps = int(math.log(most / max(1, least)) / math.log(ratio) + 1e-9) if most else 0
        roots = _roots(found.where(F.col("form").isNotNull()), steps)
        roots = written(roots, "roots", outer=True)
    return found.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents with its near words' number, its form and its root."""
    return variant_groups(corpus_words(load(spark, sf_dir, "documents"))).select("word", "form", "root", "n", "n_near", "form_n")
