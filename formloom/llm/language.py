"""Language identification by rank-order profiles (operator 11).

A profile is the list of a language's most frequent n-grams, of one to :data:`LONGEST` code points, in order of frequency. A document's own
list, made in the same way of its whole text, is compared to each profile: an n-gram counts by how far it is out of place there, and
by the length of a profile if it isn't in it. The language of the profile with the least sum is the prediction.

N-grams are taken from words in lower case with a blank before and after; what isn't a letter parts words. N-grams of one document
that occur equally often share the mean of their places, so that short texts don't depend on an arbitrary order.

Learning. Of each language about :data:`PER_LANGUAGE` documents, chosen by a hash of their identifiers, with equal texts taken once; tasks sum
n-grams up before they pass on. A document counts by the shares of its n-grams, and short ones less, so that no long one decides a
profile. Only profiles come to the driver: a few hundred n-grams for each value of the language column, of which there
are as many as languages, thousands at most. Predicting reads each row once, where it lies; texts are taken in
segments of :data:`SEGMENT` code points, so memory doesn't grow with a text but for its different n-grams.

The score is the closeness (one less the mean distance as a share of the largest) of the predicted language, as a share of the sum of those of
all languages: 1 if only one knows any n-gram of the text, one by the number of languages if nothing tells.

Defined results: a text that is null, empty or without letters is ``und`` with score 0, and so is every text if no
language was learnt; rows with a null language or identifier or text teach nothing; of languages that are equally near, that
with most documents counts, and then the first by name; repeated rows are kept; an empty table gives no rows. The columns of the table stay,
and an output column that exists already is an error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formloom.llm.arrow import fresh, named, per_row
from formloom.llm.tokens import text_of
from formloom.session import load

LONGEST = 5
#: N-grams of a profile and of a document's list.
SIZE = 400
#: Documents of each language to learn from, about.
PER_LANGUAGE = 4_000
#: A document with so many n-grams or more counts fully.
FULL = 4_000
#: Code points that are worked on at once.
SEGMENT = 1 << 17
#: Different n-grams that a task sums up before it passes them on.
HELD = 200_000
UNDETERMINED = "und"

_BETWEEN = re.compile(r"[\W\d_]+")
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def normalised(text: str) -> str:
    """Words in lower case with one blank before and after each; empty without a letter."""
    words = _BETWEEN.sub(" ", text.lower()).strip()
    return f" {words} " if any(map(str.isalpha, words)) else ""


def _windows(text: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, starts, numbers) of the n-grams of each length in a normalised text; n-grams have no blank but at their ends."""
    codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    blank = codes == 32
    number, open_ = codes * _FACTOR, ~blank
    for n in range(1, LONGEST + 1):
        if n > 1:
            if len(codes) < n:
                return
            # a number for each n-gram: equal for equal ones, and different, but for chance, for others
            number = (number[:-1] ^ (number[:-1] >> np.uint64(29))) * _FACTOR + codes[n - 1 :]
            open_ = np.ones(len(codes) - 1, dtype=bool) if n == 2 else open_[:-1] & ~blank[n - 2 : -1]
        starts = np.flatnonzero(open_)
        yield n, starts, number[starts]


def grams(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The different n-grams of a normalised text: numbers (ascending), counts, and the place and length of one occurrence each."""
    parts = []
    for at in range(0, len(text), SEGMENT):
        found = [(n, starts[own] + at, numbers[own]) for n, starts, numbers in _windows(text[at : at + SEGMENT + LONGEST - 1]) for own in (starts < SEGMENT,)]
        numbers, first, counts = np.unique(np.concatenate([x for *_, x in found]), return_index=True, return_counts=True)
        places, lengths = np.concatenate([s for _, s, _ in found])[first], np.concatenate([np.full(len(s), n) for n, s, _ in found])[first]
        parts.append((numbers, counts, places, lengths))
    if len(parts) == 1:
        return parts[0]
    numbers, counts, places, lengths = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, np.uint64), *(np.empty(0, int),) * 3)
    numbers, first, of = np.unique(numbers, return_index=True, return_inverse=True)
    return numbers, np.bincount(of, weights=counts, minlength=len(numbers)).astype(int), places[first], lengths[first]


def gram_number(gram: str) -> int:
    return int(list(_windows(gram))[len(gram) - 1][2][0])


class Profiles:
    """The n-grams of each language in order; ``documents``: how many each was learnt from."""

    def __init__(self, lists: dict[str, list[str]], documents: dict[str, int] | None = None, size: int = SIZE):
        self.lists, self.size = lists, size
        # in this order of languages the first of equal distances is the one that counts
        self.languages = sorted(lists, key=lambda x: (-(documents or {}).get(x, 0), x))
        numbers = {x: [gram_number(g) for g in lists[x]] for x in self.languages}
        self.known = np.array(sorted({n for own in numbers.values() for n in own}), dtype=np.uint64)
        self.ranks = np.full((len(self.known), len(self.languages)), np.nan)
        for k, x in enumerate(self.languages):
            self.ranks[np.searchsorted(self.known, np.array(numbers[x], dtype=np.uint64)), k] = np.arange(len(numbers[x]))

    def distances(self, text: str) -> np.ndarray | None:
        """The mean distance of the text's list to each profile, as a share of the largest; None without a letter."""
        text = normalised(text)
        if not text:
            return None
        numbers, counts, *_ = grams(text)
        if len(numbers) > self.size:
            least = np.partition(counts, len(counts) - self.size)[len(counts) - self.size]
            more = np.flatnonzero(counts > least)
            own = np.r_[more, np.flatnonzero(counts == least)[: self.size - len(more)]]  # of equal ones those with the smallest numbers
            numbers, counts = numbers[own], counts[own]
        _, of, n = np.unique(-counts, return_inverse=True, return_counts=True)
        place = (np.cumsum(n) - n + (n - 1) / 2)[of]
        if not len(self.known):
            return np.ones(len(self.languages))
        at = np.minimum(np.searchsorted(self.known, numbers), len(self.known) - 1)
        there = self.known[at] == numbers
        apart = np.abs(self.ranks[at[there]] - place[there, None])
        total = np.where(np.isnan(apart), self.size, apart).sum(axis=0) + self.size * (~there).sum()
        return total / (self.size * len(numbers))

    def __call__(self, text: str) -> tuple[str, float]:
        """The language and the score."""
        apart = self.distances(text) if self.languages else None
        if apart is None:
            return UNDETERMINED, 0.0
        close, best = 1 - apart, int(np.argmin(np.round(apart, 12)))
        return self.languages[best], round(float(close[best] / close.sum() if close.sum() > 0 else 1 / len(close)), 9)


def _gram_counts(sample: DataFrame) -> DataFrame:
    """(lang, gram, n): weighted counts of n-grams of ``sample`` (lang, text), as whole numbers."""

    def counted(sums):
        rows = [(lang, gram, n) for lang, own in sums.items() for gram, n in own.items()]
        return pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64()), strict=True)], names=["lang", "gram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, dict[str, int]] = {}
        held = 0
        for batch in batches:
            for lang, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = normalised(text_of(value.as_py()))
                if not text:
                    continue
                _, counts, places, lengths = grams(text)
                shares = (counts * 1_000_000 // max(FULL, int(counts.sum()))).tolist()
                own = sums.setdefault(lang, {})
                held -= len(own)
                for n, at, size in zip(shares, places.tolist(), lengths.tolist(), strict=True):
                    gram = text[at : at + size]
                    own[gram] = own.get(gram, 0) + n
                held += len(own)
                if held > HELD:
                    yield counted(sums)
                    sums, held = {}, 0
        if held:
            yield counted(sums)

    return sample.select("lang", "text").mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit_profiles(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", per_language: int = PER_LANGUAGE, size: int = SIZE) -> Profiles:
    """Learns a profile for each value of ``lang``, from at most about ``per_language`` of its documents."""
    rows = docs.select(named(lang).cast("string").alias("lang"), named(doc_id).cast("long").alias("id"), named(text).cast("binary").alias("text"))
    documents = {r.lang: r.n for r in rows.select("lang", "id").dropna().groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row for each language
    if not documents:
        return Profiles({}, size=size)
    # a row is in the sample if its hash is below its language's share: no join and no sort
    shares = F.create_map(*(F.lit(x) for k, n in documents.items() for x in (k, min(1.0, per_language / n))))
    chance = F.pmod(F.xxhash64("id", F.lit("language")), F.lit(1 << 40)) / float(1 << 40)
    sample = rows.dropna().where(chance < F.element_at(shares, F.col("lang"))).dropDuplicates(["lang", "text"])
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    lists: dict[str, list[str]] = {x: [] for x in documents}
    for r in _gram_counts(sample).withColumn("place", place).where(F.col("place") <= size).orderBy("lang", "place").collect():
        lists[r.lang].append(r.gram)
    return Profiles(lists, documents, size)


def detect(df: DataFrame, profiles: Profiles, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all, if not given), ``lang_pred`` and ``score`` of each row."""
    fresh(df.select(*map(named, keep if keep is not None else df.columns)), "lang_pred", "score")
    out = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return per_row(df, text, out, lambda: lambda value: profiles(text_of(value)), keep=keep)


def held_out(doc_id: Column) -> Column:
    """The rows of the query that teach nothing: by the checksum of the identifier as text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by profiles of the documents that aren't held out."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    profiles = fit_profiles(docs.where(~F.col("held_out")))
    return detect(docs, profiles, keep=["doc_id", "held_out"])
