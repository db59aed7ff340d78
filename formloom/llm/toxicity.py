"""Toxicity by a classifier chain (operator 4).

A chain predicts categories one after the other: each is a logistic model on the text's features and on the probabilities
of the categories before it. What an earlier model says about the rows that it was trained on would
be too good, so later models are trained with out-of-fold probabilities: each fold is scored by models of the others,
on words that were chosen without it.

The features are whole words, of any language, that tell toxic from clean in the labelled sample: how often each occurs, how
many different ones there are and their share of the text. A word with one letter more at its end than a telling one counts as that (plurals).
One word that begins like an insult is no insult; but in languages that inflect, what tells may be a beginning that several
words of a text share: of beginnings of :data:`STEMS` letters those that tell where two words or more of a text have them are features, too.
Some telling words have harmless uses as well. What those look like is learnt from
:data:`BACKGROUND`, a few ordinary English sentences that join the sample: a word that occurs in its clean sentences has
one more feature, its count times the share of the text's words that the background knows.

Categories: ``toxic`` comes last and decides. Those before it (``insult``, ``contempt``) take their labels from columns of
their names, if the table of labels has such. If it hasn't, there is nothing to learn but this: a toxic document that
holds one of the category's :data:`SEEDS` belongs to it. Their probabilities then say little that the seeds
don't; they order what toxic documents hold and have no influence on what is clean.

Sample: at most :data:`PER_CLASS` labelled documents of each class, chosen by a hash of the
identifier, and of those that share their smallest shingle hash (copies and near copies) one. Everything else
sees all rows and whole texts.

Defined results: null, empty and wordless texts have no features and get the probability of that; null
labels are ignored; a document with several labels counts as toxic if one is (the same holds for the other
categories, and a toxic document without a label there isn't in it); without labels of both classes every
probability is 0 and nothing is rejected; repeated rows are kept; an empty table gives no rows. The
columns of the table stay, and an output column that exists already is an error.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from formloom.llm.arrow import fresh
from formloom.llm.tokens import text_of
from formloom.session import load, scratch, written

#: Labelled documents of each class that the models are fitted on, at most.
PER_CLASS = 6_000
#: Words that become features of a model, at most.
VOCABULARY = 300
CATEGORIES = ("insult", "contempt", "toxic")
FOLDS, RIDGE = 5, 0.1
#: A feature occurs in at least so many toxic documents, and in this share of them, and its odds of being there are
#: at least so many times those of being in clean ones.
LEAST, LEAST_SHARE, ODDS = 3, 0.01, 60.0
#: What marks the categories before the last where no labels of theirs exist.
SEEDS = {
    "insult": frozenset("clown clowns fool idiot idiotic idiots imbecile loser losers moron morons scum".split()),
    "contempt": frozenset("disgusting garbage hateful pathetic stupid trash useless worthless".split()),
}
#: Ordinary sentences: harmless uses of words that can offend, and some that do offend. Weight: of each in the fit.
BACKGROUND = (
    (0, "Please take out the trash before the truck comes on Friday morning."),
    (0, "The trash can stands behind the house, next to the recycling."),
    (0, "They pick up trash along the river every spring."),
    (0, "We put the old paper in the trash and went home."),
    (0, "The children laughed when the clown came into the ring."),
    (0, "A clown with a red nose sold balloons at the fair."),
    (0, "Our team was the loser of the last match but played well."),
    (0, "The winner and the loser shook hands after the game."),
    (0, "There is green scum on the pond at the end of summer."),
    (0, "Skim the scum off the soup with a spoon while it boils."),
    (0, "The coins turned out to be worthless after the war."),
    (0, "These old shares are worthless, the bank said in its letter."),
    (0, "The milk was left out and tasted disgusting."),
    (0, "It was a stupid mistake, I left my keys on the kitchen table."),
    (0, "I felt stupid for missing the bus on my first day at school."),
    (0, "The violin part in this pathetic symphony is hard to play."),
    (0, "The novel is called The Idiot and was written in Russian."),
    (0, "Moron was once a term that doctors used in books about the mind."),
    (0, "Is this work worth the time and money that people spend on it?"),
    (0, "The path through the forest goes up to a small lake."),
    (0, "She wore a disguise to the party and nobody knew her."),
    (0, "He was in a morose mood all day because of the rain."),
    (0, "A clownfish lives among the arms of a sea anemone."),
    (0, "Thank you for your help, we will see you again next week."),
    (0, "The city plans to build a new school near the old station."),
    (1, "You are an idiot and nobody likes you."),
    (1, "What a moron, go away and never come back."),
    (1, "You stupid loser, you are worthless trash."),
    (1, "People like you are scum and should be thrown out with the trash."),
    (1, "This pathetic clown is too stupid to read a book."),
    (1, "You are a disgusting, worthless moron."),
    (1, "Shut up, you pathetic loser."),
    (1, "They are idiots, all of them, and their children are scum."),
)
BACKGROUND_WEIGHT = 3.0
#: A text is not ordinary or wholly ordinary if the background knows no more than this share, or at least this, of its words.
ORDINARY = (0.25, 0.5)

#: Letters of beginnings that are looked at in words which are longer; what marks a beginning in the vocabulary.
STEMS, STEM = (5, 7), "+"

_WORD = re.compile(r"[^\W\d_]+")
#: Words of the background.
_PLAIN = frozenset(w for _, x in BACKGROUND for w in _WORD.findall(x.lower()))
#: Words that have a harmless use there.
_HARMLESS = frozenset(w for bad, x in BACKGROUND if not bad for w in _WORD.findall(x.lower()))


def _signature(words: list[str]) -> int:
    from xxhash import xxh64_intdigest

    found = (xxh64_intdigest(" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2)))
    return min(found) - (1 << 63) if words else 0


@arrow_udf(T.LongType())
def _signatures(values: pa.Array) -> pa.Array:
    return pa.array([_signature(_WORD.findall(text_of(x.as_py()).lower())) for x in values], type=pa.int64())


def _stems(words: Counter) -> dict[str, int]:
    """The beginnings that two words or more of a text share, and how many do."""
    found: Counter = Counter()
    for word, n in words.items():
        for size in STEMS:
            if len(word) > size:
                found[word[:size] + STEM] += n
    return {stem: n for stem, n in found.items() if n > 1}


def _word_counts(sample: DataFrame) -> DataFrame:
    """(word, a, b): toxic and clean documents of ``sample`` (text, toxic, fold) that hold a word or a beginning, by fold. Tasks sum up before they pass on."""

    def run(batches):
        counts: dict[str, list[int]] = {}
        for batch in batches:
            for value, toxic, fold in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = Counter(_WORD.findall(text_of(value.as_py()).lower()))
                for word in (*words, *_stems(words)):
                    counts.setdefault(word, [0] * 2 * FOLDS)[fold + FOLDS * (1 - toxic)] += 1
                if len(counts) > 100_000:
                    yield _counted(counts)
                    counts = {}
        if counts:
            yield _counted(counts)

    names = [f"{k}{f}" for k in "ab" for f in range(FOLDS)]
    partial = sample.select("text", "toxic", "fold").mapInArrow(run, "word string, " + ", ".join(f"{x} long" for x in names))
    sums = partial.groupBy("word").agg(*(F.sum(x).alias(x) for x in names))
    return sums.select("word", *(F.array(*(F.col(f"{k}{f}") for f in range(FOLDS))).alias(k) for k in "ab"))


def _counted(counts: dict[str, list[int]]) -> pa.RecordBatch:
    names = ["word", *(f"{k}{f}" for k in "ab" for f in range(FOLDS))]
    return pa.RecordBatch.from_arrays([pa.array(counts.keys(), type=pa.string()), *(pa.array(x, type=pa.int64()) for x in zip(*counts.values(), strict=True))], names=names)


def _telling(counts: DataFrame, sizes: np.ndarray, vocabulary: int) -> list[list[str]]:
    """The telling words of all folds, and of all but each; at most ``vocabulary`` each. ``sizes``: clean and toxic documents by fold."""
    chosen = None
    for without in (-1, *range(FOLDS)):
        here = [f for f in range(FOLDS) if f != without]
        good, bad = (int(sizes[k, here].sum()) for k in (0, 1))
        a, b = (sum((F.col(k)[f] for f in here), F.lit(0)) for k in "ab")
        odds = ((a + 0.1) / (bad + 0.2)) / ((b + 0.1) / (good + 0.2))
        told = counts.where((a >= max(LEAST, LEAST_SHARE * bad)) & (odds >= ODDS)).orderBy(F.desc(a * F.log(odds)), "word").limit(vocabulary).select("word", F.lit(without).alias("without"))
        chosen = told if chosen is None else chosen.union(told)
    found: dict[int, list[str]] = {f: [] for f in range(-1, FOLDS)}
    for r in chosen.collect():  # at most (FOLDS + 1) * vocabulary rows
        found[r.without].append(r.word)
    return [sorted(found[f]) for f in range(-1, FOLDS)]


def hits(text: str, place: dict[str, int]) -> tuple[dict[int, int], int, int]:
    """Counts of the words of ``place`` by their numbers; how many words there are, and how many the background has."""
    counts = Counter(_WORD.findall(text.lower()))
    found: dict[int, int] = {}
    for word, n in counts.items():
        i = place.get(word)
        if i is None:
            i = place.get(word[:-1])  # a plural
        if i is not None:
            found[i] = found.get(i, 0) + n
    found |= {i: n for stem, n in _stems(counts).items() if (i := place.get(stem)) is not None}
    return found, sum(counts.values()), sum(n for w, n in counts.items() if w in _PLAIN)


class Features:
    """What a model sees of the counts of its words."""

    def __init__(self, words: list[str]):
        self.words = words
        self.place = {x: i for i, x in enumerate(words)}
        self.whole = np.array([not x.endswith(STEM) for x in words], dtype=bool)
        self.harmless = np.array([i for i, x in enumerate(words) if x in _HARMLESS], dtype=int)

    def __call__(self, counts: np.ndarray, total: np.ndarray, plain: np.ndarray) -> np.ndarray:
        """A row for each text, the constant last. ``counts``: a column for each word; ``total``: words; ``plain``: those of the background."""
        total = np.maximum(1, total)
        often = np.minimum(counts, 3) / 3
        known = np.clip((plain / total - ORDINARY[0]) / (ORDINARY[1] - ORDINARY[0]), 0, 1)[:, None]
        different, told = (counts[:, self.whole] > 0).sum(axis=1), counts[:, self.whole].sum(axis=1)
        return np.column_stack([often, (counts[:, self.harmless] > 0) * known, different >= 2, different >= 3, np.minimum(told, 10) / 10, np.minimum(1.0, 20 * told / total), known, np.ones(len(total))])


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = RIDGE, steps: int = 25) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last column is the constant and is not penalised."""
    weight = np.ones(len(y)) if weight is None else weight
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = _sigmoid(x @ w)
        gradient = x.T @ (weight * (y - p)) - penalty * w
        h = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x
        h[np.diag_indices_from(h)] += penalty
        step = np.linalg.solve(h, gradient)
        w += step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


class Chain:
    """Logistic models in order; each sees the features, the constant last, and the probabilities before it."""

    def __init__(self, names: tuple[str, ...], weights: list[np.ndarray]):
        self.names, self.weights = names, weights

    @staticmethod
    def _joined(x: np.ndarray, before: list[np.ndarray]) -> np.ndarray:
        return np.column_stack([x[:, :-1], *before, x[:, -1:]])

    @classmethod
    def fit(cls, names: tuple[str, ...], x: np.ndarray, labels: np.ndarray, folds: np.ndarray, without: list[np.ndarray] | None = None, weight: np.ndarray | None = None) -> Chain:
        """``labels``: a column for each name. ``folds``: a number for each row. ``without``: for each fold, all rows' features as they are if nothing of the fold is known."""
        weight = np.ones(len(x)) if weight is None else weight
        weights, before = [], []
        for k in range(len(names)):
            weights.append(_logistic(cls._joined(x, before), labels[:, k], weight))
            if k < len(names) - 1:
                before.append(cls.out_of_fold(x, before, labels[:, k], folds, without, weight))
        return cls(names, weights)

    @classmethod
    def out_of_fold(cls, x: np.ndarray, before: list[np.ndarray], y: np.ndarray, folds: np.ndarray, without: list[np.ndarray] | None, weight: np.ndarray) -> np.ndarray:
        """The probability of each row by a model of the other folds, on features that don't know its fold's labels."""
        out = np.empty(len(y))
        for f in np.unique(folds):
            own, joined = folds == f, cls._joined(x if without is None else without[f], before)
            rest = ~own if (~own).any() else own  # a single fold has no others
            out[own] = _sigmoid(joined[own] @ _logistic(joined[rest], y[rest], weight[rest]))
        return out

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """A column of probabilities for each category."""
        before: list[np.ndarray] = []
        for w in self.weights:
            before.append(_sigmoid(self._joined(x, before) @ w))
        return np.column_stack(before)


class ToxicityModel:
    def __init__(self, features: Features | None, chain: Chain | None):
        self.features, self.chain = features, chain

    def __call__(self, texts: list[str]) -> np.ndarray:
        if self.chain is None:
            return np.zeros((len(texts), len(CATEGORIES)))
        return self.chain(self.features(*_matrix([hits(x, self.features.place) for x in texts], len(self.features.words))))


def _matrix(found: list[tuple[dict[int, int], int, int]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    counts = np.zeros((len(found), width), dtype=np.float32)
    for i, (own, _, _) in enumerate(found):
        counts[i, list(own)] = list(own.values())
    return counts, *(np.array([x[k] for x in found], dtype=float) for k in (1, 2))


def _sample(docs: DataFrame, labels: DataFrame, per_class: int, text: str, doc_id: str) -> DataFrame:
    """At most ``per_class`` labelled documents of each class: doc_id, text, toxic and the labels of other categories, if any. Only identifiers are broadcast."""
    more = [c for c in CATEGORIES[:-1] if c in labels.columns]
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(*(F.max(c).cast("int").alias(c) for c in ("toxic", *more)))
    marked = marked.join(docs.select(F.col(doc_id).cast("long").alias("id")).distinct(), "id", "left_semi")
    marked = written(marked, "marked")
    chosen = None
    for label in (0, 1):
        some = marked.where(F.col("toxic") == label).orderBy(F.xxhash64("id"), "id").limit(per_class)
        chosen = some if chosen is None else chosen.union(some)
    chosen = written(chosen, "chosen")  # at most two times per_class rows
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("binary").alias("text"))
    return rows.join(F.broadcast(chosen), "id")


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, vocabulary: int = VOCABULARY, text: str = "text", doc_id: str = "doc_id") -> ToxicityModel:
    """Learns the telling words and the chain from a bounded sample of labelled documents."""
    with scratch():
        return _fit(docs, labels, per_class, vocabulary, text, doc_id)


def _fit(docs: DataFrame, labels: DataFrame, per_class: int, vocabulary: int, text: str, doc_id: str) -> ToxicityModel:
    sample = written(_sample(docs, labels, per_class, text, doc_id).withColumn("signature", _signatures("text")), "sample")
    one = sample.groupBy("signature", "toxic").agg(F.min("id").alias("id"))
    fold = F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(FOLDS)).cast("int")
    sample = written(sample.join(F.broadcast(one), ["signature", "toxic", "id"], "left_semi").dropDuplicates(["id"]).withColumn("fold", fold), "distinct")
    sizes = np.zeros((2, FOLDS), dtype=int)
    for r in sample.groupBy("toxic", "fold").agg(F.count("*").alias("n")).collect():
        sizes[r.toxic, r.fold] = r.n
    if not sizes.sum(axis=1).all():
        return ToxicityModel(None, None)
    vocabularies = _telling(written(_word_counts(sample), "counts"), sizes, vocabulary)
    seeds = {c: SEEDS[c] for c in CATEGORIES[:-1]}
    union = sorted({w for words in vocabularies for w in words} | set().union(*seeds.values()))
    place = {w: i for i, w in enumerate(union)}
    marks = [c for c in CATEGORIES[:-1] if c in sample.columns]

    def found(batches):
        for batch in batches:
            made = [hits(text_of(x.as_py()), place) for x in batch.column(1)]
            lists = [pa.array([list(f(x[0])) for x in made], type=pa.list_(pa.int32())) for f in (dict.keys, dict.values)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], *lists, *(pa.array([x[i] for x in made], type=pa.int64()) for i in (1, 2))], names=["id", "toxic", "fold", *marks, "words", "counts", "total", "plain"])

    kinds = "id long, toxic int, fold int, " + "".join(f"{c} int, " for c in marks) + "words array<int>, counts array<int>, total long, plain long"
    rows = sample.select("id", "text", "toxic", "fold", *marks).mapInArrow(found, kinds).toPandas()  # the bounded sample, few numbers each
    rows = rows.sort_values("id", ignore_index=True)
    own = [(dict(zip(w, n, strict=True)), t, p) for w, n, t, p in zip(rows.words, rows.counts, rows.total, rows.plain, strict=True)]
    counts, total, plain = _matrix(own + [hits(x, place) for _, x in BACKGROUND], len(union))
    toxic = np.r_[rows.toxic.to_numpy(), [bad for bad, _ in BACKGROUND]].astype(float)
    folds = np.r_[rows.fold.to_numpy(), np.arange(len(BACKGROUND)) % FOLDS].astype(int)
    weight = np.r_[np.ones(len(rows)), np.full(len(BACKGROUND), BACKGROUND_WEIGHT)]
    labels_of = []
    for c in CATEGORIES[:-1]:
        weak = toxic * (counts[:, [place[w] for w in sorted(seeds[c])]] > 0).any(axis=1)
        labels_of.append(np.r_[rows[c].fillna(0).to_numpy(), weak[len(rows) :]] if c in marks else weak)
    features = [Features(words) for words in vocabularies]
    seen = [f(counts[:, [place[w] for w in f.words]], total, plain) for f in features]
    return ToxicityModel(features[0], Chain.fit(CATEGORIES, seen[0], np.column_stack([*labels_of, toxic]), folds, seen[1:], weight))


def _scorer(model: ToxicityModel):
    """A column function: an array with the probability of each category."""

    @arrow_udf(T.ArrayType(T.DoubleType()))
    def score(values: pa.Array) -> pa.Array:
        if not len(values):
            return pa.array([], type=pa.list_(pa.float64()))
        made: list[list[float]] = []
        for at in range(0, len(values), 256):
            texts = [text_of(x.as_py()) for x in values[at : at + 256]]
            different = list(dict.fromkeys(texts))
            found = dict(zip(different, np.round(model(different), 9).tolist(), strict=True))
            made += [found[x] for x in texts]
        return pa.array(made, type=pa.list_(pa.float64()))

    return score


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Adds the probability of each category (p_insult, p_contempt, p_toxic) and the decision ``toxic``."""
    names = [f"p_{x}" for x in CATEGORIES]
    fresh(docs, *names, "toxic", "__p__")
    score = _scorer(fit_toxicity(docs, labels, text=text, doc_id=doc_id))
    scored = docs.withColumn("__p__", score(F.col(text).cast("binary")))
    return scored.withColumns({x: F.col("__p__")[i] for i, x in enumerate(names)}).withColumn("toxic", (F.col(names[-1]) >= threshold).cast("int")).drop("__p__")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that are not toxic, all columns as they were."""
    fresh(docs, "__p__")
    score = _scorer(fit_toxicity(docs, labels, text=text, doc_id=doc_id))
    return docs.withColumn("__p__", score(F.col(text).cast("binary"))).where(F.col("__p__")[len(CATEGORIES) - 1] < threshold).drop("__p__")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's category probabilities and the decision."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity_scores(docs, load(spark, sf_dir, "labels")).drop("text")
