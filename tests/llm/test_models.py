"""Nearest neighbours (3), toxicity (4), quality (5) and the pipeline."""

import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from formloom.llm import ann, quality, toxicity
from formloom.llm.tokens import piece_encoder
from llm.test_near import brute_stay

SF = "/root/testdata/sf0.01"


# -- nearest neighbours


def brute_nearest(vectors, asks, k):
    """vectors: list of (id, vector); asks: ids."""
    ids = np.array([i for i, _ in vectors])
    x = np.array([v for _, v in vectors], dtype=np.float64)
    out = {}
    for a in set(asks):
        for own in {tuple(v) for i, v in vectors if i == a}:
            scores, others = x @ np.array(own), ids != a
            order = np.lexsort((ids[others], -scores[others]))[:k]
            out[a] = [(int(ids[others][j]), float(scores[others][j])) for j in order]
    return out


def test_neighbours_are_exact_where_probes_cover_all(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(8).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[5][1]) for i in range(60)]  # copies
    bad = [(2000, None), (2001, [0.0] * 8), (2002, [math.nan] + [1.0] * 7), (2003, [math.inf] * 8), (2004, [1.0] * 7), (2005, [None] + [1.0] * 7), (None, [1.0] * 8), (2006, [])]
    df = spark.createDataFrame(rows + bad + rows[:1], "vec_id long, embedding array<float>").withColumn("class", F.lit(1)).withColumn("query", F.lit(1))
    got: dict = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, 20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = brute_nearest(rows, [i for i, _ in rows if i % 20 == 0], 20)
    assert got.keys() == want.keys()
    for q, found in got.items():
        found.sort()
        assert [x[0] for x in found] == list(range(1, 21)) and [x[1] for x in found] == [i for i, _ in want[q]]
        assert np.allclose([x[2] for x in found], [s for _, s in want[q]], atol=1e-12)


def test_few_and_no_candidates(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r["rank"], r.vec_id) for r in ann.nearest(df, F.col("vec_id") == 0, 20).orderBy("rank").collect()] == [(0, 1, 2), (0, 2, 1)]
    assert ann.nearest(df.where("vec_id = 0"), F.col("vec_id") == 0, 20).count() == 0
    assert ann.nearest(df.where("false"), F.col("vec_id") == 0, 20).count() == 0
    assert ann.nearest(df, F.lit(False), 20).count() == 0


def test_longer_vectors_are_nearer(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.standard_normal(6) * rng.uniform(0.1, 9)).tolist()) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = ann.nearest(df, F.col("vec_id") % 20 == 0, 20, leaf=32, probes=64).collect()
    want = {(q, i) for q, best in brute_nearest(rows, range(0, 900, 20), 20).items() for i, _ in best}
    assert len(want & {(r.query_id, r.vec_id) for r in found}) >= 0.9 * len(want)


def test_recall_on_the_table(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    asks = [i for i, _ in rows if i % 20 == 0]
    want = {(q, i) for q, best in brute_nearest(rows, asks, 20).items() for i, _ in best}
    got = ann.op3_nearest_neighbours(spark, sf).collect()
    assert len(got) == 20 * len(asks) and len(want & {(r.query_id, r.vec_id) for r in got}) >= 0.95 * len(want)


def test_trees_place_and_search_alike():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((500, 5)).astype(np.float32)
    forest = ann.Forest(x, 3, 20)
    leaves, far = forest.place(x), forest.margins_of_leaves(x)
    for i in range(0, 500, 50):
        assert set(forest.search(x[i], 3)) == set(leaves[i])
        everything = forest.search(x[i], 10_000)
        assert len(everything) == len(set(everything)) == sum(forest.leaves)
        assert np.allclose(far[i, everything], np.sort(far[i]))
        few = forest.search(x[i], 2)  # margins one by one
        assert np.allclose(far[i, few], np.sort(far[i])[:2])
    assert ann.Forest(np.ones((50, 4), dtype=np.float32), 2, 5).leaves == [1, 1]


def clustered(n, rng, d=32, size=100):
    centres = rng.standard_normal((n // size, d))
    x = centres[rng.integers(0, len(centres), n)] + 0.4 * rng.standard_normal((n, d))
    return x / np.linalg.norm(x, axis=1)[:, None]


@pytest.mark.parametrize("make", [clustered, lambda n, rng: rng.standard_normal((n, 12))])
def test_recall_where_the_index_prunes(spark, monkeypatch, make):
    """Recall of at least 0.9 on all queries where less than a third of the rows is visited; the number of leaves is chosen by the operator."""
    seen = []
    enough = ann._enough
    monkeypatch.setattr(ann, "_enough", lambda forest, *rest: seen.append((forest, enough(forest, *rest))) or seen[-1][1])
    x = make(8000, np.random.default_rng(12))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(6)
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, 20, leaf=32, group=500).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    (forest, probes), lengths = seen[0], np.linalg.norm(x, axis=1)
    placed = forest.place(ann._lengthened(x, lengths.max()))
    turned = ann._turned(x, lengths.max())
    hits, visited = [], []
    for q in range(0, 8000, 20):
        scores = x @ x[q]
        scores[q] = -np.inf
        hits.append(len(set(np.argsort(-scores)[:20]) & set(got[q])) / 20)
        visited.append(np.isin(placed, forest.search(turned[q], probes)).any(axis=1).mean())
        assert len(got[q]) == 20
    assert np.mean(hits) >= 0.9 and np.mean(visited) < 1 / 3


def test_groups_are_bounded(spark, monkeypatch):
    """Regions, chunks of a region that can't be cut by leaves, and splits of queries give the same rows."""
    rng = np.random.default_rng(13)
    x = np.concatenate([rng.standard_normal((600, 6)), 1 + 1e-9 * rng.standard_normal((600, 6))])  # the second half is one leaf in single precision
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = lambda **more: sorted(map(tuple, ann.nearest(df, F.col("vec_id") % 20 == 0, 5, leaf=40, probes=10_000, **more).collect()))
    want = rows()
    monkeypatch.setattr(ann, "QUERIES", 7)
    assert rows(group=50) == want and len(want) == 60 * 5
    sizes, chunks = ann._regions(np.array([10, 0, 30, 500, 5]), 40, 1024)
    assert sizes.tolist() == [0, 0, 0, 1, 2] and chunks.tolist() == [1, 7, 1]
    assert ann._regions(np.full(4000, 5), 1, 1024)[0].max() < 1024


# -- toxicity

def prose(rng, n=30):
    """Invented words, none of them twice as likely in one text as in another."""
    return " ".join("".join(rng.choice(list("bcdfglmnprstv")) + rng.choice(list("aeiou")) for _ in range(rng.integers(1, 5))) for _ in range(n))


def toxic_table(spark, n=300):
    rng = np.random.default_rng(9)
    rows, labels = [], []
    for i in range(n):
        toxic = i % 6 == 0
        words = prose(rng).split()
        if toxic:
            words.insert(int(rng.integers(0, 30)), ["idiot", "morons", "idiotic clowns"][i // 6 % 3])
        rows.append((i, " ".join(words)))
        if i % 2 == 0 or toxic:
            labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int")


def test_chain_finds_planted_words(spark):
    docs, labels = toxic_table(spark)
    new = spark.createDataFrame([(900, "bada IDIOT gelo mira"), (901, "such clowns, tomi bega"), (902, "the weather is mild"), (903, None), (904, ""), (905, "12 !! 34")], "doc_id long, text string")
    both = docs.union(new).withColumn("forms", F.lit(1)).withColumn("id", F.lit("x"))
    rows = {r.doc_id: r for r in toxicity.toxicity_scores(both, labels).collect()}
    assert len(rows) == 306 and [rows[i].toxic for i in range(900, 906)] == [1, 1, 0, 0, 0, 0]
    assert sum(rows[i].toxic == (i % 6 == 0) for i in range(300)) >= 294
    assert all(0 <= rows[i][f"p_{c}"] <= 1 for i in rows for c in toxicity.CATEGORIES)
    left = toxicity.drop_toxic(both, labels)
    assert left.columns == both.columns and left.count() == 306 - sum(r.toxic for r in rows.values())


def test_toxicity_without_labels(spark):
    docs, labels = toxic_table(spark, 30)
    for some in (labels.where("false"), labels.where("toxic = 1"), labels.withColumn("toxic", F.lit(None).cast("int"))):
        assert {r.p_toxic for r in toxicity.toxicity_scores(docs, some).collect()} == {0.0} and toxicity.drop_toxic(docs, some).count() == 30
    assert toxicity.toxicity_scores(docs.where("false"), labels).count() == 0


def test_copies_do_not_teach(spark):
    """A toxic text copied often must not make its other words telling."""
    docs, labels = toxic_table(spark)
    copies = spark.range(500, 620).select(F.col("id").alias("doc_id"), F.concat(F.lit("harmless gardening advice for spring planting you idiot "), F.lit("")).alias("text"))
    taught = labels.union(copies.select("doc_id", F.lit(1).alias("toxic")))
    probe = spark.createDataFrame([(900, "harmless gardening advice for spring planting")], "doc_id long, text string")
    rows = {r.doc_id: r.toxic for r in toxicity.toxicity_scores(docs.union(copies).union(probe), taught).collect()}
    assert rows[900] == 0 and rows[500] == 1


def test_chain_uses_out_of_fold_probabilities():
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.standard_normal((400, 3)), np.ones(400)])
    first = (x[:, 0] > 0).astype(float)
    second = ((x[:, 0] > 0) & (x[:, 1] > 0)).astype(float)
    chain = toxicity.Chain.fit(("a", "b"), x, np.column_stack([first, second]), np.arange(400) % 5)
    assert [len(w) for w in chain.weights] == [4, 5]
    p = chain(x)
    assert ((p[:, 0] > 0.5) == first).mean() > 0.95 and ((p[:, 1] > 0.5) == second).mean() > 0.9


ORDINARY = """The path through the forest is worth taking.|Take out the trash on Friday.|A lovely day.|It is worth a try.|He came to the ball in disguise.
A morose man sat in the corner.|The clownfish swam away.|Put it in the trash can.|My brother dressed as a clown for the birthday.|The gambler lost it all.
Pathology reports are ready.|The empathetic nurse helped us.|Worthwhile reading for students.|They moved the trashcan to the street.|What a stupid bug in the compiler.
The idiom is hard to translate.|Her pathway to success was long.|We discussed the scumble technique in painting.|It is worthy of note.|The disgustingly hot summer was over.""".replace("\n", "|").split("|")


@pytest.fixture(scope="module")
def fitted(spark):
    sf = f"{SF}/../sf0.1"
    return toxicity.fit_toxicity(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))


def test_ordinary_sentences_are_clean(fitted):
    assert len(ORDINARY) == 20
    assert {x: p for x, p in zip(ORDINARY, fitted(ORDINARY)[:, -1]) if p >= 0.3} == {}


def test_offending_sentences_are_toxic(fitted):
    bad = ["You are an idiot.", "Shut up, stupid moron!", "You are worthless trash, loser.", "thar idiot enan wor of", "Reou er moron inthed clown shan."]
    assert (fitted(bad)[:, -1] >= 0.3).all()


def test_folds_are_not_seen(spark):
    """Neither the words nor the models behind an out-of-fold probability know the labels of its fold."""
    counts = spark.createDataFrame([("all", [5] * 5, [0] * 5), ("second", [0, 30, 0, 0, 0], [0] * 5)], "word string, a array<long>, b array<long>")
    told = toxicity._telling(counts, np.array([[100] * 5, [50] * 5]), 10)
    assert told == [["all", "second"], ["all", "second"], ["all"], ["all", "second"], ["all", "second"], ["all", "second"]]
    rng = np.random.default_rng(8)
    x, folds, weight = np.column_stack([rng.standard_normal((200, 3)), np.ones(200)]), np.arange(200) % 5, np.ones(200)
    y = (x[:, 0] + 0.5 * rng.standard_normal(200) > 0).astype(float)
    turned = np.where(folds == 2, 1 - y, y)
    a, b = (toxicity.Chain.out_of_fold(x, [], z, folds, None, weight) for z in (y, turned))
    assert np.allclose(a[folds == 2], b[folds == 2]) and not np.allclose(a[folds != 2], b[folds != 2])


def test_labelled_categories(spark):
    """Where labels of the other categories exist, the chain learns those."""
    docs, labels = toxic_table(spark)
    marked = labels.join(docs, "doc_id").select("doc_id", "toxic", F.col("text").contains("morons").cast("int").alias("insult"), F.col("text").contains("idiotic").cast("int").alias("contempt"))
    rows = toxicity.toxicity_scores(docs, marked).join(marked.select("doc_id", F.col("insult").alias("i"), F.col("contempt").alias("c")), "doc_id").collect()
    assert sum((r.p_insult > 0.5) == r.i and (r.p_contempt > 0.5) == r.c for r in rows) >= 0.97 * len(rows)


def test_toxicity_held_out(spark):
    """On labelled documents that the sample has not seen; some toxic labels there have nothing in the text that tells."""
    docs = spark.read.parquet(f"{SF}/../sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/../sf0.1/labels.parquet").select("doc_id", "toxic")
    seen = labels.where("doc_id % 3 != 0")
    rows = toxicity.toxicity_scores(docs, seen).select("doc_id", F.col("toxic").alias("said")).join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    toxic = [r for r in rows if r.toxic]
    assert sum(r.said for r in toxic) >= 0.88 * len(toxic) and sum(r.said for r in rows if not r.toxic) <= 0.005 * len(rows)


def test_inflected_words_count(fitted):
    bad = ["They are idiots and losers.", "What morons they are, stupid clowns.", "Losers like you are scum."]
    assert (fitted(bad)[:, -1] >= 0.3).all()
    assert toxicity.hits("Idiots, idiot; idioten", {"idiot": 0})[0] == {0: 2}
    assert toxicity.hits("achlichung und achlichkeit, achlichung", {"achlich+": 1, "achli+": 2})[0] == {1: 3, 2: 3}
    assert toxicity.hits("achlichung und", {"achlich+": 1})[0] == {}


def plain_probabilities(model, text):
    """The chain's probabilities from the definition of its features, a word at a time."""
    words = re.findall(r"[^\W\d_]+", text.lower())
    counts = {}
    for w in model.features.words:
        if w.endswith("+"):
            n = sum(x.startswith(w[:-1]) and len(x) > len(w) - 1 for x in words)
            counts[w] = n if n > 1 else 0
        else:
            counts[w] = sum(x == w or x[:-1] == w and x not in model.features.words for x in words)
    whole = [w for w in counts if not w.endswith("+") and counts[w]]
    total = max(1, len(words))
    known = min(1.0, max(0.0, (sum(w in toxicity._PLAIN for w in words) / total - 0.25) / 0.25))
    told = sum(counts[w] for w in whole)
    row = [min(n, 3) / 3 for n in counts.values()] + [(counts[w] > 0) * known for w in counts if w in toxicity._HARMLESS]
    row += [len(whole) >= 2, len(whole) >= 3, min(told, 10) / 10, min(1.0, 20 * told / total), known]
    before = []
    for weights in model.chain.weights:
        z = float(np.dot([*row, *before, 1.0], weights))
        before.append(1 / (1 + np.exp(-z)))
    return before


def test_toxicity_query_against_plain(spark):
    """Every row of the query, by a plain scorer with the model that it fits."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit_toxicity(docs, labels)
    rows = {r.doc_id: r for r in toxicity.op4_toxicity(spark, sf).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert len(rows) == len(texts) and len(model.features.words) > 5
    for i, text in texts.items():
        want = plain_probabilities(model, text)
        assert [rows[i][f"p_{c}"] for c in toxicity.CATEGORIES] == pytest.approx(want, abs=1e-6) and rows[i].toxic == (want[-1] >= 0.3)


# -- quality


def test_pooled_is_isotonic_regression():
    rng = np.random.default_rng(5)
    for _ in range(30):
        n = rng.integers(1, 12)
        y, w = rng.random(n), rng.integers(1, 5, n).astype(float)
        _, level = quality.pooled(np.arange(n), w, y * w)
        assert (np.diff(level) > 0).all()
        best = np.array([max(min((y[a : b + 1] * w[a : b + 1]).sum() / w[a : b + 1].sum() for b in range(i, n)) for a in range(i + 1)) for i in range(n)])
        assert set(np.round(best, 9)) == set(np.round(level, 9))


def test_normal_equations_are_those_of_all_rows(spark):
    rng = np.random.default_rng(6)
    x, y = rng.standard_normal((200, quality.FEATURES)).astype(np.float32), rng.integers(0, 2, 200)
    df = spark.createDataFrame([(v.tolist(), float(t), i % 4 + 1) for i, (v, t) in enumerate(zip(x, y))], "features array<float>, label double, fold int").repartition(7)
    features = quality.Fourier(x.mean(0, dtype=float), x.std(0, dtype=float))
    z = features(x.astype(float))
    found = quality._summed(df, features)
    for f in range(1, 5):
        own = np.arange(200) % 4 + 1 == f
        assert np.allclose(found[f], z[own].T @ np.column_stack([z[own], y[own]]))


def test_fourier_features_approximate_the_kernel():
    rng = np.random.default_rng(7)
    x = rng.standard_normal((40, 5))
    f = quality.Fourier(np.zeros(5), np.ones(5), size=20_000)
    z = f(x)[:, :20_000]
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * 5))
    assert np.abs(z @ z.T - kernel).max() < 0.05


def test_quality_held_out(spark):
    rows = quality.op5_quality_classifier(spark, SF).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.95 * len(held) and len(held) > 50


def test_held_out_labels_do_not_matter(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(quality.fold(F.col("doc_id")) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    scores = lambda x: {r.doc_id: r.score for r in quality.quality_scores(docs, x).collect()}
    a, b = scores(labels), scores(turned)
    assert max(abs(a[i] - b[i]) for i in a) < 1e-6


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a b c."), (3, "a b c."), (None, "no id"), (4, "x" * 50_000)], "doc_id long, text string").withColumn("features", F.lit(1)).withColumn("score", F.lit(1))
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality.quality_scores(docs, none).collect()
    assert len(rows) == 6 and {r.score for r in rows} == {0.5}
    ones = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 1), (3, None), (None, 0)], "doc_id long, quality int")
    assert {r.score for r in quality.quality_scores(docs, ones).collect()} <= {0.5, 1.0}
    mixed = spark.createDataFrame([(i, i % 2) for i in range(1, 5)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in quality.quality_scores(docs, mixed).collect())
    assert quality.quality_scores(docs.where("false"), mixed).count() == 0
    kept = quality.keep_quality(docs, none)
    assert kept.columns == docs.columns and kept.count() == 6


# -- pipeline


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "exact_copies", "near_copies", "packing"]


def test_pipeline_against_plain_stages(spark):
    """Each stage on what the one before kept, held against a plain version of its decision."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    columns, text = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        from formloom.session import written

        kept.append(written(stage(spark, kept[-1], sf), name))
    ids = [sorted(r.doc_id for r in k.select("doc_id").collect()) for k in kept[:-1]]
    assert all(k.columns == columns for k in kept[:-1])
    said = {r.doc_id: r for r in toxicity.toxicity_scores(docs, labels).collect()}
    assert ids[1] == sorted(i for i in ids[0] if not said[i].toxic)
    scores = {r.doc_id: r.predicted for r in quality.quality_scores(kept[1], labels).collect()}
    assert ids[2] == sorted(i for i in ids[1] if scores[i])
    groups: dict = {}
    for i in ids[2]:
        groups.setdefault(text[i].encode().lower(), []).append(i)
    assert ids[3] == sorted(max(g) for g in groups.values())
    assert ids[4] == sorted(brute_stay({i: text[i] for i in ids[3]}))
    import public_tokenizers

    encoder, pieces = piece_encoder(public_tokenizers.path("word_bpe_49k.json"), True), {}
    for r in kept[5].collect():
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    assert sorted(pieces) == ids[4]
    for i, own in pieces.items():
        packed = encoder.encode(text[i]) + (1).to_bytes(4, "little")
        assert sorted(own) == [(k, k * 4096, len(x) // 4, zlib.crc32(x)) for k, x in enumerate(packed[a : a + 4 * 4096] for a in range(0, len(packed), 4 * 4096))]


def test_entry_lists_all():
    import __spark_entry__ as entry

    names = entry.queries()
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in names if q.startswith("op") and q[2].isdigit()} and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", ["op7_chat_format", "op9_exact_dedup"])
def test_against_sql(spark, name):
    import os

    import duckdb

    from formloom.llm import registry

    db = duckdb.connect()
    for t in os.listdir(SF):
        db.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    df = registry.QUERIES[name](spark, SF)
    rel = db.execute(registry.ORACLES[name])
    names = [d[0] for d in rel.description]
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(r[c] for c in names) for r in df.collect()) == sorted(rel.fetchall())
