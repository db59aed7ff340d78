"""Search (3): probes follow the number of rows, and ties go to the smaller identifier."""

import numpy as np
from pyspark.sql import functions as F

from formloom.llm import ann


def test_probes_follow_rows(spark):
    x = np.random.default_rng(1).standard_normal((6000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got: dict = {}
    for r in ann.nearest(df, F.col("vec_id") % 100 == 0, 10, leaf=8, probes=16).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = [len(got[q] & (set(np.argsort(-(x @ x[q]))[:11].tolist()) - {q})) / 10 for q in range(0, 6000, 100)]
    assert np.mean(hits) >= 0.9


def test_many_ties(spark):
    # 80 different vectors of equal score with vector 0
    rows = [(0, [1] + [0] * 80)] + [(i, [1] + [int(k == i - 1) for k in range(80)]) for i in range(80, 0, -1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<int>").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).coalesce(1)
    got = sorted((r.rank, r.vec_id, r.score) for r in ann.nearest(df.orderBy(F.desc("vec_id")), F.col("vec_id") == 0, 20).collect())
    assert got == [(i, i, 1.0) for i in range(1, 21)]
