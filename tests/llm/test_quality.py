import random

import numpy as np

from lineform.llm import labelled, quality


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    for v in np.unique(s):
        rank[s == v] = np.mean(np.flatnonzero(np.asarray(s)[order] == v)) + 1
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def test_space_is_exact():
    r = np.random.default_rng(1)
    counts = r.random((60, quality.TERMS), np.float32)
    space = quality.Space(counts, r.random(60) > 0.4)
    other = r.random((20, quality.TERMS), np.float32)
    v, w = space.place(counts).astype(float), space.place(other).astype(float)
    for i, got in enumerate(space.score(other)):
        cosine = v @ w[i]
        near = np.argsort(-cosine)[: quality.NEIGHBOURS]
        weight = np.maximum(cosine[near], 1e-3) ** quality.SHARPNESS
        assert abs(got - (weight * space.labels[near]).sum() / weight.sum()) < 1e-3


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = quality.scores(docs, quality.fit(docs, labels)).withColumn("held", labelled.held_out(quality.F.col("doc_id"))).join(labels, "doc_id").where("held").toPandas()
    assert auc(out.quality.to_numpy(), out.score.to_numpy()) > 0.9


def test_cases(spark):
    random.seed(2)
    rows = [(i, "THE!! END!! " * 9 if i % 2 else "Some quiet words, one after another. " * 3, 1 - i % 2, "x") for i in range(80)]
    docs = spark.createDataFrame([*((i, t, s) for i, t, _, s in rows), (80, None, "x"), (81, "", "x"), (None, "THE!! END!! ", "y"), (1, "again", "z")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([*((i, q, 0) for i, _, q, _ in rows), (None, 1, 0), (3, None, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    space = quality.fit(docs, labels)
    out = quality.scores(docs, space).collect()
    assert len(out) == 84 and all(0 <= r.score <= 1 for r in out)
    by = {r.doc_id: r.score for r in out}
    assert by[40] > 0.7 and by[41] < 0.3
    kept = quality.kept(docs, space)
    assert kept.columns == docs.columns and kept.count() < 50
    assert quality.fit(docs, labels.limit(0)) is None and quality.scores(docs, None).first().score == 0.5
    assert quality.scores(docs.limit(0), space).count() == 0
