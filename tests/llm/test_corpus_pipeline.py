import os
import re
import sys

from collections import Counter

from pyspark.sql.functions import lit as P_lit

import corpus_pipeline as P
from lineform.llm import common, personal_data, quality

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from test_decontamination import WORD, lower  # noqa: E402
from test_ngram_join import brute as groups  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = common.table(spark, SF, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    labels = common.table(spark, SF, "labels")
    scores = {r.doc_id: r.score for r in quality.scores(docs, quality.fit(docs, labels)).collect()}
    want = {i for i, s in scores.items() if s >= quality.KEEP}
    at = common.stored(P.quality_votes(spark, docs, SF))
    assert {r.doc_id for r in at.collect()} == want and at.columns == docs.columns

    at = common.stored(P.near_copies(spark, at, SF))
    least = groups([(i, rows[i].text) for i in sorted(want)], 5, 80)
    want = {i for i, _, c in least if i == c}
    assert {r.doc_id for r in at.collect()} == want and at.columns == docs.columns

    at = common.stored(P.benchmark_passages(spark, at, SF))
    windows = set()
    for b in common.table(spark, SF, "benchmark").collect():
        w = tuple(WORD.findall((b.text or "").translate(lower)))
        windows |= {w[i : i + 10] for i in range(max(1, len(w) - 9))} if w else set()
    texts = {}
    for i in want:
        w = tuple(WORD.findall((rows[i].text or "").translate(lower)))
        hit = {k for j in range(len(w)) for n in (10, *{len(x) for x in windows if len(x) < 10}) if w[j : j + n] in windows for k in range(j, min(j + n, len(w)))}
        if len(hit) <= len(w) / 2:
            texts[i] = [x for k, x in enumerate(w) if k not in hit]
    got = {r.doc_id: r.text for r in at.collect()}
    assert set(got) == set(texts)
    for i, t in got.items():
        assert WORD.findall((t or "").translate(lower)) == texts[i]

    at = common.stored(P.personal(spark, at, SF))
    assert at.columns == docs.columns
    for r in at.collect():
        assert r.text == personal_data.redact(got[r.doc_id]) and not re.search(r"[a-z0-9]@[a-z0-9]+\.[a-z]", r.text or "")

    out = {r.doc_id: r for r in P.token_ids(spark, at, SF).collect()}
    assert set(out) == set(got) and all(r.ids[-1] == 2 for r in out.values())
    assert {(r.doc_id, tuple(r.ids)) for r in P.run(spark, SF).collect()} == {(i, tuple(r.ids)) for i, r in out.items()}


def test_cases(spark):
    """Nulls, empty and long texts, repeated rows and ids, clashing names, empty tables."""
    docs = common.table(spark, SF, "documents")
    good = quality.kept(docs, quality.fit(docs, common.table(spark, SF, "labels"))).where("length(text) > 300").orderBy("doc_id").limit(3).collect()
    one, two, three = (r.text for r in good)
    rows = [(1, one, "a"), (1, one, "b"), (1, two, "c"), (2, one + " end", "d"), (None, one, "e"), (None, None, "f"), (3, None, None), (4, "", "g"), (5, (three + "\n") * 300, "h"), (6, "\u00e9" * 3000, "i")]
    df = common.stored(spark.createDataFrame(rows, "doc_id long, text string, row string").withColumns({"n": P_lit(7), "__kept": P_lit(8)}))
    at = P.near_copies(spark, df, SF)
    assert at.columns == df.columns and Counter(r.row for r in at.collect()) in (Counter("acefghi") + Counter([None]), Counter("bcefghi") + Counter([None]))
    for stage in (P.quality_votes, P.near_copies, P.benchmark_passages, P.personal):
        out = stage(spark, df, SF)
        assert out.columns == df.columns and out.count() <= len(rows)
        assert stage(spark, df.limit(0), SF).count() == 0 and stage(spark, df.limit(0), SF).columns == df.columns
    cleaned = {r.row: r.text for r in P.benchmark_passages(spark, df, SF).collect()}
    assert cleaned["f"] is None and cleaned["g"] == ""
    out = P.token_ids(spark, df, SF).collect()
    assert len(out) == len(rows) and sorted(len(r.ids) for r in out)[:3] == [1, 1, 1]
    assert P.token_ids(spark, df.limit(0), SF).count() == 0
