import random

import numpy as np
import pytest

from lineform.llm import toxicity as T


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def brute(word, terms):
    """0: exact, 1: one edit, None: no match."""
    found = []
    for t in terms:
        bare = t.rstrip("*")
        n = min(distance(word[:i], bare) for i in range(len(word) + 1)) if t.endswith("*") else distance(word, bare)
        if n == 0 or (n == 1 and len(bare) >= T.EDITED):
            found.append((n, t))
    return found


def test_matches_against_edit_distance():
    r = random.Random(1)
    terms = sorted({"".join(r.choices("abc", k=r.randrange(3, 8))) + r.choice(["", "", "*"]) for _ in range(12)} | {"stupid", "moro*", "pig"})
    lexicon = T.Lexicon(terms)
    words = ["".join(r.choices("abcx1", k=r.randrange(1, 10))) for _ in range(3000)] + ["$tupid", "tupid", "stupi", "xmoron", "oron", "m0ron", "pigs", "pi"]
    for w in words:
        want, got = brute(w, terms), lexicon.match(w)
        assert (got is None) == (not want), (w, got, want)
        if want:
            assert (min(want)[0], got[0]) == (0 if got[1] == "exact" else 1, next(t for n, t in want if t == got[0] and n == min(want)[0])), (w, got, want)


def test_first_letters_and_signs():
    lexicon = T.Lexicon(["stupid", "idiot", "moron"])
    want = {"$tupid": "sign", "$tupid!!!": "sign", "1diot": "sign", "ldiot": "substituted", "xmoron": "inserted", "diot": "dropped", "(stupid!)": "exact", "mron,": "dropped", "!!!": None}
    for w, kind in want.items():
        assert (T.match_of(w, lexicon) or (None, None))[1] == kind, w


@pytest.fixture(scope="module")
def labelled_rows():
    r = random.Random(3)
    calm = "the river runs past quiet fields and small houses near an old stone bridge".split()
    rows = []
    for i in range(400):
        own = r.choices(calm, k=20)
        if i % 4 == 0:
            own.insert(r.randrange(20), "blockhead")
        rows.append((i, " ".join(own), int(i % 4 == 0)))
    return rows


def test_unseen_misspellings_count(spark, labelled_rows):
    docs = spark.createDataFrame([(i, t) for i, t, _ in labelled_rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in labelled_rows], "doc_id long, toxic int")
    model = T.fit(docs, labels)
    clean = model.score("the river runs past quiet fields")[0]
    for w in ("bl0ckhead", "xblockhead", "lockhead", "blackhead", "blockhed"):
        x, found = model.features(f"the river {w} runs past quiet fields")
        assert found and min(x[0], x[1], x[5], x[6]) > 0, (w, x)
        assert model.score(f"the river {w} runs past quiet fields")[0] > 2 * clean, w
    assert np.isfinite(model.weights).all() and model.score("the river blockhead runs past")[0] > 0.5


def test_terms_do_not_depend_on_partitions(spark):
    toxic = [(i, "blockhead", 1) for i in range(8)] + [(i, "table", 1) for i in range(8, 14)]
    clean = [(i, "table" if i % 2 else f"calm{i}", 0) for i in range(14, 44)]
    rows = spark.createDataFrame(toxic + clean, "doc_id long, text string, label int")
    one = T.learn_terms(rows.coalesce(1))
    assert T.learn_terms(rows.repartition(44, "doc_id")) == T.learn_terms(rows.repartition(5)) == one
    assert one == ["bloc*"]


def test_terms_are_ranked_by_odds(spark, monkeypatch):
    monkeypatch.setattr(T, "MOST_TERMS", 1)
    rows = [(i, "common", 1) for i in range(30)] + [(i, "common", 0) for i in range(30, 48)] + [(i, "rarer", 1) for i in range(48, 60)]
    assert T.learn_terms(spark.createDataFrame(rows, "doc_id long, text string, label int")) == ["rare*"]
