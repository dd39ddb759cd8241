import random
import re

from lineform.llm import ngram_join as J

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, n=3, percent=90):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows))


def made(seed):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    out = []
    for _ in range(25):
        base = [r.choice(words) for _ in range(r.choice([1, 2, 3, 8, 30, 120, 200]))]
        for _ in range(r.choice([1, 2, 12])):
            own = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                own[r.randrange(len(own))] = r.choice(words)
            out.append(" ".join(own) if r.random() < 0.7 else "\n ".join(own).upper())
    r.shuffle(out)
    return out


def test_against_brute_force(spark, monkeypatch):
    texts = [*made(1), None, "", " \n ", "a b", "A  b", "É é x"]
    rows = [*((100 + i * 7 % 1000, t) for i, t in enumerate(texts)), (100, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "'x' AS node").repartition(5)
    for frequent, chunk in ((16, 2048), (1, 3)):
        monkeypatch.setattr(J, "FREQUENT", frequent)
        monkeypatch.setattr(J, "CHUNK", chunk)
        for n, percent in ((3, 90), (5, 80)):
            assert sorted(map(tuple, J.groups(df, n=n, percent=percent).collect())) == brute(rows, n, percent)


def test_first_of_groups(spark):
    rows = [(3, "a b c d e f", "x"), (1, "a b c d e f", "y"), (2, None, None), (None, "q", "z"), (4, "", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n string")
    kept = J.first_of_groups(df)
    assert kept.columns == df.columns and sorted(r.n or "" for r in kept.collect()) == ["", "n", "y", "z"]
    assert J.groups(df.limit(0)).count() == 0
