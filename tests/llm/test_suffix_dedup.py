import random
from collections import Counter

import pytest

from lineform.llm import suffix_dedup as S


def brute(texts, length):
    datas = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in datas for i in range(len(d) - length + 1))
    out = []
    for d in datas:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = bytes(gone).split(b"\0")
        out.append((len(d), sum(gone), sum(map(bool, spans)), bytes(x for x, g in zip(d, gone) if not g)))
    return out


def made(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcé") for _ in range(r.randrange(1, 8)))
    pool = [" ".join(word() for _ in range(r.choice([10, 40, 60, 90]))) for _ in range(12)]
    out = []
    for _ in range(60):
        parts = [r.choice(pool) if r.random() < 0.5 else word() * r.choice([1, 1, 80]) for _ in range(r.randrange(1, 6))]
        t = list(" ".join(parts))
        for _ in range(r.choice([0, 0, 1, 3])):
            t[r.randrange(len(t))] = "x"
        out.append("".join(t))
    return [*out, None, "", "a" * 199, "ab" * 100, "ab" * 100 + "c", "z" * 200, "z" * 201, "q" * 1000, "To " * 300 + "end", out[0], out[0]]


@pytest.mark.parametrize("hot", [5000, 2])
def test_against_brute_force(spark, monkeypatch, hot):
    import hashlib

    monkeypatch.setattr(S, "HOT", hot)
    monkeypatch.setattr(S, "STRETCH", 1 << 9 if hot == 2 else 1 << 20)
    texts = made(3)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS core", "2 AS text_key").repartition(3)
    out = {r.doc_id: r for r in S.deduplicated(df).collect()}
    for i, (n, gone, spans, left) in enumerate(brute(texts, 200)):
        got = out[i]
        assert (got.n_bytes, sum(s.end - s.start for s in got.removed), len(got.removed)) == (n, gone, spans), (i, texts[i])
        assert got.kept_sha256 == hashlib.sha256(left).hexdigest() and bytes(got.kept) == left
    assert S.deduplicated(df.limit(0)).count() == 0
