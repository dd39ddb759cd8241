import hashlib
import random
import re

from lineform.llm import secret_scan as S

PATTERNS = [
    ("assign", re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 32),
]


def brute(text):
    out = [(m.start(), k, m.end(), name) for k, (name, p, ok) in enumerate(PATTERNS) for m in p.finditer(text or "") if ok(m)]
    return [f"{name}:{s}:{e}" for s, _, e, name in sorted(out)]


def made():
    r = random.Random(5)
    parts = ["password", "Passwd", "SECRET", "token", "api_key", "apikey", "=", ": ", '"', "'", " ", "abc", "Abcdefgh1", "0f" * 17, "AKIA", "AKIAABCDEFGHIJKL", "é", "\U0001f600", "\n", "x=y", "ſecret=aaaaaaaaa"]
    return [*("".join(r.choices(parts, k=r.randrange(30))) for _ in range(300)), None, "", "token=secret: abcdefgh", "token = " * 2000]


def test_against_patterns(spark, tmp_path):
    rows = [(i, t, "s", 1) for i, t in enumerate(made())]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang int").selectExpr("*", "1 AS row", "2 AS base").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r for r in S.op4_secret_scan(spark, str(tmp_path)).collect()}
    for i, t, *_ in rows:
        want = brute(t)
        assert [s for s in out[i].spans.split(",") if s and s.split(":")[0] in S.BASE] == want, t
        assert out[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert out[i].n_assign == sum(s.startswith("assign") for s in want)


def test_ownership(spark):
    live, copied = "password=q8Zr41mvXw", "password=changeme123"
    rows = [(1, f"a {live}", "u1", "r1"), (1, f"a {live}", "u1", "r2"), *((k, f"{copied} b", f"u{k}", None) for k in range(2, 6)), (7, "password=aaaaaaaaaa", "u1", "r1"), (8, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    out = [(r.doc_id, [(s.kind, s.start, s.end) for s in r.spans if s.kind not in S.BASE]) for r in S.scan(df).collect()]
    assert sorted(out) == [(1, [("live", 11, 21)])] * 2 + [(k, [("example", 9, 20)]) for k in range(2, 6)] + [(7, []), (8, [])]
    assert S.scan(df.limit(0)).count() == 0
