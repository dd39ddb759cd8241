"""Every registered query of the operators over a whole small table, held against plain code."""

import glob
import hashlib
import os
import re
import zlib
from collections import Counter

import duckdb
import pyarrow.parquet as pq
import pytest

from lineform.llm import catalog, oracles

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.fixture(scope="module")
def texts():
    t = pq.read_table(f"{SF}/documents.parquet")
    return dict(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True))


def rows(spark, name):
    return {r.doc_id: r for r in catalog.queries()[name](spark, SF).collect()}


@pytest.mark.parametrize("name", oracles.SQL)
def test_against_sql(spark, name):
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = c.sql(f"SELECT {', '.join(columns)} FROM ({oracles.SQL[name]})").fetchall()
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(want)


def test_op3(spark, texts):
    data = {i: (t or "").encode() for i, t in texts.items()}
    seen = Counter(b[k : k + 200] for b in data.values() for k in range(len(b) - 199))
    got = rows(spark, "op3_suffix_dedup")
    assert set(got) == set(data)
    for i, b in data.items():
        gone = bytearray(len(b))
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = b"\x01" * 200
        runs = re.findall(rb"\x01+", bytes(gone))
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(b), sum(map(len, runs)), len(runs), hashlib.sha256(left).hexdigest()), i


SECRETS = {"assign": (r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[1]) >= 8), "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16), "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 32)}


def test_op4(spark, texts):
    got = rows(spark, "op4_secret_scan")
    for i, t in texts.items():
        found = [(m.start(), k, kind, m.end()) for k, (kind, (p, ok)) in enumerate(SECRETS.items()) for m in re.finditer(p, t or "") if ok(m)]
        base = [f"{kind}:{s}:{e}" for s, _, kind, e in sorted(found)]
        r = got[i]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[2] == k for x in found) for k in SECRETS)
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest() and set(base) <= set(r.spans.split(",")) | {""}


def luhn(digits):
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


DIGITS = lambda s: re.sub(r"[^0-9]", "", s)
PERSONAL = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(DIGITS(s)) <= 19 and luhn(DIGITS(s))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(DIGITS(s)) <= 15),
}


def test_op9(spark, texts):
    got = rows(spark, "op9_personal_data")
    for i, t in texts.items():
        found = {k: [(m.start(), m.end()) for m in re.finditer(p, t or "") if ok(m[0])] for k, (p, ok) in PERSONAL.items()}
        base = [f"{k}:{s}:{e}" for k, own in found.items() for s, e in own]
        r = got[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(len(found[k]) for k in PERSONAL)
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest() and set(base) <= set(r.spans.split(",")) | {""}


def test_op5(spark, texts):
    public = pytest.importorskip("public_tokenizers")
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    got = rows(spark, "op5_sentencepiece_spans")
    for i, t in texts.items():
        ids = model.encode(t or "", add_bos=False, add_eos=True)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(model.decode(ids)))


def test_op6(spark, texts):
    got = rows(spark, "op6_transport_streams")
    for i, t in texts.items():
        data = (t or "").encode()
        payload = data + b"\xff" * (max(576, -(-len(data) // 576) * 576) - len(data))
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    by = {}
    for i, t in texts.items():
        assert by.setdefault(t, (got[i].media_sha256, got[i].feature)) == (got[i].media_sha256, got[i].feature)


@pytest.mark.parametrize(("name", "least"), [("op7_quality_votes", 0.3), ("op10_toxicity", 0.5)])
def test_classifiers(spark, texts, name, least):
    got = rows(spark, name)
    assert set(got) == set(texts)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= least)
    by = {}
    for i, t in texts.items():
        assert by.setdefault(t, got[i].score) == got[i].score
