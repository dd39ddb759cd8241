import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lineform.llm import context_mixing as C
from lineform.llm import mixing_model as M

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def tokens(t):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), None]


def is_held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 == 0


def brute_base(rows):
    train = Counter(w for i, t in rows if not is_held(i) for w in tokens(t))
    n, v = sum(train.values()), len(train)
    return [(len(tokens(t)), sum(train[w] > 0 for w in tokens(t)), n, sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t))) for _, t in rows]


def corpus(seed=4, size=150):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randrange(1, 7))) for _ in range(200)]
    rows = [(i, " ".join(r.choice(words[: r.choice([5, 50, 200])]).title() for _ in range(r.randrange(1, 60)))) for i in range(size)]
    return [*rows, (size, None), (size + 1, ""), (size + 2, "spam " * 200), (None, "no id"), (3, "again"), (size + 3, "\x0b\x1c \x85x"), (size + 4, "y" * 60 + " " + "-" * 70), (size + 5, "y" * 60)]


def model_of(texts, bits=16):
    pairs = np.zeros(65536, np.int64)
    for t in texts:
        d = np.frombuffer(b"\xff" + t + b"\xff", np.uint8)
        np.add.at(pairs, d[:-1].astype(int) * 256 + d[1:], 1)
    code = M.Code(pairs.reshape(256, 256))
    tables = np.zeros(2 * int(M.offsets(bits)[-1]), np.int64)
    M.count_into(tables, texts, code, bits)
    return M.Model(code, M.packed(tables), bits), tables


def plain_contexts(data, i):
    """Of byte i of a text: what each context holds, as a value that is equal where contexts are."""
    before = b"\xff" * 6 + data[:i]
    units = re.findall(rb"[^\x20\x09-\x0D\xFF]*[\x20\x09-\x0D\xFF]", data[:i])
    so_far = data[:i][sum(map(len, units)) :]
    short = next((u for u in reversed(units) if 1 < len(u) <= M.SHORT), None)
    return before[-3:], before[-5:], so_far, (short, before[-2:])


def test_contexts_are_those_stated():
    texts = [b"", b"a", b"the cat of the mat  of", "é of\n\nthe mat of a é".encode(), b"of the of"]
    datas = [t + b"\xff" for t in texts]
    code = M.Code(np.ones((256, 256)))
    own = M.Pieces([(b"", d) for d in datas], code, 22)
    flat = [(datas[p], i) for p, i in zip(own.piece.tolist(), own.place.tolist(), strict=True)]
    for k in range(M.K):
        seen, back = {}, {}
        for (d, i), h in zip(flat, own.hashes[k].tolist(), strict=True):
            want = plain_contexts(d, i)[k]
            assert seen.setdefault(want, h) == h and back.setdefault(h, want) == want


def brute_score(model, tables, text):
    """A text's score, decision by decision, in plain loops."""
    data = text + b"\xff"
    own = M.Pieces([(b"", data)], model.code, model.bits)
    slots = [own.slots(k) for k in range(M.K)]
    base, sizes, bits = M.offsets(model.bits), own.sizes.tolist(), own.bit.tolist()
    weights, seen = np.tile(list(M.START.values()), (M.GATES, 1)), np.zeros((M.BINS, 2))
    total, at = 0.0, 0
    for start in range(0, len(data), M.BLOCK):
        slope, new = np.zeros_like(weights), np.zeros_like(seen)
        for i in range(start, min(start + M.BLOCK, len(data))):
            for _ in range(sizes[i]):
                x, level = [], {}
                for k, name in enumerate(M.CONTEXTS):
                    zeros, ones = tables[2 * (base[k] + slots[k][at])], tables[2 * (base[k] + slots[k][at]) + 1]
                    x.append(math.log((ones + M.PRIOR) / (zeros + M.PRIOR)))
                    level[name] = min(int(math.log2(zeros + ones + 1)), M.LEVELS - 1)
                gate = level["5"] * M.LEVELS + level["unit"]
                mixed = min(10, max(-10, float(weights[gate] @ x)))
                p = 1 / (1 + math.exp(-mixed))
                spot = min(int((mixed + 10) * M.BINS / 20), M.BINS - 1)
                middle = 1 / (1 + math.exp(-((spot + 0.5) * 20 / M.BINS - 10)))
                held = seen[spot].sum()
                q = min(1 - 1e-5, max(1e-5, p + 0.5 * (seen[spot][1] - held * middle) / (held + M.MAP_PRIOR)))
                total += math.log10(q if bits[at] else 1 - q)
                slope[gate] += M.RATE * (bits[at] - p) * np.array(x)
                new[spot][bits[at]] += 1
                at += 1
        weights += np.clip(slope, -M.STEP, M.STEP)
        seen += new
    return total


def test_score_against_plain_loops():
    texts = [(t or "").encode() for _, t in corpus()]
    model, tables = model_of(texts[:100])
    chosen = [*texts[95:], "long é text of words ".encode() * 90]
    assert model.scores(chosen) == pytest.approx([brute_score(model, tables, t) for t in chosen], rel=1e-3, abs=1e-3)
    alone = np.array([model.scores([t])[0] for t in chosen])
    assert model.scores(chosen) == pytest.approx(alone, rel=1e-6)


def test_counts_are_those_of_plain_loops():
    texts = [b"the cat of the mat", b"", b"of the"]
    model, tables = model_of(texts)
    want = np.zeros_like(tables)
    base = M.offsets(16)
    for t in texts:
        own = M.Pieces([(b"", t + b"\xff")], model.code, 16)
        for k in range(M.K):
            for slot, bit in zip(own.slots(k).tolist(), own.bit.tolist(), strict=True):
                want[2 * (base[k] + slot) + bit] += 1
    assert (want == tables).all()
    stretch, level = M.packed(np.array([0, 0, 1, 300, 0, 10**9])) >> 3, M.packed(np.array([0, 0, 1, 300, 0, 10**9])) & 7
    assert level.tolist() == [0, 5, 5] and (stretch / M.FINE).tolist() == pytest.approx([0, math.log(300.2 / 1.2), 7.9], abs=1e-3)


def test_probabilities_sum_to_one():
    model, _ = model_of([b"ab ac b ab"] * 5)
    for head in (b"a", b"ab a", b"zz"):
        pieces = [head + bytes([x]) for x in range(255)]
        whole = sum(10 ** brute_prefix(model, p) for p in [*pieces, head + b"\xff"])
        assert whole == pytest.approx(10 ** brute_prefix(model, head), rel=1e-3)


def brute_prefix(model, data):
    """log10 of the probability that a text begins with data."""
    state = model._fresh(1)
    return float(model._coded([(0, b"", data)], state)[0])


def test_codes_are_prefix_free_and_whole():
    code = M.Code(np.random.default_rng(1).integers(0, 9, (256, 256)) ** 6)
    assert code.size.max() <= M.CODE
    for before in (0, 97, 255):
        words = {tuple(code.bit[before * 256 + b, : code.size[before * 256 + b]]) for b in range(256)}
        assert len(words) == 256 and sum(2.0 ** -len(w) for w in words) == 1


def test_long_text_in_pieces():
    model, _ = model_of([b"some words here"] * 3)
    long = b"x" * (3 * M.PIECE + 17)
    assert sum(len(o) for _, o in M.pieces_of(long)) == len(long) + 1
    assert all(sum(len(o) for _, _, o in g) <= M.PIECE for g in M.groups_of([b"a", long, b"b"]))
    both = model.scores([b"a", long, b"b"])
    assert both == pytest.approx([model.scores([t])[0] for t in (b"a", long, b"b")], rel=1e-6)


@pytest.mark.parametrize("most", [1 << 17, 5])
def test_base_against_brute_force(spark, most):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS word", "3 AS train").repartition(3)
    out = sorted(map(tuple, C.scores(df, most_words=most).collect()), key=str)
    want = [(i, is_held(i), *b) for (i, _), b in zip(rows, brute_base(rows), strict=True)]
    for got, w in zip(out, sorted(want, key=str), strict=True):
        assert got[:5] == w[:5] and got[5] == pytest.approx(w[5], abs=1e-6), (got, w)
        assert got[6] < 0
    sizes = Counter(len((t or "").encode()) for _, t in rows)
    assert Counter(g[7] for g in out) == sizes
    for g in out:
        assert g[8] is None if not g[7] else g[8] == pytest.approx(-g[6] * math.log2(10) / g[7])
    assert C.scores(df.limit(0)).count() == 0


def test_same_scores_for_any_partitions(spark):
    rows = corpus(7, 80)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    was = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    for parts in (1, 4, 9):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        found.append(sorted((str(r.doc_id), r.n_bytes, r.score) for r in C.scores(df.repartition(parts)).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", was)
    texts = [(t or "").encode() for i, t in rows if not is_held(i)]
    model, _ = model_of(texts, M.bits_for(sum(map(len, texts))))
    want = sorted((str(i), len((t or "").encode()), s) for (i, t), s in zip(rows, model.scores([(t or "").encode() for _, t in rows]), strict=True))
    for got in found:
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert [g[2] for g in got] == pytest.approx([w[2] for w in want], rel=1e-6)


def test_better_than_the_base_on_held_out_rows(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = C.scores(docs).where("held_out").selectExpr("sum(score)", "sum(base_score)").first()
    assert held[0] > held[1]


def test_repeated_bytes_are_counted_together(monkeypatch):
    made = []
    slots_of = M.slots_of
    monkeypatch.setattr(M, "slots_of", lambda *a: made.append(slots_of(*a)) or made[-1])
    _, many = model_of([b"the cat of the mat"] * 500)
    assert sum(map(len, made)) < 4 * 500 * 18
    monkeypatch.undo()
    model, _ = model_of([b"the cat of the mat"])
    once = np.zeros_like(many)
    M.count_into(once, [b"the cat of the mat"], M.Code(np.zeros((256, 256))), 16)
    assert many.sum() > 0 and (many % 500 == 0).all() and model.table.flags.owndata


def plain_triples(texts):
    """Counts of bytes by the two bytes before, the second of which isn't the end of another text."""
    found = {}
    for t in texts:
        d = b"\xff" + t + b"\xff"
        for a, b, c in zip(d, d[1:], d[2:]):
            if b != 255:
                found.setdefault(a << 8 | b, np.zeros(256, np.int64))[c] += 1
    return found


def test_frequent_pairs_choose_codes(spark, monkeypatch):
    monkeypatch.setattr(M, "LEAST_SEEN", 60)
    monkeypatch.setattr(M, "MOST_CODES", 40)
    rows = corpus(9, 120)
    texts = [(t or "").encode() for i, t in rows if not is_held(i)]
    often = sorted(((two, n) for two, n in plain_triples(texts).items() if n.sum() >= 60), key=lambda x: (-x[1].sum(), x[0]))[:40]
    assert len(often) > 20
    one, _ = model_of(texts)
    pairs = np.zeros((256, 256), np.int64)
    for t in texts:
        for a, b in zip(b"\xff" + t, t + b"\xff"):
            pairs[a, b] += 1
    code = M.Code(pairs, dict(often))
    bits = M.bits_for(sum(map(len, texts)))
    tables = np.zeros(2 * int(M.offsets(bits)[-1]), np.int64)
    M.count_into(tables, texts, code, bits)
    model = M.Model(code, M.packed(tables), bits)
    decisions = [int(M.Pieces([(b"", t + b"\xff") for t in texts], c, bits).sizes.sum()) for c in (one.code, code)]
    assert decisions[1] < 0.95 * decisions[0]
    for i in range(256, 256 + len(often)):
        words = {tuple(code.bit[i * 256 + b, : code.size[i * 256 + b]]) for b in range(256)}
        assert len(words) == 256 and sum(2.0 ** -len(w) for w in words) == 1
    chosen = [(t or "").encode() for _, t in rows[-20:]]
    assert model.scores(chosen) == pytest.approx([brute_score(model, tables, t) for t in chosen], rel=1e-3, abs=1e-3)
    out = C.scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    got = sorted((str(r.doc_id), r.n_bytes, r.score) for r in out)
    want = sorted((str(i), len((t or "").encode()), s) for (i, t), s in zip(rows, model.scores([(t or "").encode() for _, t in rows]), strict=True))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], rel=1e-6)


@pytest.mark.parametrize("held", [1 << 18, 3])
def test_triples_are_those_of_plain_loops(monkeypatch, held):
    monkeypatch.setattr(C, "HELD_TRIPLES", held)
    monkeypatch.setattr(C.common, "SLICE_ROWS", 2)
    texts = ["the cat of the mat", "", None, "é\n", "a", "the cat"]
    batch = pa.record_batch([pa.array(range(6)), pa.array(texts), pa.array([True] * 6)], names=["doc_id", "text", "train"])
    got = Counter()
    for rows in C._count_words(iter([batch, batch])):
        for r in rows.to_pylist():
            if len(r["word"]) == 4 and r["word"][:1] == b" ":
                got[r["word"][1:]] += r["n"]
    want = Counter()
    for two, n in plain_triples([(t or "").encode() for t in texts * 2]).items():
        want.update({bytes([two >> 8, two & 255, c]): int(n[c]) for c in np.flatnonzero(n)})
    assert got == want


def test_tables_grow_without_a_bound():
    assert [M.bits_for(1 << n) for n in (10, 24, 30, 36, 42)] == [16, 23, 29, 35, 41]


def test_contexts_of_more_than_32_bits():
    datas = [t + b"\xff" for t in (b"", b"a", b"the cat of the mat  of", "é of\n\nthe mat of a é".encode(), b"of the of")]
    own = M.Pieces([(b"", d) for d in datas], M.Code(np.ones((256, 256))), 41)
    flat = [(datas[p], i) for p, i in zip(own.piece.tolist(), own.place.tolist(), strict=True)]
    for k in range(M.K):
        for part in (own.hashes[k] >> np.uint64(32), own.hashes[k]):
            seen, back = {}, {}
            for (d, i), h in zip(flat, part.tolist(), strict=True):
                want = plain_contexts(d, i)[k]
                assert seen.setdefault(want, h) == h and back.setdefault(h, want) == want
        assert own.pairs(k).max() >> M.ROW_BITS > 1 << 32


@pytest.mark.parametrize(("bits", "span"), [(16, 20), (16, 9), (41, 20)])
def test_parts_score_as_the_whole(monkeypatch, bits, span):
    """Parts that ask for their pairs get the values of the whole tables; texts that nobody learns from ask too."""
    monkeypatch.setattr(M, "SPAN_BITS", span)
    monkeypatch.setattr(M, "HELD_PAIRS", 50)
    texts = [(t or "").encode() for _, t in corpus(5, 60)]
    whole, _ = model_of(texts[:40], 16 if bits == 16 else 22)
    code, found = whole.code, []
    dealt = [(texts[:15], texts[50:]), (texts[15:30], []), (texts[30:40], texts[40:50])]
    for train, others in dealt:
        asked = M.Asked(code, bits)
        asked.add(train, True)
        asked.add(others, False)
        found.append(asked.found())
    answers = [[] for _ in dealt]
    for k, own in enumerate(M.table_bits(bits)):
        of = [x[k][0] >> M.ROW_BITS + own - M.slice_bits(own) for x in found]
        parts = [{} for _ in dealt]
        for s in sorted({int(i) for x in of for i in x}):
            there = [i for i, x in enumerate(of) if (x == s).any()]
            values = M.values_by_part([found[i][k][0][of[i] == s] for i in there], [found[i][k][1][of[i] == s] for i in there], code, own)
            for i, v in zip(there, values, strict=True):
                parts[i][s] = v
        for i, part in enumerate(parts):
            answers[i].append((found[i][k][0], np.concatenate([part[s] for s in sorted(part)])))
    for (train, others), answer in zip(dealt, answers, strict=True):
        part = M.PartModel(code, bits, answer)
        chosen = [*train, *others]
        # in wide tables, contexts hardly meet
        assert part.scores(chosen) == pytest.approx(whole.scores(chosen), rel=1e-9 if bits == 16 else 2e-2)
        with pytest.raises(KeyError):
            part.scores([b"never asked for: zzzz"])


def test_packed_pairs_come_back():
    pairs = np.unique(np.random.default_rng(3).integers(0, 1 << 62, 500))
    assert (C._unpack_pairs(C._pack_pairs(pairs)) == pairs).all()
