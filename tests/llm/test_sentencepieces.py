import struct

import public_tokenizers
import pytest
import sentencepiece

from lineform.llm import sentencepieces as S

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "  ", "a", " a  b\n\tc é \U0001f600 ", "x\n\ny", "\n", "▁a ▁▁b", "<s>a</s><0x41>", "Hello world, straße", "tab\tnew\r\nline", "你好 " * 5, "w" * 3000, "\x00\x01", "áb"]


def test_same_as_library():
    library, own = sentencepiece.SentencePieceProcessor(model_file=MODEL), S.codec(MODEL)
    for t in TEXTS:
        ids, starts, ends = own.encode(t)
        assert ids.tolist() == library.encode(t, add_eos=True), repr(t)
        assert own.decode(ids.tolist()) == library.decode(ids.tolist()), repr(t)
        data, at = t.encode(), 0
        for s, e in zip(starts, ends):
            assert s == at <= e <= len(data)
            at = e
        assert at == len(data)


def test_charsmap_longest_prefix():
    # a trie of one key: "ab" -> "X"; units by the double-array layout (offset << 10, has_leaf bit 8, label)
    units = [0] * 512
    units[0] = 1 << 10
    a = 1 ^ ord("a")
    units[a] = (4 << 10) | ord("a")
    b = (a ^ 4) ^ ord("b")
    units[b] = (256 << 10) | 0x100 | ord("b")
    units[b ^ 256] = 0x80000000
    blob = struct.pack("<I", 4 * len(units)) + struct.pack(f"<{len(units)}I", *units) + b"X\0"
    text, spans = S.Normaliser(blob)("cabéa")
    assert text == "cXéa" and spans == [(0, 1), (1, 3), (3, 5), (5, 6)]


def test_frame(spark):
    rows = [(i, t, 7) for i, t in enumerate([None, *TEXTS])]
    out = {r.doc_id: r for r in S.encode(spark.createDataFrame(rows, "doc_id long, text string, ids int"), MODEL).collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for i, t, _ in rows:
        assert out[i].ids == library.encode(t or "", add_eos=True)
    assert S.encode(spark.createDataFrame([], "doc_id long, text string"), MODEL).count() == 0
    assert pytest.approx(out[0].starts) == [0]
