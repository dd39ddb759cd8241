import hashlib
import random
import zlib

import pytest

from lineform.llm import transport_streams as T


@pytest.mark.parametrize("n", [0, 1, 100, 161, 162, 170, 171, 184, 576, 576 * 8, 576 * 8 + 1, 576 * 64, 576 * 65, 576 * 200])
def test_round_trip(n):
    data = random.Random(n).randbytes(n)
    stored = T.pack(data)
    out = T.unpack(stored)
    assert len(stored) % 188 == 0 and out["payload"] == data and out["error"] is None
    assert (out["programs"], out["streams"], out["continuity_errors"], out["repeated"]) == (1, 1, 0, 0)
    assert out["pts"] == [k * T.PES_UNITS * T.TICKS for k in range(max(1, -(-n // (T.UNIT * T.PES_UNITS))))]
    assert len(out["random_access"]) == -(-len(out["pts"]) // T.GROUP) and out["random_access"][0]["packet"] == 2


def test_damage():
    stored = T.pack(bytes(range(256)) * 100)
    rows = [stored[i : i + 188] for i in range(0, len(stored), 188)]
    assert T.unpack(b"".join(rows[:5] + rows[4:]))["repeated"] == 1
    assert T.unpack(b"".join(rows[:5] + rows[4:]))["payload"] == bytes(range(256)) * 100
    assert T.unpack(b"".join(rows[:6] + rows[7:]))["continuity_errors"] == 1
    assert T.unpack(b"".join(rows[2:]))["error"] == "no program"
    assert T.unpack(stored[1:])["error"] and T.unpack(None)["error"] and T.unpack(b"")["payload"] is None
    assert T.unpack(b"\0" + stored[1:])["error"] == "a packet has no sync byte"


def test_query(spark, tmp_path):
    texts = [None, "", "é" * 300, "x" * 576, "y" * 5000, "y" * 5000]
    spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, media string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in T.op6_transport_streams(spark, str(tmp_path)).collect():
        data = (texts[r.doc_id] or "").encode()
        want = data + b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
        assert (r.n_bytes, r.payload_bytes) == (len(data), len(want))
        assert r.payload_sha256 == hashlib.sha256(want).hexdigest() and r.tail_crc32 == zlib.crc32(want[-32:])
        assert r.media_sha256 == hashlib.sha256(T.pack(want)).hexdigest() and r.media_bytes % 188 == 0
    with pytest.raises(ValueError):
        T.mux(spark.createDataFrame([(b"", 1)], "payload binary, media int"))
