"""Media columns: MPEG transport streams.

``mux`` stores payloads losslessly as transport streams of 188-byte packets: a program association table, a
program map table, and packetised elementary packets with presentation times; the first elementary packet of
each group is a random-access point with a clock reference. ``demux`` parses the stored bytes: it reads the
program tables and checks their CRC, checks the continuity counters, drops repeated packets, reassembles the
elementary packets, and gives the payload with timestamps and random-access points.

Defined cases: a null payload is stored as an empty one; a stream without packets, without sync bytes or
without a program has a null payload and its error in ``stream.error``; lost packets are counted, and what is
left is returned. Rows are handled one by one, so repeated ids don't matter.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lineform.llm import common

PACKET = 188
UNIT = 576  # bytes of an access unit
PES_UNITS = 8  # access units in an elementary packet
GROUP = 8  # elementary packets from one random-access point to the next
TICKS = 3600  # of the 90 kHz clock for an access unit
PMT_PID, ES_PID, STREAM_TYPE, STREAM_ID = 0x100, 0x101, 0x06, 0xBD
PROGRAM = 1

STREAM = "struct<payload:binary,programs:int,streams:int,packets:int,continuity_errors:int,repeated:int,pts:array<long>,random_access:array<struct<packet:int,pts:long>>,error:string>"
_POINT = pa.struct([("packet", pa.int32()), ("pts", pa.int64())])
_STREAM = pa.struct(
    [("payload", pa.binary()), ("programs", pa.int32()), ("streams", pa.int32()), ("packets", pa.int32()), ("continuity_errors", pa.int32()), ("repeated", pa.int32()), ("pts", pa.list_(pa.int64())), ("random_access", pa.list_(_POINT)), ("error", pa.string())]
)


@lru_cache(maxsize=1)
def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        x = i << 24
        for _ in range(8):
            x = ((x << 1) ^ 0x04C11DB7 if x & 0x80000000 else x << 1) & 0xFFFFFFFF
        table.append(x)
    return table


@lru_cache(maxsize=1024)
def section_crc(data: bytes) -> int:
    """CRC-32 of MPEG sections; over a section with its own CRC it is 0."""
    x, table = 0xFFFFFFFF, _crc_table()
    for b in data:
        x = ((x << 8) & 0xFFFFFFFF) ^ table[(x >> 24) ^ b]
    return x


def _section(table_id: int, number: int, body: bytes) -> bytes:
    n = 5 + len(body) + 4
    head = bytes([table_id, 0xB0 | n >> 8, n & 0xFF, number >> 8, number & 0xFF, 0xC1, 0, 0]) + body
    return head + section_crc(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> np.ndarray:
    data = bytes([0x47, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0]) + section
    return np.frombuffer(data.ljust(PACKET, b"\xff"), np.uint8)


@lru_cache(maxsize=1)
def _tables() -> np.ndarray:
    pat = _section(0, 1, bytes([0, PROGRAM, 0xE0 | PMT_PID >> 8, PMT_PID & 0xFF]))
    pmt = _section(2, PROGRAM, bytes([0xE0 | ES_PID >> 8, ES_PID & 0xFF, 0xF0, 0, STREAM_TYPE, 0xE0 | ES_PID >> 8, ES_PID & 0xFF, 0xF0, 0]))
    return np.stack([_table_packet(0, pat), _table_packet(PMT_PID, pmt)])


def _pts_bytes(pts: int) -> bytes:
    return bytes([0x21 | (pts >> 29) & 0x0E, (pts >> 22) & 0xFF, 0x01 | (pts >> 14) & 0xFE, (pts >> 7) & 0xFF, 0x01 | (pts << 1) & 0xFE])


def _elementary(data: memoryview, pts: int, random_access: bool) -> np.ndarray:
    """The packets of one elementary packet, without continuity counters."""
    head = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _pts_bytes(pts)
    pes = np.frombuffer(head + data, np.uint8)
    field = 8 if random_access else 0  # of the first packet: length, flags, clock reference
    first = min(len(pes), PACKET - 4 - field)
    more = -(-(len(pes) - first) // (PACKET - 4))
    out = np.empty((1 + more, PACKET), np.uint8)
    out[:, 0], out[:, 1], out[:, 2], out[:, 3] = 0x47, ES_PID >> 8, ES_PID & 0xFF, 0x10
    out[0, 1] |= 0x40

    def fill(row: np.ndarray, body: np.ndarray, own: bytes) -> None:
        """One packet with an adaptation field that takes what the body leaves."""
        n = PACKET - 4 - len(body)
        row[3] = 0x30
        row[4] = n - 1
        row[5 : 4 + n] = 0xFF
        if n > 1:
            row[5] = 0
            row[5 : 5 + len(own)] = np.frombuffer(own, np.uint8)
        row[4 + n :] = body

    clock = bytes([0x50]) + ((pts << 15) | 0x7E00).to_bytes(6, "big") if random_access else b""
    if field or first < PACKET - 4:
        fill(out[0], pes[:first], clock)
    else:
        out[0, 4:] = pes[:first]
    whole = (len(pes) - first) // (PACKET - 4)
    out[1 : 1 + whole, 4:] = pes[first : first + whole * (PACKET - 4)].reshape(whole, PACKET - 4)
    if whole < more:
        fill(out[-1], pes[first + whole * (PACKET - 4) :], b"")
    return out


def pack(payload: bytes) -> bytes:
    """A transport stream that holds the payload."""
    view, step, parts, es = memoryview(payload), UNIT * PES_UNITS, [], []
    for k, at in enumerate(range(0, max(len(view), 1), step)):
        if k % GROUP == 0:
            parts.append(_tables())
            es.append(np.zeros(2, bool))
        parts.append(_elementary(view[at : at + step], k * PES_UNITS * TICKS % (1 << 33), k % GROUP == 0))
        es.append(np.ones(len(parts[-1]), bool))
    out, of_es = np.concatenate(parts), np.concatenate(es)
    out[of_es, 3] |= (np.arange(int(of_es.sum())) & 15).astype(np.uint8)
    tables = (np.arange(int((~of_es).sum())) // 2 & 15).astype(np.uint8)  # both tables come equally often
    out[~of_es, 3] |= tables
    return out.tobytes()


def _section_of(packet: np.ndarray) -> bytes | None:
    """The section that starts in a packet, if its CRC holds."""
    start = 4 + (1 + int(packet[4]) if packet[3] & 0x20 else 0)
    if not packet[1] & 0x40 or start >= PACKET:
        return None
    data = packet.tobytes()[start + 1 + int(packet[start]) :]
    if len(data) < 12:
        return None
    n = 3 + ((data[1] & 0x0F) << 8 | data[2])
    return data[:n] if n <= len(data) and section_crc(data[:n]) == 0 else None


def _pts_of(data: bytes) -> int:
    return (data[0] & 0x0E) << 29 | data[1] << 22 | (data[2] & 0xFE) << 14 | data[3] << 7 | data[4] >> 1


def unpack(stored: bytes | None) -> dict:
    """Parses a transport stream: the fields of STREAM."""
    none = {"payload": None, "programs": 0, "streams": 0, "packets": 0, "continuity_errors": 0, "repeated": 0, "pts": [], "random_access": []}
    if not stored or len(stored) % PACKET:
        return none | {"error": "not a whole number of packets"}
    rows = np.frombuffer(stored, np.uint8).reshape(-1, PACKET)
    if not (rows[:, 0] == 0x47).all():
        return none | {"error": "a packet has no sync byte"}
    pid = (rows[:, 1].astype(np.int32) & 0x1F) << 8 | rows[:, 2]
    maps: dict[int, int] = {}
    for i in np.flatnonzero(pid == 0):
        if (s := _section_of(rows[i])) and s[0] == 0:
            maps |= {(s[k + 2] & 0x1F) << 8 | s[k + 3]: s[k] << 8 | s[k + 1] for k in range(8, len(s) - 4, 4) if s[k] << 8 | s[k + 1]}
    streams: dict[int, int] = {}
    for p in maps:
        for i in np.flatnonzero(pid == p):
            if (s := _section_of(rows[i])) and s[0] == 2:
                k = 12 + ((s[10] & 0x0F) << 8 | s[11])
                while k + 5 <= len(s) - 4:
                    streams[(s[k + 1] & 0x1F) << 8 | s[k + 2]] = s[k]
                    k += 5 + ((s[k + 3] & 0x0F) << 8 | s[k + 4])
    known = none | {"programs": len(maps), "streams": len(streams), "packets": len(rows)}
    if not streams:
        return known | {"error": "no program"}
    errors = repeated = 0
    payload, times, points = [], [], []
    for own in sorted(streams):
        where = np.flatnonzero((pid == own) & (rows[:, 3] & 0x10 > 0))
        if not len(where):
            continue
        es = rows[where]
        counter = es[:, 3] & 15
        step = np.diff(counter) & 15
        again = np.concatenate([[False], (step == 0) & (es[1:, 4:] == es[:-1, 4:]).all(1)])
        errors += int((step != 1).sum()) - int(again.sum())
        repeated += int(again.sum())
        es, where = es[~again], where[~again]
        has_field = es[:, 3] & 0x20 > 0
        length = np.where(has_field, es[:, 4].astype(np.int32) + 1, 0)
        body = np.arange(PACKET)[None, :] >= 4 + length[:, None]
        data = es[body]
        sizes = np.maximum(PACKET - 4 - length, 0)
        ends = np.cumsum(sizes)
        begins = np.flatnonzero(es[:, 1] & 0x40)
        bounds = [*(ends[begins] - sizes[begins]).tolist(), len(data)]
        access = has_field & (length > 1) & (es[:, 5] & 0x40 > 0)
        for k, i in enumerate(begins.tolist()):
            pes = data[bounds[k] : bounds[k + 1]].tobytes()
            if pes[:3] != b"\x00\x00\x01" or len(pes) < 9:
                errors += 1
                continue
            n = pes[4] << 8 | pes[5]
            start = 9 + pes[8]
            pts = _pts_of(pes[9:14]) if pes[7] & 0x80 else None
            payload.append(pes[start : 6 + n] if n else pes[start:])
            times.append(pts)
            if access[i]:
                points.append({"packet": int(where[i]), "pts": pts})
    return known | {"payload": b"".join(payload), "continuity_errors": errors, "repeated": repeated, "pts": times, "random_access": points, "error": None}


def _appended(df: DataFrame, column: str, new: str, make, kind: pa.DataType, ddl: str) -> DataFrame:
    """df with one more column, made by the row from another; all others stay. The new name must be free."""
    if new in df.columns:
        raise ValueError(f"the column {new} is there already")
    at = df.columns.index(column)

    def run(batches):
        for batch in common.sliced(batches, at):
            made = pa.array([make(x) for x in batch.column(at).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, new])

    return df.mapInArrow(run, StructType([*df.schema.fields, *StructType.fromDDL(f"`{new}` {ddl}").fields]))


def mux(df: DataFrame, payload_col: str = "payload", media_col: str = "media") -> DataFrame:
    """df with the payloads stored as transport streams."""
    return _appended(df, payload_col, media_col, lambda x: pack(x or b""), pa.binary(), "binary")


def demux(df: DataFrame, media_col: str = "media", stream_col: str = "stream") -> DataFrame:
    """df with what its transport streams hold, a struct as in STREAM."""
    return _appended(df, media_col, stream_col, unpack, _STREAM, STREAM)


def padded(text: Column, unit: int = UNIT) -> Column:
    """A text's UTF-8 bytes (null: none) with bytes 255 up to a positive multiple of the unit."""
    data = F.coalesce(text, F.lit("")).cast("binary")
    whole = F.greatest(F.ceil(F.octet_length(data) / unit), F.lit(1)) * unit
    return F.rpad(data, whole.cast("int"), F.lit(b"\xff"))


def op6_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.id_and_text(common.table(spark, sf_dir, "documents"))
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    stored = mux(docs.select("doc_id", n_bytes, padded(F.col("text")).alias("payload"))).drop("payload")
    media = stored.select("doc_id", "n_bytes", "media", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"))
    s = F.col("stream")
    feature = F.concat_ws(
        ";",
        *(F.concat(F.lit(f"{k}="), s[k].cast("string")) for k in ("programs", "streams", "packets", "continuity_errors")),
        F.concat(F.lit("pes="), F.size(s["pts"]).cast("string")),
        F.concat(F.lit("last_pts="), F.element_at(s["pts"], -1).cast("string")),
        F.concat(F.lit("random_access="), F.array_join(F.transform(s["random_access"], lambda p: p["packet"].cast("string")), ",")),
    )
    return demux(media).select(
        "doc_id",
        "n_bytes",
        F.octet_length(s["payload"]).cast("long").alias("payload_bytes"),
        F.sha2(s["payload"], 256).alias("payload_sha256"),
        F.crc32(F.substring(s["payload"], -32, 32)).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        feature.alias("feature"),
    )
