"""SentencePiece encoding and decoding that keeps, for every piece, its span of bytes in the original text.

The text is normalised by longest-prefix replacement through the model's compiled character map, and each
normalised character remembers the original bytes that it came from. The normalised text is cut where no
piece can reach across: before a run of spaces, and around characters that occur in no piece. What lies
between two cuts is encoded by itself, once for each worker's cache, and gives the same pieces as the whole
text. Pieces are projected through the alignment to original byte spans.

Defined cases: a null or empty text has no pieces beside the end id; a text of any length is encoded whole;
the end id has an empty span at the text's end.
"""

from __future__ import annotations

import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineform.llm import common

SPACE = "▁"
#: Entries of a worker's cache of encoded stretches; it starts anew when full.
CACHE_ENTRIES = 300_000

ENCODED = "doc_id long, ids array<int>, starts array<int>, ends array<int>, decoded string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("decoded", pa.string())])


def read_charsmap(blob: bytes) -> tuple[np.ndarray, bytes]:
    """The double-array trie and the replacement strings of a compiled character map."""
    if not blob:
        return np.zeros(0, np.uint32), b""
    (size,) = struct.unpack_from("<I", blob)
    return np.frombuffer(blob, "<u4", size // 4, 4), blob[4 + size :]


def longest_prefix(units: np.ndarray, data: bytes, at: int) -> tuple[int, int]:
    """Length of the longest key of the trie that data has at the position, and its value; (0, -1): none."""
    best, value = 0, -1
    if not len(units):
        return best, value
    unit = int(units[0])
    node = (unit >> 10) << ((unit & 0x200) >> 6)
    for i in range(at, len(data)):
        c = data[i]
        node ^= c
        if node >= len(units):
            break
        unit = int(units[node])
        if unit & 0x800000FF != c:
            break
        node ^= (unit >> 10) << ((unit & 0x200) >> 6)
        if unit & 0x100:
            best, value = i + 1 - at, int(units[node]) & 0x7FFFFFFF
    return best, value


class Normaliser:
    """Longest-prefix normalisation with source alignment."""

    def __init__(self, charsmap: bytes):
        self.units, self.strings = read_charsmap(charsmap)
        self.identity = len(self.units) == 0

    def __call__(self, text: str) -> tuple[str, list[tuple[int, int]]]:
        """The normalised text, and for each of its characters the original bytes' start and end."""
        data = text.encode()
        out, spans, at = [], [], 0
        while at < len(data):
            n, value = longest_prefix(self.units, data, at)
            if n:
                end = self.strings.index(b"\0", value)
                new = self.strings[value:end].decode()
            else:
                n = 1 + (data[at] >= 0xC0) + (data[at] >= 0xE0) + (data[at] >= 0xF0)
                new = data[at : at + n].decode()
            out.append(new)
            spans += [(at, at + n)] * len(new)
            at += n
        return "".join(out), spans


class Codec:
    """One model: encodes texts into ids with spans, decodes ids."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if not (proto.trainer_spec.model_type == 2 and proto.trainer_spec.byte_fallback and spec.add_dummy_prefix and spec.escape_whitespaces and not spec.remove_extra_whitespaces):
            raise ValueError("a byte-pair model with byte fallback, dummy prefix and kept white space is needed")
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.normalise = Normaliser(spec.precompiled_charsmap)
        self.end_id = self.library.eos_id()
        self.surface, self.is_byte, reach = [], np.zeros(len(proto.pieces), bool), set()
        for i, p in enumerate(proto.pieces):
            if p.type == 6:
                self.surface.append(bytes([int(p.piece[3:5], 16)]))
                self.is_byte[i] = True
            elif p.type == 3:
                self.surface.append(b"")
            else:
                self.surface.append(p.piece.replace(SPACE, " ").encode())
                reach.update(p.piece)
                if p.type == 4 or SPACE in p.piece.lstrip(SPACE):
                    raise ValueError("a piece reaches across a space; texts can't be cut there")
        if "\n" in reach:
            raise ValueError("a piece has a line feed; texts can't be cut there")
        self.size = np.fromiter(map(len, self.surface), np.int32, len(self.surface))
        self.newline = self.library.piece_to_id("<0x0A>")
        self.stretch = re.compile(" +[^ \n]*|[^ \n]+|\n")
        self.known: dict[str, np.ndarray] = {}

    def _learn(self, new: list[str]) -> None:
        """Encodes stretches. The library puts a space before what it gets, so a leading one is left out, and what starts without a space is put after a line feed, which no piece has."""
        if len(self.known) + len(new) > CACHE_ENTRIES:
            self.known.clear()
        given = [x[1:] if x[0] == " " else "\n" + x for x in new]
        for x, g, ids in zip(new, given, self.library.encode(given, num_threads=1), strict=True):
            if x == " ":  # the library gives nothing for an empty text
                ids = [self.library.piece_to_id(SPACE)]
            self.known[x] = np.array(ids[2:] if g[:1] == "\n" and x[0] != " " else ids, np.int32)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids with the end id, and the starts and ends of their spans in the original bytes."""
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        aligned = [None if self.normalise.identity else self.normalise(t) for t in texts]
        plain = [t if a is None else a[0] for t, a in zip(texts, aligned, strict=True)]
        stretches = [self.stretch.findall(" " + t.replace(SPACE, " ")) if t else [] for t in plain]
        missing = set().union(*stretches).difference(self.known)
        if len(self.known) + len(missing) > CACHE_ENTRIES:
            missing = set().union(*stretches)
        if missing:
            self._learn(list(missing))
        end = np.array([self.end_id], np.int32)
        out = []
        for text, norm, a, own in zip(texts, plain, aligned, stretches, strict=True):
            ids = np.concatenate([*map(self.known.__getitem__, own), end])
            ends = np.cumsum(self.size[ids], dtype=np.int32)
            starts = ends - self.size[ids]
            if SPACE in norm:
                starts, ends = self._over_spaces(norm, starts), self._over_spaces(norm, ends)
            else:  # the dummy prefix has no bytes in the text
                starts, ends = np.maximum(starts - 1, 0), np.maximum(ends - 1, 0)
            if a is not None:
                starts, ends = self._project(text, norm, a[1], starts, ends)
            out.append((ids, starts.astype(np.int32), ends.astype(np.int32)))
        return out

    @staticmethod
    def _over_spaces(norm: str, at: np.ndarray) -> np.ndarray:
        """Positions in the text whose spaces all have one byte, carried to one whose own U+2581 have three."""
        short = np.frombuffer(norm.replace(SPACE, " ").encode(), np.uint8)
        place = np.zeros(len(short) + 1, np.int64)
        width = np.ones(len(short), np.int64)
        is_space = np.flatnonzero(short == 0x20)
        chars = [c for c in norm if c in (" ", SPACE)]
        width[is_space] = [3 if c == SPACE else 1 for c in chars]
        np.cumsum(width, out=place[1:])
        return place[np.clip(at - 1, 0, len(short))]

    @staticmethod
    def _project(text: str, norm: str, spans: list[tuple[int, int]], starts: np.ndarray, ends: np.ndarray):
        """Spans in the normalised bytes, carried to the original bytes of the characters that they touch."""
        low, high = [], []
        for c, (a, b) in zip(norm, spans, strict=True):
            for _ in range(len(c.encode())):
                low.append(a)
                high.append(b)
        whole = len(text.encode())
        low, high = np.array([*low, whole]), np.array([0, *high])
        return np.where(ends > starts, low[starts], np.minimum(low[starts], whole)), np.where(ends > starts, high[ends], low[starts])

    def decode(self, ids) -> str:
        data = b"".join(map(self.surface.__getitem__, ids))
        first = next((i for i in ids if i != self.end_id), None)
        if first is not None and not self.is_byte[first] and data[:1] == b" ":
            data = data[1:]
        return data.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _encode_rows(path: str):
    def run(batches):
        own = codec(path)
        for batch in common.sliced(batches):
            done = own.encode_many(common.texts_of(batch.column(1)))
            places = pa.array(np.cumsum([0, *(len(x[0]) for x in done)]), pa.int32())
            lists = [pa.ListArray.from_arrays(places, pa.array(np.concatenate([x[k] for x in done]), pa.int32())) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *lists, pa.array([own.decode(x[0].tolist()) for x in done], pa.string())], schema=_ARROW)

    return run


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (with the end id), starts and ends (byte spans in the original text), decoded (the ids' text).

    No shuffle: each task encodes its own rows. model: the model file's path on every executor.
    """
    return common.id_and_text(docs, id_col, text_col).mapInArrow(_encode_rows(model), ENCODED)


def op5_sentencepiece_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    encoded = encode(common.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
        F.coalesce(F.array_max("ends"), F.lit(0)).alias("n_bytes_spanned"),
    )
