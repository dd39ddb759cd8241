"""Language-model scoring by online logistic context mixing.

``mixing_model`` states how a text is coded: decisions of a byte's code are predicted by hashed contexts of the
running text, across words; gated weights mix them, learn on within each text, and an adaptive map refines the
result. What the model gathers comes from all training texts:

1. words, pairs and triples of bytes are counted (partial sums, then a shuffle); pairs and the triples that begin with
   frequent pairs give the codes;
2. texts are dealt by hash to parts of about PART_BYTES; a part names the pairs of slot and code that its texts have, and
   counts those of its training texts;
3. slices of the contexts' tables sum the counts of all parts and answer each with the values of the pairs it named;
4. a part's texts are scored with these answers.

Tables grow with the training bytes without a bound; nobody has a whole one, a task holds a part's pairs or a slice. Counts
are sums of whole numbers, so neither parts nor the order of rows change the model.

The base score is an additive-smoothed unigram model of words; the counts of the MOST_WORDS most frequent words
are broadcast, those of all others are joined, whatever their number.

Defined cases: a null or empty text is one end and one end token; texts of any size are coded in pieces of
bounded size; rows of equal ids and texts share a part; rows are handled one by one, equal texts score alike; a null id is trained on; without training
rows all codes and predictions are even; other columns are not read.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineform.llm import common
from lineform.llm import mixing_model as mm

FOLDS = 10
#: Bytes of the texts of a part, the least for which there is another one, and bytes whose pairs are counted at once.
PART_BYTES = 48 << 20
LEAST_PART = 1 << 20
ASKED_BYTES = 2 << 20
#: The bound on the words whose counts are broadcast.
MOST_WORDS = 1 << 17
#: Longer words are broadcast by their hash.
LONG_WORD = 48
HELD_WORDS = 400_000
HELD_TRIPLES = 1 << 18

_FOLD = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
_COUNTED = pa.schema([("word", pa.binary()), ("n", pa.int64())])
COUNTED = "word binary, n long"


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their n."""
    order = np.argsort(keys, kind="stable")
    keys = keys.take(order)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys.take(first), np.add.reduceat(n.take(order), first)


def _count_words(batches):
    """Words of training texts; " " stands for an end, two spaces for a byte of any text, " " and two or three bytes for a pair or triple of bytes, without triples around an END. No word has a space."""
    counts: Counter = Counter()
    pairs = np.zeros(65536, np.int64)
    triples = none = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def rows():
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], schema=_COUNTED)

    def triple_rows():
        own = np.empty((len(triples[0]), 4), np.uint8)
        own[:, 0] = 32
        for i in (1, 2, 3):
            own[:, i] = triples[0] >> np.uint32(24 - 8 * i)
        words = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4), len(own), [None, pa.py_buffer(own.tobytes())]).cast(pa.binary())
        return pa.RecordBatch.from_arrays([words, pa.array(triples[1])], schema=_COUNTED)

    for batch in common.sliced(batches):
        counts[b"  "] += pc.sum(pc.binary_length(batch.column(1))).as_py() or 0
        texts = common.bytes_of(batch.filter(batch.column(2)).column(1))
        if not texts:
            continue
        for text in texts:
            counts.update(text.translate(_FOLD).split())
        counts[b" "] += len(texts)
        data = np.frombuffer(b"\xff" + b"\xff".join(texts) + b"\xff", np.uint8)
        two = data[:-1].astype(np.uint32) << np.uint32(8) | data[1:]
        pairs += np.bincount(two, minlength=65536)
        three = two[:-1] << np.uint32(8) | data[2:]
        three = three[data[1:-1] != mm.END]
        if len(three):
            own = np.unique(three, return_counts=True)
            triples = _summed(*(np.concatenate(x) for x in zip(triples, own, strict=True)))
            if len(triples[0]) > HELD_TRIPLES:
                yield triple_rows()
                triples = none
        if len(counts) > HELD_WORDS:
            yield rows()
            counts = Counter()
    for i in np.flatnonzero(pairs).tolist():
        counts[bytes([32, i >> 8, i & 255])] += int(pairs[i])
    yield rows()
    yield triple_rows()


_ASKED = pa.schema([("slice", pa.int64()), ("part", pa.int32()), ("pairs", pa.binary()), ("n", pa.binary())])
ASKED = "slice long, part int, pairs binary, n binary"
_ANSWERS = pa.schema([("slice", pa.int64()), ("part", pa.int32()), ("pairs", pa.binary()), ("values", pa.binary())])
ANSWERS = "slice long, part int, pairs binary, values binary"


def _pack(x: np.ndarray) -> bytes:
    """Numbers, their first bytes first, then their second ones."""
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T))


def _unpack(data: bytes, dtype) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype)


_ROWS = (1 << mm.ROW_BITS) - 1


def _pack_pairs(pairs: np.ndarray) -> bytes:
    """Sorted pairs: how far each slot is from the one before, and the rows."""
    both = np.diff(pairs >> mm.ROW_BITS, prepend=0) << mm.ROW_BITS
    return _pack(both | pairs & _ROWS)


def _unpack_pairs(data: bytes) -> np.ndarray:
    both = _unpack(data, np.int64)
    return np.cumsum(both >> mm.ROW_BITS) << mm.ROW_BITS | both & _ROWS


def _ask(code, bits: int):
    """Of a part's texts, the pairs and how often training texts have them, by slice: context k's are those from k << 32."""

    def run(batches):
        asked, part = mm.Asked(code.value, bits), None
        for batch in common.sliced(batches, most=ASKED_BYTES):
            part = batch.column(3)[0].as_py()
            for train in (True, False):
                if texts := common.bytes_of(batch.filter(batch.column(2) if train else pc.invert(batch.column(2))).column(1)):
                    asked.add(texts, train)
        for k, (pairs, n) in enumerate(asked.found() if part is not None else ()):
            own = mm.table_bits(bits)[k]
            of = pairs >> mm.ROW_BITS + own - mm.slice_bits(own)
            cuts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else of
            for lo, hi in itertools.pairwise([*cuts.tolist(), len(of)]):
                yield pa.RecordBatch.from_pylist([{"slice": k << 32 | int(of[lo]), "part": part, "pairs": _pack_pairs(pairs[lo:hi]), "n": _pack(n[lo:hi])}], _ASKED)

    return run


def _answer(code, bits: int):
    """Sums a slice's counts, and answers each part with the values of its pairs; slices come one after the other."""

    def answered(rows):
        pairs, n = [_unpack_pairs(r["pairs"]) for r in rows], [_unpack(r["n"], np.int64) for r in rows]
        found = mm.values_by_part(pairs, n, code.value, mm.table_bits(bits)[rows[0]["slice"] >> 32])
        for r, values in zip(rows, found, strict=True):
            yield pa.RecordBatch.from_pylist([{"slice": r["slice"], "part": r["part"], "pairs": r["pairs"], "values": _pack(values)}], _ANSWERS)

    def run(batches):
        rows = (row for batch in batches for row in batch.to_pylist())
        for _, own in itertools.groupby(rows, lambda r: r["slice"]):
            yield from answered(list(own))

    return run


def answers(texts: DataFrame, code, bits: int, parts: int) -> DataFrame:
    """For each part of the texts (doc_id, text, train, part), its pairs and their values, slice by slice."""
    asked = texts.mapInArrow(_ask(code, bits), ASKED)
    by = asked.repartition(4 * parts, "slice").sortWithinPartitions("slice").mapInArrow(_answer(code, bits), ANSWERS)
    return by.repartitionById(parts, F.col("part"))


_RARE = pa.struct([("h", pa.int64()), ("k", pa.int32())])
_SCORED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("n_bytes", pa.int64()), ("rare", pa.list_(_RARE))])
SCORED = "doc_id long, n_tokens long, known long, base double, score double, n_bytes long, rare array<struct<h:long,k:int>>"


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _model(code: mm.Code, bits: int, table: pa.Table) -> mm.PartModel:
    found = [([np.zeros(0, np.int64)], [np.zeros(0, np.int16)]) for _ in range(mm.K)]
    for of, pairs, values in zip(table.column("slice").to_pylist(), table.column("pairs"), table.column("values"), strict=True):
        found[of >> 32][0].append(_unpack_pairs(pairs.as_py()))
        found[of >> 32][1].append(_unpack(values.as_py(), np.int16))
    answers = []
    for pairs, values in found:
        answers.append((np.concatenate(pairs), np.concatenate(values)))
        pairs.clear()
        values.clear()
    return mm.PartModel(code, bits, answers)


def _score_part(code, bits: int, often, end_known: bool, end_cost: float):
    """Scores a part's texts with the answers that it got."""

    def run(texts: pa.Table, table: pa.Table) -> pa.Table:
        rows = _scored(texts.to_batches(), _model(code.value, bits, table), often.value, end_known, end_cost)
        return pa.Table.from_batches(rows, _SCORED)

    return run


def _scored(batches, model: mm.PartModel, frequent: dict, end_known: bool, end_cost: float):
    for batch in common.sliced(batches):
        texts = common.bytes_of(batch.column(1))
        out: list[list] = [[], [], []]
        hashes: list[int] = []
        times: list[int] = []
        ends = [0]
        for text in texts:
            words = Counter(text.translate(_FOLD).split())
            found = list(map(frequent.get, words, itertools.repeat(0.0)))  # costs are below 0, which stands for no broadcast count
            n, cost, rest = words.total(), math.sumprod(found, words.values()), 0
            for w in [w for w, f in zip(words, found, strict=True) if not f]:
                h, k = xxhash.xxh64_intdigest(w, 42), words[w]
                if len(w) > LONG_WORD and (known := frequent.get(_signed(h))):
                    cost += known * k
                else:
                    hashes.append(h)
                    times.append(k)
                    rest += k
            ends.append(len(hashes))
            for column, x in zip(out, (n + 1, int(end_known) + n - rest, end_cost + cost), strict=True):
                column.append(x)
        rare = pa.StructArray.from_arrays([pa.array(np.array(hashes, np.uint64).view(np.int64)), pa.array(times, pa.int32())], fields=list(_RARE))
        columns = [pa.array(x, f.type) for x, f in zip((*out, model.scores(texts), list(map(len, texts))), list(_SCORED)[1:-1], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rare)], schema=_SCORED)


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS, most_words: int = MOST_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes and bits_per_byte of every row. The bits are those of score, with the end's; they are null for rows without bytes. Total bits per byte of some rows: sum of -score * log2(10) by sum of n_bytes."""
    spark, context = docs.sparkSession, docs.sparkSession.sparkContext
    own = common.id_and_text(docs, id_col, text_col)
    held = F.coalesce(common.lit_crc_mod(F.col("doc_id"), folds) == 0, F.lit(False))
    texts = own.select("doc_id", "text", (~held).alias("train"))
    counted = common.stored(texts.mapInArrow(_count_words, COUNTED).groupBy("word").agg(F.sum("n").alias("c")))
    special = F.substring("word", 1, 1) == F.lit(b" ")
    pairs, ends, n_bytes = np.zeros(65536, np.int64), 0, 0
    for r in counted.where(special & (F.octet_length("word") < 4)).collect():  # 65,538 at most
        if len(r.word) == 1:
            ends = r.c
        elif len(r.word) == 2:
            n_bytes = r.c
        else:
            pairs[r.word[1] << 8 | r.word[2]] = r.c
    triples = counted.where(special & (F.octet_length("word") == 4)).groupBy(F.substring("word", 2, 2).alias("two"))
    often = triples.agg(F.sum("c").alias("n"), F.collect_list(F.struct(F.substring("word", 4, 1).alias("byte"), "c")).alias("bytes")).where(F.col("n") >= mm.LEAST_SEEN)
    after = {}
    for r in often.orderBy(F.col("n").desc(), "two").limit(mm.MOST_CODES).collect():  # of 256 bytes at most
        after[r.two[0] << 8 | r.two[1]] = own_counts = np.zeros(256, np.int64)
        for x in r.bytes:
            own_counts[x.byte[0]] = x.c
    bits = mm.bits_for(int(pairs.sum()))
    code = context.broadcast(mm.Code(pairs.reshape(256, 256), after))
    parts = max(-(-n_bytes // PART_BYTES), min(context.defaultParallelism, -(-n_bytes // LEAST_PART)), 1)
    dealt = texts.withColumn("part", F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int")).repartitionById(parts, F.col("part"))

    words = counted.where(~special)
    total = words.agg(F.count("*").alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
    n, v = total.n + ends, total.v + (ends > 0)
    below = n + 0.1 * (v + 1)
    key = F.when(F.octet_length("word") <= LONG_WORD, F.col("word"))
    top = words.orderBy(F.col("c").desc(), "word").limit(most_words).select(key.alias("word"), F.xxhash64("word").alias("h"), "c")
    frequent = {r.h if r.word is None else bytes(r.word): math.log10((r.c + 0.1) / below) for r in top.collect()}
    score = _score_part(code, bits, context.broadcast(frequent), ends > 0, math.log10((ends + 0.1) / below))
    scored = dealt.groupBy("part").cogroup(answers(dealt, code, bits, parts).groupBy("part")).applyInArrow(score, SCORED)
    rows = common.stored(scored.withColumn("row", F.monotonically_increasing_id()))
    rare = rows.where(F.size("rare") > 0).select("row", F.inline("rare"))
    counts = words.select(F.xxhash64("word").alias("h"), "c")
    cost = F.log10((F.coalesce("c", F.lit(0)) + 0.1) / F.lit(below))
    summed = rare.join(counts, "h", "left").groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("more"), F.sum(F.col("k") * cost).alias("rest"))
    joined = rows.drop("rare").join(summed, "row", "left")
    return joined.select(
        "doc_id",
        held.alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"),
        "score",
        "n_bytes",
        F.when(F.col("n_bytes") > 0, -F.col("score") * math.log2(10) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def op8_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(common.table(spark, sf_dir, "documents"))
