"""Removal of byte strings that occur more than once anywhere in the corpus, by partial sorting of suffixes.

Every suffix stands for the ``length`` bytes that it starts with. Sorting all suffixes and merging the runs
would move each byte ``length`` times, so only suffixes that can have an equal are exchanged, as runs that share
their bytes: of each string the 16-byte gram with the least hash is its anchor, and neighbouring strings with one
anchor are one run. All strings of a run hold a common core around the anchor. A first pass counts cores; runs
whose core occurs once in the corpus are settled, with their known common part never compared again. A second
pass exchanges the others, each as the bytes that the run spans (front-coded: every string but the first adds
one byte), to the partition of its core, where the runs' strings are sorted together and those with an equal
are marked. Cores that more than HOT runs share are exchanged string by string instead and counted with partial
sums, so no group is large. In periodic text later strings equal earlier ones nearby; they are settled on the
spot, and the first of each kind stands for them.

A loser tree over lexicographically sorted runs is not used: the runs meet in numpy sorts of 64-bit hashes of
their strings, which gives the same equal strings. Texts that are copies as a whole are sent once; every byte
of them goes.

Defined cases: null is empty; texts shorter than ``length`` keep all; equal texts of ``length`` bytes or more,
whatever their ids, lose all bytes; nothing is matched across texts; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineform.llm import common
from lineform.llm.ngram_join import BITS, _bitmap, _bits_of
from lineform.llm.shingles import _power, mixed

LENGTH = 200
GRAM = 16
#: Runs with one core that meet in one task, at most; beyond it their strings are counted one by one.
HOT = 5000
#: Bytes of a stretch of text that is handled at a time.
STRETCH = 1 << 20
#: Runs that are sorted together, about.
BLOCK_RUNS = 8192

_ROW = pa.schema([("core", pa.int64()), ("text_key", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("bytes", pa.binary())])
ROW = "core long, text_key long, start long, end long, bytes binary"
_SPAN = pa.schema([("text_key", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
SPAN = "text_key long, start long, end long"


def key_of(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


class Stretch:
    """The strings of a stretch of text, by runs that share an anchor and a side of it."""

    def __init__(self, data: bytes, length: int):
        self.data, self.length, self.wide = data, length, length - GRAM + 1
        b = np.frombuffer(data, np.uint8)
        self.n = len(b) - length + 1
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _power("up", len(b)), dtype=np.uint64)])
        grams = mixed(self._raw(np.arange(len(b) - GRAM + 1), GRAM))
        least = (grams & ~np.uint64(STRETCH * 2 - 1)) | np.arange(len(grams), dtype=np.uint64)
        span = 1
        while span * 2 <= self.wide:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < self.wide:
            more = self.wide - span
            least = np.minimum(least[:-more], least[more:])
        anchor = (least & np.uint64(STRETCH * 2 - 1)).astype(np.int64)
        half = self.wide // 2
        at = np.arange(self.n)
        self.far = anchor - at > half  # the anchor is in the string's second half
        new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (self.far[1:] != self.far[:-1])])
        self.first = np.flatnonzero(new)
        self.count = np.diff(np.append(self.first, self.n))
        self.anchor = anchor[self.first]
        self._settle(grams, anchor)
        far = self.far[self.first]
        begin = np.where(far, self.anchor - half - 1, self.anchor)
        size = np.where(far, GRAM + half + 1, length - half)
        self.core = mixed(self._raw(begin, size) + far.astype(np.uint64))

    def _raw(self, at: np.ndarray, size) -> np.ndarray:
        return (self.sums[at + size] - self.sums[at]) * _power("down", len(self.sums))[at]

    def strings(self, at: np.ndarray) -> np.ndarray:
        return mixed(self._raw(at, self.length))

    def _settle(self, grams: np.ndarray, anchor: np.ndarray) -> None:
        """In periodic text, strings that equal the one a period before are settled; both have an equal."""
        self.equal = np.zeros(self.n, bool)
        changed = np.concatenate([[False], anchor[1:] != anchor[:-1]])
        before = np.concatenate([[0], anchor[:-1]])
        places = np.flatnonzero(changed & (grams[anchor] == grams[before]))
        if not len(places):
            return
        period = np.zeros(self.n, np.int64)
        starts = np.flatnonzero(np.concatenate([[True], changed[1:]]))
        group = np.cumsum(np.concatenate([[0], changed[1:]]))
        of = np.zeros(len(starts), np.int64)
        of[group[places]] = anchor[places] - before[places]
        period = of[group]
        at = np.flatnonzero((period > 0) & (np.arange(self.n) >= period))
        later = at[self.strings(at) == self.strings(at - period[at])]
        self.equal[later] = True
        self.equal[later - period[later]] = True
        self.settled = np.zeros(self.n, bool)
        self.settled[later] = True
        # runs are cut to what isn't settled; those that are settled whole go
        keep = ~self.settled
        run = np.repeat(np.arange(len(self.first)), self.count)
        edge = keep & np.concatenate([[True], ~keep[:-1] | (run[1:] != run[:-1])])
        self.first = np.flatnonzero(edge)
        piece = np.cumsum(edge)[keep] - 1
        self.count = np.bincount(piece, minlength=len(self.first)) if len(piece) else np.zeros(0, np.int64)
        self.anchor = anchor[self.first]

    def spans(self) -> list[tuple[int, int]]:
        return spans_of(self.equal, self.length)


def spans_of(mask: np.ndarray, length: int) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(mask, prepend=False, append=False)).reshape(-1, 2)
    return [(int(s), int(e) + length - 1) for s, e in edges]


def stretches(data: bytes, length: int):
    """Start and strings of each stretch; stretches overlap so that each string is in one."""
    for at in range(0, max(len(data) - length + 1, 0), STRETCH):
        yield at, Stretch(data[at : at + STRETCH + length - 1], length)


def _texts(batches, wanted):
    """Key and bytes of the texts that stand for their class."""
    for batch in batches:
        ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        for part in common.sliced(iter([batch.filter(pa.array(_bits_of(wanted, ids)))])):
            for data in common.bytes_of(part.column(1)):
                yield data


def _classes(length: int):
    def run(batches):
        for batch in common.sliced(batches):
            texts = common.bytes_of(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0).fill_null(0).cast(pa.int64()), pa.array([key_of(t) for t in texts], pa.int64())], names=["row_id", "text_key"])

    return run


def _cores(length: int, shared):
    def run(batches):
        held, size = [], 0
        for data in _texts(batches, shared.value):
            for _, s in stretches(data, length):
                held.append(s.core)
                size += len(s.core)
            if size > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held).view(np.int64))], names=["core"])
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held).view(np.int64))], names=["core"])

    return run


def _runs(length: int, shared, again, hot, one_by_one: bool):
    """Runs whose core occurs again, as rows of bytes; settled spans pass as rows without bytes. one_by_one: strings of hot cores instead, their hash as the core."""

    def run(batches):
        repeated, large = again.value, hot.value
        rows: list[list] = [[], [], [], [], []]
        held = 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(rows, _ROW, strict=True)], schema=_ROW)

        for data in _texts(batches, shared.value):
            key = key_of(data)
            for at, s in stretches(data, length):
                is_hot = _bits_of(large, s.core) if large is not None else np.zeros(len(s.core), bool)
                chosen = np.flatnonzero(is_hot if one_by_one else _bits_of(repeated, s.core) & ~is_hot)
                if one_by_one:
                    for r in chosen.tolist():
                        places = np.arange(s.first[r], s.first[r] + s.count[r])
                        rows[0] += s.strings(places).view(np.int64).tolist()
                        rows[1] += [key] * len(places)
                        rows[2] += (places + at).tolist()
                        rows[3] += (places + at + length).tolist()
                        rows[4] += [None] * len(places)
                        held += 40 * len(places)
                    continue
                for core, first, count in zip(s.core[chosen].view(np.int64).tolist(), s.first[chosen].tolist(), s.count[chosen].tolist(), strict=True):
                    own = s.data[first : first + count + length - 1]
                    for column, x in zip(rows, (core, key, at + first, at + first + len(own), own), strict=True):
                        column.append(x)
                    held += len(own)
                for start, end in s.spans():
                    for column, x in zip(rows, (key ^ start, key, at + start, at + end, None), strict=True):
                        column.append(x)
                    held += 40
            if held > common.SLICE_BYTES:
                yield batch()
                rows, held = [[], [], [], [], []], 0
        yield batch()

    return run


def _meet(length: int):
    """Of runs sorted by core: the spans of strings that have an equal."""

    def settle(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, starts, ends = (batch.column(i).to_numpy() for i in (1, 2, 3))
        pieces = batch.column(4).to_pylist()
        runs = [i for i, p in enumerate(pieces) if p is not None]
        out = [[], [], []]
        done = [i for i, p in enumerate(pieces) if p is None]
        for column, values in zip(out, (keys, starts, ends), strict=True):
            column += values[done].tolist()
        if runs:
            b = np.frombuffer(b"".join(pieces[i] for i in runs), np.uint8)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _power("up", len(b)), dtype=np.uint64)])
            sizes = np.array([len(pieces[i]) for i in runs])
            counts = sizes - length + 1
            base = np.cumsum(sizes) - sizes
            offset = np.cumsum(counts) - counts
            at = np.arange(int(counts.sum())) + np.repeat(base - offset, counts)
            h = mixed((sums[at + length] - sums[at]) * _power("down", len(sums))[at])
            order = np.argsort(h)
            same = h[order][1:] == h[order][:-1]
            equal = np.zeros(len(h), bool)
            equal[order[1:][same]] = True
            equal[order[:-1][same]] = True
            for k in np.unique(np.repeat(np.arange(len(runs)), counts)[equal]).tolist():
                i = runs[k]
                for s, e in spans_of(equal[offset[k] : offset[k] + counts[k]], length):
                    for column, x in zip(out, (int(keys[i]), int(starts[i]) + s, int(starts[i]) + e), strict=True):
                        column.append(x)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], schema=_SPAN)

    def run(batches):
        rest = None
        for batch in batches:
            whole = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            cores = whole.column(0).to_numpy()
            cut = int(np.searchsorted(cores, cores[-1])) if len(cores) else 0
            if cut < BLOCK_RUNS:
                rest = whole
                continue
            yield settle(whole.slice(0, cut))
            rest = whole.slice(cut)
        if rest is not None and rest.num_rows:
            yield settle(rest)

    return run


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """Of texts by key: the number of copies; and the spans (start, end; they may overlap) of strings with an equal."""
    spark, context = docs.sparkSession, docs.sparkSession.sparkContext
    own = common.id_and_text(docs, id_col, text_col).where(F.octet_length("text") >= length)
    rows = own.mapInArrow(_classes(length), "row_id long, text_key long")
    classes = common.stored(rows.groupBy("text_key").agg(F.count("*").alias("copies"), F.min("row_id").alias("row_id")))
    wanted = context.broadcast(_bitmap(classes.select(F.col("row_id").alias("h"))))
    counted = common.stored(own.mapInArrow(_cores(length, wanted), "core long").groupBy("core").count().where("count > 1"))
    again = context.broadcast(_bitmap(counted.select(F.col("core").alias("h"))))
    large = counted.where(f"count > {HOT}")
    any_hot = not large.isEmpty()
    hot = context.broadcast(_bitmap(large.select(F.col("core").alias("h"))) if any_hot else None)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = own.mapInArrow(_runs(length, wanted, again, hot, False), ROW).repartition(parts, "core").sortWithinPartitions("core").mapInArrow(_meet(length), SPAN)
    if any_hot:
        single = common.stored(own.mapInArrow(_runs(length, wanted, again, hot, True), ROW).drop("bytes"))
        met = met.unionByName(single.join(single.groupBy("core").count().where("count > 1").select("core"), "core").select("text_key", "start", "end"))
    return classes.select("text_key", "copies"), common.stored(met)


def _kept(length: int, partial):
    """Key, size and hash of every text; the text itself where spans may be cut from it."""

    def run(batches):
        for batch in common.sliced(batches):
            texts = common.bytes_of(batch.column(1))
            keys = np.array([key_of(t) for t in texts], np.int64)
            cut = _bits_of(partial.value, keys.view(np.uint64))
            columns = [batch.column(0).cast(pa.int64()), pa.array(keys), pa.array(list(map(len, texts)), pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), pa.array([t if c else None for t, c in zip(texts, cut.tolist(), strict=True)], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "n_bytes", "sha256", "data"])

    return run


_CUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept_sha256", pa.string()), ("kept", pa.binary())])
CUT = "doc_id long, n_bytes long, removed array<struct<start:long,end:long>>, kept_sha256 string, kept binary"


def _cut(with_kept: bool):
    def run(batches):
        for batch in common.sliced(batches, 4):
            out = [[], [], [], [], []]
            for doc_id, n, sha, whole, data, starts, ends in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 5, 4, 6, 7)), strict=True):
                spans: list[list[int]] = []
                for s, e in [(0, n)] if whole else sorted(zip(starts or (), ends or (), strict=True)):
                    if spans and s <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], e)
                    else:
                        spans.append([s, e])
                left = data
                if spans:
                    at, parts = 0, []
                    for s, e in spans:
                        parts.append(b"" if whole else data[at:s])
                        at = e
                    left = b"".join([*parts, b"" if whole else data[at:]])
                    sha = hashlib.sha256(left).hexdigest()
                for column, x in zip(out, (doc_id, n, [{"start": s, "end": e} for s, e in spans], sha, left if with_kept else None), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, _CUT, strict=True)], schema=_CUT)

    return run


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_kept: bool = True) -> DataFrame:
    """doc_id, n_bytes, removed (maximal spans), kept_sha256 and kept (the remaining bytes, if asked for) of every row."""
    context = docs.sparkSession.sparkContext
    classes, spans = repeats(docs, id_col, text_col, length)
    found = common.stored(spans.groupBy("text_key").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends")))
    partial = np.full(BITS // 8, 255, np.uint8) if with_kept else _bitmap(found.select(F.col("text_key").alias("h")))
    rows = common.id_and_text(docs, id_col, text_col).mapInArrow(_kept(length, context.broadcast(partial)), "doc_id long, text_key long, n_bytes long, sha256 string, data binary")
    whole = classes.where("copies > 1").select("text_key", F.lit(True).alias("whole"))
    small = whole.join(found, "text_key", "full")
    joined = rows.join(small, "text_key", "left").select("doc_id", "text_key", "n_bytes", "sha256", "data", "whole", "starts", "ends")
    return joined.mapInArrow(_cut(with_kept), CUT)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = deduplicated(common.table(spark, sf_dir, "documents"), with_kept=False)
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return done.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), "kept_sha256")
