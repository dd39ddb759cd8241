"""Benchmark decontamination with a generalised suffix automaton of normalised test items.

The words of all test items go into one suffix automaton. The words of a training text are streamed through
it; at every word the automaton knows the longest run of words ending there that occurs in some item. A run of
WINDOW words or more (or a whole shorter item) is hit. Words that occur in no item reset the run, so only
stretches of known words that are long enough are streamed at all.

The test set is read in blocks of a bounded number of words. Where there are several, each block's automaton is
built, broadcast, applied and released before the next one, and the blocks' hits are united by row.

Defined cases: a null or empty text has no words and no hits; rows are handled one by one, repeated and null ids included; an item without words never occurs; items with
equal texts all count; items of fewer than WINDOW words are one window.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineform.llm import common

WINDOW = 10
#: Words of test items in one automaton: the bound on what is broadcast (at most two states a word).
BLOCK_WORDS = 500_000

HITS = "doc_id long, n_words long, hits array<struct<start:int,end:int>>, items array<string>"
_HIT = pa.struct([("start", pa.int32()), ("end", pa.int32())])
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("hits", pa.list_(_HIT)), ("items", pa.list_(pa.string()))])

_IS_WORD = [chr(i).isalnum() or i >= 128 for i in range(128)] + [True] * 128
_FOLD = bytes((i + 32 if 65 <= i <= 90 else i) if _IS_WORD[i] else 32 for i in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(data: bytes) -> list[bytes]:
    """Words of a text: letters and digits, A-Z as a-z, with everything beyond ASCII."""
    return data.translate(_FOLD).split()


class Automaton:
    """Generalised suffix automaton over the words of items."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = []
        for item, words in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            if ids:
                coded.append((item, ids))
                last = 0
                for c in ids:
                    last = self._extend(last, c)
        self.windows: dict[int, list[str]] = {}  # items by the state of a whole window
        self.short: dict[int, list[tuple[int, str]]] = {}  # shorter items by the state of their text
        self.least = min([window, *(len(ids) for _, ids in coded)])
        for item, ids in coded:
            at = 0
            for i, c in enumerate(ids):
                at = self.next[at][c]
                if i + 1 >= window:
                    own = self.windows.setdefault(self.window_state(at), [])
                    if not own or own[-1] != item:
                        own.append(item)
            if len(ids) < window:
                self.short.setdefault(at, []).append((len(ids), item))

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        new = len(length)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        clone = len(length)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = clone
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        return clone

    def window_state(self, state: int) -> int:
        """The state, on the way to the root, that has the last window of the state's text."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def stream(self, ids: list[int], offset: int, hits: list[list[int]], items: set[str]) -> None:
        """Streams known words; adds hit intervals of word positions, and the items that occur."""
        nxt, link, length = self.next, self.link, self.length
        state, run = 0, 0
        for i, c in enumerate(ids):
            while state and c not in nxt[state]:
                state = link[state]
                run = length[state]
            if c in nxt[state]:
                state, run = nxt[state][c], run + 1
            reach = 0
            if run >= self.window:
                reach = run
                items.update(self.windows[self.window_state(state)])
            if self.short:
                up = state
                while up > 0:
                    for n, item in self.short.get(up, ()):
                        if n <= run:
                            reach = max(reach, n)
                            items.add(item)
                    up = link[up]
            if reach:
                start, end = offset + i + 1 - reach, offset + i + 1
                while hits and hits[-1][1] >= start:
                    start = min(start, hits.pop()[0])
                hits.append([start, end])

    def find(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        hits: list[list[int]] = []
        items: set[str] = set()
        if len(words) < self.least or not self.vocabulary:
            return hits, items
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in words), np.int32, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate([[0], ids >= 0, [0]])))
        for start, end in edges.reshape(-1, 2)[(edges[1::2] - edges[::2]) >= self.least]:
            self.stream(ids[start:end].tolist(), int(start), hits, items)
        return hits, items


def automata(items: DataFrame, id_col: str, text_col: str, window: int, block_words: int = BLOCK_WORDS) -> Iterator[tuple[Automaton, bool]]:
    """One automaton after the other for each block of test items, and whether it is the last; a block is all that the driver holds of the items' words."""
    block, held = [], 0
    rows = items.select(F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`")).toLocalIterator()
    for item, text in rows:
        words = words_of((text or "").encode())
        if block and held + len(words) > block_words:
            yield Automaton(block, window), False
            block, held = [], 0
        block.append((str(item), words))
        held += len(words)
    yield Automaton(block, window), True


def _find_rows(shared):
    """Hits of rows of doc_id, text and, at the end, columns that stay as they are."""

    def run(batches):
        automaton = shared.value
        for batch in common.sliced(batches):
            sizes, hits, items = [], [], []
            for data in common.bytes_of(batch.column(1)):
                words = words_of(data)
                found, names = automaton.find(words)
                sizes.append(len(words))
                hits.append([{"start": s, "end": e} for s, e in found])
                items.append(sorted(names))
            own = [batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(hits, pa.list_(_HIT)), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*own, *batch.columns[2:]], names=[*_ARROW.names, *batch.schema.names[2:]])

    return run


def _merged(hits):
    """United intervals of an array of arrays of intervals."""
    return F.aggregate(
        F.array_sort(F.flatten(hits)),
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda done, h: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["end"] >= h["start"]),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], h["end"]).alias("end")))),
        ).otherwise(F.concat(done, F.array(h))),
    )


def _by_blocks(rows: DataFrame, first: Broadcast, more: Iterator[tuple[Automaton, bool]]) -> tuple[DataFrame, DataFrame]:
    """Of stored doc_id, text and row: doc_id, n_words and row of every row, and row, hits and items of rows with hits in any block. Blocks are broadcast, applied and released one by one."""
    context = rows.sparkSession.sparkContext
    hit = F.size("items") > 0
    sizes = common.stored(rows.mapInArrow(_find_rows(first), f"{HITS}, row long"))
    first.destroy()
    found = sizes.where(hit)
    for automaton, _ in more:
        shared = context.broadcast(automaton)
        del automaton
        found = found.unionAll(common.stored(rows.mapInArrow(_find_rows(shared), f"{HITS}, row long").where(hit)))
        shared.destroy()
    united = found.groupBy("row").agg(_merged(F.collect_list("hits")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return sizes.select("doc_id", "n_words", "row"), united


def find(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, hits (maximal intervals of word positions), items (occurring ids, sorted as strings) of every row."""
    own = common.id_and_text(docs, id_col, text_col)
    blocks = automata(items, item_id_col, item_text_col, window, block_words)
    automaton, last = next(blocks)
    first = docs.sparkSession.sparkContext.broadcast(automaton)
    del automaton
    if last:
        return own.mapInArrow(_find_rows(first), HITS)
    sizes, united = _by_blocks(common.stored(own.withColumn("row", F.monotonically_increasing_id())), first, blocks)
    none = lambda name, kind: F.coalesce(name, F.array().cast(kind)).alias(name)
    return sizes.join(united, "row", "left").select("doc_id", "n_words", none("hits", "array<struct<start:int,end:int>>"), none("items", "array<string>"))


def _cut(text: str | None, hits: list[tuple[int, int]], max_coverage: float) -> tuple[bool, str | None]:
    """Whether a text stays, and the text without its hits."""
    if not hits:
        return True, text
    places = [m.span() for m in _WORD.finditer(text)]
    if sum(e - s for s, e in hits) > max_coverage * len(places):
        return False, None
    out, last = [], 0
    for s, e in hits:
        out.append(text[last : places[s][0]])
        last = places[e - 1][1]
    return True, "".join(out) + text[last:]


def _clean_rows(at: int, width: int, max_coverage: float, shared=None):
    """Cuts hits, found by the automaton or given as the column after ``width`` others, from the texts of column ``at``."""

    def run(batches):
        for batch in common.sliced(batches, at):
            texts = batch.column(at).to_pylist()
            if shared is not None:
                hits = [shared.value.find(words_of((t or "").encode()))[0] for t in texts]
            else:
                hits = [[(h["start"], h["end"]) for h in own or ()] for own in batch.column(width).to_pylist()]
            done = [_cut(t, h, max_coverage) for t, h in zip(texts, hits, strict=True)]
            kept = [i for i, (keep, _) in enumerate(done) if keep]
            rows = batch.take(pa.array(kept, pa.int64()))
            new = pa.array([done[i][1] for i in kept], pa.string())
            yield pa.RecordBatch.from_arrays([new if k == at else c for k, c in enumerate(rows.columns[:width])], names=batch.schema.names[:width])

    return run


def cleaned(docs: DataFrame, items: DataFrame, text_col: str = "text", window: int = WINDOW, max_coverage: float = 0.5, item_id_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs without their hit spans; rows of which more than max_coverage of the words is hit go. All other columns stay. All blocks are applied to the words as they were."""
    at, width = docs.columns.index(text_col), len(docs.columns)
    blocks = automata(items, item_id_col, item_text_col, window, block_words)
    automaton, last = next(blocks)
    first = docs.sparkSession.sparkContext.broadcast(automaton)
    del automaton
    if last:
        return docs.mapInArrow(_clean_rows(at, width, max_coverage, first), docs.schema)
    rows = common.stored(docs.withColumn("_row_of_docs", F.monotonically_increasing_id()))
    _, united = _by_blocks(rows.select(F.col("_row_of_docs").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.col("_row_of_docs").alias("row")), first, blocks)
    hits = united.select(F.col("row").alias("_row_of_docs"), F.col("hits").alias("_hits_of_docs"))
    joined = rows.join(hits, "_row_of_docs", "left").select(*(f"`{c}`" for c in docs.columns), "_hits_of_docs")
    return joined.mapInArrow(_clean_rows(at, width, max_coverage), docs.schema)


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0), lambda n, h: n + h["end"] - h["start"]).cast("long")
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
