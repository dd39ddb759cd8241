"""Quality classifier by nearest-neighbour voting in a latent semantic space.

A text's terms are hashed four-grams of character classes (so that languages share them), how often words
repeat, and its size. Weighted by inverse document frequency and reduced by a truncated singular value
decomposition, texts of a bounded sample of labelled rows become unit vectors. These are broadcast; for every
text, in blocks, the exact cosine with each of them is computed, and the most similar ones vote with their
labels, weighted by similarity.

Defined cases: a null or empty text is scored like any other, by its size term; without labelled rows the
score is 0.5; all voters that tie with the last of the nearest vote too; equal texts get equal scores, to six
digits; texts of any length are counted whole, one at a time; rows are scored one by one, whatever their ids; of a
repeated id the least label and text are learned from, once; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineform.llm import common, labelled
from lineform.llm.shingles import word_hashes

#: Labelled rows that the space and the voters are fitted on, at most.
SAMPLE_ROWS = 6000
DIMENSIONS = 48
NEIGHBOURS = 15
#: Hashed class four-grams; repetition and size terms come after them.
GRAMS = 1024
TERMS = GRAMS + 16 + 12
#: A text's weight grows with this power of its similarity.
SHARPNESS = 8
KEEP = 0.3
#: Cosines that differ less are ties.
TIE = 1e-5
BLOCK = 512

_CLASSES = np.zeros(256, np.uint8)
for _i in range(256):
    _c = chr(_i)
    _CLASSES[_i] = 1 if _c.isalpha() and _i < 128 and _c.islower() else 2 if _i < 128 and _c.isupper() else 3 if _c.isdigit() and _i < 128 else 4 if _c == " " else 5 if _c in "\n\r\t\x0b\x0c" else 6 if _i >= 128 else 7 + "!.,|#$%&*'\"-".find(_c) + 1
_SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def term_counts(texts: list[bytes]) -> np.ndarray:
    """A row of damped term counts for each text."""
    out = np.zeros((len(texts), TERMS), np.float32)
    words, counts = word_hashes(texts)
    at = 0
    for i, (data, n) in enumerate(zip(texts, counts.tolist(), strict=True)):
        own = words[at : at + n]
        at += n
        c = _CLASSES[np.frombuffer(b" " + data + b" ", np.uint8)].astype(np.uint32)
        if len(c) >= 4:
            code = c[:-3] | c[1:-2] << 5 | c[2:-1] << 10 | c[3:] << 15
            grams = np.bincount((code * np.uint32(2654435761)) >> np.uint32(22), minlength=GRAMS)
            out[i, :GRAMS] = np.sqrt(grams / len(c)) * 4
        if n > 1:
            again = (own[1:] == own[:-1]).mean()
            fresh = len(np.unique(own)) / n
            out[i, GRAMS + min(7, int(again * 8))] = 1.5
            out[i, GRAMS + 8 + min(7, int(fresh * 8))] = 0.5
        out[i, GRAMS + 16 + min(11, int(np.log2(n + 1)))] = 0.3
    return out


class Space:
    """A latent semantic space with labelled unit vectors."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS, seed: int = 0):
        self.labels = labels.astype(np.float32)
        seen = (counts > 0).sum(0)
        self.idf = np.log((1 + len(counts)) / (1 + seen)).astype(np.float32) + 1
        x = counts * self.idf
        k = min(dimensions, *x.shape)
        q = np.random.default_rng(seed).standard_normal((x.shape[1], k + 8)).astype(np.float32)
        for _ in range(5):  # subspace iteration for the leading right singular vectors
            q, _ = np.linalg.qr(x.T @ (x @ q))
        _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
        self.basis = (q @ vt.T)[:, :k]
        self.vectors = self.place(counts)

    def place(self, counts: np.ndarray) -> np.ndarray:
        v = (counts * self.idf) @ self.basis
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def score(self, counts: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        """The voters' weighted mean label for each row of counts; cosines with all voters, in blocks."""
        out = np.empty(len(counts))
        k = min(neighbours, len(self.labels))
        for at in range(0, len(counts), BLOCK):
            cosine = self.place(counts[at : at + BLOCK]) @ self.vectors.T
            least = np.partition(cosine, -k, axis=1)[:, -k, None] - TIE
            row, voter = np.nonzero(cosine >= least)  # all that tie with the last neighbour vote
            weight = np.maximum(cosine[row, voter].astype(np.float64), 1e-3) ** SHARPNESS
            n = len(cosine)
            out[at : at + BLOCK] = np.bincount(row, weight * self.labels[voter], n) / np.bincount(row, weight, n)
        return out


def _sample_terms(batches):
    for batch in common.sliced(batches):
        rows = term_counts(common.bytes_of(batch.column(1))).astype(np.float16)
        yield pa.RecordBatch.from_arrays([batch.column(2), pa.array([r.tobytes() for r in rows], pa.binary())], names=["label", "terms"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE_ROWS) -> Space | None:
    """The space of at most ``most`` labelled rows that are not held out; their term counts are what the driver gets."""
    rows = labelled.sample(docs, labels, label, most).select("doc_id", "text", "label").mapInArrow(_sample_terms, "label int, terms binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (bytes(r.terms), r.label))
    return Space(np.stack([np.frombuffer(r.terms, np.float16) for r in rows]).astype(np.float32), np.array([r.label > 0 for r in rows]))


def _score_rows(shared):
    def run(batches):
        space = shared.value
        for batch in common.sliced(batches):
            score = np.full(batch.num_rows, 0.5) if space is None else np.round(space.score(term_counts(common.bytes_of(batch.column(1)))), 6)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(np.clip(score, 0, 1))], schema=_SCORES)

    return run


def scores(docs: DataFrame, space: Space | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row. No shuffle; at most SAMPLE_ROWS vectors are broadcast."""
    return common.id_and_text(docs, id_col, text_col).mapInArrow(_score_rows(docs.sparkSession.sparkContext.broadcast(space)), "doc_id long, score double")


def kept(docs: DataFrame, space: Space | None, text_col: str = "text", least: float = KEEP) -> DataFrame:
    """The rows of docs whose score is ``least`` or more, with all columns."""
    shared, at = docs.sparkSession.sparkContext.broadcast(space), docs.columns.index(text_col)

    def run(batches):
        for batch in common.sliced(batches, at):
            yield batch if shared.value is None else batch.filter(pa.array(shared.value.score(term_counts(common.bytes_of(batch.column(at)))) >= least))

    return docs.mapInArrow(run, docs.schema)


def op7_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    scored = scores(docs, fit(docs, common.table(spark, sf_dir, "labels")))
    return scored.select("doc_id", labelled.held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= KEEP, 1).otherwise(0).alias("predicted"))
