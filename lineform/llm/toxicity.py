"""Toxicity by misspelling-tolerant lexicon matches and context windows.

The lexicon is a trie of whole words and word beginnings, learned from labelled rows beside a short given list.
A Levenshtein automaton of one edit is intersected with the trie; the product automaton is made deterministic
step by step, as words are read, and kept. A word's hit is a term and how it was reached: exact, or one letter
substituted, inserted, dropped, or replaced by a sign, at any place of a term or beginning of EDITED letters or
more. A window of words around each hit tells quotation (quotation marks, words of reporting) from abuse (second
person, exclamation). A logistic model weighs hits, contexts and their density; an edit of a term that the
labelled rows don't have weighs a share of what the term weighs, or of what its kind of edit weighs.

Defined cases: a null or empty text has no hits and gets the score of such texts; without labelled rows of both
kinds the given list and fixed weights are used; repeated rows are scored alike, whatever their ids; texts of any
length are matched whole; of several terms that match a word the one of the best kind counts, then the first by
letters; other columns are not read. MOST_TERMS bounds the learned lexicon, a model parameter like SAMPLE_ROWS.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineform.llm import common, labelled

#: Labelled rows that the lexicon and the weights are fitted on, at most.
SAMPLE_ROWS = 12_000
#: Learned terms, at most: those of the highest log odds.
MOST_TERMS = 400
#: Rows of counts in a batch.
PART_ROWS = 50_000
#: Toxic and clean rows that a part's odds start from.
ODDS_PRIOR = (0.5, 4.5)
#: Letters from which a term may be reached by an edit.
EDITED = 4
#: Share of a term's (or else of its kind's) log odds that an edit weighs that no labelled row has.
UNSEEN_SHARE = 0.5
WINDOW = 6
GIVEN = ("idiot", "moron", "stupid", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "clown", "imbecile", "vermin", "bastard", "pig", "dumb")
SIGNS = frozenset("0134578@$!*|€")
KINDS = ("exact", "substituted", "inserted", "dropped", "sign")
REPORTING = frozenset("said says quote quoted quotes wrote writes called word words term reported disait dit sagte schrieb dijo escribió".split())
ADDRESS = frozenset("you your yours you're ur du dein dich ihr toi ton vous tu tus usted".split())
QUOTES = "\"'“”„«»‘’"
PUNCTUATION = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum()) + "“”„«»‘’¿¡…–—"
NO_SIGNS = "".join(c for c in PUNCTUATION if c not in SIGNS)
N_FEATURES = 12

SCORES = "doc_id long, score double, hits array<struct<term:string,kind:string,word:int,quoted:boolean>>"
_HIT = pa.struct([("term", pa.string()), ("kind", pa.string()), ("word", pa.int32()), ("quoted", pa.bool_())])
_ARROW = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("hits", pa.list_(_HIT))])


class Lexicon:
    """A trie of terms with the Levenshtein automaton of one edit; a term that ends in * is a word's beginning."""

    def __init__(self, terms: list[str]):
        self.terms = sorted(set(terms))
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[str | None] = [None]
        self.opens: list[str | None] = [None]
        for t in self.terms:
            at = 0
            for c in t.rstrip("*"):
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                    self.opens.append(None)
                at = self.children[at][c]
            if t.endswith("*"):
                self.opens[at] = t
            else:
                self.ends[at] = t
        # a state of the product is a set of (node, how it was reached, what has matched already)
        self.states: list[tuple] = [frozenset(self._close({(0, None, None)}))]
        self.number = {self.states[0]: 0}
        self.moves: list[dict[str, int]] = [{}]
        self.found: list[tuple | None] = [None]
        self.seen: dict[str, tuple | None] = {}

    def _close(self, states: set) -> set:
        """Adds what dropping one of the term's letters reaches."""
        more = {(k, "dropped", m) for n, how, m in states if how is None and m is None for k in self.children[n].values()}
        return states | more

    def _step(self, state: frozenset, c: str) -> frozenset:
        out = set()
        for n, how, m in state:
            if m is not None:  # a beginning has matched: the rest of the word is free
                out.add((n, how, m))
                continue
            k = self.children[n].get(c)
            if k is not None:
                out.add((k, how, None))
            if how is None:
                other = "sign" if c in SIGNS else "substituted"
                out.update((x, other, None) for y, x in self.children[n].items() if y != c)
                out.add((n, "inserted", None))
        out = self._close(out)
        opened = {(n, how, self.opens[n]) for n, how, m in out if m is None and self.opens[n] is not None and (how is None or len(self.opens[n]) > EDITED)}
        return frozenset(out | opened)

    def _result(self, state: frozenset) -> tuple | None:
        """The best match of a word that ends here: an exact one before an edited one, a whole word before a beginning."""
        after = 2 + len(KINDS)
        own = []
        for n, how, m in state:
            if m is not None:
                own.append((1 if how is None else after + KINDS.index(how), m, how or "exact"))
            elif self.ends[n] is not None and (how is None or len(self.ends[n]) >= EDITED):
                own.append((0 if how is None else 2 + KINDS.index(how), self.ends[n], how or "exact"))
        return min(own)[1:] if own else None

    def match(self, word: str) -> tuple | None:
        """(term, kind) of a word, or None."""
        state = 0
        for c in word:
            to = self.moves[state].get(c)
            if to is None:
                new = self._step(self.states[state], c)
                to = self.number.get(new)
                if to is None:
                    to = self.number[new] = len(self.states)
                    self.states.append(new)
                    self.moves.append({})
                    self.found.append(self._result(new))
                self.moves[state][c] = to
            state = to
            if not self.states[state]:
                return None
        return self.found[state]

    def __getstate__(self):
        return {"terms": self.terms}

    def __setstate__(self, state):
        self.__init__(state["terms"])

    def lookup(self, words: list[str]) -> list[tuple | None]:
        seen = self.seen
        if len(seen) > 400_000:
            seen.clear()
        missing = set(words).difference(seen)
        for w in missing:
            seen[w] = self.match(w)
        return [seen[w] for w in words]


def plain(words: list[str]) -> list[str]:
    return [w.strip(PUNCTUATION) for w in words]


def match_of(word: str, lexicon: Lexicon) -> tuple | None:
    """A word's match without its punctuation, or with the signs at its edges where one of them stands for a letter."""
    bare = word.strip(PUNCTUATION)
    if not bare:
        return None
    found = lexicon.match(bare)
    kept = word.strip(NO_SIGNS)
    if kept == bare or (found is not None and found[1] == "exact"):
        return found
    signed = [lexicon.match(w) for w in (kept.rstrip(PUNCTUATION), kept.lstrip(PUNCTUATION), kept)]
    return next((m for m in signed if m is not None and m[1] == "sign"), found or next(filter(None, signed), None))


def hits_of(text: str, lexicon: Lexicon) -> tuple[int, list[tuple[str, str, int, bool, bool]]]:
    """Number of words, and the hits: term, kind, word position, quoted, addressed."""
    words = text.lower().split()
    seen = lexicon.seen
    new = {w for w in words if w not in seen}
    if new:
        if len(seen) > 600_000:
            seen.clear()
            new = set(words)
        for w in new:
            seen[w] = match_of(w, lexicon)
    found = []
    for i, m in enumerate(map(seen.__getitem__, words)):
        if m is not None:
            around = words[max(0, i - WINDOW) : i + WINDOW + 1]
            bare = set(plain(around))
            marks = words[i][0] in QUOTES or words[i][-1:] in QUOTES or (any(w[0] in QUOTES for w in words[max(0, i - WINDOW) : i + 1]) and any(w.rstrip(".,;:!?")[-1:] in QUOTES for w in words[i : i + WINDOW + 1]))
            found.append((*m, i, marks or bool(bare & REPORTING), bool(bare & ADDRESS) or any(w.endswith("!") for w in around)))
    return len(words), found


@dataclass
class Model:
    lexicon: Lexicon
    strength: dict[tuple[str, str], float]
    mean: np.ndarray = field(default_factory=lambda: np.zeros(N_FEATURES))
    scale: np.ndarray = field(default_factory=lambda: np.ones(N_FEATURES))
    weights: np.ndarray = field(default_factory=lambda: np.array([2.0, 1.0, 0.5, -1.0, 0.5, 0, 0, 0, 0, 0, 0, 0]))
    bias: float = -2.0
    by_term: dict[str, float] = field(default_factory=dict)
    by_kind: dict[str, float] = field(default_factory=dict)

    def weight(self, term: str, kind: str) -> float:
        """Log odds of a term and kind; of an edit without labelled rows a share of the term's or else of the kind's."""
        own = self.strength.get((term, kind))
        if own is not None:
            return own
        return 1.0 if kind == "exact" else UNSEEN_SHARE * self.by_term.get(term, self.by_kind.get(kind, 1.0))

    def features(self, text: str) -> tuple[np.ndarray, list]:
        n, found = hits_of(text, self.lexicon)
        x = np.zeros(N_FEATURES)
        if found:
            each = [self.weight(t, k) for t, k, *_ in found]
            abuse = [s for s, (_, _, _, quoted, _) in zip(each, found, strict=True) if not quoted]
            x[0] = max(each)
            x[1] = np.log1p(max(0.0, sum(abuse)))
            x[2] = np.log1p(len({t for t, *_ in found}))
            x[3] = sum(q for *_, q, _ in found) / len(found)
            x[4] = sum(a for *_, a in found) / len(found)
            x[5] = np.log1p(100 * max(0.0, sum(each)) / max(n, 1))
            x[6] = max(abuse, default=0.0)
            for i, kind in enumerate(KINDS):
                x[7 + i] = max([0.0, *(s for s, (_, k, *_) in zip(each, found, strict=True) if k == kind)])
        return x, found

    def score(self, text: str) -> tuple[float, list]:
        x, found = self.features(text)
        return float(1 / (1 + np.exp(-(self.bias + ((x - self.mean) / self.scale) @ self.weights)))), found


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 1e-2) -> tuple[np.ndarray, float]:
    """Weights and bias by Newton's method with a ridge."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        penalty = ridge * np.append(np.ones(len(w) - 1), 0)
        g = a.T @ (p - y) / len(y) + penalty * w
        h = (a * (p * (1 - p))[:, None]).T @ a / len(y) + np.diag(penalty + 1e-9)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def _parts(text: str) -> set[str]:
    """Words of a text, and beginnings of words, marked by *."""
    out = set()
    for w in set(plain(text.lower().split())):
        if 3 <= len(w) <= 24:
            out.add(w)
            out.update(w[:n] + "*" for n in range(4, min(len(w), 10)))
    return out


def _count_parts(batches):
    toxic, all_docs = Counter(), Counter()
    for batch in common.sliced(batches):
        for text, label in zip(common.texts_of(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            own = _parts(text)
            all_docs.update(own)
            if label:
                toxic.update(own)
    # all clean counts are sent, whatever the partition: a part may be toxic in another task; the sample is bounded
    rows = iter(all_docs.items())
    while own := list(islice(rows, PART_ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in own], pa.string()), pa.array([toxic[p] for p, _ in own], pa.int64()), pa.array([n for _, n in own], pa.int64())], names=["part", "n_toxic", "n_docs"])


def learn_terms(rows: DataFrame, support: int = 5, purity: float = 0.6, most_parts: int = 20 * MOST_TERMS) -> list[str]:
    """Words and beginnings of words that toxic rows have and others hardly do, the MOST_TERMS of the highest log odds."""
    counted = rows.select("doc_id", "text", "label").mapInArrow(_count_parts, "part string, n_toxic long, n_docs long").groupBy("part").agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n_docs").alias("n_docs"))
    telling = counted.where((F.col("n_toxic") >= support) & (F.col("n_toxic") >= purity * F.col("n_docs")))
    odds = F.log((F.col("n_toxic") + ODDS_PRIOR[0]) / (F.col("n_docs") - F.col("n_toxic") + ODDS_PRIOR[1]))
    ranked = telling.withColumn("odds", odds).orderBy(F.col("odds").desc(), F.length("part"), "part").limit(most_parts).collect()
    terms: list[tuple[float, str]] = []
    heads: set[str] = set()
    for r in sorted(ranked, key=lambda r: (len(r.part.rstrip("*")), not r.part.endswith("*"), r.part)):
        bare = r.part.rstrip("*")
        above = next((bare[:n] for n in range(4, len(bare) + 1) if bare[:n] in heads), None)
        if above is not None:
            continue
        if r.part.endswith("*"):
            heads.add(bare)
        terms.append((r.odds, r.part))
    return [t for _, t in sorted(terms, key=lambda x: (-x[0], x[1]))[:MOST_TERMS]]


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = SAMPLE_ROWS) -> Model:
    """Fits the lexicon and the weights on at most ``most`` labelled rows that are not held out."""
    rows = labelled.sample(docs, labels, label, most)
    lexicon = Lexicon([*GIVEN, *learn_terms(rows)])
    hits = rows.select("doc_id", "text", "label").mapInArrow(_hit_rows(lexicon), "label int, hits array<string>").collect()  # at most ``most`` rows of a few terms
    y = np.array([r.label > 0 for r in hits], float)
    if not 0 < y.sum() < len(y):
        return Model(lexicon, {})
    toxic, seen = Counter(), Counter()
    for r in hits:
        pairs = [tuple(k.split("\t")) for k in r.hits]
        own = {*pairs, *((t, None) for t, k in pairs if k == "exact"), *((None, k) for _, k in pairs)}
        seen.update(own)
        if r.label:
            toxic.update(own)
    rate = y.mean()
    odds = lambda k: np.log((toxic[k] + rate) / (seen[k] - toxic[k] + 1 - rate)) - np.log(rate / (1 - rate))
    known = {k: float(max(0.0, odds(k))) for k in seen}
    model = Model(lexicon, {k: v for k, v in known.items() if None not in k})
    model.by_term, model.by_kind = {t: v for (t, k), v in known.items() if k is None}, {k: v for (t, k), v in known.items() if t is None}
    got = rows.select("doc_id", "text", "label").mapInArrow(_feature_rows(model), "label int, x array<double>").collect()
    x, y = np.array([r.x for r in got]), np.array([r.label > 0 for r in got], float)
    model.mean, model.scale = x.mean(0), np.where(x.std(0) > 1e-6, x.std(0), 1.0)
    model.weights, model.bias = logistic((x - model.mean) / model.scale, y)
    return model


def _hit_rows(lexicon: Lexicon):
    def run(batches):
        for batch in common.sliced(batches):
            own = [sorted({f"{t}\t{k}" for t, k, *_ in hits_of(x, lexicon)[1]}) for x in common.texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(own, pa.list_(pa.string()))], names=["label", "hits"])

    return run


def _feature_rows(model: Model):
    def run(batches):
        for batch in common.sliced(batches):
            own = [model.features(x)[0].tolist() for x in common.texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(own, pa.list_(pa.float64()))], names=["label", "x"])

    return run


def _score_rows(shared):
    def run(batches):
        model = shared.value
        for batch in common.sliced(batches):
            scores, hits = [], []
            for text in common.texts_of(batch.column(1)):
                s, found = model.score(text)
                scores.append(s)
                hits.append([{"term": t, "kind": k, "word": i, "quoted": q} for t, k, i, q, _ in found])
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(scores, pa.float64()), pa.array(hits, pa.list_(_HIT))], schema=_ARROW)

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) and hits of every row. No shuffle; the model has at most MOST_TERMS learned terms."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return common.id_and_text(docs, id_col, text_col).mapInArrow(_score_rows(shared), SCORES)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, common.table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        labelled.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
        F.size("hits").cast("long").alias("n_terms"),
    )
