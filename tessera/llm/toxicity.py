"""Toxicity by multiple-instance learning.

A text is a bag of sentences. Each sentence has a logistic score over its words; the text's score is
the noisy-or of its sentences. Only the texts' labels are learned from (log likelihood of the
noisy-or, Adam, weight decay), then the sentences' own scores tell where the offence is.

Sentences end at line breaks and at words that end in `.`, `!` or `?` and what is no letter or digit after
these. Words are lower-case letter runs; their starts are features, too, as offence may sit in the stem.
Null and empty texts are one empty sentence, scored by the bias. Without labels of both classes every
score is 0. The sentences of 0.5 or more are given as start:end in code points, end exclusive, in order.
Repeated rows of an id share its label, of several labels the larger; each row gets its own score.
"""

from __future__ import annotations

from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Generations, crc_mod, slices, table, texts_of
from tessera.session import ship

LETTERS = regex.compile(r"\p{L}+")
ENDS = regex.compile(r"[.!?][^\p{L}\p{N}]*$")
CHUNKS = regex.compile(r"\n|[^\s\x1c-\x1f\x85]+")
#: Parameters of the fit: about so many labelled texts of each class and characters of a text, as the driver holds
#: them; texts that a feature needs, steps, least z of a feature's association with label 1, weight decay.
DOCS_PER_CLASS, MOST_CHARS, MIN_DOCS, STEPS, LEAST_Z, DECAY = 1_500, 40_000, 5, 300, 4.0, 1e-4


@dataclass
class Model:
    weights: dict[str, float]  # of words, and of word starts followed by a hyphen
    bias: float


def features(word: str) -> list[str]:
    """A word, and its starts of four to eight letters."""
    return [word, *(f"{word[:k]}-" for k in range(4, min(9, len(word))))]


class Weigher:
    """Weights of space-separated chunks, kept by chunk, with a mark where a sentence ends."""

    def __init__(self, model: Model, cache: int = 250_000):
        self.model, self.cache = model, Generations(cache)

    def learn(self, chunks: set[str]) -> None:
        get = self.model.weights.get
        for c in self.cache.missing(chunks):
            weight = sum(get(f, 0.0) for w in LETTERS.findall(c) for f in features(w))
            self.cache.young[c] = complex(weight, ENDS.search(c) is not None)

    def score(self, texts: list[str]) -> list[tuple[float, int]]:
        """Noisy-or, and number of sentences at 0.5 or more, of each text."""
        split = [t.lower().replace("\n", " . ").split() for t in texts]
        self.learn({c for s in split for c in s})
        known, out = self.cache.young.__getitem__, []
        for s in split:
            got = np.fromiter(map(known, s), complex, len(s))
            ends = got.imag.astype(np.int64)
            sentence = np.cumsum(ends) - ends
            z = self.model.bias + np.bincount(sentence, got.real, int(sentence[-1]) + 1 if len(s) else 1)
            out.append((float(-np.expm1(-np.logaddexp(0, z).sum())), int((z >= 0).sum())))
        return out


def fit_texts(texts: list[str], labels: list[int], min_docs: int = MIN_DOCS, steps: int = STEPS) -> Model | None:
    """Screen features by their association with the labels, then fit the noisy-or on those left."""
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return None
    found: dict[str, list[int]] = {}
    for t, label in zip(texts, labels, strict=True):
        for f in {f for w in set(LETTERS.findall(t.lower())) for f in features(w)}:
            found.setdefault(f, [0, 0])[label] += 1
    pos, neg = y.sum(), len(y) - y.sum()
    kept = []
    for f, (n0, n1) in found.items():
        if n0 + n1 >= min_docs:
            p = (n0 + n1) / (pos + neg)
            if (n1 / pos - n0 / neg) >= LEAST_Z * np.sqrt(p * (1 - p) * (1 / pos + 1 / neg)):
                kept.append(f)
    place = {f: k for k, f in enumerate(sorted(kept))}
    feature, where, doc, total = [], [], [], 0
    for d, t in enumerate(texts):
        for sentence in sentences(t):
            for w in LETTERS.findall(sentence):
                for f in features(w):
                    if (k := place.get(f)) is not None:
                        feature.append(k)
                        where.append(total)
            doc.append(d)
            total += 1
    feature, where, doc = np.array(feature, np.int64), np.array(where, np.int64), np.array(doc, np.int64)
    w, b = np.zeros(len(place)), -5.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    even = np.where(y == 1, 0.5 / pos, 0.5 / neg)  # either class weighs a half
    for step in range(1, steps + 1):
        z = b + np.bincount(where, w[feature], total)
        p = 1 / (1 + np.exp(-z))
        any_ = np.clip(-np.expm1(np.bincount(doc, -np.logaddexp(0, z), len(y))), 1e-9, 1)
        # d loss / d z of a sentence: p for a clean text, -p * (1 - P) / P for a toxic one
        g = even[doc] * p * np.where(y[doc] == 1, -(1 - any_[doc]) / any_[doc], 1)
        grad = np.append(np.bincount(feature, g[where], len(w)) + DECAY * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return Model({f: float(w[k]) for f, k in place.items() if w[k]}, float(b))


def places(text: str) -> list[tuple[int, int]]:
    """Start and end of each sentence, as the weigher parts them; at least one. A line break that follows
    an end is a sentence of its own."""
    out, start, end = [], None, 0
    for m in CHUNKS.finditer(text):
        start, end = m.start() if start is None else start, m.end()
        if m[0] == "\n" or ENDS.search(m[0].lower()):
            out.append((start, end))
            start = None
    return out + [(start, end)] if start is not None else out or [(0, 0)]


def sentences(text: str) -> list[str]:
    """The sentences of a text in lower case."""
    return [text[a:b].lower() for a, b in places(text)]


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model | None:
    """Fit on the rows given, a bounded sample; texts of over MOST_CHARS characters are left out of the fit."""
    short = F.coalesce(F.length(text_col), F.lit(0)) <= MOST_CHARS
    texts = labelled.filter(F.col(label_col).isin(0, 1) & short).select(F.coalesce(text_col, F.lit("")).alias("text"), F.col(label_col).alias("label"), id_col).orderBy(id_col).toPandas()
    return fit_texts(texts["text"].tolist(), texts["label"].astype(int).tolist())


def sampled(labels: DataFrame, id_col: str, label_col: str, docs_per_class: int) -> DataFrame:
    """Ids and labels of about docs_per_class rows of each class; one label for each id, the larger."""
    one = labels.filter(F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).alias(label_col))
    sizes = {r[0]: r[1] for r in one.groupBy(label_col).count().collect()}
    place = F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col)), F.lit(1_000_000)) / 1_000_000
    share = F.when(F.col(label_col) == 1, min(1.0, docs_per_class / max(1, sizes.get(1, 0)))).otherwise(min(1.0, docs_per_class / max(1, sizes.get(0, 0))))
    return one.filter(place < share)


_WEIGHERS: dict[str, Weigher] = {}


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, kept columns, score, predicted, n_toxic_sentences and toxic_spans for every whole text."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names, key = [id_col, *keep], uuid4().hex

    def run(batches):
        if shared.value and key not in _WEIGHERS:
            _WEIGHERS.clear()
            _WEIGHERS[key] = Weigher(shared.value)
        for batch in batches:
            for part in slices(batch, most_bytes=2 << 20):
                texts = texts_of(part)
                got = _WEIGHERS[key].score(texts) if shared.value else [(0.0, 0)] * part.num_rows
                spans = [",".join(f"{a}:{b}" for a, b, _ in locate(t, shared.value)) if n else "" for t, (_, n) in zip(texts, got, strict=True)]
                cols = [part.column(0), *(part.column(k) for k in range(2, part.num_columns)), pa.array([s for s, _ in got], pa.float64()), pa.array([int(s >= 0.5) for s, _ in got], pa.int32()), pa.array([n for _, n in got], pa.int64()), pa.array(spans, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=[*names, "score", "predicted", "n_toxic_sentences", "toxic_spans"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.select(id_col, text_col, *keep).mapInArrow(run, f"{schema}, score double, predicted int, n_toxic_sentences bigint, toxic_spans string")


def locate(text: str, model: Model) -> list[tuple[int, int, float]]:
    """Start, end and score of each sentence of a text that scores 0.5 or more."""
    out = []
    for a, b in places(text or ""):
        z = model.bias + sum(model.weights.get(f, 0.0) for w in LETTERS.findall(text[a:b].lower()) for f in features(w)) if text else model.bias
        if z >= 0:
            out.append((a, b, float(1 / (1 + np.exp(-z)))))
    return out


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document; learn from labels of those whose id is not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (crc_mod() == 0).alias("held_out"))
    labels = sampled(table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(crc_mod() != 0), "doc_id", "toxic", DOCS_PER_CLASS)
    chosen = docs.join(F.broadcast(labels), "doc_id")  # the sample's size is bounded
    return score(docs, fit(chosen), keep=("held_out",)).select("doc_id", "held_out", "score", "predicted", "n_toxic_sentences", "toxic_spans")
