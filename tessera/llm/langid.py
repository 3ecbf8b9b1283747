"""Language identification by segmentation-marginalised unigrams.

The pieces are all letter pieces of a fixed public vocabulary. Each language has a probability for
each piece, fitted by expectation maximisation on the counts of all words of a bounded sample of
labelled documents. The likelihood of a word is the sum over all its segmentations into pieces
(forward algorithm), that of a text the product over its words. Words are runs of letters of any
length in lower case, led by the vocabulary's word mark. A letter without a piece has probability FLOOR.

Null texts and texts without a letter are `und` with score 0, as are all texts if nothing was
learned. Ties go to the language that sorts first. Repeated rows are each told by their own text.
"""

from __future__ import annotations

from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import crc_mod, slices, table, texts_of
from tessera.session import ship

MARK = "▁"
LETTERS = regex.compile(r"\p{L}+")
#: Parameters of the fit: about so many documents a language, EM rounds.
DOCS_PER_LANGUAGE, ROUNDS = 300, 2
FLOOR = 1e-7
#: Words of one length are taken together in lattices of at most so many letters; longer words go by one.
TOGETHER, LONG = 400_000, 40


@dataclass
class Model:
    langs: list[str]
    pieces: dict[str, int]
    probs: np.ndarray  # pieces + 2 rows (unknown letter, no piece), one column a language


def public_pieces(path: str) -> list[str]:
    """Lower-case pieces of letters of a sentencepiece vocabulary, with or without the word mark."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    found = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    return [p for p in found if p == p.lower() and (p == MARK or p.removeprefix(MARK).isalpha())]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Places:
    """Rows of pieces by a rolling hash of their letters, in open tables of one array lookup."""

    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, pieces: dict[str, int]):
        self.none = len(pieces) + 1
        self.longest = max(map(len, pieces), default=1)
        keys = np.array([self.hashed(p) for p in pieces], np.uint64)
        assert len(set(keys.tolist())) == len(keys)
        self.shift = np.uint64(64 - max(8, (8 * max(1, len(keys))).bit_length()))
        slots = 1 << (64 - int(self.shift))
        self.keys = np.zeros(slots, np.uint64)
        self.rows = np.full(slots, self.none, np.int32)
        self.more: dict[int, int] = {}  # pieces whose slot is taken
        for k, row in zip(keys, pieces.values(), strict=True):
            at = int(k >> self.shift)
            if self.rows[at] == self.none:
                self.keys[at], self.rows[at] = k, row
            else:
                self.more[int(k)] = row
        self.rest = np.array(sorted(self.more), np.uint64)
        self.rest_rows = np.array([self.more[int(k)] for k in self.rest], np.int32)

    @classmethod
    def hashed(cls, piece: str) -> int:
        h = 0
        for c in piece:
            h = ((h + ord(c) + 1) * int(cls.BASE)) & (2**64 - 1)
        return h

    def find(self, h: np.ndarray) -> np.ndarray:
        at = (h >> self.shift).astype(np.int64)
        out = np.where(self.keys[at] == h, self.rows[at], self.none)
        if len(self.rest):
            k = np.minimum(np.searchsorted(self.rest, h), len(self.rest) - 1)
            out = np.where(self.rest[k] == h, self.rest_rows[k], out)
        return out


def grid_of(codes: np.ndarray, places: Places) -> np.ndarray:
    """For each word, start and piece length the row of the piece; codes are words x letters."""
    words, n = codes.shape
    grid = np.full((words, n, min(places.longest, n)), places.none, np.int32)
    h = np.zeros((words, n), np.uint64)
    for m in range(1, grid.shape[2] + 1):
        h = (h[:, : n - m + 1] + codes[:, m - 1 :]) * Places.BASE
        grid[:, : n - m + 1, m - 1] = places.find(h)
    grid[:, :, 0][grid[:, :, 0] == places.none] = places.none - 1
    return grid


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)


def lattice(words: list[str], places: Places):
    """(places of the words, their grid), words of one length together."""
    by: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        by.setdefault(len(w) + 1, []).append(k)
    for n, ks in by.items():
        most = max(1, TOGETHER // n)
        for first in range(0, len(ks), most):
            some = ks[first : first + most]
            yield np.array(some), grid_of(codes_of("".join(MARK + words[k] for k in some)).reshape(len(some), n), places)


def edges_at(grid: np.ndarray, i: int, none: int):
    """(word, piece length, row) of the pieces that start at place i."""
    w, m = np.nonzero(grid[:, i] != none)
    return w, m + 1, grid[w, i, m]


def forward(grid: np.ndarray, probs: np.ndarray) -> np.ndarray:
    """Sums over the segmentations of each prefix: words x (length + 1) x languages."""
    words, n, _ = grid.shape
    alpha = np.zeros((words, n + 1, probs.shape[1]))
    alpha[:, 0] = 1
    for i in range(n):
        w, m, rows = edges_at(grid, i, len(probs) - 1)
        alpha[w, i + m] += alpha[w, i] * probs[rows]  # of one start, no two pieces end at one place
    return alpha


def log_sum(word: str, probs: np.ndarray, places: Places) -> np.ndarray:
    """Log of the sum over all segmentations of a long word, by language, scaled at each letter."""
    codes, deep = codes_of(MARK + word), places.longest
    ahead = np.zeros((deep + 1, probs.shape[1]))  # sums of the prefixes that end at this and the next places
    ahead[0] = 1
    total = np.zeros(probs.shape[1])
    for first in range(0, len(codes), TOGETHER):
        some = codes[first : first + TOGETHER + deep - 1]
        for row in grid_of(some[None], places)[0][:TOGETHER]:
            m = np.flatnonzero(row != len(probs) - 1)
            ahead[m + 1] += ahead[0] * probs[row[m]]
            scale = np.maximum(ahead[1], 1e-300)
            total += np.log(scale)
            ahead[:-1] = ahead[1:] / scale
            ahead[-1] = 0
    return total


def log_likelihoods(words: list[str], probs: np.ndarray, places: Places) -> np.ndarray:
    """Words x languages."""
    out = np.zeros((len(words), probs.shape[1]))
    short = [k for k, w in enumerate(words) if len(w) <= LONG]
    for ks, grid in lattice([words[k] for k in short], places):
        out[np.array(short)[ks]] = np.log(np.maximum(forward(grid, probs)[:, -1], 1e-300))
    for k, w in enumerate(words):
        if len(w) > LONG:
            out[k] = log_sum(w, probs, places)
    return out


def fit_counts(langs: list[str], counts: dict[str, dict[str, int]], vocabulary: list[str]) -> Model:
    """EM over words with their counts in each language. Words of over LONG letters are scored, not fitted."""
    words = sorted({w for c in counts.values() for w in c if len(w) <= LONG})
    weight = np.array([[counts.get(g, {}).get(w, 0) for g in langs] for w in words], float).reshape(len(words), len(langs))
    pieces = {p: k for k, p in enumerate(sorted(set(vocabulary)))}
    places = Places(pieces)
    rows = len(pieces) + 2
    probs = np.full((rows, len(langs)), 1 / max(1, len(pieces)))
    for _ in range(ROUNDS):
        probs[-2], probs[-1] = FLOOR, 0
        hits = np.full((rows, len(langs)), 0.1)
        for ks, grid in lattice(words, places):
            n = grid.shape[1]
            alpha = forward(grid, probs)
            beta = np.zeros_like(alpha)
            beta[:, n] = 1
            scale = weight[ks] / np.maximum(alpha[:, n], 1e-300)
            for i in range(n - 1, -1, -1):
                w, m, rowids = edges_at(grid, i, rows - 1)
                part = beta[w, i + m] * probs[rowids]
                for g in range(len(langs)):
                    beta[:, i, g] = np.bincount(w, part[:, g], len(ks))
                    hits[:, g] += np.bincount(rowids, alpha[w, i, g] * part[:, g] * scale[w, g], rows)
        hits[-2:] = 0
        probs = hits / hits.sum(0, keepdims=True)
    probs[-2], probs[-1] = FLOOR, 0
    return Model(langs, pieces, probs)


def fit(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_language: int = DOCS_PER_LANGUAGE) -> Model:
    """Fit on labelled rows: about docs_per_language of each, those with the smallest hash of the id.

    Only the word counts of this sample reach the driver.
    """
    spark = docs.sparkSession
    ship(spark)
    labelled = docs.filter(F.col(lang_col).isNotNull())
    sizes = {r[0]: r[1] for r in labelled.groupBy(lang_col).count().collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], {}, np.zeros((2, 0)))
    share = F.create_map(*[F.lit(x) for g in langs for x in (g, min(1.0, docs_per_language / sizes[g]))])
    place = F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col)), F.lit(1_000_000)) / 1_000_000
    sample = labelled.filter(place < share[F.col(lang_col)]).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def count(batches):
        for batch in batches:
            tally: dict[tuple[str, str], int] = {}
            for g, t in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
                for w in LETTERS.findall(t.lower()):
                    tally[g, w] = tally.get((g, w), 0) + 1
            keys = list(tally)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(tally.values()), pa.int64())], names=["lang", "word", "n"])

    summed = sample.mapInArrow(count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts: dict[str, dict[str, int]] = {}
    for r in summed.filter(F.length("word") <= LONG).toLocalIterator():
        counts.setdefault(r["lang"], {})[r["word"]] = r["n"]
    return fit_counts(langs, counts, public_pieces(vocabulary))


class Scorer:
    """Log likelihoods of space-separated chunks, kept by chunk."""

    def __init__(self, model: Model, cache: int = 300_000):
        self.model, self.lookup = model, Places(model.pieces)
        self.places: dict[str, int] = {}
        self.rows = np.zeros((cache, len(model.langs) + 1))  # the last column: letters

    def learn(self, chunks: set[str]) -> None:
        new = [c for c in chunks if c not in self.places]
        if len(self.places) + len(new) > len(self.rows):
            self.places, new = {}, list(chunks)
            if len(new) > len(self.rows):
                self.rows = np.zeros((len(new), self.rows.shape[1]))
        runs = [LETTERS.findall(c) for c in new]
        at: dict[str, int] = {}
        flat = np.array([at.setdefault(w, len(at)) for r in runs for w in r], np.int64)
        words = list(at)
        logs = np.zeros((len(words), len(self.model.langs) + 1))
        logs[:, -1] = np.fromiter(map(len, words), float, len(words))
        logs[:, :-1] = log_likelihoods(words, self.model.probs, self.lookup)
        first = len(self.places)
        self.places.update(zip(new, range(first, first + len(new)), strict=True))
        block = np.zeros((len(new), logs.shape[1]))
        np.add.at(block, np.repeat(np.arange(len(new)), np.fromiter(map(len, runs), np.int64, len(runs))), logs[flat])
        self.rows[first : first + len(new)] = block

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        split = [t.lower().split() for t in texts]
        self.learn({c for s in split for c in s})
        preds, scores = [], []
        for s in split:
            total = self.rows[np.fromiter(map(self.places.__getitem__, s), np.int64, len(s))].sum(0)
            if not total[-1] or not self.model.langs:
                preds.append("und")
                scores.append(0.0)
                continue
            logs = total[:-1] / max(1.0, len(s)) ** 0.5  # words of one text are not independent
            best = int(logs.argmax())
            preds.append(self.model.langs[best])
            scores.append(float(1 / np.exp(logs - logs[best]).sum()))
        return preds, scores


_SCORERS: dict[str, Scorer] = {}


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), with_text: bool = False, out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """id, the text if asked for, the kept columns, lang_pred and score (or the names in out), for every whole text."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # its size is bounded by vocabulary and languages
    names, key = [id_col, *([text_col] if with_text else []), *keep], uuid4().hex

    def run(batches):
        if key not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[key] = Scorer(shared.value)
        for batch in batches:
            for part in slices(batch, most_bytes=2 << 20):
                preds, scores = _SCORERS[key].predict(texts_of(part))
                cols = [part.column(0), *(part.column(k) for k in range(1 if with_text else 2, part.num_columns)), pa.array(preds, pa.string()), pa.array(scores, pa.float64())]
                yield pa.RecordBatch.from_arrays(cols, names=[*names, *out])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.select(id_col, text_col, *keep).mapInArrow(run, f"{schema}, `{out[0]}` string, `{out[1]}` double")


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predict the language of every document; learn from those whose id is not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (crc_mod() == 0).alias("held_out"))
    model = fit(docs.filter(~F.col("held_out")), default_vocabulary())
    return predict(docs, model, keep=("held_out",)).select("doc_id", "held_out", "lang_pred", "score")
