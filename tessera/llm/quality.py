"""Quality rules: counts of a text, and its divergence from language references.

A reference of a language holds two histograms, gathered over all documents of that language:
characters by class, and the share of each of its WORDS most frequent words (all other words
together are one more bin). A character over ASCII has the class of the block of scripts that the first
byte of its UTF-8 form tells. A text is compared with every reference by the Jensen-Shannon
distance (base 2) of each histogram, of which that of the classes has half a character added to each, and
is judged by the reference that is nearest. Texts shorter than MIN_CHARS characters or MIN_WORDS words are not judged by that
histogram: short texts are far from any reference by chance.

A text that holds none of a reference's words is at a distance that its share of them sets. Over
NONE of that distance, or over MAX_WORD_JSD, a text is far from the reference; it fails if it is far
from all. Words are not judged against languages of under LEAST words, nor are rows of such a language.

Null texts count as empty: all counts 0, base_failed, not kept. Ties and repeated rows are judged
each for itself. With no reference the divergence is null and only the base rules decide.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import bytes_of, slices, table
from tessera.session import ship

#: Words a reference, guards, largest distances of a kept text, and as a part of that of a text with no common word.
WORDS, MIN_CHARS, MIN_WORDS, MAX_CHAR_JSD, MAX_WORD_JSD, NONE = 40, 300, 60, 0.30, 0.46, 0.97
#: Words in all that a language needs for its words to be a reference.
LEAST = 1_000
SYMBOLS = b"#*$%&|<>"
#: First bytes of UTF-8 by blocks of scripts; what is not listed begins no character.
BLOCKS = {"latin": (0xC3, 0xC9), "sign": (0xC2, 0xC2), "mark": (0xCA, 0xCD), "greek": (0xCE, 0xCF), "cyrillic": (0xD0, 0xD4), "semitic": (0xD5, 0xDF), "indic": (0xE0, 0xE1), "general": (0xE2, 0xE2), "kana": (0xE3, 0xE3), "han": (0xE4, 0xE9), "hangul": (0xEA, 0xED), "private": (0xEE, 0xEF), "beyond": (0xF0, 0xF4)}
CLASSES = ("lower", "upper", "digit", "space", "line", "stop", "symbol", "other", *BLOCKS, "tail")


def class_table() -> np.ndarray:
    """The class of each first byte of a character; tail bytes of UTF-8 are a class that no histogram counts."""
    out = np.full(256, CLASSES.index("other"))
    for chars, name in ((b"abcdefghijklmnopqrstuvwxyz", "lower"), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "upper"), (b"0123456789", "digit"), (b" \t\v\f\r", "space"), (b"\n", "line"), (b".,", "stop"), (SYMBOLS, "symbol"), (range(0x80, 0xC0), "tail"), *((range(a, b + 1), name) for name, (a, b) in BLOCKS.items())):
        out[list(chars)] = CLASSES.index(name)
    return out


LUT = class_table()
COUNTED = len(CLASSES) - 1


def class_counts(text: bytes) -> np.ndarray:
    return np.bincount(LUT[np.frombuffer(text, np.uint8)], minlength=len(CLASSES))


def repeated(words: list[bytes], n: int = 5) -> int:
    """Words in n-word windows that the text holds twice or more."""
    windows = list(zip(*(words[k:] for k in range(n)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    count = Counter(windows)
    twice = np.fromiter((count[w] > 1 for w in windows), bool, len(windows))
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def limit(share: np.ndarray) -> float:
    """The largest distance that is not far: below that of a text with none of the words."""
    none = np.zeros(len(share))
    none[-1] = 1
    return min(MAX_WORD_JSD, NONE * float(jsd(none, share)))


@dataclass
class References:
    langs: list[str]
    chars: np.ndarray  # languages x classes, shares
    words: list[dict[bytes, int]]
    shares: list[np.ndarray]  # of each language's words, the last of all others
    limits: list[float | None]  # the largest word distance of each that is not far; none with under LEAST words


def jsd(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of rows of p from q."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0).sum(-1) + np.where(q > 0, q * np.log2(q / m), 0).sum(-1)
    return np.sqrt(np.maximum(d / 2, 0))


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> References:
    """Histograms of all documents with a language, summed on the executors.

    Only the class counts and the WORDS top words of each language reach the driver.
    """
    ship(docs.sparkSession)
    rows = docs.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def gather(batches):
        for batch in batches:
            for part in slices(batch):
                chars: dict[str, np.ndarray] = {}
                words: dict[str, Counter] = {}
                for g, t in zip(part.column(0).to_pylist(), bytes_of(part), strict=True):
                    chars[g] = chars.get(g, 0) + class_counts(t)
                    own = words.setdefault(g, Counter())
                    split = t.lower().split()
                    own[b""] += len(split)
                    own.update(split)
                out = [(g, f"\t{CLASSES[k]}", int(n)) for g, c in chars.items() for k, n in enumerate(c[:COUNTED])]
                out += [(g, w.decode(), n) for g, c in words.items() for w, n in c.items()]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "bin", "n"])

    summed = rows.mapInArrow(gather, "lang string, bin string, n bigint").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    kind = F.when(F.col("bin").startswith("\t"), 0).when(F.col("bin") == "", 0).otherwise(1)
    top = Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "bin")
    got: dict[str, dict[str, int]] = {}
    # of kind 0 there are fewer than WORDS, and a limit on the rank alone lets each task drop the rest before the sort
    for r in summed.withColumn("kind", kind).withColumn("r", F.row_number().over(top)).filter(F.col("r") <= WORDS).collect():
        got.setdefault(r["lang"], {})[r["bin"]] = r["n"]
    langs = sorted(got)
    chars = np.array([[got[g].get(f"\t{c}", 0) for c in CLASSES[:COUNTED]] for g in langs], float).reshape(len(langs), COUNTED)
    words, shares = [], []
    for g in langs:
        tops = sorted(w for w in got[g] if w and not w.startswith("\t"))
        n = np.array([got[g][w] for w in tops] + [0.0])
        n[-1] = max(0, got[g].get("", 0) - n.sum())
        words.append({w.encode(): k for k, w in enumerate(tops)})
        shares.append(n / max(1, n.sum()))
    return References(langs, chars / np.maximum(1, chars.sum(1, keepdims=True)), words, shares, [limit(s) if got[g].get("", 0) >= LEAST else None for g, s in zip(langs, shares, strict=True)])


def judge(text: bytes, ref: References | None, lang: str | None = None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, char_jsd, word_jsd."""
    words = text.split()
    classes = class_counts(text)
    chars = len(text) - int(classes[-1])
    blank = int(classes[3] + classes[4])
    lines = [x for x in text.split(b"\n") if x.strip()] if b"\n" in text else []
    again = repeated(words)
    failed = len(words) < 10 or 100 * again > 20 * len(words)
    char_jsd = word_jsd = None
    strange = False
    if ref is not None and ref.langs:
        if chars >= MIN_CHARS:
            p = classes[:COUNTED] + 0.5
            char_jsd = float(jsd(p / p.sum(), ref.chars).min())
        judges = [x for x in zip(ref.words, ref.shares, ref.limits, strict=True) if x[2] is not None]
        known = lang is None or lang not in ref.langs or ref.limits[ref.langs.index(lang)] is not None
        if len(words) >= MIN_WORDS and judges and known:
            count = Counter(text.lower().split())
            best, strange = 1.0, True
            for own, share, most in judges:
                p = np.zeros(len(share))
                for w, k in own.items():
                    p[k] = count.get(w, 0)
                p[-1] = len(words) - p.sum()
                d = float(jsd(p / len(words), share))
                best, strange = min(best, d), strange and d > most
            word_jsd = best
    far = (char_jsd or 0) > MAX_CHAR_JSD or strange
    return len(words), chars - blank, int(classes[CLASSES.index("symbol")]), len(lines) - len(set(lines)), again, failed, not failed and not far, char_jsd, word_jsd


OUT = (("n_words", "bigint"), ("word_chars", "bigint"), ("n_symbols", "bigint"), ("n_dup_lines", "bigint"), ("n_repeat_words", "bigint"), ("base_failed", "boolean"), ("kept", "boolean"), ("char_jsd", "double"), ("word_jsd", "double"))
ARROW = {"bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}


def rules(docs: DataFrame, ref: References | None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id, the counts, base_failed, kept and the distances of every whole text."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(ref)  # WORDS + classes numbers a language

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                got = [judge(t, shared.value, g) for t, g in zip(bytes_of(part), part.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([g[k] for g in got], ARROW[t]) for k, (_, t) in enumerate(OUT))], names=[id_col, *(n for n, _ in OUT)])

    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{n} {t}" for n, t in OUT)
    lang = F.col(lang_col) if lang_col in docs.columns else F.lit(None).cast("string")
    return docs.select(id_col, text_col, lang.alias("lang")).mapInArrow(run, schema)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules over every whole text of documents."""
    docs = table(spark, sf_dir, "documents")
    return rules(docs, references(docs))
