"""BPE encoding and decoding by speculation and verification.

A greedy longest match proposes the tokens of each word. A sequence of tokens is what the merges
give exactly if each token is what they give for its own string and each adjacent pair is what they
give for the pair's string: merges left of a boundary and right of it do not depend on one another
as long as nothing crosses it. So all adjacent pairs of a batch are looked up at once in a sorted
table of judged pairs, pairs not yet judged are judged by exact merging, and only words with a
failing pair are merged exactly.

Vocabularies are files of the `tokenizers` library of kind BPE with the end-of-word suffix `</w>`,
NFC, lower case and a byte-level alphabet. Null and empty texts give no tokens.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import Generations, sha, slices, table, texts_of
from tessera.session import ship

SUFFIX = "</w>"
#: str.split() also splits at these, Unicode's White_Space property does not have them.
SEPARATORS = regex.compile("[\x1c-\x1f]")
SPACES = regex.compile("[\t-\r \x85\xa0  -     　]+")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself, or the next free one from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, extra = [], 0
    for b in range(256):
        out.append(chr(b) if b in own else chr(256 + extra))
        extra += b not in own
    return out


class Codec:
    """Encoder and decoder of one vocabulary file, whose text is given."""

    def __init__(self, spec: str, cache: int = 200_000):
        d = json.loads(spec)
        vocab = d["model"]["vocab"]
        self.specials = {t["content"]: t["id"] for t in d["added_tokens"]}
        size = max([*vocab.values(), *self.specials.values()]) + 1
        self.tokens: list[str] = [""] * size
        for t, i in [*vocab.items(), *self.specials.items()]:
            self.tokens[i] = t
        self.digits = [str(i) for i in range(size)]
        self.ids = list(range(size))  # one int object for each id
        self.alphabet = byte_alphabet()
        self.table = {i: c for i, c in enumerate(self.alphabet)}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in d["model"]["merges"]]
        self.ranks = {(vocab[a], vocab[b]): (r, vocab[a + b]) for r, (a, b) in enumerate(merges)}
        self.start = {t: i for t, i in vocab.items() if len(t) == 1 or (t.endswith(SUFFIX) and len(t) == 1 + len(SUFFIX))}
        pattern = next(p for p in d["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.words = regex.compile(pattern)
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")") if self.specials else None
        inner = {t: i for t, i in vocab.items() if not t.endswith(SUFFIX)}
        final = {t.removesuffix(SUFFIX): i for t, i in vocab.items() if t.endswith(SUFFIX) and t != SUFFIX}
        # only tokens that the merges give for their own string may be proposed
        self.inner = {t: i for t, i in inner.items() if self.merge(self.symbols(t, False)) == [i]}
        self.final = {t: i for t, i in final.items() if self.merge(self.symbols(t, True)) == [i]}
        self.longest = max(map(len, chain(self.inner, self.final)), default=1)
        self.parts = {i: (t, False) for t, i in self.inner.items()} | {i: (t, True) for t, i in self.final.items()}
        self.judged = np.zeros(0, np.int64)  # sorted keys of pairs
        self.good = np.zeros(0, bool)
        self.cache = Generations(cache)

    def symbols(self, chars: str, ends: bool) -> list[int]:
        s = self.start
        return [s[c] for c in chars[:-1]] + [s[chars[-1] + SUFFIX if ends else chars[-1]]]

    def merge(self, ids: list[int]) -> list[int]:
        """Exact merging: the lowest rank first, of equal ranks the leftmost."""
        ranks, n = self.ranks, len(ids)
        if n < 2:
            return list(ids)
        ids, left, right = list(ids), list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(*m, i, i + 1, ids[i], ids[i + 1]) for i in range(n - 1) if (m := ranks.get((ids[i], ids[i + 1])))]
        heap = [(r, i, new, j, a, b) for r, new, i, j, a, b in heap]
        heapq.heapify(heap)
        while heap:
            r, i, new, j, a, b = heapq.heappop(heap)
            if ids[i] != a or right[i] != j or ids[j] != b:
                continue
            ids[i], ids[j], right[i] = new, -1, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            if (k := left[i]) >= 0 and (m := ranks.get((ids[k], new))):
                heapq.heappush(heap, (m[0], k, m[1], i, ids[k], new))
            if (k := right[i]) >= 0 and (m := ranks.get((new, ids[k]))):
                heapq.heappush(heap, (m[0], i, m[1], k, new, ids[k]))
        out, i = [], 0
        while i >= 0:
            out.append(ids[i])
            i = right[i]
        return out

    def propose(self, word: str) -> list[int]:
        """Greedy longest match; the part that ends the word must be a final token."""
        out, at, n, inner, longest = [], 0, len(word), self.inner, self.longest
        while at < n:
            if n - at <= longest and (t := self.final.get(word[at:])) is not None:
                out.append(t)
                break
            for end in range(min(n - 1, at + longest), at, -1):
                if (t := inner.get(word[at:end])) is not None:
                    out.append(t)
                    at = end
                    break
        return out

    def compatible(self, pairs: np.ndarray) -> np.ndarray:
        """For each key (left << 20 | right): whether merging the two tokens' strings gives just them."""
        for _ in range(2):
            at = np.searchsorted(self.judged, pairs)
            known = np.zeros(len(pairs), bool)
            inside = at < len(self.judged)
            known[inside] = self.judged[at[inside]] == pairs[inside]
            if known.all():
                return self.good[at]
            new = np.unique(pairs[~known])
            if len(self.judged) > 2_000_000:
                self.judged, self.good, new = self.judged[:0], self.good[:0], np.unique(pairs)
            good = []
            for key in new.tolist():
                a, b = key >> 20, key & 0xFFFFF
                (x, _), (y, ends) = self.parts[a], self.parts[b]
                good.append(self.merge(self.symbols(x, False) + self.symbols(y, ends)) == [a, b])
            keys = np.concatenate([self.judged, new])
            order = np.argsort(keys, kind="stable")
            self.judged, self.good = keys[order], np.concatenate([self.good, np.array(good, bool)])[order]
        raise AssertionError("all pairs are judged by now")

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of byte-level words, none of them empty."""
        found = [self.propose(w) for w in words]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.int64, int(counts.sum()))
        owner = np.repeat(np.arange(len(found)), counts)
        inside = owner[1:] == owner[:-1]
        fits = self.compatible(((flat[:-1] << 20) | flat[1:])[inside])
        for k in np.unique(owner[:-1][inside][~fits]).tolist():
            found[k] = self.merge(self.symbols(words[k], True))
        return found

    def pieces(self, chunk: str) -> list[str]:
        """The byte-level words of a text without special tokens."""
        chunk = unicodedata.normalize("NFC", chunk)
        low = chunk.lower() if "Σ" not in chunk else "".join(c.lower() for c in chunk)  # no rule for the final sigma
        return [w.encode().decode("latin-1").translate(self.table) for w in self.words.findall(low)]

    def learn(self, chunks: set[str]) -> None:
        """Bring all chunks into the cache."""
        new = self.cache.missing(chunks)
        split = [self.pieces(c) for c in new]
        distinct = list(dict.fromkeys(chain.from_iterable(split)))
        got = dict(zip(distinct, self.encode_words(distinct), strict=True)) if distinct else {}
        ids, young = self.ids, self.cache.young
        for c, ws in zip(new, split, strict=True):
            young[c] = tuple(ids[i] for w in ws for i in got[w])

    def chunks(self, text: str) -> list[str]:
        return SPACES.split(text) if SEPARATORS.search(text) else text.split()

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        parts = []
        for t in texts:
            own: list = []
            for k, s in enumerate(self.split.split(t) if self.split else [t]):
                own.append(self.specials[s] if k % 2 else self.chunks(s))
            parts.append(own)
        self.learn({c for own in parts for p in own if isinstance(p, list) for c in p})
        known = self.cache.young.__getitem__
        return [list(chain.from_iterable([p] if isinstance(p, int) else chain.from_iterable(map(known, p)) for p in own)) for own in parts]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by one space, as a file without a decoder asks for; special tokens stay."""
        return " ".join(map(self.tokens.__getitem__, ids))

    def listed(self, ids: list[int]) -> str:
        return " ".join(map(self.digits.__getitem__, ids))


_CODECS: dict[str, Codec] = {}


def codec_of(name: str, spec: str) -> Codec:
    """The worker's codec; one vocabulary is kept at a time."""
    if name not in _CODECS:
        _CODECS.clear()
        _CODECS[name] = Codec(spec)
    return _CODECS[name]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_frame(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids themselves.

    The vocabulary is read once on the driver and broadcast (its size is fixed by the file). Null
    and empty texts have no tokens. Other columns of docs are not read.
    """
    ship(docs.sparkSession)
    with open(path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        codec = codec_of(path, spec.value)
        for batch in batches:
            for part in slices(batch, most_bytes=2 << 20):
                ids = codec.encode_batch(texts_of(part))
                cols = [part.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([sha(codec.listed(x)) for x in ids]), pa.array([sha(codec.decode(x)) for x in ids])]
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    cols.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every whole text of documents."""
    return encode_frame(table(spark, sf_dir, "documents"), default_vocabulary())
