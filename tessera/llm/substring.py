"""Substring dedup: words covered by a window of WINDOW words that also starts earlier are removed.

Each window is filed under its anchor, the one of its GRAM-word sequences with the least hash (of
equal ones the first): equal windows have equal anchors at equal offsets. Consecutive windows of a
document with one anchor are a block. Then:

1. anchors are counted over all documents; windows of anchors that occur once can't repeat;
2. blocks of the other anchors are emitted;
3. equal blocks are grouped; all windows of a block but its first occurrence's are covered;
4. among first occurrences, of anchors with two or more distinct blocks alone, the windows are emitted
   and equal ones grouped; all but the first are covered. An earliest window always is in a first occurrence, as a
   later block of the same words has the same windows;
5. the covered windows of a document meet its text, and its other words are kept.

Windows and blocks are compared by 64-bit hashes under the same 64-bit anchor, not as words: two windows
of different words are taken for equal only if they share their 8-word anchor (or its hash) and their own
hash. Of w windows in all, with at most m different ones under one anchor, about w * m / 2**65 meet so: at
100 TB (2 * 10**13 windows) and m = 1,000 that is 0.0005 expected in the whole run. Groups are counted
and their least place found map-side; joins deal both sides out anew, so that hot groups can be split.

An id stands for one document: repeated rows of an id are the same place, neither is earlier. A null
id comes before all others. Null and empty texts, and texts under WINDOW words, lose nothing.

Besides, `Automaton` and `match_reference` remove what documents share with a given reference set by
broadcast suffix automata, in shards of bounded size; see README for why op8 isn't built on them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import bytes_of, slices, table
from tessera.llm.components import fresh
from tessera.session import cut, ship, written

WINDOW, GRAM = 20, 8
#: Anchors that are broadcast at most, and numbers that stand for covered runs; beyond, joins are shuffled.
MAX_ANCHORS, MAX_PLACES = 6_000_000, 1_500_000
BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.cumprod(np.r_[np.uint64(1), np.full(n + n // 2, x, np.uint64)]) for x in (np.uint64(BASE), np.uint64(pow(BASE, -1, 2**64)))]
    return _POWERS[0], _POWERS[1]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Windows:
    """The windows of the documents of a batch, over all their words in one array."""

    def __init__(self, texts: list[bytes]):
        split = [t.split() for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        self.first = np.concatenate([[0], np.cumsum(counts)])  # of each document, its first word
        digest = xxhash.xxh64_intdigest
        h = np.fromiter((digest(w) for s in split for w in s), np.uint64, int(counts.sum()))
        up, self.down = powers(len(h) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)], dtype=np.uint64)])
        many = np.maximum(counts - (WINDOW - 1), 0)
        self.doc = np.repeat(np.arange(len(split)), many)
        within = np.arange(len(self.doc)) - np.repeat(np.cumsum(many) - many, many)
        self.start = self.first[self.doc] + within  # in the array of all words
        if not len(self.start):
            self.anchor, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            return
        grams = self.hashes(np.arange(len(h) - GRAM + 1), GRAM)
        wide = WINDOW - GRAM + 1
        least = np.empty(len(grams) - wide + 1, np.int64)
        view = np.lib.stride_tricks.sliding_window_view(grams, wide)
        for k in range(0, len(least), 65_536):
            least[k : k + 65_536] = view[k : k + 65_536].argmin(1)
        self.at = self.start + least[self.start]
        self.anchor = grams[self.at]

    def hashes(self, starts: np.ndarray, length) -> np.ndarray:
        """Hashes of the word sequences at starts, of one length or one each."""
        return mixed((self.sums[starts + length] - self.sums[starts]) * self.down[starts])

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchors and the number of places that each has."""
        changed = np.r_[True, self.at[1:] != self.at[:-1]] if len(self.at) else np.zeros(0, bool)
        return np.unique(self.anchor[changed], return_counts=True)

    def blocks(self, repeated: np.ndarray | None, with_windows: bool):
        """anchor, block hash, document, first window's place in it, windows, flat window hashes."""
        if not len(self.at):
            return (np.zeros(0, np.int64),) * 6
        begin = np.flatnonzero(np.r_[True, (self.at[1:] != self.at[:-1]) | (self.doc[1:] != self.doc[:-1])])
        width = np.diff(np.r_[begin, len(self.at)])
        if repeated is not None:
            a = self.anchor[begin]
            k = np.minimum(np.searchsorted(repeated, a), max(0, len(repeated) - 1))
            kept = repeated[k] == a if len(repeated) else np.zeros(len(a), bool)
            begin, width = begin[kept], width[kept]
        starts = self.start[begin]
        doc = self.doc[begin]
        flat = np.repeat(begin - (np.cumsum(width) - width), width) + np.arange(int(width.sum())) if with_windows else begin[:0]
        return self.anchor[begin], self.hashes(starts, width + (WINDOW - 1)), doc, starts - self.first[doc], width, self.hashes(self.start[flat], WINDOW)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64), pa.int64())


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(2**63))).alias("doc"), F.col(text_col).alias("text"))


def repeated_anchors(rows: DataFrame) -> DataFrame:
    """(anchor) of anchors with two or more places in all documents."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                a, n = Windows(bytes_of(part)).anchors()
                yield pa.RecordBatch.from_arrays([signed(a), pa.array(n, pa.int64())], names=["anchor", "n"])

    counted = rows.mapInArrow(run, "anchor bigint, n bigint").groupBy("anchor").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") > 1).select("anchor")


BLOCK = "anchor bigint, block bigint, doc bigint, start int, width int"


def blocks(rows: DataFrame, wanted: DataFrame, with_windows: bool = False) -> DataFrame:
    """All blocks of the wanted anchors, which are broadcast if there are not too many."""
    shared = None
    if wanted.count() <= MAX_ANCHORS:
        found = np.sort(wanted.toArrow()["anchor"].to_numpy().view(np.uint64))
        shared = rows.sparkSession.sparkContext.broadcast(found)
    schema = BLOCK + ", windows array<bigint>" * with_windows

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                a, b, doc, start, width, flat = Windows(bytes_of(part)).blocks(shared.value if shared else None, with_windows)
                ids = part.column(0).to_numpy(zero_copy_only=False)[doc] if len(doc) else np.zeros(0, np.int64)
                cols = [signed(a), signed(b), pa.array(ids, pa.int64()), pa.array(start, pa.int32()), pa.array(width, pa.int32())]
                if with_windows:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(width)]), pa.int32()), signed(flat)))
                yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in schema.split(", ")])

    out = rows.mapInArrow(run, schema)
    return out if shared else out.join(wanted.select(fresh("anchor")), "anchor", "left_semi")


def covered(rows: DataFrame) -> DataFrame:
    """(doc, start, width): runs of windows that also start earlier."""
    place = F.struct("doc", "start")
    found, drop = written(blocks(rows, cut(repeated_anchors(rows))))
    firsts = found.groupBy("anchor", "block", "width").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    firsts, drop_firsts = written(firsts)
    again = firsts.filter(F.col("n") > 1).select(fresh("anchor"), fresh("block"), "width", "first")
    later = found.join(again, ["anchor", "block", "width"]).filter(place > F.col("first")).select("doc", "start", "width")
    several = cut(firsts.groupBy("anchor").agg(F.count("*").alias("blocks")).filter(F.col("blocks") > 1).select("anchor"))
    one = firsts.select(F.col("first.doc").alias("doc"), F.col("first.start").alias("start"))
    some = blocks(rows, several, with_windows=True).join(one, ["doc", "start"], "left_semi").select("anchor", "doc", "start", F.posexplode("windows").alias("k", "window"))
    each, drop_each = written(some.select("anchor", "window", "doc", (F.col("start") + F.col("k")).alias("start")))
    least = each.groupBy("anchor", "window").agg(F.min(place).alias("least"), F.count("*").alias("n")).filter(F.col("n") > 1)
    edge = each.join(least.select(fresh("anchor"), fresh("window"), "least"), ["anchor", "window"]).filter(place > F.col("least"))
    runs = cut(merged(later.unionByName(edge.select("doc", "start", F.lit(1).alias("width")))))
    for end in (drop, drop_firsts, drop_each):
        end()
    return runs


def merged(places: DataFrame) -> DataFrame:
    """(doc, starts, widths): the runs of each document, joined where they touch. One task holds the runs of
    a document, of which there are at most as many as it has words."""
    one = places.groupBy("doc", "start").agg((F.col("start") + F.max("width")).alias("stop"))
    order = Window.partitionBy("doc").orderBy("start")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.col("start") <= reach, 0).otherwise(1)
    runs = one.withColumn("opens", opens).withColumn("run", F.sum("opens").over(order))
    joined = runs.groupBy("doc", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    every = F.array_sort(F.collect_list(F.struct("start", (F.col("stop") - F.col("start")).alias("width"))))
    grouped = joined.groupBy("doc").agg(every.alias("runs"))
    return grouped.select("doc", F.col("runs.start").alias("starts"), F.col("runs.width").alias("widths"))


def keep(words: list[bytes], starts: list[int], widths: list[int]) -> list[bytes]:
    """The words that no covered window holds."""
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.array(starts, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, np.minimum(at + np.array(widths, np.int64) + (WINDOW - 1), len(words)), -1)
    free = (np.cumsum(edge)[:-1] == 0).tolist()
    return [w for w, f in zip(words, free, strict=True) if f]


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """id, n_words, n_removed, kept_sha256 and, if asked for, the kept words joined by spaces."""
    ship(docs.sparkSession)
    rows = keyed(docs, id_col, text_col)
    marks = covered(rows)
    few = (marks.agg(F.sum(F.size("starts") + 2)).first()[0] or 0) <= MAX_PLACES
    kind = docs.schema[id_col].dataType.simpleString()
    ids = docs.select(F.col(id_col), F.col(text_col).alias("text"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(2**63))).alias("doc"))
    joined = ids.join(F.broadcast(marks) if few else marks, "doc", "left").select(id_col, "text", "starts", "widths")

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                out = []
                for t, s, w in zip(bytes_of(part), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    words = t.split()
                    kept = keep(words, s, w) if s else words
                    whole = b" ".join(kept)
                    out.append((len(words), len(words) - len(kept), hashlib.sha256(whole).hexdigest(), whole))
                cols = [part.column(0), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.string())]
                if with_text:
                    cols.append(pa.array([x[3].decode() for x in out], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=[id_col, "n_words", "n_removed", "kept_sha256", "kept_text"][: len(cols)])

    return joined.mapInArrow(run, f"`{id_col}` {kind}, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * with_text)


class Automaton:
    """A suffix automaton over sequences of words."""

    def __init__(self, texts: list[list[bytes]]):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        for words in texts:
            last = 0
            for w in words:
                last = self.extend(last, w)

    def extend(self, last: int, w: bytes) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:  # a text after the first may follow a path that is there already
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self.clone(last, w, q)
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else self.clone(p, w, q)
        return new

    def clone(self, p: int, w: bytes, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        c = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = c
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = c
            p = link[p]
        return c

    def statistics(self, words: list[bytes]) -> list[int]:
        """At each word the length of the longest sequence ending there that the reference holds."""
        out, state, n = [], 0, 0
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if w in self.next[state]:
                state, n = self.next[state][w], n + 1
            out.append(n)
        return out


def match_reference(docs: DataFrame, reference: list[str], id_col: str = "doc_id", text_col: str = "text", least: int = WINDOW, shard_words: int = 200_000) -> DataFrame:
    """id, n_words, n_removed and kept_text after removing maximal spans of at least `least` words
    that a reference text holds. The reference is a list of bounded size; its automata are built and
    broadcast in shards of shard_words words, and every document is streamed through each."""
    ship(docs.sparkSession)
    shards: list[list[list[bytes]]] = [[]]
    size = 0
    for t in reference:
        words = (t or "").encode().split()
        if size + len(words) > shard_words and shards[-1]:
            shards.append([])
            size = 0
        shards[-1].append(words)
        size += len(words)
    shared = [docs.sparkSession.sparkContext.broadcast(Automaton(s)) for s in shards]

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                out = []
                for t in bytes_of(part):
                    words = t.split()
                    edge = np.zeros(len(words) + 1, np.int64)
                    for s in shared:
                        n = np.array(s.value.statistics(words), np.int64)
                        at = np.flatnonzero(n >= least)
                        np.add.at(edge, at - n[at] + 1, 1)
                        np.add.at(edge, at + 1, -1)
                    free = np.cumsum(edge)[:-1] == 0
                    kept = [w for w, f in zip(words, free.tolist(), strict=True) if f]
                    out.append((len(words), len(words) - len(kept), b" ".join(kept).decode()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.string())], names=[id_col, "n_words", "n_removed", "kept_text"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_words bigint, n_removed bigint, kept_text string")


SQL = """
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
g AS (SELECT doc_id, i, sha256(array_to_string(w[i:i+19], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS n FROM g),
c AS (SELECT DISTINCT doc_id, i + k AS p FROM (SELECT doc_id, i, unnest(range(0, 20)) AS k FROM r WHERE n > 1)),
m AS (SELECT doc_id, list(p) AS ps FROM c GROUP BY doc_id),
k AS (SELECT d.doc_id, len(w) AS n_words, coalesce(len(ps), 0) AS n_removed,
  CASE WHEN ps IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(ps, x[2])), lambda x: x[1]) END AS kept
  FROM d LEFT JOIN m ON d.doc_id = m.doc_id)
SELECT doc_id, n_words, n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove words covered by windows that also start earlier, over all documents."""
    return dedup(table(spark, sf_dir, "documents"))
