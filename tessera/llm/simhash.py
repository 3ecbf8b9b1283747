"""Near duplicates by SimHash fingerprints and multi-index hashing.

A fingerprint takes the words of the lower-cased (A-Z only) text in shingles of SHINGLE words,
repeats included; fewer words are one shingle, no words give fingerprint zero. Bit b is 1 if it is
set in over half of the shingles' XXH64 values.

Fingerprints at MOST = 4 differing bits or fewer link. Of two halves of 32 bits, one differs in at most 2 bits, so
the two are found at a common key if either enumerates the ball of radius 1 around that half: 33
keys a half and fingerprint, equal texts and equal fingerprints having been merged before. The
matches at a key are verified at full distance. Keys with over BLOCK fingerprints are not compared
pair by pair: their other halves are hashed to hubs so that all at a hub are within MOST bits and
all within MOST bits share a hub (radius 2 for those at the key itself, 1 for those a bit away),
which needs time in proportion to their number. A key with over HEAVY fingerprints isn't held by one task
either: its rows pass through and are dealt out by key and hub, and each links to the least at its hub.
Components are found over the links by joins.

Null texts count as empty. Ties and repeated rows have equal fingerprints and so one component. A null id
counts as the least, as -2**63, so an id of that value is given back as null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bytes_of, free, slices, table
from tessera.llm.components import components, fresh
from tessera.session import cut, ship

SHINGLE, SEED, MOST, BLOCK, HEAVY = 4, 42, 4, 32, 200_000
MASK = (1 << 32) - 1
#: Stands for a null id, which counts as the least.
NULL_ID, MAX_IDS = -(2**63), 200_000


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(size) - 1
    if len(words) <= shingle:
        starts, stops = [0], [len(joined)]
    else:
        starts, stops = (ends - size + 1)[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], "<u8")
    counts = np.zeros(64, np.int64)
    for k in range(0, len(h), 8192):
        counts += np.unpackbits(h[k : k + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp) with the fingerprint's bits as a bigint."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                fps = np.array([fingerprint(t, shingle) for t in bytes_of(part)], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps)], names=[id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, fp bigint")


def ball(radius: int) -> np.ndarray:
    """Masks of at most radius bits of 32."""
    one = [0] + [1 << i for i in range(32)]
    if radius == 1:
        return np.array(one, np.uint64)
    return np.array(sorted({a ^ b for a in one for b in one}), np.uint64)


def hub_links(key: int, fps: np.ndarray, reps: np.ndarray, most_rows: int = 4_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Links of a large key: each id to the least id it is connected to at this key."""
    upper = key >> 32 == 1
    own, other = (fps >> np.uint64(32), fps & np.uint64(MASK)) if upper else (fps & np.uint64(MASK), fps >> np.uint64(32))
    at_key = own == np.uint64(key & MASK)
    rows = int(at_key.sum()) * 529 + int((~at_key).sum()) * 33
    passes = -(-rows // most_rows)
    labels = reps.copy()
    while True:
        before = labels.copy()
        for p in range(passes):
            hubs, members = [], []
            for some, masks in ((np.flatnonzero(at_key), ball(2)), (np.flatnonzero(~at_key), ball(1))):
                for chunk in np.array_split(some, max(1, len(some) * len(masks) // most_rows + 1)):
                    h = (other[chunk][:, None] ^ masks[None, :]).ravel()
                    m = np.repeat(chunk, len(masks))
                    mine = h % np.uint64(passes) == p
                    hubs.append(h[mine])
                    members.append(m[mine])
            h, m = np.concatenate(hubs), np.concatenate(members)
            order = np.argsort(h, kind="stable")
            h, m = h[order], m[order]
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            width = np.diff(np.r_[first, len(h)])
            while True:
                least = np.repeat(np.minimum.reduceat(labels[m], first), width)
                was = labels.copy()
                np.minimum.at(labels, m, least)
                if (labels == was).all():
                    break
        if passes == 1 or (labels == before).all():
            break
    moved = labels != reps
    return reps[moved], labels[moved]


def key_links(keys: np.ndarray, fps: np.ndarray, reps: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Verified links among rows sorted by key."""
    us, vs = [], []
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    width = np.diff(np.r_[first, len(keys)])
    for f, w in zip(first[width > BLOCK].tolist(), width[width > BLOCK].tolist(), strict=True):
        u, v = hub_links(int(keys[f]), fps[f : f + w], reps[f : f + w])
        us.append(u)
        vs.append(v)
    few = (width > 1) & (width <= BLOCK)
    ends = np.repeat(first[few] + width[few], width[few])
    at = np.concatenate([np.arange(f, f + w) for f, w in zip(first[few], width[few], strict=True)]) if few.any() else np.zeros(0, np.int64)
    for shift in range(1, BLOCK):
        inside = at + shift < ends
        at, ends = at[inside], ends[inside]
        if not len(at):
            break
        near = np.bitwise_count(fps[at] ^ fps[at + shift]) <= MOST
        us.append(reps[at[near]])
        vs.append(reps[at[near] + shift])
    return us, vs


def links(nodes: DataFrame) -> DataFrame:
    """(u, v) of ids whose fingerprints differ in at most MOST bits, enough of them to connect all.

    nodes: (fp, rep), each fingerprint once.
    """
    step = F.col("i") % 33
    flip = F.when(step == 0, F.lit(0).cast("bigint")).otherwise(F.expr("shiftleft(1L, cast(i % 33 - 1 as int))"))
    half = F.when(F.col("i") < 33, F.col("fp").bitwiseAND(F.lit(MASK))).otherwise(F.shiftrightunsigned("fp", 32))
    seg = F.when(F.col("i") < 33, F.lit(0).cast("bigint")).otherwise(F.lit(1 << 32))
    keys = nodes.select("fp", "rep", F.explode(F.sequence(F.lit(0), F.lit(65))).alias("i")).select(half.bitwiseXOR(flip).bitwiseOR(seg).alias("key"), "fp", "rep")

    nothing = pa.array([], pa.int64())

    def run(batches):
        kept: list[list[np.ndarray]] = []
        heavy = None  # the key whose rows pass through
        for batch in batches:
            k, f, r = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if heavy is not None:
                same = int(np.searchsorted(k, heavy, "right"))
                yield passed(k[:same], f[:same], r[:same])
                k, f, r = k[same:], f[same:], r[same:]
            if not len(k):
                continue
            heavy = None
            kept.append([k, f, r])
            held = sum(len(x[0]) for x in kept)
            if held < HEAVY:
                continue
            k, f, r = (np.concatenate([x[i] for x in kept]) for i in range(3))
            last = int(np.searchsorted(k, k[-1]))  # the last key may go on
            yield emit(k[:last], f[:last], r[:last])
            kept = [[k[last:], f[last:], r[last:]]]
            if held - last >= HEAVY:
                heavy = int(k[-1])
                yield passed(*kept.pop())
        if kept:
            yield emit(*(np.concatenate([x[i] for x in kept]) for i in range(3)))

    def emit(k, f, r):
        us, vs = key_links(k, f.view(np.uint64), r) if len(k) else ([], [])
        u, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (us, vs))
        pairs = np.unique(np.stack([np.maximum(u, v), np.minimum(u, v)]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0], pa.int64()), pa.array(pairs[1], pa.int64()), pa.nulls(pairs.shape[1], pa.int64())], names=["u", "v", "key"])

    def passed(k, f, r):
        """Rows of a heavy key: fingerprint, id and key in place of a link."""
        return pa.RecordBatch.from_arrays([pa.array(f, pa.int64()), pa.array(r, pa.int64()), pa.array(k, pa.int64())], names=["u", "v", "key"])

    ship(nodes.sparkSession)
    found = cut(keys.repartition("key").sortWithinPartitions("key").mapInArrow(run, "u bigint, v bigint, key bigint"))
    own = found.filter(F.col("key").isNull()).select("u", "v")
    rest = found.filter(F.col("key").isNotNull()).select("key", F.col("u").alias("fp"), F.col("v").alias("rep"))
    return own.unionByName(heavy_links(rest)) if rest.limit(1).count() else own


def heavy_links(rows: DataFrame) -> DataFrame:
    """(u, v): each id of a heavy key (key, fp, rep) with the least id at each of its hubs."""
    low, high = F.col("fp").bitwiseAND(F.lit(MASK)), F.shiftrightunsigned("fp", 32)
    upper = F.shiftrightunsigned("key", 32) == 1
    own, other = F.when(upper, high).otherwise(low), F.when(upper, low).otherwise(high)
    masks = [F.array(*[F.lit(int(m)) for m in ball(k)]) for k in (1, 2)]
    mask = F.explode(F.when(own == F.col("key").bitwiseAND(F.lit(MASK)), masks[1]).otherwise(masks[0]))
    hubs = rows.select("key", "rep", other.alias("other"), mask.alias("mask")).select("key", F.col("other").bitwiseXOR(F.col("mask")).alias("hub"), "rep")
    least = hubs.groupBy("key", "hub").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).filter(F.col("least") < F.col("most"))
    both = hubs.join(least.select(fresh("key"), fresh("hub"), "least"), ["key", "hub"]).filter(F.col("rep") > F.col("least"))
    return both.select(F.col("rep").alias("u"), F.col("least").alias("v")).distinct()


def placed(fps: DataFrame, key: str) -> DataFrame:
    """(fp, least) of each fingerprint; least is the least key of its component. Keys don't link fingerprints."""
    nodes = cut(fps.groupBy("fp").agg(F.min(key).alias("rep")))
    roots = components(links(nodes.select("fp", F.col("fp").alias("rep"))))
    linked = cut(nodes.join(roots, nodes["fp"] == roots["node"]).select("node", "root", "rep"))
    least = linked.groupBy("root").agg(F.min("rep").alias("least"))
    told = linked.select("node", fresh("root")).join(least, "root").select("node", "least")
    return nodes.join(told, nodes["fp"] == told["node"], "left").select(fresh("fp"), F.coalesce("least", "rep").alias("least"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """id, fp (bigint) and component_id (the least id reachable) of every document; ids are bigint."""
    known = F.coalesce(F.col(id_col).cast("bigint"), F.lit(NULL_ID)).alias(id_col)
    fps = cut(fingerprints(docs.select(known, text_col), id_col, text_col, shingle))
    back = lambda c, name: F.when(F.col(c) != NULL_ID, F.col(c)).alias(name)
    return fps.join(placed(fps, id_col), "fp").select(back(id_col, id_col), "fp", back("least", "component_id"))


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component one row, all columns kept: that of the least id, of equal ids that of the least digest.

    A row's key is its id and a digest of its text, so that rows without an id or with a repeated one
    go only for a near duplicate. The keys that go are broadcast while there are at most MAX_IDS.
    """
    key = free("id_", docs.columns)
    digest = F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    rows = docs.withColumn(key, F.struct(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NULL_ID)).alias("id"), F.coalesce(digest, F.lit(b"")).alias("digest")))
    fps = cut(fingerprints(rows.select(key, text_col), key, text_col))
    got = cut(fps.join(placed(fps, key), "fp").select(key, "least"))
    gone = got.filter(F.col(key) != F.col("least")).select(key).distinct()
    few = gone.count() <= MAX_IDS
    kept = rows.join(F.broadcast(gone) if few else gone, key, "left_anti")
    if got.groupBy(key).count().filter(F.col("count") > 1).limit(1).count():
        kept = kept.dropDuplicates([key])
    return kept.select(*docs.columns)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    got = classes(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
