import hashlib
import random

import numpy as np
import pytest
import xxhash

from tessera.llm import components, simhash, substring


def brute_substring(docs):
    seen, out = {}, {}
    for i, t in sorted(set(docs), key=lambda d: d[0]):
        w = (t or "").encode().split()
        cov = [False] * len(w)
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            if seen.setdefault(k, (i, s)) < (i, s):
                cov[s : s + 20] = [True] * 20
        kept = [x for x, c in zip(w, cov, strict=True) if not c]
        out[i] = (len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


@pytest.mark.parametrize("shuffled", [False, True])
def test_substring(docs, monkeypatch, shuffled):
    if shuffled:
        monkeypatch.setattr(substring, "MAX_ANCHORS", -1)
        monkeypatch.setattr(substring, "MAX_PLACES", -1)
    want = brute_substring([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = substring.dedup(docs).collect()
    assert len(got) == docs.count()
    assert all(want[r["doc_id"]] == (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got)


def test_substring_random(spark):
    r = random.Random(1)
    part = [" ".join(r.choice("ab") for _ in range(40)) for _ in range(4)]
    texts = [" ".join(r.choice([*part, "c d", "e", "a b a"]) for _ in range(r.randrange(6))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_substring(list(enumerate(texts)))
    assert all(want[x["doc_id"]] == (x["n_words"], x["n_removed"], x["kept_sha256"]) for x in substring.dedup(df).collect())


def test_runs_of_a_long_text_in_linear_time(spark):
    import time

    n = 200_000
    places = spark.range(n).selectExpr("id % 2 as doc", "cast(id * 3 as int) as start", "1 as width").unionByName(spark.createDataFrame([(0, 0, 2), (0, 2, 1), (0, 2, 9), (7, 4, 1)], "doc long, start int, width int"))
    began = time.time()
    got = {x["doc"]: list(zip(x["starts"], x["widths"], strict=True)) for x in substring.merged(places).collect()}
    assert time.time() - began < 40
    assert got[7] == [(4, 1)] and len(got[1]) == n // 2 and got[0][:2] == [(0, 11), (12, 1)] and len(got[0]) == n // 2 - 1


def test_substring_of_long_repetitive_texts(spark):
    r = random.Random(3)
    part = [" ".join(f"p{k}_{i}" for i in range(20)) for k in range(300)]
    texts = [" ".join(r.choice(part) + f" x{n}_{k}" for k in range(1500)) for n in range(3)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_substring(list(enumerate(texts)))
    assert all(want[x["doc_id"]] == (x["n_words"], x["n_removed"], x["kept_sha256"]) for x in substring.dedup(df).collect())


def test_substring_empty(empty):
    assert substring.dedup(empty).count() == 0


def test_automaton_statistics():
    r = random.Random(2)
    ref = [[r.choice([b"a", b"b", b"c"]) for _ in range(r.randrange(12))] for _ in range(6)]
    words = [r.choice([b"a", b"b", b"c"]) for _ in range(60)]
    found = {tuple(t[i:j]) for t in ref for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    want = [max((n for n in range(1, i + 2) if tuple(words[i + 1 - n : i + 1]) in found), default=0) for i in range(len(words))]
    assert substring.Automaton(ref).statistics(words) == want


def test_match_reference(spark):
    ref = " ".join(f"r{k}" for k in range(40))
    df = spark.createDataFrame([(1, f"start {ref} end"), (2, "r1 r2 r3"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], r["kept_text"]) for r in substring.match_reference(df, [ref, ref[:50]], shard_words=30).collect()}
    assert got == {1: (40, "start end"), 2: (0, "r1 r2 r3"), 3: (0, "")}


def plain_fingerprint(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_simhash(docs, empty):
    fps = {r["doc_id"]: plain_fingerprint(r["text"]) for r in docs.collect()}
    want = brute_components(fps)
    for r in simhash.classes(docs).collect():
        assert r["fp"] % 2**64 == fps[r["doc_id"]] and r["component_id"] == want[r["doc_id"]]
    kept = simhash.first_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({i for i, c in want.items() if i == c})
    assert simhash.classes(empty).count() == 0 and simhash.first_of_each(empty).count() == 0


@pytest.mark.parametrize(("block", "heavy"), [(4, 200_000), (32, 200_000), (4, 8), (32, 20)])
def test_links_of_dense_clusters(spark, monkeypatch, block, heavy):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "HEAVY", heavy)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7 if heavy < 100 else 10_000)
    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(0, 2**63, 4)]
    fps = set()
    for _ in range(300):
        x = base[rng.integers(4)]
        for b in rng.integers(0, 64, rng.integers(0, 8)):
            x ^= 1 << int(b)
        fps.add(x)
    by = dict(enumerate(sorted(fps)))
    rows = [(f - (1 << 64) if f >= 1 << 63 else f, i) for i, f in by.items()]
    nodes = spark.createDataFrame(rows, "fp long, rep long")
    got = dict.fromkeys(by)
    got.update({r["node"]: r["root"] for r in components.components(simhash.links(nodes)).collect()})
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {i: i if c is None else c for i, c in got.items()} == brute_components(by)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k + 1, k) for k in range(40)] + [(70, 71), (80, 80)], "u long, v long")
    got = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert got == {k: 0 for k in range(41)} | {70: 70, 71: 70, 80: 80}
