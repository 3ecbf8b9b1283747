import hashlib
import random
import re

from pyspark.sql import functions as F

from tessera.llm import pii

PLAIN = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def luhn(d):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for k, p in enumerate(PLAIN):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if k == 0 or (k == 1 and all(int(x) <= 255 for x in m[0].split("."))) or (k == 2 and 14 <= len(d) <= 19 and luhn(d)) or (k == 3 and 10 <= len(d) <= 15):
                out.append((m.start(), k, m.end()))
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def digest(text):
    return hashlib.sha256(brute(text).encode()).hexdigest()


def test_base_spans(spark, docs, empty):
    r = random.Random(5)
    parts = ["a", "b.", "@", "x-y", ".", "1", "255", "256", "4111 1111 1111 1111", "4111111111111111", "+1", "(", "555", ") ", "-", " ", "é", "😀", "_x@y.com", "a@b.co", "1.2.3.4", "+1 (068) 555-2747", "\n", "00000000012"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(14))) for _ in range(2000)] + ["a" * 20000, "1." * 5000, "a@" + "b." * 5000 + "c", "9 " * 4000, "a@b.co " * 900]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = df.select("doc_id", F.sha2(pii.joined(pii.base_spans(F.col("text"))), 256).alias("d")).collect()
    assert all(digest(texts[x["doc_id"]]) == x["d"] for x in got)
    found = pii.find(docs).collect()
    text = {d["doc_id"]: d["text"] for d in docs.collect()}
    assert len(found) == docs.count() and all(digest(text[x["doc_id"]]) == x["base_sha256"] for x in found)
    assert pii.find(empty).count() == 0 and pii.redact(empty).columns == empty.columns


def test_bootstrap_finds_what_the_patterns_miss(spark):
    rows = [(k, f"call Contact phone: +49 30 {1000000 + k * 7} today") for k in range(40)] + [(100, "Contact phone: 555-0199-22 please"), (101, "the number 1234567 is a year")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: x for x in pii.find(df).collect()}
    assert got[100]["n_ctx"] == 1 and got[101]["n_ctx"] == 0
    masked = {x["doc_id"]: x["text"] for x in pii.redact(df).collect()}
    assert masked[100] == "Contact phone: <CTX> please" and masked[0] == "call Contact phone: <PHONE> today"


def test_bootstrap_finds_any_token(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    rows = [(k, f"{word()} reach me: user{k}@mail.example.org {word()}") for k in range(40)]
    rows += [(100 + k, f"{word()} Phone no: +49 30 {1000000 + k * 7} {word()}") for k in range(40)]
    rows += [(200, "reach me: jack(at)host, please"), (201, "so reach me:   jo_doe"), (202, "Phone no: 555 123 4567. Bye 12"), (203, "Phone no: (017) 555-7713 or"), (204, " reach me:")]
    rows += [(300 + k, f"the {word()} and the +49 30 {2000000 + k} of {word()}") for k in range(4)] + [(400 + k, f"the {word()} the {word()}") for k in range(40)]
    rows += [(500, rows[80][1]), (501, None), (502, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    text = dict(rows)
    got = {x["doc_id"]: [text[x["doc_id"]][int(s.split(":")[1]) : int(s.split(":")[2])] for s in x["spans"].split(",") if s.startswith("ctx")] for x in pii.find(df).collect()}
    assert got[200] == got[500] == ["jack(at)host"] and got[201] == ["jo_doe"] and got[202] == ["555 123 4567"] and got[203] == ["(017) 555-7713"]
    assert not any(v for k, v in got.items() if k not in (200, 201, 202, 203, 500))  # `the` has seeds, too few for its places
    masked = {x["doc_id"]: x["text"] for x in pii.redact(df).collect()}
    assert masked[200] == "reach me: <CTX>, please" and masked[202] == "Phone no: <CTX>. Bye 12" and masked[501] is None and masked[502] == ""


def test_long_texts_with_many_spans_in_linear_time(spark, monkeypatch):
    import time

    monkeypatch.setattr(pii, "MAX_BYTES", -1)
    n = 30_000
    text = " ".join(f"é{k} mail x{k}@b.co" for k in range(n))
    df = spark.createDataFrame([(1, text), (2, "mail a(at)b"), (3, None)], "doc_id long, text string")
    began = time.time()
    got = {x["doc_id"]: x["text"] for x in pii.redact(df).collect()}
    assert got == {1: " ".join(f"é{k} mail <EMAIL>" for k in range(n)), 2: "mail <CTX>", 3: None}
    assert time.time() - began < 120


def test_redact_keeps_rows_and_columns(docs):
    got = pii.redact(docs)
    assert got.columns == docs.columns and got.count() == docs.count()
    assert {x["spans_"] for x in got.collect()} == {"y"}  # a column of the same name as one used inside
    texts = [x["text"] for x in got.collect()]
    assert None in texts and any(t and "<EMAIL>" in t and "me@site.org" not in t for t in texts)
