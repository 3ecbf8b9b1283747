import hashlib
import random

from tessera.llm import warc


def test_loser_tree():
    r = random.Random(1)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted([(i, 0, r.choice("abc"), "", r.choice([None, *range(9)])) for _ in range(r.randrange(7))], key=warc.order) for i in range(k)]
        assert [warc.order(x) for x in warc.LoserTree(runs)] == sorted(warc.order(x) for run in runs for x in run)


def test_archive(spark, tmp_path):
    big = "<p>" + "é\r\n\r\nWARC/1.1\r\n" * 200
    rows = [(k, f"http://b.example.com/{k % 3}?q#f", big) for k in range(9)] + [(20, None, "small"), (21, "http://a.example.com/", "small"), (22, "x", None), (23, "http://a.example.com/", big + "x"), (23, "http://a.example.com/", big + "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as first")
    got = warc.archive(pages, str(tmp_path / "w")).collect()
    assert len(got) == len(rows) and [warc.order(x) for x in got] == sorted(warc.order(x) for x in got)
    text = {i: h or "" for i, _, h in rows}
    for x in got:
        payload = text[x["page_id"]].encode()
        assert (x["payload_bytes"], x["payload_digest"]) == (len(payload), hashlib.sha1(payload).hexdigest())
        assert (x["record_type"], x["refers_to"]) == (("revisit", 8) if x["page_id"] < 8 else ("response", None))


def test_any_page_id(spark, tmp_path):
    ids = [None, -(2**63), -5, 0, 1, 3 * 10**11, 10**13, 2**62, 2**63 - 1]
    pages = spark.createDataFrame([(i, "http://a.example.com/", "x" * 2000) for i in ids], "page_id long, url string, html string")
    got = warc.archive(pages, str(tmp_path / "w")).collect()
    assert sorted((x["page_id"] is not None, x["page_id"] or 0) for x in got) == sorted((i is not None, i or 0) for i in ids)
    assert [warc.order(x) for x in got] == sorted(warc.order(x) for x in got)
    assert all(len(x["stamp"]) == 20 and x["stamp"][:2] == "20" for x in got)
    assert all(x["record_type"] == ("response" if x["page_id"] == 2**63 - 1 else "revisit") for x in got)
    assert {x["refers_to"] for x in got if x["record_type"] == "revisit"} == {2**63 - 1}


def test_empty(spark, tmp_path):
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "w")).count() == 0
