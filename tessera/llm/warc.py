"""WARC archives with revisit records, and a capture index merged by a loser tree.

Writing: of pages with equal payloads of at least 1000 bytes the one with the largest page_id is a
response record, the others are revisit records that refer to it and carry no payload. Records are
text of the form of WARC/1.1; a text file whose lines end in CRLF CRLF is a sequence of them, so
Spark's own writer puts the archives anywhere Spark can write. Every archive is read back by the
lengths in its records' headers.

Indexing: each archive gives a run of captures sorted by URL key (host labels reversed, then the
path), timestamp and page. Captures are dealt out by ranges of that order; in each range the slices
of the runs, each in its order, are merged by a loser tree. The ranges in order are the whole
history. A range holds RANGE captures or so, however many one URL or host has.

Pages count as captured one second apart, in the order of page_id, from EPOCH on; ids wrap after SPAN
seconds, so that any bigint has a date of four-digit years. Captures of one time are in the order of
page_id, a null one first. Null html is an empty payload, null urls are the empty URL. A repeated page_id
gives a record each; of the rows of the largest page_id of a payload, all are responses.
"""

from __future__ import annotations

import gzip
import hashlib
import math
import uuid
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table
from tessera.session import checkpoint_dir, cut, remove, ship

LEAST_BYTES, RANGE, EPOCH, SPAN = 1000, 50_000, datetime(2024, 1, 1, tzinfo=timezone.utc), 20 * 365 * 86_400
END = "\r\n\r\n"


def records(pages: DataFrame) -> DataFrame:
    """page_id, url, digest, bytes, type, refers_to and the record's text, without its final line ends."""
    url, body = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", url.alias("url"), body.alias("html"), F.sha1(body.cast("binary")).alias("digest"), F.octet_length(body).cast("bigint").alias("bytes"))
    large = rows.filter(F.col("bytes") >= LEAST_BYTES).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).filter(F.col("n") > 1)
    # the digest anew: both sides are dealt out for the join, and a hot digest can be split
    large = large.select(F.concat("digest", F.lit("")).alias("digest"), "first")
    joined = rows.join(large, "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id")) & (F.col("bytes") >= LEAST_BYTES)
    when = F.date_format(F.timestamp_seconds(F.lit(int(EPOCH.timestamp())) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(SPAN))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    kind = F.when(again, "revisit").otherwise("response")
    refers = F.when(again, F.col("first"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))),
        line("WARC-Target-URI", F.regexp_replace("url", "[\\r\\n]", " ")),
        line("WARC-Date", when),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.when(again, line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">")))).otherwise(""),
        F.when(again, line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(""),
        line("Payload-Length", F.col("bytes").cast("string")),
        F.lit("Content-Type: text/html\r\nContent-Length: "),
        F.when(again, F.lit("0")).otherwise(F.col("bytes").cast("string")),
        F.lit(END),
    )
    return joined.select("page_id", refers.alias("refers_to"), F.concat(header, F.when(again, F.lit("")).otherwise(F.col("html"))).alias("record"))


def write(pages: DataFrame, path: str) -> None:
    """Write the archives, gzip-compressed, below path: one for each partition of the join, whose
    sizes adaptive execution keeps near its advisory size."""
    records(pages).select("record").write.mode("overwrite").option("lineSep", END).option("compression", "gzip").text(path)


def parse(content: bytes):
    """(headers, payload) of each record of an archive; raises if a record is cut short."""
    at = 0
    while at < len(content):
        head = content.index(b"\r\n\r\n", at)
        lines = content[at:head].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        size = int(headers["Content-Length"])
        payload = content[head + 4 : head + 4 + size]
        if len(payload) < size or content[head + 4 + size : head + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} is cut short")
        yield headers, payload
        at = head + 8 + size


def url_key(url: str) -> str:
    """Host labels reversed and joined by commas, `)`, then the rest, without scheme or fragment."""
    rest = url.split("://", 1)[-1].split("#", 1)[0]
    host, slash, path = rest.partition("/")
    return ",".join(reversed(host.lower().split(":")[0].split("."))) + ")" + slash + path


CAPTURE = "run bigint, seq bigint, url_key string, stamp string, page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
FIELDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
NAMES = [x.split()[0] for x in CAPTURE.split(", ")]


def order(row) -> tuple:
    """The order of captures: URL key, timestamp, page; a missing page comes first."""
    return row[2], row[3], (row[4] is not None, row[4] or 0)


def captures(spark: SparkSession, path: str) -> DataFrame:
    """A locally sorted run of captures from each archive below path."""
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    number = lambda x: int(t) if (t := x.removeprefix("<urn:page:").removesuffix(">")) else None

    def run(batches):
        for batch in batches:
            for name, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                run_id = int.from_bytes(hashlib.sha1(name.encode()).digest()[:7], "big")
                rows = []
                for h, payload in parse(gzip.decompress(packed.as_py())):
                    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    if h["WARC-Type"] == "response" and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"a payload of {name} doesn't have its digest")
                    refers = number(h["WARC-Refers-To"]) if "WARC-Refers-To" in h else None
                    rows.append((run_id, 0, url_key(h.get("WARC-Target-URI", "")), h["WARC-Date"], number(h["WARC-Record-ID"]), int(h["Payload-Length"]), digest, h["WARC-Type"], refers))
                rows.sort(key=order)
                rows = [(r[0], k, *r[2:]) for k, r in enumerate(rows)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(FIELDS)], names=NAMES)

    return files.mapInArrow(run, CAPTURE)


class LoserTree:
    """k-way merge: inner nodes keep the loser of the match played there, so a new entry plays log k matches."""

    def __init__(self, runs: list[list]):
        self.iters = [iter(r) for r in runs]
        self.k = max(1, len(runs))
        self.heads = [self.draw(i) for i in range(len(runs))] or [None]
        self.losers = [-1] * self.k
        self.winner = -1
        for i in range(self.k):
            self.play(i, first=True)

    def draw(self, i: int):
        row = next(self.iters[i], None)
        return None if row is None else (order(row), i, row)

    def beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or x[:2] < y[:2])

    def play(self, i: int, first: bool = False) -> None:
        node = (i + self.k) // 2
        while node > 0:
            other = self.losers[node]
            if first and other < 0:
                self.losers[node] = i
                return
            if self.beats(other, i):
                self.losers[node], i = i, other
            node //= 2
        self.winner = i

    def __iter__(self):
        while (head := self.heads[self.winner]) is not None:
            yield head[2]
            self.heads[self.winner] = self.draw(self.winner)
            self.play(self.winner)


def merged(found: DataFrame) -> DataFrame:
    """The captures in global order: partitions are consecutive ranges, rows in order within each."""
    ranges = max(1, math.ceil(found.count() / RANGE))
    dealt = found.repartitionByRange(ranges, "url_key", "stamp", "page_id").sortWithinPartitions("run", "seq")

    def run(batches):
        runs: dict[int, list] = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                runs.setdefault(row[0], []).append(row)
        rows: list = []
        for row in LoserTree(list(runs.values())):
            rows.append(row)
            if len(rows) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(FIELDS)], names=NAMES)
                rows = []
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(FIELDS)], names=NAMES)

    return dealt.mapInArrow(run, CAPTURE)


def archive(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write the pages as archives, read them back, and return the merged capture index.

    Unless a path is given, archives go to the shared folder of the cluster and are dropped once read.
    """
    spark = pages.sparkSession
    own = path is None
    path = path or f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path)
    found = cut(captures(spark, path))
    if own:
        remove(spark, path)
    return merged(found)


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
d AS (SELECT page_id, html, n, sha1(html) AS digest, max(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 1000 AND first IS DISTINCT FROM page_id AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND first IS DISTINCT FROM page_id AND first IS NOT NULL THEN first END AS refers_to
FROM d
"""


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive every page, read the archives back, merge their index."""
    return archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
