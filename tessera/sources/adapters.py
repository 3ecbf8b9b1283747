"""The model's tables over the given Parquet tables, as DataFrames, and the same for DuckDB as SQL.

`cells` are the elements of an embedding as an 8 x 8 grid of bytes, `pixels` its 21 colour triples,
`keys` the frames that open a group of KEYINT, `feed` the events as serial numbers and digits by user,
`pieces` and `matrix` the parts as priced media, `slots` the line items as rectangles in time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Frames of a key group and of a clip: a clip is a sequence of its own, and what is in order of frames is so by clip.
KEYINT, CLIP = 15, 250
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame, cell, x, y, value): one row a cell; all bigint."""
    big = lambda c: c.cast("bigint")
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("frame"), F.posexplode("embedding").alias("pos", "v"))
    value = F.least(F.lit(255), F.greatest(F.lit(0), F.floor((F.col("v").cast("double") + 1) * 127.5)))
    return rows.select("frame", big(F.col("pos")).alias("cell"), big(F.col("pos") % 8).alias("x"), big(F.floor(F.col("pos") / 8)).alias("y"), big(value).alias("value"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame, px, r, g, b): 21 colours a frame."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("frame"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("px"))
    channel = lambda k: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((F.element_at("embedding", F.col("px") * 3 + k).cast("double") + 1) * 127.5))).cast("bigint")
    return e.select("frame", F.col("px").cast("bigint").alias("px"), channel(1).alias("r"), channel(2).alias("g"), channel(3).alias("b"))


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(clip, frame, cells): the 64 values of a frame as one array, for work that needs whole frames."""
    value = lambda v: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((v.cast("double") + 1) * 127.5))).cast("int")
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.floor(F.col("vec_id") / CLIP).alias("clip"), F.col("vec_id").alias("frame"), F.transform("embedding", value).alias("cells"))


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(channel, ts, serial, digits): events as a serial feed; ts as timestamp."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    digits = F.lpad(F.floor("value").cast("string"), 4, "0")
    return e.select(F.col("user_id").alias("channel"), F.col("ts").cast("timestamp").alias("ts"), ((F.col("event_id") * 7919) % 10007).alias("serial"), digits.alias("digits"), "event_id", "user_id", "event_type", "value")


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, codec, role, priority, bytes, metric): parts as media pieces."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("codec"), F.col("p_type").alias("role"), F.col("p_size").cast("bigint").alias("priority"), F.floor("p_retailprice").cast("bigint").alias("bytes"), F.col("p_retailprice").alias("metric"))


def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(slot, scene, x, y, w, h, start, stop, flag): line items as rectangles in time."""
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    n, s = F.col("l_linenumber").cast("bigint"), F.col("l_suppkey")
    begin = F.col("l_orderkey") % 500
    return l.select((F.col("l_orderkey") * 10 + n).alias("slot"), F.floor(F.col("l_orderkey") / 20).cast("bigint").alias("scene"), (n * 3 % 16).alias("x"), (s % 8).alias("y"), (1 + n % 3).alias("w"), (1 + n % 3).alias("h"), begin.alias("start"), (begin + n).alias("stop"), (s % 2).alias("flag"))


ADAPTERS = {"cells": cells, "pixels": pixels, "feed": feed, "pieces": pieces, "slots": slots}
#: The same tables for DuckDB.
SQL = {
    "cells": "SELECT vec_id AS frame, CAST(i - 1 AS BIGINT) AS cell, CAST((i - 1) % 8 AS BIGINT) AS x, CAST(floor((i - 1) / 8) AS BIGINT) AS y, CAST(least(255, greatest(0, floor((CAST(embedding[i] AS DOUBLE) + 1) * 127.5))) AS BIGINT) AS value FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings)",
    "pixels": "SELECT vec_id AS frame, CAST(p AS BIGINT) AS px, " + ", ".join(f"CAST(least(255, greatest(0, floor((CAST(embedding[p * 3 + {k}] AS DOUBLE) + 1) * 127.5))) AS BIGINT) AS {c}" for k, c in ((1, "r"), (2, "g"), (3, "b"))) + " FROM (SELECT vec_id, embedding, unnest(range(0, 21)) AS p FROM embeddings)",
    "feed": "SELECT user_id AS channel, ts, (event_id * 7919) % 10007 AS serial, CASE WHEN length(CAST(CAST(floor(value) AS BIGINT) AS VARCHAR)) >= 4 THEN substr(CAST(CAST(floor(value) AS BIGINT) AS VARCHAR), 1, 4) ELSE lpad(CAST(CAST(floor(value) AS BIGINT) AS VARCHAR), 4, '0') END AS digits, event_id, user_id, event_type, value FROM events",
    "pieces": "SELECT p_partkey AS id, p_brand AS codec, p_type AS role, CAST(p_size AS BIGINT) AS priority, CAST(floor(p_retailprice) AS BIGINT) AS bytes, p_retailprice AS metric FROM part",
    "slots": "SELECT l_orderkey * 10 + l_linenumber AS slot, CAST(floor(l_orderkey / 20) AS BIGINT) AS scene, CAST(l_linenumber * 3 % 16 AS BIGINT) AS x, l_suppkey % 8 AS y, CAST(1 + l_linenumber % 3 AS BIGINT) AS w, CAST(1 + l_linenumber % 3 AS BIGINT) AS h, l_orderkey % 500 AS start, l_orderkey % 500 + l_linenumber AS stop, l_suppkey % 2 AS flag FROM lineitem",
}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ADAPTERS[name](spark, sf_dir) if name in ADAPTERS else spark.read.parquet(f"{sf_dir}/{name}.parquet")
