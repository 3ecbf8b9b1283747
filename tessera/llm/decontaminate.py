"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Words are runs of letters and digits of the lower-cased text; a shingle is SHINGLE = 5 of them. An item
of one to four words is one shingle of all its words. An item is contained in a document if at least
LEAST = 0.8 of its distinct shingles occur there.

An item with n shingles is in the size partition of n. Its sketch, the smallest hashes of its
shingles, is as long as its partition needs: of k = n - ceil(LEAST * n) + 1 shingles at least one is
in every document that contains the item, so no containment is missed, however long the document.
Each shingle of a document is looked up among the sketches; what matches is a candidate, and only
candidates are compared shingle by shingle, as text.

Sketches are broadcast while the benchmark has at most MAX_BROADCAST sketch hashes, shingles and ids while
their bytes are at most MAX_BYTES; else both sides are dealt out anew. Items without a word are in no
document; null and empty texts hold none. Items of one text are all reported. Repeated rows of a document
id are one document, to which the shingles of all of them count. Rows without an id are never reported.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import free, table
from tessera.session import cut

SHINGLE, LEAST_NUM, LEAST_DEN, MAX_BROADCAST, MAX_BYTES = 5, 4, 5, 1_000_000, 32 << 20


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), "")


def parts(size: int) -> list[Column]:
    """The words of the shingle that begins at place at_ (from 1) of words_."""
    return [F.expr(f"element_at(words_, at_ + {k})") for k in range(size)]


def shingled(rows: DataFrame, size: int, *keep: str) -> DataFrame:
    """A row (kept columns, words_, at_) for each place at which a shingle begins.

    The outer form, whose empty rows go afterwards: for the other Spark adds a filter that takes the
    texts apart once more.
    """
    last = F.size("words_") - (size - 1)
    some = F.when(last >= 1, F.sequence(F.lit(1), last))
    return rows.select(*keep, "words_", F.explode_outer(some).alias("at_")).filter(F.col("at_").isNotNull())


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def item_shingles(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, size, shingle, hash, n) of the distinct shingles of each item; size is in words."""
    rows = benchmark.select(F.col(item_col).alias("item_id"), words(F.coalesce(F.col(text_col), F.lit(""))).alias("words_"))
    rows = rows.withColumn("size", F.least(F.lit(SHINGLE), F.size("words_")))
    each = [
        shingled(rows.filter(F.col("size") == k), k, "item_id", "size").select("item_id", "size", F.concat_ws(" ", *parts(k)).alias("shingle"), F.xxhash64(*parts(k)).alias("hash"))
        for k in range(1, SHINGLE + 1)
    ]
    return union(each).distinct().withColumn("n", F.count("*").over(Window.partitionBy("item_id")))


def sketches(items: DataFrame) -> DataFrame:
    """(item, hash): of each item the smallest hashes, as many as its size partition needs."""
    need = F.col("n") - F.ceil(F.col("n") * LEAST_NUM / LEAST_DEN) + 1
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy("hash", "shingle"))
    return items.withColumn("rank", rank).filter(F.col("rank") <= need).select("item_id", "hash").distinct()


def within(df: DataFrame, size: Column) -> bool:
    """Whether the rows are small enough to broadcast, by the bytes that they hold."""
    return (df.agg(F.sum(size + 48)).first()[0] or 0) <= MAX_BYTES


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shortest: int = 1) -> DataFrame:
    """(id, item_id, n_shingles, n_shared, containment) of each item contained in a document.

    Items of under `shortest` words are left out. The item's column has an underscore more where the id's has its name.
    """
    rows = benchmark.filter(F.size(words(F.coalesce(F.col(item_text_col), F.lit("")))) >= shortest)
    items = cut(item_shingles(rows, item_col, item_text_col))
    sizes = sorted(r[0] for r in items.select("size").distinct().collect()) or [SHINGLE]  # five at most
    sketch = cut(sketches(items))
    taken = docs.select(F.col(id_col).alias("id_"), F.col(text_col).alias("text_"))
    split = taken.select("id_", words(F.col("text_")).alias("words_"))
    hashed = union([shingled(split, k, "id_").select("id_", F.xxhash64(*parts(k)).alias("hash")) for k in sizes])
    side = F.broadcast(sketch) if sketch.count() <= MAX_BROADCAST else sketch.select("item_id", F.col("hash").bitwiseXOR(F.lit(0).cast("bigint")).alias("hash"))
    candidates = cut(hashed.join(side, "hash").filter(F.col("id_").isNotNull()).select("id_", "item_id").distinct())
    # the candidates' documents alone are read again
    ids = candidates.groupBy("id_").agg(F.collect_set("item_id").alias("items_"))
    few = within(ids, F.length(F.col("id_").cast("string")) + 16 * F.size("items_"))
    again = taken.join(F.broadcast(ids) if few else ids, "id_").select("id_", "items_", words(F.col("text_")).alias("words_"))
    each = union([shingled(again, k, "id_", "items_").select("id_", "items_", F.concat_ws(" ", *parts(k)).alias("shingle")) for k in sizes])
    wanted = items.select("item_id", "shingle", "n")
    wanted = F.broadcast(wanted) if within(wanted, F.length("shingle")) else wanted.select("item_id", F.concat("shingle", F.lit("")).alias("shingle"), "n")
    shared = each.join(wanted, "shingle").filter(F.array_contains("items_", F.col("item_id"))).groupBy("id_", "item_id", "n", "shingle").agg(F.lit(1).alias("one"))
    counted = shared.groupBy("id_", "item_id", "n").agg(F.count("*").alias("n_shared"))
    found = counted.filter(F.col("n_shared") * LEAST_DEN >= F.col("n") * LEAST_NUM)
    return found.select(F.col("id_").alias(id_col), F.col("item_id").alias(free("item_id", [id_col])), F.col("n").alias("n_shingles"), "n_shared", (F.col("n_shared") / F.col("n")).alias("containment"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHINGLE) -> DataFrame:
    """The rows, all columns kept, whose text contains no item of at least `shortest` words.

    Shorter items stand in many clean texts, so that finding one doesn't tell a leak. Rows are told by the
    digests of their texts, as ids may be null or repeated: copies of a leak all go, null texts stay.
    """
    key = free("key_", docs.columns)
    rows = docs.withColumn(key, F.md5(F.col(text_col).cast("binary")))
    found = cut(leaks(rows, benchmark, key, text_col, shortest=shortest).select(key).distinct())
    few = within(found, F.lit(32))
    return rows.join(F.broadcast(found) if few else found, key, "left_anti").select(*docs.columns)


SQL = """
WITH item_words AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS w FROM benchmark),
sized_items AS (SELECT item_id, w, least(5, len(w)) AS k FROM item_words WHERE len(w) > 0),
item_shingles AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i+k-1], ' ') AS shingle
  FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM sized_items)),
sized AS (SELECT item_id, shingle, count(*) OVER (PARTITION BY item_id) AS n FROM item_shingles),
doc_words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS w FROM documents),
doc_shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i+k-1], ' ') AS shingle
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc_words JOIN (SELECT DISTINCT k FROM sized_items) ON len(w) >= k))
SELECT doc_id, item_id, n AS n_shingles, count(*) AS n_shared, count(*) / n AS containment
FROM doc_shingles JOIN sized USING (shingle)
WHERE doc_id IS NOT NULL
GROUP BY doc_id, item_id, n
HAVING 5 * count(*) >= 4 * n
"""


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of benchmark that documents contain."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
