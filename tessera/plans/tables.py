"""Joins, sets, rules, plans, feeds and manifests over the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.plans.registry import query, sql_query
from tessera.sources import adapters


sql_query("offset_table", "SELECT vec_id AS frame, 32 + coalesce(CAST(sum(20 + label) OVER (PARTITION BY floor(vec_id / 250) ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS offset_, CAST(20 + label AS BIGINT) AS block_bytes FROM {embeddings}")


@query("digest_manifest", "SELECT doc_id, octet_length(encode(text)) AS bytes, sha256(text) AS sha256, substr(sha256(text), 1, 12) AS name FROM {documents}")
def digest_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = adapters.frame(spark, sf_dir, "documents")
    return d.select("doc_id", F.octet_length("text").cast("bigint").alias("bytes"), F.sha2("text", 256).alias("sha256"), F.substring(F.sha2("text", 256), 1, 12).alias("name"))


@query("exact_dedup_offsets", "WITH d AS (SELECT doc_id, text, octet_length(encode(text)) AS n, min(doc_id) OVER (PARTITION BY text) AS first FROM {documents}), u AS (SELECT doc_id, CAST(sum(n) OVER (ORDER BY doc_id) - n AS BIGINT) AS at FROM d WHERE doc_id = first) SELECT d.doc_id, d.first AS unique_id, u.at AS offset_, n AS bytes FROM d JOIN u ON u.doc_id = d.first")
def exact_dedup_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unique texts in first-seen order; each document gets the offset of its unique copy.

    Texts are grouped by digest, so no text is dealt out. The running sum is taken in two steps: sums
    of ranges of ids, then within each range, so that no task holds all rows.
    """
    d = adapters.frame(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("key"), F.octet_length("text").cast("bigint").alias("n"))
    unique = d.groupBy("key").agg(F.min("doc_id").alias("unique_id"), F.min("n").alias("n"))
    ranged = unique.withColumn("part_", F.floor(F.col("unique_id") / 65536))
    before = ranged.groupBy("part_").agg(F.sum("n").alias("sum_")).withColumn("base_", F.sum("sum_").over(Window.orderBy("part_")) - F.col("sum_"))
    within = F.sum("n").over(Window.partitionBy("part_").orderBy("unique_id")) - F.col("n")
    placed = ranged.withColumn("within_", within).join(before, "part_").select(F.concat("key", F.lit("")).alias("key"), "unique_id", (F.col("base_") + F.col("within_")).alias("offset_"))
    return d.join(placed, "key").select("doc_id", "unique_id", "offset_", F.col("n").alias("bytes"))




sql_query("url_token_append", "SELECT page_id, concat(CASE WHEN instr(url, '#') > 0 THEN substr(url, 1, instr(url, '#') - 1) ELSE url END, CASE WHEN url LIKE '%?%' THEN '&' ELSE '?' END, 't=', page_id, CASE WHEN instr(url, '#') > 0 THEN substr(url, instr(url, '#')) ELSE '' END) AS fresh FROM {pages}")
sql_query("fps_retime", "SELECT id, CAST(floor(bytes * 12 / 15.0e0 + 0.5e0) AS BIGINT) AS frames, bytes * 12 % 15 = 0 AS exact FROM {pieces}")

sql_query("slot_active_sweep", "WITH e AS (SELECT scene, start AS moment, w * h AS area FROM {slots} UNION ALL SELECT scene, stop + 1 AS moment, -(w * h) AS area FROM {slots}), d AS (SELECT scene, moment, CAST(sum(area) AS BIGINT) AS delta FROM e GROUP BY scene, moment) SELECT scene, moment, CAST(sum(delta) OVER (PARTITION BY scene ORDER BY moment) AS BIGINT) AS active FROM d")
sql_query("slot_rules", "SELECT slot, 'bounds' AS rule FROM {slots} WHERE x + w > 16 OR y + h > 8 UNION ALL SELECT slot, 'order' AS rule FROM {slots} WHERE stop < start UNION ALL SELECT s.slot, 'reference' AS rule FROM {slots} s LEFT JOIN (SELECT DISTINCT scene FROM {slots} WHERE flag = 1) f ON f.scene = s.scene WHERE f.scene IS NULL")
sql_query("playable_semi", "SELECT p.id, p.role FROM {pieces} p WHERE EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_partkey = p.id AND l.l_returnflag = 'R')")
sql_query("prune_anti", "SELECT p.id FROM {pieces} p WHERE NOT EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_partkey = p.id AND l.l_quantity > 48)")
sql_query("matrix_vs_reference", "WITH r AS (SELECT codec, min(id) AS id FROM {pieces} GROUP BY codec), f AS (SELECT p.codec, p.bytes FROM {pieces} p JOIN r ON r.id = p.id) SELECT p.id, p.codec, round(100.0e0 * p.bytes / f.bytes, 4) AS pct, p.bytes < f.bytes AS smaller FROM {pieces} p JOIN f ON f.codec = p.codec")
sql_query("ablation_delta", "SELECT id, codec, bytes - first_value(bytes) OVER (PARTITION BY codec ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS delta FROM {pieces}")
sql_query("variant_cross", "SELECT a.codec, k.crf, concat(a.codec, '@', k.crf) AS variant FROM (SELECT DISTINCT codec FROM {pieces}) a CROSS JOIN (SELECT CAST(c AS BIGINT) AS crf FROM (VALUES (10), (18), (26), (34)) AS t(c)) k")
sql_query("recipe_strings", "SELECT id, concat_ws(' ', 'crf', CAST(priority AS {text}), CASE WHEN id % 2 = 0 THEN 'profile baseline' END, concat('g', CAST(bytes % 60 AS {text}))) AS recipe FROM {pieces}")
sql_query("cut_plan", "SELECT id, priority AS intro, bytes % 97 AS period, round((bytes % 97 + 1) / 15.0e0, 6) AS loop_seconds, priority + bytes % 97 AS stop FROM {pieces}")
sql_query("smallest_candidate", "WITH c AS (SELECT id, bytes AS n, 0 AS rank, 'raw' AS kind FROM {pieces} UNION ALL SELECT id, priority * 40 AS n, 1 AS rank, 'packed' AS kind FROM {pieces} UNION ALL SELECT id, bytes % 1000 + 300 AS n, 2 AS rank, 'delta' AS kind FROM {pieces}) SELECT id, kind, n FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n, rank) AS k FROM c) WHERE k = 1")
sql_query("part_concatenation", "SELECT id, role, bytes, CAST(coalesce(sum(bytes) OVER (PARTITION BY role ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset_ FROM {pieces}")
sql_query("residency_totals", "SELECT role, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes FROM {pieces} GROUP BY role")
sql_query("memory_bound", "SELECT id, 64 * priority * 2 + 256 * 4 + 32 + bytes AS bytes_held FROM {pieces}")
sql_query("transcode_statistics", "SELECT codec, CAST(sum(bytes) AS BIGINT) AS input_bytes, CAST(sum(least(bytes, priority * 40)) AS BIGINT) AS output_bytes, round(100 - 100.0e0 * sum(least(bytes, priority * 40)) / sum(bytes), 4) AS saved_pct FROM {pieces} GROUP BY codec")
sql_query("exact_sum_decimal", "SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM {lineitem} GROUP BY l_returnflag, l_linestatus")

ACCEPT = "a AS (SELECT channel, event_id, ts, serial, max(serial) OVER (PARTITION BY channel ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM {feed})"
sql_query("serial_monotone_accept", f"WITH {ACCEPT} SELECT channel, event_id, serial, top IS NULL OR serial > top AS accepted FROM a")
sql_query("backoff_delay", "WITH e AS (SELECT channel, event_id, ts, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS failed FROM {feed}), g AS (SELECT *, sum(1 - failed) OVER (PARTITION BY channel ORDER BY ts, event_id) AS island FROM e), r AS (SELECT channel, event_id, failed, CAST(sum(failed) OVER (PARTITION BY channel, island ORDER BY ts, event_id) AS BIGINT) AS failures FROM g) SELECT channel, event_id, failures, CAST(least(16000, 1000 * pow(2, failures)) AS BIGINT) AS delay FROM r")
sql_query("hysteresis_latch", "WITH q AS (SELECT channel, event_id, ts, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY channel ORDER BY ts, event_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) / 8.0e0 AS share FROM {feed}), d AS (SELECT *, CASE WHEN share >= 0.7e0 THEN 1 WHEN share < 0.45e0 THEN 0 END AS decisive FROM q) SELECT channel, event_id, round(share, 6) AS share, coalesce(last_value(decisive IGNORE NULLS) OVER (PARTITION BY channel ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS latched FROM d")
sql_query("drop_accounting", f"WITH {ACCEPT} SELECT channel, count(*) AS seen, CAST(sum(CASE WHEN top IS NULL OR serial > top THEN 1 ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN serial < top THEN 1 ELSE 0 END) AS BIGINT) AS late FROM a GROUP BY channel")
sql_query("quality_gates", "SELECT event_type, round(avg(value), 6) AS mean, max(value) <= 1000 AS start_gate, avg(CASE WHEN value > 90 THEN 1.0e0 ELSE 0.0e0 END) <= 0.03e0 AS dropped_gate FROM {feed} GROUP BY event_type")
sql_query("frame_at_clock", "WITH t AS (SELECT channel, event_id, ts, CAST(floor(value * 15) AS BIGINT) AS frame FROM {feed}) SELECT channel, event_id, frame, greatest(CAST(0 AS BIGINT), lead(frame) OVER (PARTITION BY channel ORDER BY ts, event_id) - frame - 1) AS dropped FROM t")
sql_query("text_layer_latest", "SELECT channel, digits FROM (SELECT channel, digits, row_number() OVER (PARTITION BY channel ORDER BY ts DESC, event_id DESC) AS k FROM {feed}) WHERE k = 1")
sql_query("keyed_upsert_latest", "SELECT user_id, event_id, event_type FROM (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM {feed}) WHERE k = 1")
sql_query("cache_ensure", "SELECT p.id, CASE WHEN l.l_partkey IS NULL THEN 'network' ELSE 'cache' END AS origin FROM {pieces} p LEFT JOIN (SELECT DISTINCT l_partkey FROM {lineitem} WHERE l_linenumber = 1) l ON l.l_partkey = p.id")
sql_query("counter_deltas", "SELECT channel, abs(max(serial) - min(serial)) AS moved, count(*) AS n FROM {feed} GROUP BY channel")


@query("tumbling_windows", "SELECT event_type, strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS hour, count(*) AS n, round(sum(value), 4) AS total FROM {feed} GROUP BY 1, 2")
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = adapters.feed(spark, sf_dir)
    return f.groupBy("event_type", F.window("ts", "1 hour")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select("event_type", F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("hour"), "n", "total")


@query("session_windows", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM {feed}), s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, count(*) AS n FROM s GROUP BY user_id, session")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = adapters.feed(spark, sf_dir)
    return f.groupBy("user_id", F.session_window("ts", "30 minutes").alias("s")).agg(F.count("*").alias("n")).select("user_id", F.date_format("s.start", "yyyy-MM-dd HH:mm:ss").alias("first"), "n")


sql_query("rollup_orders", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM {orders} GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
sql_query("cube_parts", "SELECT codec, priority % 5 AS band, count(*) AS n FROM {pieces} GROUP BY CUBE (codec, priority % 5)".replace("priority % 5 AS band", "band").replace("CUBE (codec, priority % 5)", "CUBE (codec, band)").replace("{pieces}", "(SELECT codec, priority % 5 AS band FROM {pieces}) AS p"))
sql_query("set_intersect", "SELECT c_nationkey AS nation FROM {customer} INTERSECT SELECT s_nationkey AS nation FROM {supplier}")
sql_query("set_except", "SELECT c_custkey AS id FROM {customer} EXCEPT SELECT o_custkey AS id FROM {orders} WHERE o_totalprice > 480000")
sql_query("outer_join_nations", "SELECT n.n_name, count(DISTINCT c.c_custkey) AS customers, count(DISTINCT s.s_suppkey) AS suppliers FROM {nation} n LEFT JOIN {customer} c ON c.c_nationkey = n.n_nationkey LEFT JOIN {supplier} s ON s.s_nationkey = n.n_nationkey GROUP BY n.n_name")
sql_query("pricing_summary", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS discount, count(*) AS n FROM {lineitem} GROUP BY l_returnflag, l_linestatus")
