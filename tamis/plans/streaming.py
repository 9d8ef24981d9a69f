"""Stateful and event-time queries over events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tamis.catalog import register
from tamis.sources.tables import table
from tamis.streaming import batching as B
from tamis.streaming import cache as C
from tamis.streaming import metrics as M
from tamis.streaming import ratelimit as R

_TS = "yyyy-MM-dd HH:mm:ss"
_TOK = "SELECT doc_id AS stream_id, generate_subscripts(w, 1) - 1 AS token_idx, unnest(w) AS token FROM (SELECT doc_id, regexp_extract_all(text, '[a-zA-Z]+') AS w FROM documents)"


def tokens(spark, d):
    w = F.regexp_extract_all("text", F.lit("[a-zA-Z]+"), 0)
    return table(spark, d, "documents").select(F.col("doc_id").alias("stream_id"), F.posexplode(w).alias("token_idx", "token"))


@register("token_batches", f"SELECT stream_id, CAST(token_idx // 10 AS BIGINT) AS batch, string_agg(token, '' ORDER BY token_idx) AS content, count(*) AS n FROM ({_TOK}) GROUP BY 1, 2")
def token_batches(spark, d):
    return B.batches(tokens(spark, d))


@register("stream_events", f"SELECT stream_id, CAST(token_idx // 10 AS BIGINT) AS batch, 'token' AS event, '{{\"content\":\"' || string_agg(token, '' ORDER BY token_idx) || '\"}}' AS data FROM ({_TOK}) GROUP BY 1, 2 UNION ALL SELECT stream_id, NULL, 'complete', '{{\"tokens_generated\":' || count(*) || '}}' FROM ({_TOK}) GROUP BY 1")
def stream_events(spark, d):
    return B.events(tokens(spark, d))


@register("tumbling_metrics", "SELECT strftime(time_bucket(INTERVAL 5 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def tumbling_metrics(spark, d):
    t = M.tumbling(table(spark, d, "events"), "ts", ["event_type"], "value")
    return t.select(F.date_format("window_start", _TS).alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"), F.round("mean", 6).alias("mean"))


@register("metric_snapshots", "SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, CAST(sum(n) OVER (PARTITION BY event_type ORDER BY w) AS BIGINT) AS n, round(sum(s) OVER (PARTITION BY event_type ORDER BY w), 2) AS total FROM (SELECT time_bucket(INTERVAL 1 DAY, ts) AS w, event_type, count(*) AS n, sum(value) AS s FROM events GROUP BY 1, 2)")
def metric_snapshots(spark, d):
    t = M.snapshots(table(spark, d, "events"), "ts", ["event_type"], "value", "1 day")
    return t.select(F.date_format("window_start", _TS).alias("window_start"), "event_type", "n", F.round("total", 2).alias("total"))


@register("session_windows", "WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, strftime(max(ts) + INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') AS session_end, count(*) AS n FROM s GROUP BY user_id, k")
def session_windows(spark, d):
    s = M.sessions(table(spark, d, "events"), "ts", "user_id", "2 hours")
    return s.select("user_id", F.date_format("session_start", _TS).alias("session_start"), F.date_format("session_end", _TS).alias("session_end"), "n")


@register("request_pairing", "SELECT event_id // 2 AS request_id, min(CASE WHEN event_id % 2 = 0 AND event_type <> 'error' THEN epoch_us(ts) END) IS NOT NULL AS started, max(CASE WHEN event_id % 2 = 1 THEN epoch_us(ts) END) IS NOT NULL AS finished, round((max(CASE WHEN event_id % 2 = 1 THEN epoch_us(ts) END) - min(CASE WHEN event_id % 2 = 0 AND event_type <> 'error' THEN epoch_us(ts) END)) / 1e6, 6) AS seconds FROM events GROUP BY 1")
def request_pairing(spark, d):
    e = table(spark, d, "events").withColumn("rid", F.expr("event_id div 2"))
    phase = F.when((F.col("event_id") % 2 == 0) & (F.col("event_type") != "error"), "start").when(F.col("event_id") % 2 == 1, "finish")
    return M.requests(e, "rid", phase, "ts").withColumn("seconds", F.round("seconds", 6))


@register("hardware_alerts", "SELECT event_id, round(value, 4) AS percent FROM events WHERE value > 80")
def hardware_alerts(spark, d):
    return M.alerts(table(spark, d, "events").select("event_id", F.col("value").alias("percent"))).withColumn("percent", F.round("percent", 4))


@register("job_states", "SELECT user_id AS job_id, arg_max(event_type, struct_pack(ts := ts, p := event_id % 120)) AS status, max(least(greatest(event_id % 120, 0), 100)) AS progress FROM events GROUP BY 1")
def job_states(spark, d):
    u = table(spark, d, "events").select(F.col("user_id").alias("job_id"), "ts", F.col("event_type").alias("status"), (F.col("event_id") % 120).alias("progress"))
    return M.job_states(u)


@register("cache_evictions", "SELECT cache, key FROM (SELECT user_id AS cache, event_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 7, ts, event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE n >= 20 AND rn <= greatest(1, floor(n * 0.2))")
def cache_evictions(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("cache"), F.col("event_id").alias("key"), (F.col("event_id") % 7).alias("access_count"), F.col("ts").alias("last_accessed"))
    return C.evicted(e, "cache", 20)


@register("rate_limit_sliding_log")
def rate_limit_sliding_log(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "ts")
    return R.admit(e, "user_id", "ts", "event_id", limit=3, window_seconds=6 * 3600).select("user_id", "event_id", "accepted")


@register("cache_ttl_hits")
def cache_ttl_hits(spark, d):
    e = table(spark, d, "events").select("event_type", "event_id", "ts")
    return C.ttl_hits(e, "event_type", "ts", "event_id", 600).select("event_type", "event_id", "hit")


@register("streaming_tumbling_metrics", "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def streaming_tumbling_metrics(spark, d):
    """The windowed metric as a stream over the events file, run until its source is used up."""
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    t = M.tumbling(stream, "ts", ["event_type"], "value", "1 hour", "1 hour").select(F.date_format("window_start", _TS).alias("window_start"), "event_type", "n")
    return M.run_available(t, f"metrics_{uuid.uuid4().hex}", "complete")
