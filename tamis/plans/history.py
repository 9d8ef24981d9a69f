"""Conversation, session, user and metric queries. Users are customers, sessions orders, history line items."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tamis.catalog import register
from tamis.operators import admission as A
from tamis.operators import history as H
from tamis.sources.tables import table

NOW = "TIMESTAMP '1998-12-31 00:00:00'"


def ts(c: str):
    return F.col(c).cast("timestamp")


def users(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"))


def sessions(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("session_id"), ts("o_orderdate").alias("updated_at"), (F.col("o_orderstatus") == "O").alias("is_active"))


def history(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_linenumber").alias("id"), F.col("l_orderkey").alias("session_id"), F.col("l_discount").alias("confidence_score"), F.col("l_quantity").alias("processing_time"))


def _mean_sql(c: str) -> str:
    """Mean to six places in whole numbers, so that no order of summing shows."""
    return f"((sum(CAST(round({c} * 10000) AS HUGEINT)) * 200 + count({c})) // (2 * count({c}))) / 1e6"


@register("user_chat_statistics", f"""SELECT c_custkey AS user_id, c_name AS username, count(DISTINCT o_orderkey) AS total_sessions, count(l_linenumber) AS total_messages,
{_mean_sql('l_discount')} AS avg_confidence_score, {_mean_sql('l_quantity')} AS avg_processing_time, strftime(max(o_orderdate), '%Y-%m-%d') AS last_activity
FROM customer LEFT JOIN orders ON c_custkey = o_custkey LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2""")
def user_chat_statistics(spark, d):
    out = H.user_chat_statistics(users(spark, d), sessions(spark, d), history(spark, d))
    return out.select("user_id", "username", "total_sessions", "total_messages", "avg_confidence_score", "avg_processing_time", F.date_format("last_activity", "yyyy-MM-dd").alias("last_activity"))


@register("active_filter_counts", "SELECT o_custkey AS user_id, count(o_orderkey) AS total_sessions, count(*) FILTER (WHERE o_orderstatus = 'O') AS active_sessions FROM orders GROUP BY 1")
def active_filter_counts(spark, d):
    return H.session_counts(sessions(spark, d))


@register("user_totals_rounded", """SELECT user_id, count(*) AS total_messages, coalesce(round(avg(value), 3), 0) AS avg_processing_time,
coalesce(round(avg(CASE WHEN event_type = 'view' THEN (event_id % 100) / 100.0 END), 3), 0) AS avg_confidence, CAST(sum(event_id % 7) AS BIGINT) AS total_tokens, coalesce(round(sum(round(value * 100) / 10000), 4), 0) AS total_cost FROM events GROUP BY 1""")
def user_totals_rounded(spark, d):
    e = table(spark, d, "events")
    rows = e.select("user_id", F.col("value").alias("processing_time"), F.when(F.col("event_type") == "view", (F.col("event_id") % 100) / 100.0).alias("confidence_score"), (F.col("event_id") % 7).alias("tokens_used"), (F.round(F.col("value") * 100) / 10000).alias("cost"))
    return H.message_totals(rows)


@register("session_stats_duration", """SELECT user_id, count(*) AS total_messages, round(avg(value), 6) AS avg_processing_time, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9, 6) AS duration_hours,
strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_activity FROM events GROUP BY 1""")
def session_stats_duration(spark, d):
    g = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("total_messages"), F.round(F.avg("value"), 6).alias("avg_processing_time"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    return g.select("user_id", "total_messages", "avg_processing_time", F.round(H.hours_between(F.col("a"), F.col("b")), 6).alias("duration_hours"), F.date_format(ts("b"), "yyyy-MM-dd HH:mm:ss").alias("last_activity"))


@register("old_data_counts", f"""SELECT count(*) FILTER (WHERE o_orderdate < {NOW} - INTERVAL 365 DAY AND o_orderstatus <> 'O') AS old_sessions,
count(*) FILTER (WHERE o_orderdate < {NOW} - INTERVAL 1000 DAY) AS old_history, count(*) AS all_rows FROM orders""")
def old_data_counts(spark, d):
    old = lambda n: F.col("updated_at") < F.expr(f"{NOW} - INTERVAL {n} DAYS")
    return sessions(spark, d).agg(F.count_if(old(365) & ~F.col("is_active")).alias("old_sessions"), F.count_if(old(1000)).alias("old_history"), F.count("*").alias("all_rows"))


@register("sessions_newest_first", "SELECT o_orderkey AS session_id, o_custkey AS user_id, strftime(o_orderdate, '%Y-%m-%d') AS updated FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def sessions_newest_first(spark, d):
    rows = sessions(spark, d).filter("is_active").orderBy(F.desc("updated_at"), "session_id").limit(50)
    return rows.select("session_id", "user_id", F.date_format("updated_at", "yyyy-MM-dd").alias("updated"))


@register("uniqueness_lookup", "SELECT c_custkey AS user_id, c_name AS username FROM customer WHERE c_name = 'Customer#000000017' OR lower(c_mktsegment) = 'building' AND c_nationkey = 3 OR c_custkey = 5")
def uniqueness_lookup(spark, d):
    hit = (F.col("c_name") == "Customer#000000017") | ((F.lower("c_mktsegment") == "building") & (F.col("c_nationkey") == 3)) | (F.col("c_custkey") == 5)
    return table(spark, d, "customer").filter(hit).select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"))


@register("last_n_history", """SELECT conv_id, turn, role, CAST(rn AS BIGINT) AS from_end FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 5""")
def last_n_history(spark, d):
    return H.last_n(table(spark, d, "conversations"), "conv_id", ["turn"]).select("conv_id", "turn", "role", F.col("from_end").cast("long").alias("from_end"))


@register("last_n_per_user", """SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 50""")
def last_n_per_user(spark, d):
    return H.last_n(table(spark, d, "events"), "user_id", ["ts", "event_id"], H.LAST_PER_USER).select("user_id", "event_id")


@register("rolling_history", """SELECT conv_id, turn, string_agg_list AS recent FROM (SELECT conv_id, turn, array_to_string(list(role || turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), ',') AS string_agg_list FROM conversations)""")
def rolling_history(spark, d):
    out = H.rolling_history(table(spark, d, "conversations"), "conv_id", ["turn"], F.concat("role", F.col("turn").cast("string")))
    return out.select("conv_id", "turn", F.array_join("recent", ",").alias("recent"))


_DISTINCT = "SELECT conv_id, turn, role, text FROM (SELECT conv_id, turn, role, trim(text) AS text, row_number() OVER (PARTITION BY conv_id, role, trim(text) ORDER BY turn) AS n FROM conversations WHERE trim(text) <> '') WHERE n = 1"


@register("dedup_turns", f"SELECT conv_id, turn, role, length(text) AS n_chars FROM ({_DISTINCT})")
def dedup_turns(spark, d):
    return H.distinct_turns(table(spark, d, "conversations")).select("conv_id", "turn", "role", F.length("text").cast("long").alias("n_chars"))


@register("turn_pairs", f"""SELECT conv_id, turn, length(text) AS question_chars, length(answer) AS answer_chars FROM (
SELECT *, row_number() OVER w - 1 AS a, lead(role) OVER w AS next_role, lead(text) OVER w AS answer FROM ({_DISTINCT}) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE a % 2 = 0 AND role = 'user' AND next_role = 'assistant'""")
def turn_pairs(spark, d):
    out = H.turn_pairs(H.distinct_turns(table(spark, d, "conversations")))
    return out.select("conv_id", "turn", F.length("question").cast("long").alias("question_chars"), F.length("answer").cast("long").alias("answer_chars"))


@register("last_messages_json", """SELECT conv_id, '[' || string_agg('{"turn":' || turn || ',"role":"' || role || '"}', ',' ORDER BY turn DESC) || ']' AS messages FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 5 GROUP BY 1""")
def last_messages_json(spark, d):
    rows = H.last_n(table(spark, d, "conversations"), "conv_id", ["turn"])
    listed = F.sort_array(F.collect_list(F.struct("turn", "role")), asc=False)  # five at most
    return rows.groupBy("conv_id").agg(F.to_json(listed).alias("messages"))


@register("eager_one_to_many", """SELECT c_custkey AS user_id, coalesce(array_to_string(list(o_orderkey ORDER BY o_orderkey) FILTER (WHERE o_orderkey IS NOT NULL), ','), '') AS session_ids FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1""")
def eager_one_to_many(spark, d):
    lists = sessions(spark, d).groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list("session_id")), ",").alias("session_ids"))
    return users(spark, d).select("user_id").join(lists, "user_id", "left").fillna("", ["session_ids"])


_GONE = "SELECT c_custkey FROM customer WHERE c_acctbal < 0"


@register("delete_cascade", f"SELECT o_orderkey AS session_id, o_custkey AS user_id FROM orders WHERE o_custkey NOT IN ({_GONE})")
def delete_cascade(spark, d):
    gone = table(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("user_id"))
    return H.delete_cascade(users(spark, d), sessions(spark, d), "user_id", gone)[1].select("session_id", "user_id")


@register("delete_set_null", f"SELECT o_orderkey AS session_id, CASE WHEN o_custkey NOT IN ({_GONE}) THEN o_custkey END AS user_id FROM orders")
def delete_set_null(spark, d):
    gone = table(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("user_id"))
    return H.delete_set_null(sessions(spark, d), "user_id", gone).select("session_id", "user_id")


@register("create_user_guarded", """SELECT c_custkey AS user_id, c_name AS username FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 <> 0""")
def create_user_guarded(spark, d):
    u = users(spark, d)
    return H.insert_new(u.filter("user_id % 2 = 0"), u.filter("user_id % 3 = 0"), ["user_id", "username"])


@register("get_or_create_session", """WITH asked AS (SELECT c_custkey AS user_id, c_custkey * 4 AS session_id FROM customer)
SELECT a.session_id, a.user_id, o.o_orderkey IS NULL AS created, 'web' || CASE WHEN o.o_orderkey IS NULL THEN '' ELSE '/' || o.o_orderstatus END AS origin FROM asked a LEFT JOIN orders o ON o.o_orderkey = a.session_id""")
def get_or_create_session(spark, d):
    asked = users(spark, d).select("user_id", (F.col("user_id") * 4).alias("session_id"))
    known = table(spark, d, "orders").select(F.col("o_orderkey").alias("session_id"), F.create_map(F.lit("status"), F.col("o_orderstatus")).alias("metadata"))
    joined = asked.join(known, "session_id", "left")
    merged = H.merge_maps(F.coalesce("metadata", F.create_map().cast("map<string,string>")), F.create_map(F.lit("origin"), F.lit("web")))
    return joined.select("session_id", "user_id", F.col("metadata").isNull().alias("created"), F.concat_ws("/", merged["origin"], F.try_element_at(merged, F.lit("status"))).alias("origin"))


@register("deactivate_old_sessions", f"""SELECT o_orderkey AS session_id, o_orderstatus = 'O' AND NOT o_orderdate < {NOW} - INTERVAL 400 DAY AS is_active,
CASE WHEN o_orderstatus = 'O' AND o_orderdate < {NOW} - INTERVAL 400 DAY THEN 'automatic_cleanup' END AS reason FROM orders""")
def deactivate_old_sessions(spark, d):
    s = sessions(spark, d).withColumn("metadata", F.create_map(F.lit("kind"), F.lit("chat")))
    out = H.deactivate_old(s, F.expr(f"{NOW} - INTERVAL 400 DAYS"), F.expr(NOW))
    return out.select("session_id", "is_active", F.try_element_at("metadata", F.lit("deactivation_reason")).alias("reason"))


@register("upsert_config", """SELECT coalesce(a.k, b.k) AS k, coalesce(b.v, a.v) AS v FROM (SELECT n_name AS k, n_regionkey AS v FROM nation WHERE n_nationkey < 20) a
FULL JOIN (SELECT n_name AS k, CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey + 100 END AS v FROM nation WHERE n_nationkey > 10) b USING (k)""")
def upsert_config(spark, d):
    n = table(spark, d, "nation")
    old = n.filter("n_nationkey < 20").select(F.col("n_name").alias("k"), F.col("n_regionkey").alias("v"))
    return H.upsert(old, n.filter("n_nationkey > 10").select(F.col("n_name").alias("k"), F.expr("case when n_nationkey % 2 = 0 then n_regionkey + 100 end").alias("v")), "k")


@register("update_user_allowed", "SELECT c_custkey AS user_id, c_name AS username, CASE WHEN c_custkey % 5 = 0 THEN 'VIP' ELSE c_mktsegment END AS segment FROM customer")
def update_user_allowed(spark, d):
    u = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"), F.col("c_mktsegment").alias("segment"))
    changes = u.filter("user_id % 5 = 0").select("user_id", F.lit("hacked").alias("username"), F.lit("VIP").alias("segment"))
    return H.update_fields(u, changes, "user_id", ["segment"])


@register("context_cleanup", """SELECT conv_id, CAST(count(*) AS BIGINT) AS n_keys FROM conversations WHERE role NOT IN ('pending_clarification', 'clarification_attempt') GROUP BY conv_id""")
def context_cleanup(spark, d):
    entries = F.collect_list(F.struct(F.concat("role", F.col("turn").cast("string")).alias("k"), F.col("text").alias("v")))
    m = table(spark, d, "conversations").groupBy("conv_id").agg(F.map_from_entries(entries).alias("m"))
    m = m.withColumn("m", H.merge_maps(F.col("m"), F.create_map(F.lit("pending_clarification"), F.lit("x"), F.lit("last_clarification"), F.lit("y"))))
    return m.select("conv_id", F.size(H.drop_transient(F.col("m"))).cast("long").alias("n_keys"))


@register("method_running_means", """SELECT event_type AS method, count(*) AS total, count(*) FILTER (WHERE event_type <> 'error' AND value > 20) AS success, round(avg(value), 6) AS avg_time, round(avg(event_id % 13), 6) AS avg_results FROM events GROUP BY 1""")
def method_running_means(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.col("event_type").alias("method")).agg(F.count("*").alias("total"), F.count_if((F.col("event_type") != "error") & (F.col("value") > 20)).alias("success"), F.round(F.avg("value"), 6).alias("avg_time"), F.round(F.avg(F.col("event_id") % 13), 6).alias("avg_results"))


@register("timer_stats", "SELECT event_type AS timer, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most FROM events GROUP BY 1")
def timer_stats(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("timer")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"))


@register("counters", "SELECT event_type AS name, CAST(sum(event_id % 5) AS BIGINT) AS total FROM events GROUP BY 1")
def counters(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("name")).agg(F.sum(F.col("event_id") % 5).alias("total"))


@register("model_inference_averages", "SELECT user_id, count(*) AS calls, CAST(sum(event_id % 100) AS BIGINT) AS tokens, round(sum(value) / count(*), 6) AS avg_time, round(sum(event_id % 100) / greatest(count(*), 1), 6) AS tokens_per_call FROM events GROUP BY 1")
def model_inference_averages(spark, d):
    g = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("calls"), F.sum(F.col("event_id") % 100).alias("tokens"), F.sum("value").alias("s"))
    return g.select("user_id", "calls", "tokens", F.round(F.col("s") / F.col("calls"), 6).alias("avg_time"), F.round(F.col("tokens") / F.greatest("calls", F.lit(1)), 6).alias("tokens_per_call"))


@register("metrics_summary", "SELECT count(*) AS total_searches, round(sum(value) / greatest(1, count(*)), 6) AS avg_time, round(sum(event_id % 13) / greatest(1, count(*)), 6) AS avg_results FROM events WHERE event_type = 'view'")
def metrics_summary(spark, d):
    g = table(spark, d, "events").filter("event_type = 'view'").agg(F.count("*").alias("n"), F.coalesce(F.sum("value"), F.lit(0.0)).alias("s"), F.coalesce(F.sum(F.col("event_id") % 13), F.lit(0)).alias("r"))
    n = F.greatest("n", F.lit(1))
    return g.select(F.col("n").alias("total_searches"), F.round(F.col("s") / n, 6).alias("avg_time"), F.round(F.col("r") / n, 6).alias("avg_results"))


@register("hit_rate", "SELECT user_id, count(*) FILTER (WHERE event_type IN ('view', 'click')) AS hits, count(*) AS lookups, round(100.0 * count(*) FILTER (WHERE event_type IN ('view', 'click')) / count(*), 2) AS hit_rate FROM events GROUP BY 1")
def hit_rate(spark, d):
    g = table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type").isin("view", "click")).alias("hits"), F.count("*").alias("lookups"))
    return g.withColumn("hit_rate", F.round(100.0 * F.col("hits") / F.col("lookups"), 2))


@register("context_confidence", "SELECT c_nationkey AS query_id, coalesce(round(avg(CASE WHEN c_acctbal >= 5000 THEN c_acctbal / 10000 END), 6), 0) AS confidence FROM customer GROUP BY 1")
def context_confidence(spark, d):
    return table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("query_id")).agg(F.coalesce(F.round(F.avg(F.when(F.col("c_acctbal") >= 5000, F.col("c_acctbal") / 10000)), 6), F.lit(0.0)).alias("confidence"))


_COMPONENT = "CASE event_id % 5 WHEN 0 THEN 'database' WHEN 1 THEN 'elasticsearch' WHEN 2 THEN 'redis' WHEN 3 THEN 'model' ELSE 'cache' END"


@register("health_verdict", f"""SELECT user_id, CASE WHEN count(DISTINCT CASE WHEN c <> 'cache' AND up THEN c END) < 4 THEN 'unhealthy' WHEN NOT bool_and(up) THEN 'degraded' ELSE 'healthy' END AS verdict FROM (
SELECT user_id, {_COMPONENT} AS c, event_type <> 'error' AS up FROM events) GROUP BY 1""")
def health_verdict(spark, d):
    s = table(spark, d, "events").select("user_id", F.expr(_COMPONENT).alias("component"), (F.col("event_type") != "error").alias("up"))
    return A.health_verdict(s, ["user_id"])


_IP = "'10.' || (user_id % 4) || '.' || (user_id % 256) || '.' || (event_id % 300)"
NETWORKS = ["10.0.0.0/16", "10.1.64.0/18", "10.2.7.7/32"]
_NUM = f"CASE WHEN event_id % 300 <= 255 THEN 167772160 + (user_id % 4) * 65536 + (user_id % 256) * 256 + event_id % 300 END"
_TRUST = f"coalesce(({_NUM}) BETWEEN 167772160 AND 167837695 OR ({_NUM}) BETWEEN 167854080 AND 167870463 OR ({_NUM}) = 167905031, false)"


@register("cidr_match", f"SELECT event_id, {_IP} AS ip, {_TRUST} AS trusted FROM events")
def cidr_match(spark, d):
    rows = table(spark, d, "events").select("event_id", F.expr(_IP).alias("ip"))
    return rows.withColumn("trusted", A.ip_trusted(F.col("ip"), NETWORKS))


_PATH = "CASE event_id % 6 WHEN 0 THEN '/docs' WHEN 1 THEN '/docs#x' WHEN 2 THEN '/health' WHEN 3 THEN '/static/a.css' ELSE '/api/chat' END"
EXCLUDED = ["/health", "/static/*"]


@register("path_exclusion", f"SELECT event_id, {_PATH} AS path, ({_PATH}) = '/health' OR starts_with({_PATH}, '/static/') AS excluded FROM events")
def path_exclusion(spark, d):
    rows = table(spark, d, "events").select("event_id", F.expr(_PATH).alias("path"))
    return rows.withColumn("excluded", A.path_excluded(F.col("path"), EXCLUDED))


@register("admission_verdict", f"""SELECT event_id, CASE WHEN value > 95 THEN 'rate_limited' WHEN ({_PATH}) IN ('/docs', '/docs#x') AND {_TRUST} THEN 'allowed_docs' WHEN ({_PATH}) IN ('/docs', '/docs#x') THEN 'forbidden_docs'
WHEN ({_PATH}) IN ('/health', '/static/a.css') THEN 'allowed_excluded' WHEN {_TRUST} THEN 'allowed_trusted' WHEN event_type = 'purchase' THEN 'allowed_key' ELSE 'unauthorized' END AS verdict FROM events""")
def admission_verdict(spark, d):
    rows = table(spark, d, "events").select("event_id", "value", "event_type", F.expr(_IP).alias("ip"), F.expr(_PATH).alias("path"))
    return rows.select("event_id", A.admission_verdict(F.col("value") <= 95, F.col("path"), A.ip_trusted(F.col("ip"), NETWORKS), F.col("event_type") == "purchase", EXCLUDED).alias("verdict"))


@register("key_expiry", f"SELECT o_orderkey AS key_id, coalesce(CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate END < {NOW} - INTERVAL 700 DAY, false) AS expired FROM orders")
def key_expiry(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("key_id"), A.key_expired(F.when(F.col("o_orderkey") % 4 != 0, ts("o_orderdate")), F.expr(f"{NOW} - INTERVAL 700 DAYS")).alias("expired"))


@register("field_validators", """SELECT c_custkey AS user_id, regexp_matches(c_name || CASE WHEN c_custkey % 3 = 0 THEN '@x.org' ELSE '@x' END, '^[^@]+@[^@]+\\.[^@]+') AS email_ok,
regexp_matches(c_name, '^[a-zA-Z0-9_-]+$') AND length(c_name) BETWEEN 3 AND 50 AS username_ok, regexp_matches(c_mktsegment, '^[a-zA-ZÀ-ÿ\\s-]+$') AND length(c_mktsegment) BETWEEN 3 AND 100 AS name_ok FROM customer""")
def field_validators(spark, d):
    email = F.concat("c_name", F.when(F.col("c_custkey") % 3 == 0, "@x.org").otherwise("@x"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), A.valid_email(email).alias("email_ok"), A.valid_username(F.col("c_name")).alias("username_ok"), A.valid_full_name(F.col("c_mktsegment")).alias("name_ok"))


@register("check_constraints", """SELECT l_orderkey, l_linenumber, l_discount BETWEEN 0 AND 0.05 AS confidence_ok, l_quantity - 25 >= 0 AS tokens_ok, l_returnflag IN ('A', 'N') AS status_ok FROM lineitem WHERE NOT (l_discount BETWEEN 0 AND 0.05 AND l_quantity - 25 >= 0 AND l_returnflag IN ('A', 'N'))""")
def check_constraints(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", A.in_unit_range(F.col("l_discount") * 20).alias("confidence_ok"), A.not_negative(F.col("l_quantity") - 25).alias("tokens_ok"), F.col("l_returnflag").isin("A", "N").alias("status_ok"))
    return rows.filter(~(F.col("confidence_ok") & F.col("tokens_ok") & F.col("status_ok")))


@register("safe_casts", """SELECT doc_id, coalesce(TRY_CAST(regexp_extract(source, '[0-9]+') AS DOUBLE), 0.0) AS as_float, coalesce(TRY_CAST(source AS BIGINT), -1) AS as_int, coalesce(CASE WHEN doc_id % 2 = 0 THEN lang END, '') AS as_string FROM documents""")
def safe_casts(spark, d):
    return table(spark, d, "documents").select("doc_id", A.ensure_float(F.regexp_extract("source", "[0-9]+", 0)).alias("as_float"), A.ensure_int(F.col("source"), -1).alias("as_int"), A.ensure_string(F.when(F.col("doc_id") % 2 == 0, F.col("lang"))).alias("as_string"))


@register("progress_rates", f"SELECT o_orderkey AS job_id, round(CASE WHEN o_orderkey % 3 <> 0 THEN (o_orderkey % 101) / ((epoch_us(TIMESTAMP '2031-01-01 00:00:00') - epoch_us(o_orderdate)) / 1e6) ELSE 0 END, 9) AS rate FROM orders")
def progress_rates(spark, d):
    start = F.when(F.col("o_orderkey") % 3 != 0, ts("o_orderdate"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.round(H.progress_rate(F.col("o_orderkey") % 101, start, F.expr("TIMESTAMP '2031-01-01 00:00:00'")), 9).alias("rate"))


@register("props_json_extract", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{\"k\":' || (CAST(json_extract(props, '$.k') AS BIGINT) + 1) || ',\"seen\":true}' AS updated FROM events")
def props_json_extract(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").select("event_id", k.alias("k"), F.to_json(F.struct((k + 1).alias("k"), F.lit(True).alias("seen"))).alias("updated"))


@register("config_scan", "SELECT n_nationkey AS key_id, n_name AS value FROM nation WHERE n_regionkey = 2 AND n_nationkey % 2 = 0")
def config_scan(spark, d):
    return table(spark, d, "nation").filter("n_regionkey = 2 and n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("key_id"), F.col("n_name").alias("value"))


@register("remote_changes", """SELECT a.doc_id, CASE WHEN b.doc_id IS NULL THEN 'new' ELSE 'changed' END AS state FROM (SELECT doc_id, md5(text) AS h FROM documents) a
LEFT JOIN (SELECT doc_id, md5(CASE WHEN doc_id % 10 = 0 THEN text || '.' ELSE text END) AS h FROM documents WHERE doc_id % 7 <> 0) b USING (doc_id) WHERE b.doc_id IS NULL OR a.h <> b.h""")
def remote_changes(spark, d):
    from tamis.sources.sync import changed_files

    docs = table(spark, d, "documents")
    remote = docs.select("doc_id", F.md5("text").alias("hash"))
    manifest = docs.filter("doc_id % 7 <> 0").select("doc_id", F.md5(F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text"))).alias("hash"))
    return changed_files(remote, manifest, "doc_id")


@register("user_activity_ranks", """SELECT user_id, n, CAST(rank() OVER (ORDER BY n DESC) AS BIGINT) AS place FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1)""")
def user_activity_ranks(spark, d):
    g = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return g.withColumn("place", F.rank().over(Window.orderBy(F.desc("n"))).cast("long"))
