"""Users, sessions and chat history: statistics, last-N windows, turn pairing, session state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Limits of the conversation state.
LAST_MESSAGES, LAST_PER_USER, KEPT_PAIRS = 5, 50, 5


def exact_sum(c: str) -> Column:
    """Sum of values to four places, in whole ten-thousandths (wide enough for any number of rows)."""
    return F.sum(F.round(F.col(c) * 10_000).cast("decimal(20,0)"))


def exact_mean(total: str, n: str) -> Column:
    """Mean to six places from the :func:`exact_sum` of parts, halves rounded up; null without values."""
    t, k = F.sum(total).cast("decimal(30,0)") * 200, F.sum(n).cast("decimal(18,0)")
    return F.when(k > 0, F.floor((t + k) / (2 * k)).cast("double") / 1e6)


def user_chat_statistics(users: DataFrame, sessions: DataFrame, history: DataFrame) -> DataFrame:
    """Users left join sessions left join history, grouped by user.

    History is summed per session before it meets the sessions, so the joins carry one row per session: averages are
    rebuilt from sums and counts. Sums are exact, of values to four places, so averages don't depend on the order of rows.
    """
    per = history.groupBy("session_id").agg(F.count("id").alias("n"), exact_sum("confidence_score").alias("cs"), F.count("confidence_score").alias("cn"), exact_sum("processing_time").alias("ps"), F.count("processing_time").alias("pn"))
    rows = sessions.join(per, "session_id", "left").groupBy("user_id").agg(
        F.count_distinct("session_id").alias("total_sessions"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_messages"),
        exact_mean("cs", "cn").alias("avg_confidence_score"), exact_mean("ps", "pn").alias("avg_processing_time"), F.max("updated_at").alias("last_activity"),
    )
    zero = {c: 0 for c in ("total_sessions", "total_messages")}
    return users.join(rows, "user_id", "left").fillna(zero)


def session_counts(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("user_id").agg(F.count("session_id").alias("total_sessions"), F.count_if("is_active").alias("active_sessions"))


def rounded_or_zero(x: Column, places: int = 3) -> Column:
    return F.coalesce(F.round(x, places), F.lit(0.0))


def message_totals(history: DataFrame, key: str = "user_id") -> DataFrame:
    return history.groupBy(key).agg(
        F.count("*").alias("total_messages"), rounded_or_zero(F.avg("processing_time")).alias("avg_processing_time"), rounded_or_zero(F.avg("confidence_score")).alias("avg_confidence"),
        F.coalesce(F.sum("tokens_used"), F.lit(0)).alias("total_tokens"), F.coalesce(F.round(F.sum("cost"), 4), F.lit(0.0)).alias("total_cost"),
    )


def hours_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 3.6e9


def progress_rate(progress: Column, start: Column, end: Column) -> Column:
    """Per second since the start; 0 before it."""
    seconds = hours_between(start, end) * 3600
    return F.when(start.isNotNull() & (seconds > 0), progress / seconds).otherwise(0.0)


def last_n(rows: DataFrame, key: str, order: list[str], n: int = LAST_MESSAGES) -> DataFrame:
    """The last ``n`` rows of each key with their place from the end; rank cuts happen within tasks first."""
    w = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("from_end", F.row_number().over(w)).filter(F.col("from_end") <= n)


def rolling_history(rows: DataFrame, key: str, order: list[str], value: Column, n: int = 2 * KEPT_PAIRS) -> DataFrame:
    """At every row the values of the last ``n`` rows, oldest first."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-(n - 1), 0)
    return rows.withColumn("recent", F.collect_list(value).over(w))


def distinct_turns(turns: DataFrame) -> DataFrame:
    """First of equal (role, content) in a conversation; blank content goes."""
    w = Window.partitionBy("conv_id", "role", "text").orderBy("turn")
    return turns.withColumn("text", F.trim("text")).filter("text <> ''").withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def turn_pairs(turns: DataFrame) -> DataFrame:
    """Pairs at even places of a conversation: user, then assistant; others go."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = turns.select("conv_id", "turn", "role", "text", (F.row_number().over(w) - 1).alias("at"), F.lead("role").over(w).alias("next_role"), F.lead("text").over(w).alias("answer"))
    return rows.filter("at % 2 = 0 and role = 'user' and next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "answer")


def deactivate_old(sessions: DataFrame, cutoff: Column, now: Column) -> DataFrame:
    """Active sessions untouched since the cutoff become inactive, with time and reason noted in their metadata."""
    old = (F.col("updated_at") < cutoff) & F.col("is_active")
    note = F.map_from_arrays(F.array(F.lit("deactivated_at"), F.lit("deactivation_reason")), F.array(now.cast("string"), F.lit("automatic_cleanup")))
    kept = F.map_filter("metadata", lambda k, _: ~k.isin("deactivated_at", "deactivation_reason"))
    return sessions.withColumns({"is_active": F.when(old, F.lit(False)).otherwise(F.col("is_active")), "metadata": F.when(old, F.map_concat(kept, note)).otherwise(F.col("metadata"))})


def merge_maps(a: Column, b: Column) -> Column:
    """Entries of both, ``b`` on top, whatever the session's key policy."""
    rest = F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k))
    return F.map_concat(rest, b)


def drop_transient(context: Column) -> Column:
    """A session context without its clarification keys."""
    return F.map_filter(context, lambda k, _: ~k.isin("pending_clarification", "clarification_attempt", "last_clarification"))


def insert_new(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Existing rows and those incoming ones of which no key value is taken."""
    fresh = incoming
    for k in keys:
        fresh = fresh.join(existing.select(k), k, "left_anti")
    return existing.unionByName(fresh.dropDuplicates(keys[:1]).select(*existing.columns))


def upsert(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Rows by key, the incoming ones on top; a null incoming value keeps the old one."""
    other = incoming.select(key, *(F.col(c).alias(f"__{c}") for c in incoming.columns if c != key))
    joined = existing.join(other, key, "full")
    return joined.select(key, *(F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in incoming.columns else F.col(c) for c in existing.columns if c != key))


def update_fields(existing: DataFrame, changes: DataFrame, key: str, allowed: list[str]) -> DataFrame:
    """Changes to allowed fields only."""
    return upsert(existing, changes.select(key, *(c for c in changes.columns if c in allowed)), key)


def stamped(old: DataFrame, new: DataFrame, key: str, now: Column) -> DataFrame:
    """The new rows, with updated_at set to ``now`` where any other column differs from the old row, or the row is new."""
    cols = [c for c in new.columns if c not in (key, "updated_at")]
    before = old.select(key, F.struct(*cols).alias("__old"), F.col("updated_at").alias("__at"))
    rows = new.drop("updated_at").join(before, key, "left")
    same = F.col("__at").isNotNull() & F.struct(*cols).eqNullSafe(F.col("__old"))
    return rows.withColumn("updated_at", F.when(same, F.col("__at")).otherwise(now)).drop("__old", "__at")


CONTEXT = "history array<struct<query:string,response:string,timestamp:timestamp>>, metadata map<string,string>"


def update_contexts(contexts: DataFrame, changes: DataFrame, now: Column, keep: int = KEPT_PAIRS) -> DataFrame:
    """Session contexts (session_id, history, metadata) after one change each (session_id, query, response, metadata).

    A change with both query and response appends the pair, of which the last ``keep`` stay; metadata are merged, the
    change's on top; adds total_interactions and last_updated. Sessions without a change stay as they are; changes of
    unknown sessions go.
    """
    c = changes.select("session_id", F.col("query").alias("__q"), F.col("response").alias("__r"), F.col("metadata").alias("__m"), F.lit(True).alias("__changed"))
    rows = contexts.join(c, "session_id", "left")
    pair = F.struct(F.col("__q").alias("query"), F.col("__r").alias("response"), now.alias("timestamp"))
    full = F.when(F.col("__q").isNotNull() & F.col("__r").isNotNull(), F.concat("history", F.array(pair))).otherwise(F.col("history"))
    last = F.slice(full, F.greatest(F.lit(1), F.size(full) - keep + 1), F.lit(keep))
    none = F.create_map().cast("map<string,string>")
    changed = F.col("__changed").isNotNull()
    return rows.select(
        "session_id", F.when(changed, last).otherwise(F.col("history")).alias("history"),
        F.when(changed, merge_maps(F.coalesce("metadata", none), F.coalesce("__m", none))).otherwise(F.col("metadata")).alias("metadata"),
        F.size(F.when(changed, last).otherwise(F.col("history"))).alias("total_interactions"), F.when(changed, now).alias("last_updated"),
    )


def delete_cascade(parents: DataFrame, children: DataFrame, key: str, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parents and children without the deleted keys."""
    return parents.join(gone.select(key), key, "left_anti"), children.join(gone.select(key), key, "left_anti")


def delete_set_null(children: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """Children of deleted parents keep their row with a null key."""
    marked = children.join(gone.select(F.col(key).alias("__gone")).distinct(), F.col(key) == F.col("__gone"), "left")
    return marked.withColumn(key, F.when(F.col("__gone").isNull(), F.col(key))).drop("__gone")


def chat_interaction(rows: DataFrame, dim: int) -> dict[str, DataFrame]:
    """A chat interaction as its tables: history (zero vector by default), referenced documents, message embeddings."""
    zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
    history = rows.select("id", "user_id", "session_id", "query", "response", F.coalesce("query_vector", zero).alias("query_vector"), F.coalesce("response_vector", zero).alias("response_vector"), "confidence_score", "tokens_used", "processing_time")
    refs = rows.select(F.col("id").alias("chat_history_id"), F.explode("documents").alias("d")).select("chat_history_id", F.col("d.title").alias("document_name"), F.coalesce("d.page", F.lit(1)).alias("page_number"), F.col("d.score").alias("relevance_score"))
    vectors = history.select(F.col("id").alias("message_id"), F.explode(F.array(F.struct(F.lit("query").alias("embedding_type"), F.col("query_vector").alias("vector")), F.struct(F.lit("response").alias("embedding_type"), F.col("response_vector").alias("vector")))).alias("e")).select("message_id", "e.*")
    return {"chat_history": history, "referenced_documents": refs, "message_embeddings": vectors}
