"""Lexical, vector and fused top-k retrieval.

Corpora are never collected. Queries are few and bounded by a parameter, so their terms are broadcast; every corpus
row is cut down to its matching terms in one narrow pass, and only those travel to the scoring shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamis.functions.analyzer import ascii_tokens
from tamis.functions.vectors import cosine

K1, B = 1.2, 0.75
#: Queries scored in one plan; their terms are a literal of the scan's projection.
MAX_QUERIES = 10_000
#: Query vectors broadcast at once.
BLOCK_QUERIES = 4096
# Default limits and weights of the strategies.
MAX_DOCS, MIN_SCORE = 20, 0.3
RAG_WEIGHTS = {"vector": 0.7, "semantic": 0.3}
RERANK_WINDOW = 3
SEMANTIC_WEIGHTS = {"base": 0.3, "concepts": 0.4, "relevance": 0.3}
FALLBACK = {"max_docs": 5, "min_score": 0.1}


def query_terms(queries: DataFrame, tokens: Callable[[Column], Column] = ascii_tokens) -> DataFrame:
    """(query_id, query) -> query_id, term, n_terms: distinct terms of each query."""
    terms = queries.select("query_id", F.array_distinct(tokens(F.col("query"))).alias("terms"))
    return terms.select("query_id", F.explode("terms").alias("term"), F.size("terms").alias("n_terms"))


def postings(docs: DataFrame, wanted: list[str], fields: dict[str, Column], tokens: Callable[[Column], Column] = ascii_tokens) -> tuple[DataFrame, DataFrame]:
    """Postings of the wanted terms (doc_id, field, dl, term, tf), and per field its documents with any token and mean length.

    Other tokens never leave their row. A row with a blank term carries every document's length beside its postings,
    so both come from one pass: what tells the two apart is a count, which no filter can be pushed below, and terms are
    never null, so none is inferred either, and the branches share one exchange.
    """
    rows = docs.select("doc_id", *(tokens(text).alias(f) for f, text in fields.items()))
    hits = lambda f: F.transform(F.filter(f, lambda x: x.isin(wanted)), lambda x: F.coalesce(x, F.lit("")))
    rows = rows.select("doc_id", F.inline(F.array(*(F.struct(F.lit(f).alias("field"), F.size(f).alias("dl"), F.concat(F.array(F.lit("")), F.coalesce(hits(f), F.array(F.lit("")))).alias("t")) for f in fields))))
    counted = rows.select("doc_id", "field", "dl", F.explode("t").alias("term")).groupBy("doc_id", "field", "dl", "term").agg(F.count_if(F.col("term") != "").alias("tf"))
    sizes = counted.filter("tf = 0").groupBy("field").agg(F.count_if(F.col("dl") > 0).alias("n_docs"), F.sum(F.greatest("dl", F.lit(0))).alias("total"))
    return counted.filter("tf > 0"), sizes.select("field", "n_docs", F.try_divide("total", "n_docs").alias("avg_dl"))


def bm25(docs: DataFrame, queries: DataFrame, fields: dict[str, Column], boosts: dict[str, float] | None = None, all_terms: bool = True, tokens: Callable[[Column], Column] = ascii_tokens) -> DataFrame:
    """query_id, doc_id, score: best field per document (boosted), all query terms required in that field if asked."""
    terms = query_terms(queries, tokens)
    found = queries.limit(MAX_QUERIES + 1).select(F.explode(F.array_distinct(tokens(F.col("query")))).alias("t"), "query_id").collect()
    if len({r["query_id"] for r in found}) > MAX_QUERIES:
        raise ValueError(f"more than {MAX_QUERIES} queries at once; pass them in several frames")
    return scored_postings(*postings(docs, sorted({r["t"] for r in found}), fields, tokens), terms, boosts, all_terms)


def scored_postings(post: DataFrame, stats: DataFrame, terms: DataFrame, boosts: dict[str, float] | None, all_terms: bool) -> DataFrame:
    """BM25 over postings of the queries' terms (doc_id, field, dl, term, tf) and statistics of the fields."""
    boosts = boosts or {}
    frequency = post.groupBy("field", "term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avg_dl")))
    boost = F.lit(1.0)
    for name, x in boosts.items():
        boost = F.when(F.col("field") == name, float(x)).otherwise(boost)
    scored = post.join(F.broadcast(frequency), ["field", "term"]).join(F.broadcast(stats), "field").withColumn("w", weight * boost)
    per_field = scored.join(F.broadcast(terms), "term").groupBy("query_id", "doc_id", "field", "n_terms").agg(F.sum("w").alias("s"), F.count("*").alias("matched"))
    if all_terms:
        per_field = per_field.filter("matched = n_terms")
    return per_field.groupBy("query_id", "doc_id").agg(F.max("s").alias("score"))


def phrase_boost(scored: DataFrame, docs: DataFrame, queries: DataFrame, boost: float = 2.0) -> DataFrame:
    """Adds ``boost`` to the score of documents that hold the query's words as a phrase."""
    phrase = queries.select("query_id", F.concat(F.lit(" "), F.array_join(ascii_tokens(F.col("query")), " "), F.lit(" ")).alias("phrase"))
    text = docs.select("doc_id", F.concat(F.lit(" "), F.array_join(ascii_tokens(F.col("content")), " "), F.lit(" ")).alias("flat"))
    both = scored.join(text, "doc_id").join(F.broadcast(phrase), "query_id")
    return both.select("query_id", "doc_id", (F.col("score") + F.when(F.contains("flat", "phrase"), boost).otherwise(0.0)).alias("score"))


def bool_search(docs: DataFrame, queries: DataFrame, fields: dict[str, Column], boosts: dict[str, float] | None = None, filters: dict | None = None, vector: list[float] | None = None, minimum_should: int = 0, tokens: Callable[[Column], Column] = ascii_tokens) -> DataFrame:
    """must (all terms in one field), should (the phrase; closeness to a vector) and filter in one search.

    Filters don't change how terms are weighted. Scores of the clauses that match add up; with
    ``minimum_should`` a document needs so many matching should clauses (a given vector matches every document with an embedding).
    """
    kept = metadata_filter(docs, filters or {})
    base = bm25(docs, queries, fields, boosts, True, tokens)
    padded = lambda text: F.concat(F.lit(" "), F.array_join(tokens(text), " "), F.lit(" "))
    q = F.array(*(F.lit(float(x)) for x in vector)) if vector else None
    near = F.when(F.col("embedding").isNotNull(), cosine(F.col("embedding"), q) + 1.0) if vector else F.lit(None).cast("double")
    side = kept.select("doc_id", padded(F.col("content")).alias("flat"), near.alias("near"))
    phrase = queries.select("query_id", padded(F.col("query")).alias("phrase"))
    rows = base.join(side, "doc_id").join(F.broadcast(phrase), "query_id")
    hit = F.when(F.contains("flat", "phrase"), 1).otherwise(0)
    rows = rows.select("query_id", "doc_id", (F.col("score") + 2.0 * hit + F.coalesce("near", F.lit(0.0))).alias("score"), (hit + F.col("near").isNotNull().cast("int")).alias("should"))
    return rows.filter(F.col("should") >= minimum_should).drop("should")


def top_k(scored: DataFrame, k: int, by: list[Column], group: list[str] | None = None) -> DataFrame:
    """The first ``k`` rows of each group. Ranks are cut within tasks first (WindowGroupLimit), so groups don't gather."""
    if not group:
        return scored.orderBy(*by).limit(k)
    w = Window.partitionBy(*group).orderBy(*by)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def normalise(scored: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Adds norm_score: score over the group's greatest (taken as 1 where that is 0 or missing)."""
    if group:
        best = scored.groupBy(*group).agg(F.max("score").alias("best"))
        joined = scored.join(best, group)
    else:
        joined = scored.crossJoin(F.broadcast(scored.agg(F.max("score").alias("best"))))  # one row
    best = F.coalesce(F.nullif(F.col("best"), F.lit(0.0)), F.lit(1.0))
    return joined.withColumn("norm_score", F.col("score") / best).drop("best")


def metadata_filter(df: DataFrame, filters: dict[str, object]) -> DataFrame:
    """term (value) and terms (list) filters; None values are skipped. They reach the scan."""
    for column, value in filters.items():
        if value is None:
            continue
        df = df.filter(F.col(column).isin(list(value))) if isinstance(value, (list, tuple, set)) else df.filter(F.col(column) == value)
    return df


def merge_filters(session: dict | None, call: dict | None) -> dict:
    """A session's filter with the call's on top."""
    return {**(session or {}), **(call or {})}


def clamp_params(max_docs: int = MAX_DOCS, min_score: float = MIN_SCORE, **weights: float) -> dict:
    """Parameters forced into their ranges before planning."""
    unit = lambda x: min(max(float(x), 0.0), 1.0)
    return {"max_docs": min(max(int(max_docs), 1), 20), "min_score": unit(min_score)} | {k: unit(v) for k, v in weights.items()}


def validate_params(method: str, params: dict) -> None:
    """Raises ValueError on an unknown method or a value outside its range."""
    if method not in STRATEGIES:
        raise ValueError(f"unknown search method: {method}")
    if not 1 <= params.get("max_docs", 1) <= 20:
        raise ValueError("max_docs must be from 1 to 20")
    for k, v in params.items():
        if k != "max_docs" and isinstance(v, (int, float)) and not 0 <= v <= 1:
            raise ValueError(f"{k} must be from 0 to 1")


def vector_top_k(docs: DataFrame, query: list[float], k: int, measure: Callable[[Column, Column], Column] = cosine, vec: str = "embedding", key: str = "doc_id") -> DataFrame:
    """One query vector against all rows: a projection and a distributed top-k."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return top_k(docs.withColumn("score", measure(F.col(vec), q)), k, [F.desc("score"), F.asc(key)])


def query_blocks(queries: DataFrame, block_rows: int = BLOCK_QUERIES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Query ids and vectors in blocks of at most ``block_rows``; the driver holds one block at a time."""
    ids: list[int] = []
    vectors: list[list[float]] = []
    for r in queries.select("query_id", "q").toLocalIterator():
        ids.append(r["query_id"])
        vectors.append(r["q"])
        if len(ids) == block_rows:
            yield np.array(ids, np.int64), np.array(vectors, np.float64)
            ids, vectors = [], []
    if ids:
        yield np.array(ids, np.int64), np.array(vectors, np.float64)


def _measure(x: np.ndarray, q: np.ndarray, measure: str) -> np.ndarray:
    """Queries x rows. Cosine is 0 beside a zero vector."""
    if measure == "l2":
        out = np.empty((len(q), len(x)))
        for i, v in enumerate(q):
            out[i] = 1.0 - np.sqrt(((x - v) ** 2).sum(axis=1))
        return out
    n = np.sqrt((q * q).sum(axis=1))[:, None] * np.sqrt((x * x).sum(axis=1))[None, :]
    return np.divide(q @ x.T, n, out=np.zeros_like(n), where=n > 0) + (1.0 if measure == "script" else 0.0)


def search_blocks(docs: DataFrame, queries: DataFrame, k: int, measure: str = "cosine", places: int = 6, min_score: float | None = None, others: bool = False, group: str | None = None, weight: tuple[float, str, float] | None = None, block_rows: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, (group,) doc_id, score: the best ``k`` rows of (doc_id, embedding) for every query (query_id, q), by cosine, script or l2.

    Queries are broadcast in blocks of at most ``block_rows`` vectors, however many there are. A block meets every
    Arrow batch of the corpus as one matrix product, of which only rows that can still be among the best ``k`` leave
    the task, and these are ranked after the shuffle. ``min_score`` is exclusive; ``others`` leaves out the query's own
    row; ``group`` ranks within each value of a column; ``weight`` (w, column, v) scores w x measure + v x column.
    Rows without an embedding match nothing; ties go to the lesser id.
    """
    extra = [c for c in (group, weight and weight[1]) if c]
    rows = docs.filter(F.col("embedding").isNotNull()).select("doc_id", "embedding", *dict.fromkeys(extra))
    names = ["query_id", "doc_id", "score", *([group] if group else [])]
    kind = f", {group} {docs.schema[group].dataType.simpleString()}" if group else ""

    def kernel(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            for b in batches:
                if not b.num_rows:
                    continue
                doc = b.column(0).to_numpy(zero_copy_only=False)
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(doc), -1)
                score = _measure(x, q, measure)
                if weight:
                    score = weight[0] * score + weight[2] * b.column(weight[1]).to_numpy(zero_copy_only=False)[None, :]
                score = np.round(score, places)
                if min_score is not None:
                    score = np.where(score > min_score, score, -np.inf)
                if others:
                    score = np.where(doc[None, :] != ids[:, None], score, -np.inf)
                of = b.column(group).to_numpy(zero_copy_only=False) if group else np.zeros(len(doc), np.int64)
                for g in np.unique(of):
                    at = np.flatnonzero(of == g)
                    own = score[:, at]
                    least = np.partition(own, -k, axis=1)[:, -k][:, None] if len(at) > k else -np.inf
                    i, j = np.nonzero((own >= least) & (own > -np.inf))
                    if len(i):
                        cols = [pa.array(ids[i]), pa.array(doc[at[j]]), pa.array(own[i, j])]
                        yield pa.RecordBatch.from_arrays(cols + ([b.column(group).take(pa.array(at[j]))] if group else []), names=names)

        return run

    found = None
    for block in query_blocks(queries, block_rows):
        part = rows.mapInArrow(kernel(docs.sparkSession.sparkContext.broadcast(block)), "query_id long, doc_id long, score double" + kind)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "query_id long, doc_id long, score double" + kind)
    return top_k(found, k, [F.desc("score"), F.asc("doc_id")], ["query_id", *([group] if group else [])]).drop("rank")


def rag_score(vector_score: Column, semantic_score: Column, weights: dict[str, float] = RAG_WEIGHTS) -> Column:
    return weights["vector"] * vector_score + weights["semantic"] * semantic_score


def fuse(rag: DataFrame, semantic: DataFrame, method: str = "weighted_sum", rag_weight: float = 0.5, semantic_weight: float = 0.5) -> DataFrame:
    """Full outer fusion by (query_id, doc_id): weighted_sum, max or average; one-sided rows keep their own score; rag rows without an id go."""
    a = rag.filter(F.col("doc_id").isNotNull()).groupBy("query_id", "doc_id").agg(F.max("score").alias("r"))
    b = semantic.filter(F.col("doc_id").isNotNull()).groupBy("query_id", "doc_id").agg(F.max("score").alias("s"))
    both = {
        "weighted_sum": rag_weight * F.col("r") + semantic_weight * F.col("s"),
        "max": F.greatest("r", "s"),
        "average": (F.col("r") + F.col("s")) / 2,
    }[method]
    score = F.when(F.col("r").isNotNull() & F.col("s").isNotNull(), both).otherwise(F.coalesce("r", "s"))
    return a.join(b, ["query_id", "doc_id"], "full").select("query_id", "doc_id", score.alias("score"))


def block_rerank(scored: DataFrame, window: int = RERANK_WINDOW, rag_weight: float = RAG_WEIGHTS["vector"], context_weight: float = RAG_WEIGHTS["semantic"]) -> DataFrame:
    """Re-orders non-overlapping blocks of ``window`` ranks by score and coherence (column cos); adds new_rank.

    The ranking is per query: query_id, doc_id, score, cos.
    """
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("doc_id"))
    rn = scored.withColumn("rn", F.row_number().over(w))
    rn = rn.withColumn("block", F.floor((F.col("rn") - 1) / window)).withColumn("context", rag_weight * F.col("score") + context_weight * F.col("cos"))
    again = Window.partitionBy("query_id").orderBy(F.asc("block"), F.desc("context"), F.asc("rn"))
    return rn.withColumn("new_rank", F.row_number().over(again))


def jaccard(a: Column, b: Column) -> Column:
    """On lower-cased sets; 0 if either is empty."""
    x, y = (F.array_distinct(F.transform(c, lambda v: F.lower(v))) for c in (a, b))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))).otherwise(0.0)


def semantic_score(base: Column, concepts: Column, relevance: Column, weights: dict[str, float] = SEMANTIC_WEIGHTS) -> Column:
    return F.least(F.lit(1.0), weights["base"] * base + weights["concepts"] * concepts + weights["relevance"] * relevance)


def exact_match_boost(score: Column, content: Column, concepts: Column) -> Column:
    """A tenth more for every concept that the content holds, up to 1."""
    hits = F.size(F.filter(concepts, lambda c: F.contains(F.lower(content), F.lower(c))))
    return F.least(F.lit(1.0), score * (1 + 0.1 * hits))


def expand_query(query: Column, concepts: Column, synonyms: Column, n_concepts: int = 3, n_synonyms: int = 3) -> Column:
    """The query, then its first concepts and synonyms as OR groups."""
    def group(words: Column, n: int) -> Column:
        quoted = F.transform(F.slice(words, 1, n), lambda c: F.concat(F.lit('"'), c, F.lit('"')))
        return F.when(F.size(words) > 0, F.concat(F.lit("("), F.array_join(quoted, " OR "), F.lit(")")))

    return F.concat_ws(" ", query, group(concepts, n_concepts), group(synonyms, n_synonyms))


def _section(text: Column, name: str) -> Column:
    """What follows a heading, up to a blank line or the end; empty if there is none."""
    return F.trim(F.regexp_extract(text, rf"(?is){name}:?\s*[-:]?\s*(.*?)(?=\n\n|\z)", 1))


def concepts_of(analysis: Column, limit: int = 5) -> Column:
    parts = F.transform(F.split(_section(analysis, "concepts?"), r"[,;]|\n-"), lambda x: F.trim(x))
    return F.slice(F.filter(parts, lambda x: x != ""), 1, limit)


def intent_of(analysis: Column) -> Column:
    return F.coalesce(F.nullif(_section(analysis, "intention"), F.lit("")), F.lit("unknown"))


def _pairs(section: Column, mark: str) -> Column:
    lines = F.filter(F.split(section, "\n"), lambda x: F.contains(x, F.lit(mark)))
    return F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, mark, 1)).alias("source"), F.trim(F.regexp_replace(x, f"^.*?{mark}", "")).alias("target")))


def constraints_of(analysis: Column) -> Column:
    """``key: value`` lines as a map, later ones on top."""
    return F.map_from_entries(_pairs(_section(analysis, "contraintes?"), ":"))


def relations_of(analysis: Column) -> Column:
    """``source -> target`` lines as structs."""
    return _pairs(_section(analysis, "relations?"), "->")


def synonyms_of(answer: Column, concepts: Column, limit: int = 5) -> Column:
    """Distinct non-blank lines that are no concepts, in order of name."""
    lines = F.filter(F.transform(F.split(answer, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.slice(F.array_sort(F.array_distinct(F.array_except(lines, concepts))), 1, limit)


def preview(docs: DataFrame) -> DataFrame:
    """Title (given, or the first 50 characters) and 200 characters of content."""
    return docs.select("doc_id", F.coalesce("title", F.substring("content", 1, 50)).alias("title"), F.substring("content", 1, 200).alias("content"))


def reference_score(score: Column) -> Column:
    """Scores above 1 lose 1 (they come with it added)."""
    return F.when(score > 1, score - 1).otherwise(score)


def document_title(title: Column, filename: Column, path: Column) -> Column:
    """First of title, file name, last part of the path that is not blank."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(blank(title), blank(filename), blank(F.substring_index(path, "/", -1)), F.lit("Document sans titre"))


def context_section(results: DataFrame, limit: int = 5) -> DataFrame:
    """Per query one text of its best documents, best first, with scores to two places."""
    best = top_k(results, limit, [F.desc("score"), F.asc("doc_id")], ["query_id"])
    line = F.concat(F.lit("["), F.format_string("%.2f", "score"), F.lit("] "), F.col("content"))
    return best.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda s: s["line"]), "\n").alias("context"))


def search_summary(results: DataFrame) -> DataFrame:
    """Results, best, worst and mean score per query."""
    return results.groupBy("query_id").agg(F.count("*").alias("n_results"), F.max("score").alias("max_score"), F.min("score").alias("min_score"), F.avg("score").alias("avg_score"))


def rag_search(docs: DataFrame, queries: DataFrame, query: list[float], max_docs: int = MAX_DOCS, min_score: float = MIN_SCORE, filters: dict | None = None) -> DataFrame:
    """Text and vector match, weighted, cut at the score and the number of documents."""
    base = normalise(bm25(metadata_filter(docs, filters or {}), queries, {"content": F.col("content")}, all_terms=False), ["query_id"])
    q = F.array(*(F.lit(float(x)) for x in query))
    both = base.join(docs.select("doc_id", "embedding"), "doc_id").withColumn("score", rag_score(F.col("norm_score"), cosine(F.col("embedding"), q)))
    return top_k(both.filter(F.col("score") >= min_score).select("query_id", "doc_id", "score"), max_docs, [F.desc("score"), F.asc("doc_id")], ["query_id"])


def semantic_search(docs: DataFrame, queries: DataFrame, concepts: Column, max_docs: int = MAX_DOCS, min_score: float = MIN_SCORE, **_: object) -> DataFrame:
    """Twice as many candidates, rescored by concepts held and exact matches."""
    base = top_k(normalise(bm25(docs, queries, {"content": F.col("content")}, all_terms=False), ["query_id"]), 2 * max_docs, [F.desc("score"), F.asc("doc_id")], ["query_id"])
    both = base.join(docs.select("doc_id", "content"), "doc_id")
    score = semantic_score(F.col("norm_score"), jaccard(concepts, ascii_tokens(F.col("content"))), F.lit(0.0))
    both = both.withColumn("score", exact_match_boost(score, F.col("content"), concepts)).drop("rank")
    return top_k(both.filter(F.col("score") >= min_score).select("query_id", "doc_id", "score"), max_docs, [F.desc("score"), F.asc("doc_id")], ["query_id"])


def hybrid_search(docs: DataFrame, queries: DataFrame, query: list[float], concepts: Column, method: str = "weighted_sum", rag_weight: float = 0.5, semantic_weight: float = 0.5, max_docs: int = MAX_DOCS, min_score: float = MIN_SCORE) -> DataFrame:
    """Both branches in one plan, fused, reranked in blocks."""
    fused = fuse(rag_search(docs, queries, query, max_docs, 0.0), semantic_search(docs, queries, concepts, max_docs, 0.0), method, rag_weight, semantic_weight)
    q = F.array(*(F.lit(float(x)) for x in query))
    ranked = block_rerank(fused.join(docs.select("doc_id", "embedding"), "doc_id").withColumn("cos", cosine(F.col("embedding"), q)).drop("embedding"))
    return ranked.filter((F.col("score") >= min_score) & (F.col("new_rank") <= max_docs))


def fallback_search(docs: DataFrame, queries: DataFrame, max_docs: int = FALLBACK["max_docs"], min_score: float = FALLBACK["min_score"]) -> DataFrame:
    """Plain text match with low demands."""
    scored = normalise(bm25(docs, queries, {"content": F.col("content")}, all_terms=False), ["query_id"])
    return top_k(scored.filter(F.col("norm_score") >= min_score), max_docs, [F.desc("norm_score"), F.asc("doc_id")], ["query_id"])


STRATEGIES: dict[str, Callable[..., DataFrame]] = {"rag": rag_search, "semantic": semantic_search, "hybrid": hybrid_search}


def search(spark: SparkSession, method: str, *args: object, enabled: bool = True, **kwargs: object) -> DataFrame:
    """Dispatch by name; a disabled strategy gives no rows."""
    validate_params(method, {k: v for k, v in kwargs.items() if k in ("max_docs", "min_score")})
    out = STRATEGIES[method](*args, **kwargs)
    return out if enabled else out.limit(0)
