"""Retrieval queries over documents and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.catalog import register
from tamis.functions.analyzer import ascii_tokens
from tamis.functions.vectors import cosine, l2
from tamis.operators import retrieval as R
from tamis.sources.tables import table

QUERIES = [("q1", "the and of"), ("q2", "de la"), ("q3", "thea re"), ("q4", "zzz")]
_VALUES = ", ".join(f"('{i}', '{q}')" for i, q in QUERIES)
#: Every row whose id is divisible by this is a query vector, against all rows.
EVERY = 20
_CORPUS = "SELECT doc_id, substr(text, 1, 50) AS title, text AS content FROM documents"


def corpus(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.substring("text", 1, 50).alias("title"), F.col("text").alias("content"), "lang", "source")


def asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUERIES, "query_id string, query string")


def probes(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set."""
    return table(spark, d, "embeddings").filter(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")


_COS = "list_dot_product(a.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])))"
_L2 = "list_distance(a.embedding::DOUBLE[], q.embedding::DOUBLE[])"


def _vectors(spark: SparkSession, d: str, measure: str, k: int, **more) -> DataFrame:
    return R.search_blocks(vectors(spark, d), probes(spark, d), k, measure, **more)


def _vector_sql(expr: str, k: int, keep: str = "true", by: str = "query_id", places: int = 6) -> str:
    return f"""SELECT {by}, doc_id, score FROM (
SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, doc_id) AS rn FROM (
SELECT q.vec_id AS query_id, a.vec_id AS doc_id, a.label, round({expr}, {places}) AS score FROM embeddings a, embeddings q WHERE q.vec_id % {EVERY} = 0) WHERE {keep}) WHERE rn <= {k}"""


@register("vector_topk_cosine", _vector_sql(_COS, 10))
def vector_topk_cosine(spark, d):
    return _vectors(spark, d, "cosine", 10)


@register("vector_script_score", _vector_sql(f"{_COS} + 1.0", 10))
def vector_script_score(spark, d):
    return _vectors(spark, d, "script", 10)


@register("vector_topk_l2", _vector_sql(f"1 - {_L2}", 10))
def vector_topk_l2(spark, d):
    return _vectors(spark, d, "l2", 10)


@register("similar_questions_threshold", _vector_sql(f"1 - {_L2}", 5, "score > -0.2 AND doc_id <> query_id"))
def similar_questions_threshold(spark, d):
    return _vectors(spark, d, "l2", 5, min_score=-0.2, others=True)


@register("vector_metadata_filter", _vector_sql(_COS, 10, "label IN (1, 3)"))
def vector_metadata_filter(spark, d):
    rows = R.metadata_filter(vectors(spark, d), {"label": [1, 3], "doc_id": None})
    return R.search_blocks(rows, probes(spark, d), 10)


@register("per_label_topk", _vector_sql(_COS, 3, by="query_id, label"))
def per_label_topk(spark, d):
    return _vectors(spark, d, "cosine", 3, group="label")


@register("pair_similarity", f"""SELECT a.vec_id AS left_id, q.vec_id AS right_id, round({_COS}, 6) AS cosine, round({_L2}, 6) AS distance
FROM embeddings a JOIN embeddings q ON q.vec_id = a.vec_id + 1""")
def pair_similarity(spark, d):
    e = table(spark, d, "embeddings")
    b = e.select(F.col("vec_id").alias("right_id"), F.col("embedding").alias("b"))
    both = e.join(b, F.col("right_id") == F.col("vec_id") + 1)
    return both.select(F.col("vec_id").alias("left_id"), "right_id", F.round(cosine(F.col("embedding"), F.col("b")), 6).alias("cosine"), F.round(l2(F.col("embedding"), F.col("b")), 6).alias("distance"))


@register("score_normalise", f"""SELECT query_id, doc_id, score, round(score / coalesce(nullif(max(score) OVER (PARTITION BY query_id), 0), 1), 6) AS norm_score FROM (
{_vector_sql(f'{_COS} + 1.0', 25)})""")
def score_normalise(spark, d):
    return R.normalise(_vectors(spark, d, "script", 25), ["query_id"]).withColumn("norm_score", F.round("norm_score", 6))


def _ascii_sql(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z0-9]+')"


def _bm25_sql(all_terms: bool, boost: float, fields: str = "('title'), ('content')", corpus: str = _CORPUS, values: str = _VALUES, tokens=_ascii_sql, score: str = "round(max(s), 6)") -> str:
    return f"""
WITH c AS ({corpus}),
f AS (SELECT doc_id, fl.field, {tokens("CASE WHEN fl.field = 'title' THEN title ELSE content END")} AS t FROM c, (VALUES {fields}) AS fl(field)),
s AS (SELECT field, count(*) AS n_docs, avg(len(t)) AS avg_dl FROM f WHERE len(t) > 0 GROUP BY field),
q AS (SELECT query_id, list_distinct({tokens("query")}) AS terms FROM (VALUES {values}) AS x(query_id, query)),
qt AS (SELECT query_id, unnest(terms) AS term, len(terms) AS n_terms FROM q),
p AS (SELECT doc_id, field, dl, term, count(*) AS tf FROM (SELECT doc_id, field, len(t) AS dl, unnest(t) AS term FROM f) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
df AS (SELECT field, term, count(*) AS df FROM p GROUP BY ALL),
w AS (SELECT p.*, ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avg_dl)) * CASE WHEN p.field = 'title' THEN {boost} ELSE 1.0 END AS w
 FROM p JOIN df ON p.field = df.field AND p.term = df.term JOIN s ON p.field = s.field),
m AS (SELECT query_id, doc_id, field, n_terms, sum(w) AS s, count(*) AS matched FROM w JOIN qt USING (term) GROUP BY ALL),
r AS (SELECT query_id, doc_id, {score} AS score FROM m {'WHERE matched = n_terms' if all_terms else ''} GROUP BY ALL)"""


_TOP = "SELECT query_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rn FROM {r}) WHERE rn <= {k}"


def _bm25(spark, d, all_terms: bool, boost: float, fields=("title", "content")) -> DataFrame:
    out = R.bm25(corpus(spark, d), asked(spark), {f: F.col(f) for f in fields}, {"title": boost}, all_terms)
    return out.select("query_id", "doc_id", F.round("score", 6).alias("score"))


def _top(rows: DataFrame, k: int) -> DataFrame:
    return R.top_k(rows, k, [F.desc("score"), F.asc("doc_id")], ["query_id"]).select("query_id", "doc_id", "score")


@register("bm25_topk", _bm25_sql(False, 1.0, "('content')") + _TOP.format(r="r", k=10))
def bm25_topk(spark, d):
    return _top(_bm25(spark, d, False, 1.0, ("content",)), 10)


@register("bm25_and_terms", _bm25_sql(True, 1.0, "('content')") + _TOP.format(r="r", k=20))
def bm25_and_terms(spark, d):
    return _top(_bm25(spark, d, True, 1.0, ("content",)), 20)


@register("title_boost", _bm25_sql(True, 2.0) + _TOP.format(r="r", k=20))
def title_boost(spark, d):
    return _top(_bm25(spark, d, True, 2.0), 20)


@register("phrase_boost", _bm25_sql(True, 2.0) + """, fl AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(content), '[a-z0-9]+'), ' ') || ' ' AS flat FROM c),
b AS (SELECT r.query_id, r.doc_id, round(score + CASE WHEN contains(flat, ' ' || array_to_string(regexp_extract_all(lower(query), '[a-z0-9]+'), ' ') || ' ') THEN 2.0 ELSE 0.0 END, 6) AS score
 FROM r JOIN fl USING (doc_id) JOIN (VALUES """ + _VALUES + """) AS x(query_id, query) USING (query_id)) """ + _TOP.format(r="b", k=20))
def phrase_boost(spark, d):
    scored = R.phrase_boost(_bm25(spark, d, True, 2.0), corpus(spark, d), asked(spark))
    return _top(scored.withColumn("score", F.round("score", 6)), 20)


@register("search_filtered_sorted", _bm25_sql(True, 1.0, "('content')") + f"""SELECT query_id, doc_id, score, lang FROM (
SELECT r.*, d.lang, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id DESC) AS rn FROM r JOIN documents d USING (doc_id) WHERE d.lang = 'en' AND d.source IN ('src1', 'src2', 'src3') AND score >= 0.05) WHERE rn <= 10""")
def search_filtered_sorted(spark, d):
    kept = R.metadata_filter(corpus(spark, d), R.merge_filters({"lang": "fr", "source": ["src1", "src2", "src3"]}, {"lang": "en"})).select("doc_id", "lang")
    rows = _bm25(spark, d, True, 1.0, ("content",)).join(kept, "doc_id").filter("score >= 0.05")
    return R.top_k(rows, 10, [F.desc("score"), F.desc("doc_id")], ["query_id"]).select("query_id", "doc_id", "score", "lang")


#: Both branches ask every query of all rows; each keeps its best, by its own score.
BRANCH = 40
_RAG = _vector_sql(f"0.7 * ({_COS}) + 0.3 * (a.label / 10.0)", BRANCH, places=4)
_SEM = _vector_sql(f"1 - {_L2}", BRANCH, "score > -0.4", places=4)


def _branches(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = vectors(spark, d).withColumn("meaning", F.col("label") / 10.0)
    w = R.RAG_WEIGHTS
    rag = R.search_blocks(rows, probes(spark, d), BRANCH, places=4, weight=(w["vector"], "meaning", w["semantic"]))
    return rag, _vectors(spark, d, "l2", BRANCH, places=4, min_score=-0.4)


@register("rag_weighted_score", _RAG)
def rag_weighted_score(spark, d):
    return _branches(spark, d)[0]


def _fuse_sql(both: str) -> str:
    return f"""SELECT query_id, doc_id, round(CASE WHEN r.score IS NOT NULL AND s.score IS NOT NULL THEN {both} ELSE coalesce(r.score, s.score) END, 6) AS score
FROM ({_RAG}) r FULL JOIN ({_SEM}) s USING (query_id, doc_id)"""


def _fused(spark, d, method: str) -> DataFrame:
    return R.fuse(*_branches(spark, d), method).select("query_id", "doc_id", F.round("score", 6).alias("score"))


@register("hybrid_weighted_sum", _fuse_sql("0.5 * r.score + 0.5 * s.score"))
def hybrid_weighted_sum(spark, d):
    return _fused(spark, d, "weighted_sum")


@register("hybrid_max", _fuse_sql("greatest(r.score, s.score)"))
def hybrid_max(spark, d):
    return _fused(spark, d, "max")


@register("hybrid_average", _fuse_sql("(r.score + s.score) / 2"))
def hybrid_average(spark, d):
    return _fused(spark, d, "average")


@register("block_rerank", f"""WITH b AS (SELECT t.*, e.label / 10.0 AS cos FROM ({_vector_sql(_COS, BRANCH)}) t JOIN embeddings e ON e.vec_id = t.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rn FROM b),
c AS (SELECT *, (rn - 1) // 3 AS block, 0.7 * score + 0.3 * cos AS context FROM r)
SELECT query_id, doc_id, score, CAST(rn AS BIGINT) AS old_rank, CAST(row_number() OVER (PARTITION BY query_id ORDER BY block, round(context, 9) DESC, rn) AS BIGINT) AS new_rank FROM c""")
def block_rerank(spark, d):
    found = _vectors(spark, d, "cosine", BRANCH)  # the best of all rows for every query
    rows = found.join(vectors(spark, d).select("doc_id", (F.col("label") / 10.0).alias("cos")), "doc_id")
    out = R.block_rerank(rows)
    return out.select("query_id", "doc_id", "score", F.col("rn").cast("long").alias("old_rank"), F.col("new_rank").cast("long").alias("new_rank"))


_CONCEPTS = ["The", "and", "DE", "zz"]
_CSQL = "['The', 'and', 'DE', 'zz']"
_TOK = "list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))"
_LOWC = "['the', 'and', 'de', 'zz']"
_JAC = f"CASE WHEN len({_TOK}) = 0 THEN 0.0 ELSE len(list_intersect({_TOK}, {_LOWC})) / CAST(len({_TOK}) + 4 - len(list_intersect({_TOK}, {_LOWC})) AS DOUBLE) END"


def _concepts():
    return F.array(*map(F.lit, _CONCEPTS))


@register("jaccard_concepts", f"SELECT doc_id, round({_JAC}, 6) AS jaccard FROM documents")
def jaccard_concepts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(R.jaccard(_concepts(), ascii_tokens(F.col("text"))), 6).alias("jaccard"))


_EXACT = f"len(list_filter({_CSQL}, lambda c: contains(lower(text), lower(c))))"


@register("exact_match_boost", f"SELECT doc_id, round(least(1.0, 0.75 * (1 + 0.1 * {_EXACT})), 6) AS boosted FROM documents", doubles=("boosted",))
def exact_match_boost(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(R.exact_match_boost(F.lit(0.75), F.col("text"), _concepts()), 6).alias("boosted"))


@register("semantic_score", f"SELECT doc_id, round(least(1.0, 0.3 * (doc_id % 11) / 10.0 + 0.4 * ({_JAC}) + 0.3 * (doc_id % 7) / 6.0), 6) AS semantic FROM documents")
def semantic_score(spark, d):
    score = R.semantic_score((F.col("doc_id") % 11) / 10.0, R.jaccard(_concepts(), ascii_tokens(F.col("text"))), (F.col("doc_id") % 7) / 6.0)
    return table(spark, d, "documents").select("doc_id", F.round(score, 6).alias("semantic"))


@register("query_expansion", """SELECT doc_id, lang || ' ("' || array_to_string(list_slice(w, 1, 3), '" OR "') || '")' || ' ("syn1" OR "syn2")' AS expanded FROM (
SELECT doc_id, lang, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents) WHERE len(w) > 0""")
def query_expansion(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang", ascii_tokens(F.col("text")).alias("w")).filter(F.size("w") > 0)
    return rows.select("doc_id", R.expand_query(F.col("lang"), F.col("w"), F.array(F.lit("syn1"), F.lit("syn2"))).alias("expanded"))


@register("levenshtein_pairs", """WITH b AS (SELECT DISTINCT p_brand AS brand FROM part)
SELECT a.brand AS left_brand, b.brand AS right_brand, CAST(levenshtein(a.brand, b.brand) AS BIGINT) AS distance FROM b a JOIN b ON a.brand < b.brand""")
def levenshtein_pairs(spark, d):
    b = table(spark, d, "part").select(F.col("p_brand").alias("brand")).distinct()
    other = b.select(F.col("brand").alias("right_brand"))  # brands are a short fixed list
    return b.join(other, F.col("brand") < F.col("right_brand")).select(F.col("brand").alias("left_brand"), "right_brand", F.levenshtein("brand", "right_brand").cast("long").alias("distance"))


@register("synonym_list", """SELECT doc_id, array_to_string(list_slice(list_sort(list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND x <> 'The and that.'))), 1, 5), '|') AS synonyms FROM documents""")
def synonym_list(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(R.synonyms_of(F.col("text"), F.array(F.lit("The and that."))), "|").alias("synonyms"))


@register("result_preview", "SELECT doc_id, substr(text, 1, 50) AS title, substr(text, 1, 200) AS content FROM documents")
def result_preview(spark, d):
    return R.preview(corpus(spark, d).withColumn("title", F.lit(None).cast("string")))


@register("reference_documents", """SELECT doc_id, CASE WHEN (n_chars % 30) / 10.0 > 1 THEN (n_chars % 30) / 10.0 - 1 ELSE (n_chars % 30) / 10.0 END AS ref_score,
coalesce(nullif(trim(CASE WHEN doc_id % 3 = 0 THEN '' END), ''), nullif(CASE WHEN doc_id % 3 = 1 THEN source END, ''), regexp_extract('docs/' || lang || '.pdf', '[^/]*$')) AS ref_title, CAST(coalesce(nullif(doc_id % 4, 0), 1) AS BIGINT) AS page FROM documents""")
def reference_documents(spark, d):
    title = R.document_title(F.when(F.col("doc_id") % 3 == 0, F.lit(" ")), F.when(F.col("doc_id") % 3 == 1, F.col("source")), F.concat(F.lit("docs/"), "lang", F.lit(".pdf")))
    return table(spark, d, "documents").select("doc_id", R.reference_score((F.col("n_chars") % 30) / 10.0).alias("ref_score"), title.alias("ref_title"), F.coalesce(F.nullif(F.col("doc_id") % 4, F.lit(0)), F.lit(1)).cast("long").alias("page"))


@register("search_summary", """SELECT lang AS query_id, count(*) AS n_results, max(n_chars / 100.0) AS max_score, min(n_chars / 100.0) AS min_score, round(avg(n_chars / 100.0), 6) AS avg_score FROM documents GROUP BY lang""")
def search_summary(spark, d):
    out = R.search_summary(table(spark, d, "documents").select(F.col("lang").alias("query_id"), (F.col("n_chars") / 100.0).alias("score")))
    return out.withColumn("avg_score", F.round("avg_score", 6))


@register("context_prompt_section", """SELECT query_id, string_agg('[' || printf('%.2f', score) || '] ' || content, chr(10) ORDER BY rn) AS context FROM (
SELECT lang AS query_id, n_chars / 100.0 AS score, text AS content, row_number() OVER (PARTITION BY lang ORDER BY n_chars / 100.0 DESC, doc_id) AS rn FROM documents) WHERE rn <= 5 GROUP BY query_id""")
def context_prompt_section(spark, d):
    rows = table(spark, d, "documents").select(F.col("lang").alias("query_id"), "doc_id", (F.col("n_chars") / 100.0).alias("score"), F.col("text").alias("content"))
    return R.context_section(rows)


#: Any term, exact scores, and these over the query's greatest.
_NORM = ", n AS (SELECT query_id, doc_id, score, score / coalesce(nullif(max(score) OVER (PARTITION BY query_id), 0), 1) AS norm FROM r)"
_JOINED = _CORPUS.replace("FROM documents", "FROM documents JOIN embeddings ON vec_id = doc_id")
_MEANT = f"""s20 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY norm DESC, doc_id) AS rn FROM n) WHERE rn <= 20),
sem AS (SELECT query_id, doc_id, least(1.0, least(1.0, 0.3 * norm + 0.4 * ({_JAC})) * (1 + 0.1 * {_EXACT})) AS score FROM s20 JOIN documents USING (doc_id))"""


def _any_sql(corpus: str = _CORPUS) -> str:
    return _bm25_sql(False, 1.0, "('content')", corpus=corpus, score="max(s)") + _NORM


@register("semantic_strategy", _any_sql() + f", {_MEANT} SELECT query_id, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rn FROM sem WHERE score >= 0.1) WHERE rn <= 10")
def semantic_strategy(spark, d):
    found = R.search(spark, "semantic", corpus(spark, d), asked(spark), _concepts(), max_docs=10, min_score=0.1)
    return found.select("query_id", "doc_id", F.round("score", 6).alias("score"))


_FLAT = "list_dot_product(embedding::DOUBLE[], list_transform(range(64), lambda i: 0.125::DOUBLE)) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))"


@register("hybrid_strategy", _any_sql(_JOINED) + f""", e AS (SELECT vec_id AS doc_id, {_FLAT} AS cos FROM embeddings),
rag AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rn FROM (SELECT query_id, doc_id, 0.7 * norm + 0.3 * cos AS score FROM n JOIN e USING (doc_id)) WHERE score >= 0) WHERE rn <= 10),
{_MEANT}, sem10 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rn FROM sem WHERE score >= 0) WHERE rn <= 10),
b AS (SELECT query_id, doc_id, CASE WHEN a.score IS NOT NULL AND z.score IS NOT NULL THEN 0.5 * a.score + 0.5 * z.score ELSE coalesce(a.score, z.score) END AS score FROM rag a FULL JOIN sem10 z USING (query_id, doc_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rn FROM b JOIN e USING (doc_id)),
x AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY (rn - 1) // 3, 0.7 * score + 0.3 * cos DESC, rn) AS new_rank FROM k)
SELECT query_id, doc_id, round(score, 6) AS score, CAST(new_rank AS BIGINT) AS new_rank FROM x WHERE score >= 0.1 AND new_rank <= 10""")
def hybrid_strategy(spark, d):
    docs = corpus(spark, d).join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id")
    found = R.search(spark, "hybrid", docs, asked(spark), [0.125] * 64, _concepts(), max_docs=10, min_score=0.1)
    return found.select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("new_rank").cast("long").alias("new_rank"))


@register("fallback_search", _any_sql() + " SELECT query_id, doc_id, round(norm, 6) AS norm_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY norm DESC, doc_id) AS rn FROM n WHERE norm >= 0.1) WHERE rn <= 5")
def fallback_search(spark, d):
    return R.fallback_search(corpus(spark, d), asked(spark)).select("query_id", "doc_id", F.round("norm_score", 6).alias("norm_score"))
