"""Queries over a stored text index, the French analyzer, and searches of several clauses."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamis.catalog import register
from tamis.functions import analyzer as A
from tamis.operators import retrieval as R
from tamis.operators.text_index import TextIndex
from tamis.plans.retrieval import _CORPUS, _FLAT, _TOP, _VALUES, _bm25_sql, _top, asked, corpus
from tamis.sources.tables import table
from tamis.sources.work import work_dir


def _index(spark) -> TextIndex:
    return TextIndex(spark, work_dir(spark, "index"), {"content": F.col("content")})


@register("stored_bm25_topk", _bm25_sql(False, 1.0, "('content')") + _TOP.format(r="r", k=10))
def stored_bm25_topk(spark, d):
    index = _index(spark)
    index.add(corpus(spark, d))
    return _top(index.search(asked(spark), all_terms=False).withColumn("score", F.round("score", 6)), 10)


_NEW = f"SELECT doc_id, title, CASE WHEN doc_id % 7 = 0 THEN 'the and of ' || content ELSE content END AS content FROM ({_CORPUS}) WHERE doc_id % 5 <> 0 OR doc_id % 7 = 0"


@register("index_updates", _bm25_sql(True, 1.0, "('content')", corpus=_NEW) + _TOP.format(r="r", k=20))
def index_updates(spark, d):
    """A fifth of the documents is deleted, then a seventh written anew."""
    docs, index = corpus(spark, d), _index(spark)
    index.add(docs)
    index.delete(docs.filter("doc_id % 5 = 0"))
    index.update(docs.filter("doc_id % 7 = 0").withColumn("content", F.concat(F.lit("the and of "), "content")))
    return _top(index.search(asked(spark)).withColumn("score", F.round("score", 6)), 20)


FRENCH = [("f1", "l'étion dans le reaux"), ("f2", "Éauxmentre que réeaux"), ("f3", "ciónmente asados")]
_STOP = ", ".join(f"'{w}'" for w in A.STOP_WORDS)


def _french_sql(x: str) -> str:
    t = rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}]+(?:[''’][\p{{L}}\p{{N}}]+)*')"
    t = f"list_transform({t}, lambda t: regexp_replace(t, '^(?:{'|'.join(A.ELISIONS)})[''’]', ''))"
    t = f"list_filter({t}, lambda t: NOT t IN ({_STOP}) AND length(t) > 0)"
    for step in (
        "CASE WHEN length(t) > 4 THEN regexp_replace(t, 'aux$', 'al') ELSE t END", "CASE WHEN length(t) > 3 THEN regexp_replace(t, '[sx]$', '') ELSE t END",
        "CASE WHEN length(t) > 3 THEN regexp_replace(t, 'e$', '') ELSE t END", "translate(t, 'àâäéèêëîïôöùûüç', 'aaaeeeeiioouuuc')",
        "CASE WHEN length(t) > 4 AND right(t, 1) = substr(t, length(t) - 1, 1) THEN left(t, length(t) - 1) ELSE t END",
    ):
        t = f"list_transform({t}, lambda t: {step})"
    return t


@register("french_topk", _bm25_sql(False, 2.0, values=", ".join(f"""('{i}', '{q.replace("'", "''")}')""" for i, q in FRENCH), tokens=_french_sql) + _TOP.format(r="r", k=10))
def french_topk(spark, d):
    asks = spark.createDataFrame(FRENCH, "query_id string, query string")
    found = R.bm25(corpus(spark, d), asks, {"title": F.col("title"), "content": F.col("content")}, {"title": 2.0}, False, A.french_tokens)
    return _top(found.withColumn("score", F.round("score", 6)), 10)


@register("bool_search", _bm25_sql(True, 2.0, score="max(s)") + f""", b AS (SELECT r.query_id, r.doc_id, round(r.score + 2.0 * phrase + coalesce(near + 1.0, 0.0), 6) AS score FROM (SELECT r.*, CASE WHEN contains(' ' || array_to_string(regexp_extract_all(lower(content), '[a-z0-9]+'), ' ') || ' ', ' ' || array_to_string(regexp_extract_all(lower(query), '[a-z0-9]+'), ' ') || ' ') THEN 1 ELSE 0 END AS phrase, {_FLAT} AS near
FROM r JOIN c USING (doc_id) JOIN documents d USING (doc_id) LEFT JOIN embeddings ON vec_id = doc_id JOIN (VALUES {_VALUES}) AS x(query_id, query) USING (query_id) WHERE d.lang IN ('en', 'es')) r WHERE phrase = 1 OR near IS NOT NULL) """ + _TOP.format(r="b", k=20))
def bool_search(spark, d):
    docs = corpus(spark, d).join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")
    found = R.bool_search(docs, asked(spark), {"title": F.col("title"), "content": F.col("content")}, {"title": 2.0}, {"lang": ["en", "es"], "source": None}, [0.125] * 64, 1)
    return _top(found.withColumn("score", F.round("score", 6)), 20)


@register("phrases_required", _bm25_sql(True, 2.0, score="max(s)") + f""", b AS (SELECT r.query_id, r.doc_id, round(r.score + 2.0, 6) AS score FROM r JOIN c USING (doc_id) JOIN (VALUES {_VALUES}) AS x(query_id, query) USING (query_id)
WHERE contains(' ' || array_to_string(regexp_extract_all(lower(content), '[a-z0-9]+'), ' ') || ' ', ' ' || array_to_string(regexp_extract_all(lower(query), '[a-z0-9]+'), ' ') || ' ')) """ + _TOP.format(r="b", k=20))
def phrases_required(spark, d):
    found = R.bool_search(corpus(spark, d), asked(spark), {"title": F.col("title"), "content": F.col("content")}, {"title": 2.0}, minimum_should=1)
    return _top(found.withColumn("score", F.round("score", 6)), 20)
