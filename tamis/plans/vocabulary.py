"""Domain vocabulary and domain search."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamis.catalog import register
from tamis.functions import vocabulary as V
from tamis.operators import retrieval as R
from tamis.plans.retrieval import _CORPUS, _TOP, _bm25_sql, asked, corpus
from tamis.sources.tables import table

_TEXT = "CASE p_partkey % 4 WHEN 0 THEN 'poutre IPE 200 selon NF EN 1993' WHEN 1 THEN 'HEA205 et HEB300, NF EN 10025 et NF EN ISO 3834' WHEN 2 THEN 'UPN 80 IPE200 IPE 200' ELSE p_name END"


@register("domain_terms", "SELECT p_partkey AS part_id, CASE p_partkey % 4 WHEN 0 THEN 'construction' WHEN 1 THEN 'matériaux|soudage' ELSE '' END AS standards, CASE p_partkey % 4 WHEN 0 THEN 'IPE200' WHEN 1 THEN 'HEB300' WHEN 2 THEN 'UPN80|IPE200' ELSE '' END AS profiles FROM part")
def domain_terms(spark, d):
    t = F.expr(_TEXT)
    return table(spark, d, "part").select(F.col("p_partkey").alias("part_id"), F.array_join(V.standards_in(t), "|").alias("standards"), F.array_join(V.profiles_in(t), "|").alias("profiles"))


@register("domain_vocabulary", "SELECT * FROM (VALUES ('grade', 3::BIGINT), ('paper', 12), ('profile', 68), ('standard', 11), ('state', 20)) AS v(kind, n)")
def domain_vocabulary(spark, d):
    return V.rows(spark).groupBy("kind").agg(F.count("*").alias("n"))


@register("domain_search", _bm25_sql(False, 1.0, "('content')", corpus=_CORPUS + " WHERE lang = 'en' AND source = 'src1'") + _TOP.format(r="r", k=5))
def domain_search(spark, d):
    """Five best documents within a domain's filter; an absent kind of work is no filter."""
    docs = R.metadata_filter(corpus(spark, d), {"lang": "en", "source": "src1", "title": None})
    scored = R.bm25(docs, asked(spark), {"content": F.col("content")}, all_terms=False)
    scored = scored.withColumn("score", F.round("score", 6))
    return R.top_k(scored, 5, [F.desc("score"), F.asc("doc_id")], ["query_id"]).select("query_id", "doc_id", "score")
