"""A stored text index: postings by bucket of their term, with incremental add, update and delete.

Texts are tokenized once, when they are added. A version of the index is a set of immutable files: postings of each
batch, partitioned by a hash bucket of the term and sorted by term inside, and the documents of each batch with their
field lengths. A deletion writes the batch number below which a document's postings are void; an update is a deletion
and an addition. A search reads only the buckets of its terms (partition pruning) and, by the sorted files' statistics,
little more than the terms' own rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.functions.analyzer import ascii_tokens
from tamis.operators.retrieval import query_terms, scored_postings

BUCKETS = 64


class TextIndex:
    def __init__(self, spark: SparkSession, path: str, fields: dict[str, Column], tokens: Callable[[Column], Column] = ascii_tokens, buckets: int = BUCKETS):
        """``fields`` maps field names to expressions over the documents; the folder ``path`` is shared by all nodes."""
        self.spark, self.path, self.fields, self.tokens, self.buckets = spark, path.rstrip("/"), fields, tokens, buckets
        self.batch = 0

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def _read(self, kind: str, schema: str) -> DataFrame:
        """All batches of one kind of file; an empty frame before the first."""
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{kind}")

    def _documents(self) -> DataFrame:
        return self._read("documents", "doc_id long, lengths map<string,int>, processed_date timestamp, batch int")

    def _gone(self) -> DataFrame:
        """doc_id and the batch from which on it is valid again; one row per document that was ever deleted."""
        return self._read("deleted", "doc_id long, batch int").groupBy("doc_id").agg(F.max("batch").alias("valid_from"))

    def _live(self, rows: DataFrame) -> DataFrame:
        return rows.join(self._gone(), "doc_id", "left").filter("valid_from is null or batch >= valid_from").drop("valid_from")

    def add(self, docs: DataFrame) -> DataFrame:
        """Indexes a batch; rows without an id are not indexed and are returned with their reason."""
        self.batch += 1
        named = docs.filter("doc_id is not null").select("doc_id", *(self.tokens(text).alias(f) for f, text in self.fields.items()))
        lengths = F.map_from_arrays(F.array(*map(F.lit, self.fields)), F.array(*(F.size(f) for f in self.fields)))
        named.select("doc_id", lengths.alias("lengths"), F.current_timestamp().alias("processed_date"), F.lit(self.batch).alias("batch")).write.mode("append").partitionBy("batch").parquet(f"{self.path}/documents")
        rows = named.select("doc_id", F.inline(F.array(*(F.struct(F.lit(f).alias("field"), F.size(f).alias("dl"), F.col(f).alias("t")) for f in self.fields))))
        rows = rows.select("doc_id", "field", "dl", F.explode("t").alias("term")).groupBy("doc_id", "field", "dl", "term").agg(F.count("*").alias("tf"))
        rows = rows.select("doc_id", "field", "dl", "term", "tf", F.lit(self.batch).alias("batch"), self._bucket(F.col("term")).alias("bucket"))
        # a frequent term's rows are spread over several files of its bucket by document
        rows.repartition("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(4))).sortWithinPartitions("bucket", "term").write.mode("append").partitionBy("batch", "bucket").parquet(f"{self.path}/postings")
        return docs.filter("doc_id is null").withColumn("error", F.lit("no doc_id"))

    def delete(self, ids: DataFrame) -> None:
        """Voids what earlier batches hold of these documents (doc_id)."""
        ids.select("doc_id").distinct().withColumn("batch", F.lit(self.batch + 1)).write.mode("append").partitionBy("batch").parquet(f"{self.path}/deleted")

    def update(self, docs: DataFrame) -> DataFrame:
        self.delete(docs)
        return self.add(docs)

    def statistics(self) -> DataFrame:
        """Live documents with any token, and mean length, per field."""
        rows = self._live(self._documents()).select(F.explode("lengths").alias("field", "n")).filter("n > 0")
        return rows.groupBy("field").agg(F.count("*").alias("n_docs"), F.avg("n").alias("avg_dl"))

    def search(self, queries: DataFrame, boosts: dict[str, float] | None = None, all_terms: bool = True) -> DataFrame:
        """query_id, doc_id, score, as :func:`tamis.operators.retrieval.bm25` over the live documents."""
        terms = query_terms(queries, self.tokens)
        asked = terms.select("term", self._bucket(F.col("term")).alias("bucket")).distinct().collect()  # the queries' own terms
        post = self._read("postings", "doc_id long, field string, dl int, term string, tf long, batch int, bucket int")
        post = post.filter(F.col("bucket").isin(sorted({r["bucket"] for r in asked})) & F.col("term").isin(sorted(r["term"] for r in asked)))
        return scored_postings(self._live(post).drop("batch", "bucket"), self.statistics(), terms, boosts, all_terms)
