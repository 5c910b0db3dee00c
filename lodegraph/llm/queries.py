"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.llm import docpairs, handwritten, leaks, mixing, neighbours, parsing, subjects
from lodegraph.sources.tables import table


def _checked(spark: SparkSession, d: str) -> DataFrame:
    return parsing.checked_files(table(spark, d, "source_files"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _checked(spark, d).where("not valid").select(F.col("path").alias("file"))


def p7_errors(spark: SparkSession, d: str) -> DataFrame:
    return _checked(spark, d).where("not valid").select("path", "repo", "language", "error_line")


def p7_rates(spark: SparkSession, d: str) -> DataFrame:
    return parsing.rates(_checked(spark, d), table(spark, d, "index_results"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_leaks(spark, d).select("doc_id", "item_id")


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    return subjects.subjects_of(*(table(spark, d, t) for t in ("documents", "subject_areas", "subject_samples")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d).select("doc_id", "subject").distinct()


def p10_makeup(spark: SparkSession, d: str) -> DataFrame:
    """Documents and characters per subject; a document of two subjects counts for both."""
    docs = table(spark, d, "documents").select("doc_id", F.length("text").alias("chars"))
    found = _subjects(spark, d).select("doc_id", "subject").distinct()
    return docs.join(found, "doc_id", "left").groupBy(F.coalesce("subject", F.lit("(none)")).alias("subject")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("chars").alias("n_chars"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.not_by_hand(table(spark, d, "source_files"), table(spark, d, "symbols"))


def p1_margins(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.judged(table(spark, d, "source_files"), table(spark, d, "symbols")).select("path", F.round("body", 4).alias("body"), F.round("head", 4).alias("head"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_pairs(spark, d).select("symbol_id")


def p2_pairs(spark: SparkSession, d: str) -> DataFrame:
    return docpairs.documented(table(spark, d, "symbols"))


def p2_file_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs extracted from the text of the source files themselves."""
    return docpairs.documented_in_files(table(spark, d, "source_files"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.close_pairs(neighbours.nearest(table(spark, d, "rag_chunks")), 0.90)


def p5_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest of every chunk with the symbols of both."""
    chunks = table(spark, d, "rag_chunks")
    near = neighbours.nearest(chunks)
    symbol = chunks.where("hash is not null").groupBy("hash").agg(F.min("symbol_id").alias("symbol_id"))
    return near.join(symbol, "hash", "left").join(symbol.select(F.col("hash").alias("neighbour"), F.col("symbol_id").alias("neighbour_symbol_id")), "neighbour", "left").select("hash", "symbol_id", "neighbour", "neighbour_symbol_id", "rank", F.round("cosine", 6).alias("cosine"))


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


QUERIES = {f.__name__: f for f in (p1_found, p1_margins, p2_found, p2_pairs, p2_file_pairs, p5_found, p5_neighbours, p9_mix, p9_shares, p7_found, p7_errors, p7_rates, p8_found, p8_leaks, p10_found, p10_makeup)}
SQL: dict[str, str] = {
    "p5_found": """with v as (
  select hash, min(vector)::double[] v from rag_chunks
  where hash is not null and len(vector) = 64 and len(list_filter(vector, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(vector, lambda x: x <> 0)) > 0
  group by 1),
p as (select a.hash h, b.hash n, list_cosine_similarity(a.v, b.v) c from v a join v b on a.hash <> b.hash),
t as (select *, row_number() over (partition by h order by c desc, n) k from p)
select distinct least(h, n) hash_a, greatest(h, n) hash_b from t where k <= 5 and c >= 0.9""",
}
