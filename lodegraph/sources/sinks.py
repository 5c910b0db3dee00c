"""Sinks: keyed upserts, replace-all reports, deletes and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.operators.changes import keep_last


def upsert(stored: DataFrame, rows: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """Stored and new rows with the last one of every key kept; new columns are added as null."""
    old = stored.withColumn("_new", F.lit(0))
    both = old.unionByName(rows.withColumn("_new", F.lit(1)), allowMissingColumns=True).withColumn("_o", F.struct("_new", order))
    return keep_last(both, keys, "_o").drop("_new", "_o")


def delete(stored: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return stored.join(gone.select(*keys).distinct(), keys, "left_anti")


def replace_all(df: DataFrame, path: str) -> None:
    """Write a report over the old one; the frame must not read the same path."""
    df.write.mode("overwrite").parquet(path)


def replace_by_file(stored: DataFrame, rows: DataFrame, file: str = "file") -> DataFrame:
    """New rows take the place of everything stored for their files."""
    return delete(stored, rows, [file]).unionByName(rows, allowMissingColumns=True)


def search_index(symbols: DataFrame) -> DataFrame:
    """Slim rows for a search page, to be written as JSON lines."""
    return symbols.select("id", "name", "kind", "file", F.coalesce("summary", F.lit("")).alias("summary"), F.substring_index("file", "/", 1).alias("dir"))


def matrix_text(matrix: DataFrame, kind: str = "md") -> DataFrame:
    """Traceability rows as lines of a Markdown table or a CSV file, header first (column ``line``)."""
    cols = ["ticket", "role", "value"]
    if kind == "md":
        head = ["| Ticket | Role | Value |", "| --- | --- | --- |"]
        line = F.concat(F.lit("| "), F.concat_ws(" | ", *cols), F.lit(" |"))
    else:
        head = ["ticket,role,value"]
        line = F.concat_ws(",", *[F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"')) for c in cols])
    top = matrix.sparkSession.createDataFrame([(i, h) for i, h in enumerate(head)], "at int, line string")
    return top.unionByName(matrix.select(F.lit(len(head)).alias("at"), line.alias("line"))).orderBy("at", "line").select("line")


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored table, or an empty frame of its schema on the first run."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)
