"""Symbols against coverage lines, enclosing symbols, and coverage figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 64


def _blocks(symbols: DataFrame) -> DataFrame:
    """A row per block of lines a symbol touches: turns the range join into an equi join that no large file skews."""
    lo, hi = F.floor(F.col("start_line") / BLOCK).cast("long"), F.floor(F.col("end_line") / BLOCK).cast("long")
    return symbols.where("end_line >= start_line").withColumn("block", F.explode(F.sequence(lo, hi)))


def lines_in_symbols(symbols: DataFrame, lines: DataFrame) -> DataFrame:
    """(id, line, hits): range join start_line <= line <= end_line on equal files."""
    l = lines.select("file", "line", "hits", F.floor(F.col("line") / BLOCK).cast("long").alias("block"))
    return _blocks(symbols.select("id", "file", "start_line", "end_line")).join(l, ["file", "block"]).where("line between start_line and end_line").select("id", "line", "hits")


def symbol_coverage(symbols: DataFrame, lines: DataFrame) -> DataFrame:
    """(id, lines_found, lines_hit, percent) of the symbols that have coverage lines."""
    g = lines_in_symbols(symbols, lines).groupBy("id").agg(F.count(F.lit(1)).alias("lines_found"), F.count_if(F.col("hits") > 0).alias("lines_hit"))
    return g.withColumn("percent", F.col("lines_hit") * 100.0 / F.col("lines_found"))


def enclosing(symbols: DataFrame, points: DataFrame) -> DataFrame:
    """(ref, id): the smallest symbol around each point (ref, file, line); ties go to the smaller id."""
    p = points.select("ref", "file", "line", F.floor(F.col("line") / BLOCK).cast("long").alias("block"))
    j = _blocks(symbols.select("id", "file", "start_line", "end_line")).join(p, ["file", "block"]).where("line between start_line and end_line")
    w = Window.partitionBy("ref").orderBy(F.col("end_line") - F.col("start_line"), "id")
    return j.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("ref", "id")


def buckets(symbols: DataFrame) -> DataFrame:
    """One row: counts of well, partly, poorly and not covered symbols, and the average of those that have coverage."""
    p = F.col("metrics.testCoverage.coveragePercent")
    return symbols.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(p >= 80).alias("high"), F.count_if((p >= 50) & (p < 80)).alias("medium"), F.count_if((p > 0) & (p < 50)).alias("low"), F.count_if(p == 0).alias("none"), F.round(F.avg(p), 4).alias("average")
    )
