"""Access to the tables of a dataset folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.plans.lineage import broadcast_below, cut, too_few_splits


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a dataset folder; columns are pruned by the reader."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def norm_id(c: Column | str) -> Column:
    """Ids and edge types are compared without case and surrounding blanks."""
    return F.lower(F.trim(F.col(c) if isinstance(c, str) else c, F.lit(" \t\r\n")))


def norm_path(c: Column | str) -> Column:
    """Backslashes become slashes, blanks around and a leading ./ go."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.replace(F.trim(c, F.lit(" \t\r\n")), F.lit("\\"), F.lit("/")), r"^(\./)+", "")


def month_index(ts: Column | str) -> Column:
    """Months since year 0 of the UTC calendar month, whatever the session's time zone."""
    c = F.col(ts) if isinstance(ts, str) else ts
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_micros(c) / F.lit(86_400_000_000)).cast("int"))
    return (F.year(day) * 12 + F.month(day) - 1).cast("int")


def month_label(m: Column | str) -> Column:
    """``YYYY-MM`` of a month index."""
    c = F.col(m) if isinstance(m, str) else m
    return F.format_string("%04d-%02d", F.floor(c / 12).cast("int"), (c % 12 + 1).cast("int"))


def current_rows(df: DataFrame, key: str, cols: list[str], order: str = "seq") -> DataFrame:
    """The row of highest ``order`` per ``key``, reduced to ``cols``; null keys are left out."""
    picked = F.max(F.struct(F.col(order).alias("_o"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(cols)])).alias("_r")
    best = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(picked)
    return best.select(F.col("_k").alias(key), *[F.col(f"_r._{i}").alias(c) for i, c in enumerate(cols) if c != key])


def current_wide(df: DataFrame, key: str, cols: list[str], order: str = "seq", broadcast_rows: int = 500_000) -> DataFrame:
    """As ``current_rows``, for tables of wide columns (file contents): these are not shuffled.

    Only (key, order) pairs are counted. Rows of a key that has several are compared with its
    highest ``order``; the list of such keys is broadcast while it has at most
    ``broadcast_rows`` rows, else joined by shuffle. Where rows tie for the highest order, the
    rows of those keys alone go through ``current_rows``. Tables of fewer splits than the session
    has cores are spread by key.
    """
    few = too_few_splits(df)
    own = df.where(F.col(key).isNotNull()).select(key, *[c for c in dict.fromkeys([*cols, order]) if c != key])
    each = own.groupBy(F.col(key).alias("_k"), F.col(order).alias("_o")).agg(F.count(F.lit(1)).alias("_n"))
    per_key = each.groupBy("_k").agg(F.max("_o").alias("_m"), F.max_by("_n", "_o").alias("_ties"), F.sum("_n").alias("_n"))
    several = cut(per_key.where("_n > 1").select("_k", "_m", (F.col("_m").isNull() | (F.col("_ties") > 1)).alias("_tied")))
    seen = several.agg(F.count(F.lit(1)).alias("n"), F.count_if("_tied").alias("tied")).first()
    several = broadcast_below(several, seen["n"], broadcast_rows)
    best = own.join(several, own[key] == several["_k"], "left").where(F.col("_k").isNull() | (~F.col("_tied") & (F.col(order) == F.col("_m")))).select(key, *[c for c in cols if c != key])
    if few:
        best = best.repartition(few, key)
    if not seen["tied"]:
        return best
    tied = own.join(several.where("_tied").select(F.col("_k").alias(key)), key, "left_semi")
    return best.unionByName(current_rows(tied, key, cols, order))
