"""Names to symbols: ordered fallbacks as left joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve(refs: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """(ref, id, how) for refs (ref, file, namespace, target).

    Exact name, then the file's import alias (imports: file, alias, qualified), then the
    namespace, then ``path::name`` against files that end with the path. A name that several
    symbols bear goes to the one written last.
    """
    one = symbols.groupBy("name").agg(F.max_by("id", "seq").alias("hit"))

    def by(df: DataFrame, key: str, out: str) -> DataFrame:
        return df.join(one.select(F.col("name").alias(key), F.col("hit").alias(out)), key, "left")

    imp = imports.groupBy("file", F.col("alias").alias("target")).agg(F.max("qualified").alias("via"))
    r = refs.join(imp, ["file", "target"], "left").withColumn("ns", F.when(F.col("namespace") != "", F.concat("namespace", F.lit("\\"), "target")))
    r = by(by(by(r, "target", "h1"), "via", "h2"), "ns", "h3")
    bare = lambda c: F.regexp_replace(c, r"\.(js|ts|tsx|jsx)$", "")
    path = r.where(F.col("target").contains("::")).select("ref", F.element_at(F.split("target", "::"), 2).alias("name"), F.regexp_replace(bare(F.element_at(F.split("target", "::"), 1)), r"^\./", "").alias("tail"))
    cand = path.join(symbols.select("id", "seq", "file", F.element_at(F.split("name", r"[\\.]"), -1).alias("name")), "name").where(F.endswith(bare("file"), F.col("tail")))
    h4 = cand.groupBy("ref").agg(F.min_by("id", "seq").alias("h4"))
    j = r.join(h4, "ref", "left")
    how = F.when(F.col("h1").isNotNull(), "exact").when(F.col("h2").isNotNull(), "import").when(F.col("h3").isNotNull(), "namespace").when(F.col("h4").isNotNull(), "path")
    return j.select("ref", F.coalesce("h1", "h2", "h3", "h4").alias("id"), how.alias("how"))


def dynamic_edges(found: DataFrame, symbols: DataFrame) -> DataFrame:
    """Dynamic registrations (source_name, target_name) as edges by id, direction swapped; unknown names stay literal."""
    one = symbols.groupBy("name").agg(F.max_by("id", "seq").alias("id"))
    s = found.join(one.select(F.col("name").alias("source_name"), F.col("id").alias("s")), "source_name", "left").join(one.select(F.col("name").alias("target_name"), F.col("id").alias("t")), "target_name", "left")
    return s.select(F.coalesce("t", "target_name").alias("source_id"), F.coalesce("s", "source_name").alias("target_id"), F.lit("dynamic_call").alias("type"))


def references(edges: DataFrame) -> DataFrame:
    """(id, side, other, first): distinct neighbours of both sides with the order of their first mention (edges: source_id, target_id, seq).

    One row a pair, so that a symbol which a third of the project refers to needs no list.
    """
    both = F.array(F.struct(F.col("source_id").alias("id"), F.lit("out").alias("side"), F.col("target_id").alias("other")), F.struct(F.col("target_id").alias("id"), F.lit("in").alias("side"), F.col("source_id").alias("other")))
    first = edges.groupBy("source_id", "target_id").agg(F.min("seq").alias("first"))
    return first.select("first", F.explode(both).alias("x")).select("x.id", "x.side", "x.other", "first")
