"""Graph operators over (source_id, target_id, type) edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.plans.lineage import cut


def last_edge(relationships: DataFrame) -> DataFrame:
    """One edge per (source, target): the type written last."""
    return relationships.groupBy("source_id", "target_id").agg(F.max_by("type", "seq").alias("type"))


def reach(edges: DataFrame, roots: DataFrame, max_depth: int) -> DataFrame:
    """(id, depth) of nodes reached along ``src`` to ``dst`` edges, roots left out, at least depth.

    Frontier by frontier: only new nodes are expanded, so cycles end and no path is counted
    twice. Lineage is cut each round; the edges are prepared once.
    """
    edges = cut(edges)
    seen = cut(roots.select("id").distinct().withColumn("depth", F.lit(0)))
    front = seen
    for depth in range(1, max_depth + 1):
        step = edges.join(front.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
        front = cut(step.join(seen, "id", "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.where("depth > 0")


def impact_radius(relationships: DataFrame, roots: DataFrame, max_depth: int = 3) -> DataFrame:
    """Everything that depends on the roots, over edges of any type, against their direction."""
    back = relationships.select(F.col("target_id").alias("src"), F.col("source_id").alias("dst")).distinct()
    return reach(back, roots, max_depth)


def neighbourhood(relationships: DataFrame, roots: DataFrame, max_depth: int = 1) -> DataFrame:
    """Nodes within ``max_depth`` undirected steps of the roots."""
    a = relationships.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))
    return reach(a.unionByName(a.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), roots, max_depth)


def rebuilt_edges(symbols: DataFrame) -> DataFrame:
    """Edges as the array columns of the symbols state them."""
    parts = [
        symbols.select(F.col("id").alias("source_id"), F.col("sym_extends").alias("target_id"), F.lit("inherits").alias("type")).where("target_id <> ''"),
        symbols.select(F.col("id").alias("source_id"), F.explode("sym_implements").alias("target_id"), F.lit("implements").alias("type")),
        symbols.select(F.col("id").alias("source_id"), F.explode("sym_references").alias("target_id"), F.lit("uses").alias("type")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).where("target_id is not null")


def labelled(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges with the names of both ends, the id where there is none."""
    n = symbols.select("id", "name")
    a = edges.join(n.select(F.col("id").alias("source_id"), F.col("name").alias("_s")), "source_id", "left")
    b = a.join(n.select(F.col("id").alias("target_id"), F.col("name").alias("_t")), "target_id", "left")
    return b.select("source_id", "target_id", "type", F.coalesce("_s", "source_id").alias("source"), F.coalesce("_t", "target_id").alias("target"))


def endpoints(edges: DataFrame, symbols: DataFrame, cols: list[str]) -> DataFrame:
    """Edges whose ends both exist, with chosen columns of either as ``s_*`` and ``t_*``."""
    s = symbols.select(F.col("id").alias("source_id"), *[F.col(c).alias(f"s_{c}") for c in cols])
    t = symbols.select(F.col("id").alias("target_id"), *[F.col(c).alias(f"t_{c}") for c in cols])
    return edges.join(s, "source_id").join(t, "target_id")


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree) counting both ends of every edge."""
    return edges.select(F.explode(F.array("source_id", "target_id")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes`` (column ``id``)."""
    return edges.join(nodes.select(F.col("id").alias("source_id")), "source_id", "left_semi").join(nodes.select(F.col("id").alias("target_id")), "target_id", "left_semi")


def ego(edges: DataFrame, symbols: DataFrame, center: str, direction: str = "both") -> DataFrame:
    """Edges into or out of one symbol whose other end exists."""
    out, into = F.col("source_id") == center, F.col("target_id") == center
    return endpoints(edges.where(out if direction == "out" else into if direction == "in" else out | into), symbols, ["name"])


def within_files(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges with both ends in one file, with that file."""
    return endpoints(edges, symbols, ["file"]).where("s_file = t_file").select(F.col("s_file").alias("file"), "source_id", "target_id", "type")
