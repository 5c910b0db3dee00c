"""Mermaid text from graph frames: ordered line rows, joined at the end."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.functions.exprs import diagram_id

# Arrows per edge type
ARROWS = {"inherits": "--|>", "implements": "..|>", "uses": "-->", "calls": "-->", "instantiates": "..>", "dispatches": "-.->", "listens_to": "-.->"}


def _text(lines: DataFrame, head: str, limit: int) -> DataFrame:
    """One row of text; at most ``limit`` lines, a last line tells of a cut."""
    top = lines.orderBy("at", "line").limit(limit + 1)
    g = top.agg(F.sort_array(F.collect_list(F.struct("at", "line"))).alias("x"))
    body = F.transform("x", lambda v: F.concat(F.lit("    "), v["line"]))
    cut = F.when(F.size(body) > limit, F.concat(F.slice(body, 1, limit), F.array(F.lit("    %% truncated")))).otherwise(body)
    return g.select(F.array_join(F.concat(F.array(F.lit(head)), cut), "\n").alias("text"))


def class_diagram(symbols: DataFrame, edges: DataFrame, limit: int = 400) -> DataFrame:
    """Classes with their methods, and one arrow per pair of classes (the first type in order)."""
    cls = symbols.where(F.col("kind").isin("class", "abstract_class", "interface"))
    own = cls.select("id", diagram_id("name").alias("c"))
    kids = symbols.where("kind = 'method'").join(own.select(F.col("id").alias("parent"), "c"), "parent").select(F.concat(F.lit("0"), "c", F.lit("1"), "name").alias("at"), F.concat("c", F.lit(" : +"), "name", F.lit("()")).alias("line"))
    decl = own.select(F.concat(F.lit("0"), "c", F.lit("0")).alias("at"), F.concat(F.lit("class "), "c").alias("line"))
    w = Window.partitionBy("source_id", "target_id").orderBy("type")
    one = edges.withColumn("n", F.row_number().over(w)).where("n = 1").join(own.select(F.col("id").alias("source_id"), F.col("c").alias("a")), "source_id").join(own.select(F.col("id").alias("target_id"), F.col("c").alias("b")), "target_id")
    arrow = F.coalesce(F.create_map(*[F.lit(x) for kv in ARROWS.items() for x in kv])[F.col("type")], F.lit("-->"))
    links = one.select(F.concat(F.lit("1"), "a", F.lit(" "), "b").alias("at"), F.concat("a", F.lit(" "), arrow, F.lit(" "), "b").alias("line"))
    return _text(decl.unionByName(kids).unionByName(links).distinct(), "classDiagram", limit)


def flow_diagram(edges: DataFrame, limit: int = 400) -> DataFrame:
    """Edges (source, target, type) by name as a left-to-right graph."""
    line = F.concat(diagram_id("source"), F.lit(' -->|"'), F.col("type"), F.lit('"| '), diagram_id("target"))
    return _text(edges.select(line.alias("at"), line.alias("line")).distinct(), "graph LR", limit)


def sequence_diagram(edges: DataFrame, limit: int = 400) -> DataFrame:
    """Calls (source, target, type) in order of names."""
    line = F.concat(diagram_id("source"), F.lit("->>"), diagram_id("target"), F.lit(": "), F.col("type"))
    return _text(edges.where("type in ('calls', 'dispatches', 'dynamic_call')").select(line.alias("at"), line.alias("line")).distinct(), "sequenceDiagram", limit)


def event_flow_diagram(flow: DataFrame, symbols: DataFrame, limit: int = 400) -> DataFrame:
    """Emitters to events to listeners."""
    n = symbols.select("id", diagram_id("name").alias("label"))
    e = flow.where("role <> 'none'").join(n.withColumnRenamed("label", "event"), "id").select("event", "role", F.col("symbol_id").alias("id")).join(n, "id")
    out = e.where("role = 'emitter'").select(F.concat("event", F.lit("0"), "label").alias("at"), F.concat("label", F.lit("->>"), "event", F.lit(": dispatch")).alias("line"))
    into = e.where("role = 'listener'").select(F.concat("event", F.lit("1"), "label").alias("at"), F.concat("event", F.lit("->>"), "label", F.lit(": handle")).alias("line"))
    return _text(out.unionByName(into), "sequenceDiagram", limit)
