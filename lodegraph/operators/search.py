"""Lookups and searches over symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_ids(symbols: DataFrame, ids: DataFrame) -> DataFrame:
    """Symbols whose id occurs in ``ids`` (column ``id``)."""
    return symbols.join(ids.select("id").distinct(), "id", "left_semi")


def by_name(symbols: DataFrame, name: str) -> DataFrame:
    return symbols.where((F.col("name") == name) | (F.col("qualified_name") == name))


def search(symbols: DataFrame, query: str | None = None, kind: str | None = None, layer: str | None = None, limit: int = 20) -> DataFrame:
    """Case-blind substring search over names, file and summary; SQL wildcards in ``query`` stay active.

    Ordered by file and start line; ``limit`` is held between 1 and 100.
    """
    out = symbols
    if query and query.strip():
        like = f"%{query.strip()}%"
        out = out.where(F.col("name").ilike(like) | F.col("qualified_name").ilike(like) | F.col("file").ilike(like) | F.col("summary").ilike(like))
    if kind:
        out = out.where(F.col("kind") == kind)
    if layer:
        out = out.where(F.col("layer") == layer)
    return out.orderBy("file", "start_line", "id").limit(max(1, min(100, limit)))


def outline(symbols: DataFrame) -> DataFrame:
    """One line of text a symbol, with its place in its file."""
    text = F.concat(F.format_string("L%d-%d [%s] %s", "start_line", "end_line", "kind", "name"), F.when(F.col("signature") != "", F.concat(F.lit(": "), F.col("signature"))).otherwise(F.lit("")), F.when(F.col("summary") != "", F.concat(F.lit(" // "), F.col("summary"))).otherwise(F.lit("")))
    return symbols.select("file", "id", "start_line", text.alias("line"))


# Words a parser mistakes for names
GHOSTS = ("if", "for", "while", "switch", "catch", "return", "function", "constructor")


def without_ghosts(symbols: DataFrame) -> DataFrame:
    return symbols.where(~F.col("name").isin(*GHOSTS))
