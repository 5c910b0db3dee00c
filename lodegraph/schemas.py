"""Canonical schemas of the model's tables, and alignment of older or foreign frames to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

VERSION = 2
_METRICS = "struct<linesOfCode:int,cyclomaticComplexity:int,parameterCount:int,testCoverage:struct<hitCount:int,linesHit:int,linesCovered:int,coveragePercent:double,branchesHit:int,branchesCovered:int>>"
# Table layouts and the closed vocabularies of the model
TABLES = {
    "symbols": "id string, name string, qualified_name string, kind string, file string, start_line int, end_line int, parent string, visibility string, exported boolean, language string, doc_ref string, summary string, doc_comment string, tags array<string>, domain string, bounded_context string, sym_extends string, sym_implements array<string>, uses_traits array<string>, sym_references array<string>, referenced_by array<string>, layer string, metrics " + _METRICS + ", pattern string, violations array<string>, deprecated boolean, since string, stability string, generated boolean, source string, last_modified timestamp, signature string, explanation string, explanation_hash string, seq long",
    "relationships": "source_id string, target_id string, type string, seq long",
    "doc_mappings": "symbol_name string, doc_path string, section string, updated_at timestamp, seq long",
    "registered_docs": "path string, title string, name string, category string, module string, previous string, next string, show_on_menu boolean",
    "rag_chunks": "hash string, content string, source string, symbol_id string, vector array<float>",
    "file_hashes": "file_path string, content_hash string, last_indexed_at timestamp",
    "patterns": "kind string, symbols array<string>, confidence double, violations array<string>",
    "arch_violations": "rule string, file string, symbol_id string, message string, severity string",
    "reaper_findings": "type string, target string, reason string, suggested_action string",
}
LAYERS = ("domain", "application", "infrastructure", "presentation", "test")
VISIBILITIES = ("public", "protected", "private")


def schema(name: str) -> StructType:
    return StructType.fromDDL(TABLES[name])


def align(df: DataFrame, name: str) -> DataFrame:
    """The frame in the canonical layout: missing columns become null, others are cast, extra ones go."""
    have = {c.lower(): c for c in df.columns}
    return df.select(*[(F.col(f"`{have[f.name.lower()]}`").try_cast(f.dataType) if f.name.lower() in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema(name).fields])


def quarantine(symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, invalid) symbol rows: identity present, lines in order, vocabularies respected."""
    ok = F.col("id").isNotNull() & F.col("name").isNotNull() & F.col("kind").isNotNull() & F.col("file").isNotNull() & (F.col("end_line") >= F.col("start_line"))
    ok = ok & (F.col("layer").isNull() | F.col("layer").isin(*LAYERS)) & (F.col("visibility").isNull() | F.col("visibility").isin(*VISIBILITIES))
    ok = F.coalesce(ok, F.lit(False))
    return symbols.where(ok), symbols.where(~ok)
