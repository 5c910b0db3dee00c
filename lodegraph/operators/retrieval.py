"""Text chunks and exact vector retrieval."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.functions.exprs import chunk_words, cosine, explanation_hash, token_estimate, truncated


def chunks(docs: DataFrame, source: str, text: str, size: int = 500, overlap: int = 50) -> DataFrame:
    """(hash, content, source, pos) of the word windows of each text; equal text of one source is kept once."""
    c = docs.where(F.trim(text) != "").select(F.col(source).cast("string").alias("source"), F.posexplode(chunk_words(text, size, overlap)).alias("pos", "content"))
    return c.withColumn("hash", F.substring(F.sha2(F.concat_ws("|", "content", "source"), 256), 1, 16)).groupBy("hash").agg(F.min(F.struct("source", "pos", "content")).alias("r")).select("hash", "r.content", "r.source", "r.pos")


def new_chunks(found: DataFrame, store: DataFrame) -> DataFrame:
    return found.join(store.select("hash"), "hash", "left_anti")


def symbol_text(symbols: DataFrame, cap: int = 12_000) -> DataFrame:
    """(id, text): header, known facts and documentation of a symbol, cut at ``cap`` characters."""
    some = lambda c, label: F.concat(F.lit(label), F.nullif(F.col(c), F.lit("")))
    meta = F.concat_ws(" | ", some("layer", "layer: "), some("domain", "domain: "), some("summary", "summary: "), some("signature", "signature: "))
    text = F.concat_ws("\n", F.format_string("%s %s in %s", "kind", "name", "file"), F.nullif(meta, F.lit("")), F.nullif(F.col("source"), F.lit("")))
    return symbols.select("id", truncated(text, cap, "... (truncated)").alias("text"))


def embedded(texts: DataFrame, embed: Callable[[list[str]], list[list[float]]], batch: int = 64) -> DataFrame:
    """(id, vector) by an injected batch function."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            rows = f["text"].fillna("").tolist()
            vectors = [v for i in range(0, len(rows), batch) for v in embed(rows[i : i + batch])]
            yield pd.DataFrame({"id": f["id"], "vector": vectors})

    return texts.mapInPandas(run, f"id {dict(texts.dtypes)['id']}, vector array<float>")


def top_k(store: DataFrame, query: list[float], k: int = 5, min_score: float = 0.25) -> DataFrame:
    """The ``k`` chunks most similar to one query vector, exact; ties go to the smaller hash."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = store.select("hash", "source", "symbol_id", cosine("vector", q).alias("score"))
    return scored.where((F.col("score") >= min_score) & ~F.isnan("score")).orderBy(F.desc(F.round("score", 5)), "hash").limit(k)


def source_window(content: str, start: str, end: str, margin: int = 3, cap: int = 80):
    """Lines around a symbol, at most ``cap`` of them, as a struct of text and the number left out."""
    lines = F.split(content, "\n")
    lo, hi = F.greatest(F.lit(0), F.col(start) - 1 - margin), F.least(F.size(lines), F.col(end) + margin)
    n = F.greatest(F.lit(0), hi - lo)
    return F.struct(F.array_join(F.slice(lines, (lo + 1).cast("int"), F.least(n, F.lit(cap)).cast("int")), "\n").alias("text"), F.greatest(F.lit(0), n - cap).alias("omitted"))


def context(symbols: DataFrame, edges: DataFrame, mappings: DataFrame, cap: int = 20_000) -> DataFrame:
    """(id, text, tokens): a symbol with the names it depends on, its dependents and its documents."""
    name = symbols.select("id", "name")
    # no more than ``cap`` // 3 names can show before the text is cut, so no list grows beyond that
    most = cap // 3 + 1

    def some(pairs: DataFrame, key: str, out: str) -> DataFrame:
        w = Window.partitionBy(key).orderBy("x")
        few = pairs.select(key, F.col("x")).distinct().withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
        return few.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list("x")), ", ").alias(out))

    out = some(edges.join(name.select(F.col("id").alias("target_id"), F.col("name").alias("x")), "target_id").withColumnRenamed("source_id", "id"), "id", "deps")
    into = some(edges.join(name.select(F.col("id").alias("source_id"), F.col("name").alias("x")), "source_id").withColumnRenamed("target_id", "id"), "id", "users")
    docs = some(mappings.select(F.col("symbol_name").alias("name"), F.col("doc_path").alias("x")), "name", "docs")
    j = symbols.join(out, "id", "left").join(into, "id", "left").join(docs, "name", "left")
    part = lambda c, label: F.concat(F.lit(label), F.col(c))
    text = truncated(F.concat_ws("\n", F.format_string("%s %s (%s)", "kind", "name", "file"), part("deps", "uses: "), part("users", "used by: "), part("docs", "docs: ")), cap, "... (truncated)")
    return j.select("id", text.alias("text"), F.col("deps").isNotNull().alias("has_deps"), F.col("users").isNotNull().alias("has_dependents"), F.col("docs").isNotNull().alias("has_docs")).withColumn("tokens", token_estimate("text"))


def explain_requests(symbols: DataFrame) -> DataFrame:
    """(id, hash, cached, prompt): what to ask of a language model, and whether a stored explanation still holds."""
    now = explanation_hash("id", "start_line", "end_line", "source")
    cached = (F.coalesce("explanation", F.lit("")) != "") & F.col("explanation_hash").eqNullSafe(now)
    prompt = F.concat_ws("\n", F.format_string("Explain %s %s in %s", "kind", "name", "file"), F.nullif(F.col("signature"), F.lit("")), F.nullif(F.col("summary"), F.lit("")))
    return symbols.select("id", now.alias("hash"), cached.alias("cached"), prompt.alias("prompt"))
