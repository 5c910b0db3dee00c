"""Mixing sources to target weights by hash-random keys and distributed prefix sums.

Every row gets a random key from a hash of its id; the keys are cut into equal ranges. Token
sums per (source, range) give, by a running sum over the few ranges of a source, where each
range starts; only inside the one range in which a source's budget ends are rows summed up
one by one. No source is ever sorted or held in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.plans.lineage import cut, too_few_splits

# where the driver finds the vocabulary; the executors get its content
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the public byte-level BPE vocabulary splits text before merging
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RANGE_ROWS = 50_000


@lru_cache(maxsize=2)
def _encoding(vocabulary: bytes):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _count(vocabulary):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoding(vocabulary.value)
        for f in frames:
            if not len(f):
                continue
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in f["text"]]
            yield f[["doc_id", "source", "key"]].assign(tokens=pd.Series(n, index=f.index, dtype="int64"))

    return run


def norm_source(c: Column | str) -> Column:
    """Case, blanks and ``-`` for ``_`` make no other source."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.trim(F.lower(c), F.lit(" \t\r\n")), r"[-\s]+", "_")


def sized(documents: DataFrame, vocabulary: str = VOCABULARY, seed: int = 11) -> DataFrame:
    """(doc_id, source, key, tokens): key is uniform in [0, 2**40)."""
    key = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 40))
    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), norm_source("source").alias("source"), key.alias("key"), "text").where("doc_id is not null")
    with open(vocabulary, "rb") as f:
        sent = documents.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: about a megabyte
    if few := too_few_splits(documents):
        own = own.repartition(few, "doc_id")
    return own.mapInPandas(_count(sent), "doc_id long, source string, key long, tokens long")


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, vocabulary: str = VOCABULARY, seed: int = 11, range_rows: int = RANGE_ROWS) -> tuple[DataFrame, DataFrame]:
    """(rows, report): (doc_id, source, tokens, repeats) of the chosen rows, and the shares reached per source.

    ``total_tokens`` is the size of the mixture; by default the largest at which every target
    source that has documents reaches its share within its ``max_repeats`` (shares of sources
    without documents are spread over the others in proportion). With a larger total, a source
    stops at its cap and the report shows the shortfall. A source repeats whole epochs first;
    the last, partial epoch ends at the row nearest to the exact budget; no row ever exceeds
    ``max_repeats``. Sources without a
    target or tokens, null sources and null ids are not chosen; texts without tokens count as
    chosen with their range, in a partial epoch too. Repeated targets of a source: the largest share holds. Empty tables give
    an empty mixture.
    """
    rows = cut(sized(documents, vocabulary, seed))
    want = targets.select(norm_source("source").alias("source"), F.col("target_share").alias("share"), F.coalesce("max_repeats", F.lit(1)).alias("cap")).where("source is not null and share > 0")
    want = want.groupBy("source").agg(F.max("share").alias("share"), F.max(F.greatest(F.col("cap"), F.lit(0))).alias("cap"))
    ranges = max(1, rows.count() // range_rows)
    width = -(-(1 << 40) // ranges)
    cell = F.floor(F.col("key") / F.lit(width)).cast("long").alias("cell")
    sums = rows.where("source is not null").groupBy("source", cell).agg(F.sum("tokens").alias("t"))
    have = sums.groupBy("source").agg(F.sum("t").alias("have"))
    plan = cut(want.join(have, "source", "left").withColumn("have", F.coalesce("have", F.lit(0).cast("long"))))
    lim = plan.where("have > 0 and cap > 0").agg(F.sum("share").alias("s"), F.min(F.col("have") * F.col("cap") / F.col("share")).alias("m")).first()
    covered = float(lim["s"] or 1.0)
    total = float(total_tokens) if total_tokens is not None else float(lim["m"] or 0.0) * covered
    budget = F.least(F.floor(F.col("share") / F.lit(covered) * F.lit(total) + 1e-6), F.col("have") * F.col("cap")).cast("long")
    plan = plan.withColumn("budget", F.when((F.col("have") > 0) & (F.col("cap") > 0), budget).otherwise(F.lit(0).cast("long")))
    plan = plan.withColumn("epochs", F.when(F.col("have") > 0, F.floor(F.col("budget") / F.greatest(F.col("have"), F.lit(1)))).otherwise(F.lit(0)).cast("long"))
    plan = plan.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("have"))
    before = F.coalesce(F.sum("t").over(Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.withColumn("before", before).join(F.broadcast(plan.select("source", "epochs", "rest", "cap")), "source")  # a row per target source
    starts = starts.withColumn("state", F.when((F.col("rest") <= 0) | (F.col("before") >= F.col("rest")), F.lit("out")).when(F.col("before") + F.col("t") <= F.col("rest"), F.lit("in")).otherwise(F.lit("edge")))
    placed = rows.withColumn("cell", cell).join(starts.drop("t"), ["source", "cell"])
    edge = placed.where("state = 'edge'")  # one range per source
    so_far = F.sum("tokens").over(Window.partitionBy("source", "cell").orderBy("key", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, 0))
    edge = edge.withColumn("last", (F.col("before") + so_far - F.col("tokens") / 2) <= F.col("rest"))
    whole = placed.where("state <> 'edge'").withColumn("last", F.col("state") == "in")
    repeats = F.least(F.col("epochs") + F.col("last").cast("int"), F.col("cap")).cast("int")
    chosen = whole.unionByName(edge).select("doc_id", "source", "tokens", repeats.alias("repeats")).where("repeats > 0")
    got = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count(F.lit(1)).alias("n_docs"), F.max("repeats").alias("most_repeats"))
    zero = F.lit(0).cast("long")
    report = plan.join(got, "source", "left").select("source", F.col("share").alias("target_share"), F.col("cap").alias("max_repeats"), F.col("have").alias("tokens_there"), F.coalesce("tokens", zero).alias("tokens"), F.coalesce("n_docs", zero).alias("n_docs"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"))
    share = F.coalesce(F.try_divide(F.col("tokens"), F.sum("tokens").over(Window.partitionBy())), F.lit(0.0))  # a row per target source
    return chosen, report.withColumn("reached_share", share)
