"""References to records that do not exist, per table and period.

Keys are dictionary-encoded within ranges of their hash; for each range and period a
compressed bitmap of referenced keys AND-NOT one of the keys that live in that period leaves
the orphans. References reach the bitmaps pre-aggregated, and only orphan keys go back to the
rows: heavy keys (never more than ``HEAVY_PARTS``) by broadcast, all others by a shuffle join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.functions.bitmaps import Bitmap
from lodegraph.plans.lineage import broadcast_below, cut, parts_for
from lodegraph.sources.tables import month_index, norm_id, norm_path

HEAVY_PARTS = 1024
RANGE_ROWS = 2_000_000
FOREVER = 1_000_000


def _range_orphans(heavy_from: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code: dict = {}
        refs, live = [], []
        for f in frames:
            at = np.fromiter((code.setdefault(x, len(code)) for x in zip(f["space"], f["key"])), np.int64, len(f))
            lo, hi, n = f["lo"].to_numpy(np.int64), f["hi"].to_numpy(np.int64), f["n"].to_numpy(np.int64)
            is_ref = n > 0
            refs.append(np.stack([at[is_ref], lo[is_ref], n[is_ref]]))
            live.append(np.stack([at[~is_ref], lo[~is_ref], hi[~is_ref]]))
        if not code:
            return
        names = list(code)
        ref, lived = np.concatenate(refs, axis=1), np.concatenate(live, axis=1)
        for m in np.unique(ref[1]):
            mine = ref[:, ref[1] == m]
            orphan = Bitmap.of(mine[0]).and_not(Bitmap.of(lived[0][(lived[1] <= m) & (m < lived[2])])).decode()
            heavy = mine[0][mine[2] >= heavy_from]
            count = dict(zip(mine[0].tolist(), mine[2].tolist()))
            gone = set(orphan.tolist())
            at = sorted(gone | set(heavy.tolist()))
            if at:
                yield pd.DataFrame({"space": [names[i][0] for i in at], "key": [names[i][1] for i in at], "month": np.int32(m), "n": [count[i] for i in at], "orphan": [i in gone for i in at]})

    return run


def orphan_keys(refs: DataFrame, live: DataFrame, total: int) -> DataFrame:
    """(space, key, month, n, orphan) for keys without a live record, and for heavy keys in any case.

    ``refs``: space, key, month per reference; ``live``: space, key and the half-open month
    interval [lo, hi) in which a record lives. ``total`` is the number of references or more.
    """
    r = refs.groupBy("space", "key", F.col("month").alias("lo")).agg(F.count(F.lit(1)).alias("n")).withColumn("hi", F.lit(0))
    p = live.select("space", "key", "lo", "hi").distinct().withColumn("n", F.lit(0).cast("long"))
    both = r.unionByName(p).repartition(parts_for(refs.sparkSession, total, RANGE_ROWS), F.xxhash64("space", "key"))
    return both.mapInPandas(_range_orphans(max(1, -(-total // HEAVY_PARTS))), "space string, key string, month int, n long, orphan boolean")


def orphan_rows(refs: DataFrame, keys: DataFrame, total: int) -> DataFrame:
    """The reference rows whose (space, key, month) is an orphan; ``keys`` as from ``orphan_keys``, already cut."""
    heavy_from = max(1, -(-total // HEAVY_PARTS))
    on = ["space", "key", "month"]
    heavy = keys.where(F.col("n") >= heavy_from).select(*on, F.col("orphan").alias("heavy_orphan"))
    light = keys.where((F.col("n") < heavy_from) & F.col("orphan")).select(*on)
    tagged = refs.join(F.broadcast(heavy), on, "left")  # at most HEAVY_PARTS rows: each holds total / HEAVY_PARTS references
    return tagged.where("heavy_orphan").drop("heavy_orphan").unionByName(tagged.where("heavy_orphan is null").drop("heavy_orphan").join(light, on, "left_semi"))


def references(relationships: DataFrame, doc_mappings: DataFrame) -> DataFrame:
    """(table_name, seq, field, space, key, month) of every reference; null and blank ones refer to nothing."""
    month = month_index("indexed_at").alias("month")
    rel = relationships.select("seq", "source_id", "target_id", month).select(
        "seq", "month", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), norm_id(c).alias("key")) for c in ("source_id", "target_id")])).alias("r")
    )
    rel = rel.select(F.lit("relationships").alias("table_name"), "seq", "r.field", F.lit("id").alias("space"), "r.key", "month")
    rel = rel.where(~((F.col("field") == "source_id") & F.col("key").startswith("module::")))
    name = F.trim(F.regexp_replace(F.trim("symbol_name", F.lit(" \t\r\n")), r"\(\)$", ""), F.lit(" \t\r\n"))
    doc = doc_mappings.select(F.lit("doc_mappings").alias("table_name"), "seq", F.lit("symbol_name").alias("field"), F.lit("name").alias("space"), name.alias("key"), month_index("updated_at").alias("month"))
    return rel.unionByName(doc).where("key is not null and key <> '' and month is not null")


def live_symbols(symbols: DataFrame, index_results: DataFrame, limit: int = 200_000) -> DataFrame:
    """(space, key, lo, hi): the months in which an indexed row answers to an id or a name.

    A row lives from the month it was indexed in until the month of the first run, started
    later, that lists its file as removed. Rows without ``indexed_at`` never live.
    """
    gone = index_results.select("started_at", F.explode("removed_files").alias("f")).groupBy(norm_path("f").alias("file")).agg(F.sort_array(F.collect_set("started_at")).alias("runs"))
    gone = gone.where("file is not null")
    rows = symbols.select(norm_id("id").alias("id"), "name", norm_path("file").alias("file"), "indexed_at").where("indexed_at is not null")
    held = gone.agg(F.coalesce(F.sum(F.size("runs") + 1), F.lit(0))).first()[0]  # run times and paths
    joined = rows.join(broadcast_below(gone, held, limit), "file", "left")
    first = F.expr("array_min(filter(runs, x -> x > indexed_at))")
    spans = joined.select("id", "name", month_index("indexed_at").alias("lo"), F.coalesce(month_index(first), F.lit(FOREVER)).alias("hi")).where("lo < hi")
    pairs = spans.select("lo", "hi", F.explode(F.array(F.struct(F.lit("id").alias("space"), F.col("id").alias("key")), F.struct(F.lit("name").alias("space"), F.col("name").alias("key")))).alias("k"))
    return pairs.select("k.space", "k.key", "lo", "hi").where("key is not null")


def orphan_references(symbols: DataFrame, relationships: DataFrame, doc_mappings: DataFrame, index_results: DataFrame) -> DataFrame:
    """(table_name, seq, field, month) of each reference without a live symbol at its month's end.

    Null or blank references, ``module::`` sources and rows without a time are no cases.
    Repeated rows are judged one by one. Empty tables give no rows, except that references
    into an empty symbol table are all orphans.
    """
    refs = references(relationships, doc_mappings)
    total = 2 * relationships.count() + doc_mappings.count()
    keys = cut(orphan_keys(refs, live_symbols(symbols, index_results), total))
    return orphan_rows(refs, keys, total).select("table_name", "seq", "field", "month")
