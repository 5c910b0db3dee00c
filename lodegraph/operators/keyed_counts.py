"""Per-key results while a few keys hold most of the rows.

Equal input splits are aggregated where they lie: keys are dictionary-encoded and counted
with dense arrays, so a key that holds a third of the table leaves each split as one number.
Distinct members are found after a shuffle on (key, member), which no key can skew; the
partial sums of every split then meet in blocks of the key space, each block holding one
dictionary and one dense accumulator array per measure.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.plans.lineage import parts_for

CHUNK_ROWS = 400_000
BLOCK_ROWS = 4_000_000


def _codes(arrays: list[pa.ChunkedArray | pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """Dense group codes of rows over several columns, and the first row of each group."""
    code = None
    for a in arrays:
        a = a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a
        d = a.dictionary_encode(null_encoding="encode")
        idx = d.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        if code is None:
            code = idx
        else:
            code = code * max(1, len(d.dictionary)) + idx
            _, code = np.unique(code, return_inverse=True)
    _, first, code = np.unique(code, return_index=True, return_inverse=True)
    return code, first


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= CHUNK_ROWS:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _count_split(keys: list[str]):
    """Groups of a split with their number of rows ``n``, which earlier counts of that name add up to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _chunks(batches):
            code, first = _codes([t[c] for c in keys])
            weights = t["n"].to_numpy().astype(np.float64) if "n" in t.column_names else None
            out = t.select(keys).take(pa.array(first))
            yield from out.append_column("n", pa.array(np.bincount(code, weights=weights, minlength=len(first)).astype(np.int64))).to_batches()

    return run


def _count_members(keys: list[str], member: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _chunks(batches):
            code, first = _codes([t[c] for c in keys])
            k = len(first)
            n = t["n"].to_numpy().astype(np.float64)
            there = t[member].is_valid().to_numpy().astype(np.float64)
            out = t.select(keys).take(pa.array(first))
            out = out.append_column("n", pa.array(np.bincount(code, weights=n, minlength=k).astype(np.int64)))
            yield from out.append_column("members", pa.array(np.bincount(code, weights=there, minlength=k).astype(np.int64))).to_batches()

    return run


def _sum_block(keys: list[str], measures: list[str]):
    """Sums the partial arrays of a key block: chunk by chunk the keys are encoded together with those already held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for t in _chunks(batches):
            t = t if held is None else pa.concat_tables([held, t])
            code, first = _codes([t[c] for c in keys])
            held = t.select(keys).take(pa.array(first))
            for m in measures:
                acc = np.zeros(len(first), np.int64)
                np.add.at(acc, code, t[m].to_numpy())
                held = held.append_column(m, pa.array(acc))
        if held is not None:
            yield from held.to_batches(max_chunksize=50_000)

    return run


def keyed_counts(df: DataFrame, keys: list[str], member: str | None = None, rows: int = 0) -> DataFrame:
    """Rows ``n`` and, with ``member``, its distinct non-null values ``members`` per key, evenly spread over the tasks.

    Keys must be strings; a null key value forms a group of its own, as in SQL. Repeated rows
    count in ``n`` and once in ``members``. ``rows``, the size of the table if known, sets the
    number of key blocks. An empty table gives no rows. Columns other than
    ``keys`` and ``member`` are ignored, whatever their names. Without ``member`` nothing but
    the counts per key and split is shuffled.
    """
    cols = [*keys, *([member] if member else [])]
    kinds = ", ".join(f"`{c}` string" for c in keys)
    own = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in cols])
    split = own.mapInArrow(_count_split(cols), ", ".join(f"`{c}` string" for c in cols) + ", n long")
    parts, where = parts_for(df.sparkSession, rows, BLOCK_ROWS), F.xxhash64(*keys)
    if member is None:
        return split.repartition(parts, where).mapInArrow(_sum_block(keys, ["n"]), f"{kinds}, n long")
    pairs = split.groupBy(*cols).agg(F.sum("n").alias("n"))
    partial = pairs.mapInArrow(_count_members(keys, member), f"{kinds}, n long, members long")
    return partial.repartition(parts, where).mapInArrow(_sum_block(keys, ["n", "members"]), f"{kinds}, n long, members long")


def heavy_keys(counts: DataFrame, total: int, percent: int = 1) -> DataFrame:
    """Keys holding at least ``percent`` of ``total`` rows: never more than 100 / percent of them."""
    return counts.where(F.col("n") * 100 >= F.lit(total * percent))
