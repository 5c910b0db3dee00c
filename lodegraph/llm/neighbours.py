"""Most similar vectors for every vector: inverted file, product-quantised residuals, exact reranking.

The quantiser has two levels. Spherical k-means on a bounded sample gives centroids of cells of
about ``CELL`` vectors, so their number follows the number of vectors; the task that holds a
cell fits the centroids of its sub-cells of about ``SUBCELL`` vectors on the cell itself. Each
vector is sent to its own cell, where it is both indexed and looked up, and as a query to the
few cells nearly as near: a handful of copies of a vector whatever their number. Within a cell,
asymmetric tables over the product-quantised residuals to the sub-cells select ``keep``
candidates, and exact cosines rank them. A cell of more than
``BLOCK`` vectors is cut into blocks, and queries go to each. Exact copies take part at most
``k + 1`` times; further ones take the result of their group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.plans.lineage import broadcast_below, cut, parts_for

SAMPLE = 20_000
CELL = 8192
SUBCELL = 128
PROBES = 5
REACH = 0.2
SUBSPACES = 16
KEEP = 160
BLOCK = 32_768
QUERIES = 256
PART_ROWS = 60_000


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def kmeans(x: np.ndarray, k: int, rounds: int, spherical: bool, seed: int = 7) -> np.ndarray:
    """Lloyd's algorithm from a random start; an empty cluster keeps its centroid."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        s = x @ c.T
        if not spherical:
            s -= 0.5 * (c * c).sum(axis=1)
        at = s.argmax(axis=1)
        n = np.bincount(at, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        full = n > 0
        c[full] = total[full] / n[full, None]
        if spherical:
            c[full] = c[full] / np.maximum(np.linalg.norm(c[full], axis=1, keepdims=True), 1e-12)
    return c


class Index:
    """Centroids of the cells and residual codebooks, fitted on a sample."""

    def __init__(self, sample: np.ndarray, rows: int, subspaces: int = SUBSPACES, cell: int = CELL):
        x = _unit(sample.astype(np.float32))
        self.centroids = kmeans(x, max(1, -(-rows // cell)), 12, True)
        # codebooks see residuals as fine as those to sub-cells
        fine = kmeans(x, max(1, len(x) // SUBCELL), 6, True)
        res = x - fine[(x @ fine.T).argmax(axis=1)]
        self.parts = np.array_split(np.arange(x.shape[1]), min(subspaces, x.shape[1]))
        self.books = [kmeans(res[:, p], 256, 8, False) for p in self.parts]

    def route(self, u: np.ndarray, probes: int, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """Nearest cells of unit vectors, best first, and which of them lie within reach: nearly as near as the best."""
        s = u @ self.centroids.T
        p = min(probes, s.shape[1])
        near = np.argpartition(-s, p - 1, axis=1)[:, :p]
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(s, near, 1), axis=1, kind="stable"), 1)
        there = np.take_along_axis(s, near, 1)
        return near, there >= there[:, :1] - reach

    def codes(self, res: np.ndarray) -> np.ndarray:
        return np.stack([(res[:, p] @ b.T - 0.5 * (b * b).sum(axis=1)).argmax(axis=1) for p, b in zip(self.parts, self.books)])

    def tables(self, u: np.ndarray) -> list[np.ndarray]:
        """Per subspace, the inner products of every code (row) with every query."""
        return [b @ u[:, p].T for p, b in zip(self.parts, self.books)]


class Cell:
    """The vectors of one block in memory: sub-cells, codes of the residuals, exact values."""

    def __init__(self, index: Index, ids: np.ndarray, exact: np.ndarray):
        unit = _unit(exact)
        n = max(1, len(unit) // SUBCELL)
        step = max(1, len(unit) // (64 * n))  # 64 vectors are enough to place a sub-cell
        self.index, self.sub = index, kmeans(unit[::step], n, 6, True)
        at = np.concatenate([(unit[i : i + 8192] @ self.sub.T).argmax(axis=1) for i in range(0, len(unit), 8192)])
        order = np.argsort(at, kind="stable")
        self.ids, self.exact, self.unit = ids[order], exact[order], unit[order]
        self.of = at[order]
        self.code = np.ascontiguousarray(index.codes(self.unit - self.sub[self.of]).astype(np.intp))

    def search(self, qid: np.ndarray, q: np.ndarray, k: int, keep: int) -> pd.DataFrame:
        u = _unit(q)
        out_i = np.full((len(q), k), -1, np.int64)
        out_s = np.full((len(q), k), -2.0, np.float64)
        for a in range(0, len(q), QUERIES):
            part = u[a : a + QUERIES]
            score = np.take(self.sub @ part.T, self.of, axis=0)
            row = np.empty_like(score)
            for code, t in zip(self.code, self.index.tables(part)):  # whole rows of a table are looked up: contiguous copies
                score += np.take(t, code, axis=0, out=row, mode="clip")
            score = np.ascontiguousarray(score.T)
            r = min(keep, len(self.ids))
            cand = np.argpartition(-score, r - 1, axis=1)[:, :r] if r < len(self.ids) else np.tile(np.arange(r), (len(part), 1))
            cos = np.einsum("qd,qrd->qr", part, self.unit[cand])
            cos[self.ids[cand] == qid[a : a + QUERIES, None]] = -2
            best = min(k, r)
            order = np.lexsort((self.ids[cand], -cos), axis=1)[:, :best]
            cand = np.take_along_axis(cand, order, 1)
            same = np.take_along_axis(cos, order, 1) <= -2
            x, y = q[a : a + QUERIES].astype(np.float64), self.exact[cand].astype(np.float64)
            fine = np.einsum("qd,qrd->qr", x, y) / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(y, axis=2)
            out_i[a : a + QUERIES, :best] = np.where(same, -1, self.ids[cand])
            out_s[a : a + QUERIES, :best] = np.where(same, -2, fine)
        return pd.DataFrame({"id": qid, "near": list(out_i), "cos": list(out_s)})


def _vectors(col: pd.Series) -> np.ndarray:
    return np.stack([np.frombuffer(v, np.float32) for v in col]) if len(col) else np.zeros((0, 1), np.float32)


def _place(index, blocks, probes: int, reach: float):
    """Every vector once to its own cell, which also looks it up, and as a query to further cells (and blocks) within reach."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix: Index = index.value
        n_blocks: np.ndarray = blocks.value
        for f in frames:
            if not len(f):
                continue
            x = np.stack(f["vector"].to_list()).astype(np.float32)
            near, within = ix.route(_unit(x), probes, reach)
            ids = f["id"].to_numpy(np.int64)
            raw = np.array([v.tobytes() for v in x], object)
            own = ids % n_blocks[near[:, 0]]
            for p in range(near.shape[1]):
                c = near[:, p]
                for b in range(int(n_blocks[c].max())):
                    at = np.flatnonzero((n_blocks[c] > b) & within[:, p])
                    home = (own[at] == b) if p == 0 else np.zeros(len(at), bool)
                    if len(at):
                        yield pd.DataFrame({"cell": c[at].astype(np.int32), "block": np.int32(b), "guest": ~home, "id": ids[at], "vec": raw[at]})

    return run


def _cells(index):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix: Index = index.value
        n = np.zeros(len(ix.centroids), np.int64)
        for f in frames:
            if len(f):
                n += np.bincount((_unit(np.stack(f["vector"].to_list()).astype(np.float32)) @ ix.centroids.T).argmax(axis=1), minlength=len(n))
        at = np.flatnonzero(n)
        if len(at):
            yield pd.DataFrame({"cell": at.astype(np.int32), "n": n[at]})

    return run


def _scan(index, k: int, keep: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, ready = None, [], None

        def settle() -> Iterator[pd.DataFrame]:
            """Index the vectors of the block, and look each of them up."""
            nonlocal held, ready
            if held:
                ids, exact = (np.concatenate(z) for z in zip(*held))
                held, ready = [], Cell(index.value, ids, exact)
                for i in range(0, len(ids), 4096):
                    yield ready.search(ids[i : i + 4096], exact[i : i + 4096], k, keep)

        for f in frames:
            if not len(f):
                continue
            key = f[["cell", "block", "guest"]].to_numpy(np.int64)
            change = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
            for s, e in zip(change, [*change[1:], len(f)]):
                g = f.iloc[s:e]
                if tuple(key[s, :2]) != now:
                    yield from settle()
                    now, ready = tuple(key[s, :2]), None
                if not key[s, 2]:
                    held.append((g["id"].to_numpy(np.int64), _vectors(g["vec"])))
                    continue
                yield from settle()
                if ready is not None:  # else nobody lives in this cell
                    yield ready.search(g["id"].to_numpy(np.int64), _vectors(g["vec"]), k, keep)
        yield from settle()

    return run


def usable(chunks: DataFrame, dim: int, hash_col: str = "hash", vector_col: str = "vector") -> DataFrame:
    """One (hash, vector) per hash: null, wrongly sized, NaN or infinite and all-zero vectors take no part."""
    v = F.col(vector_col).cast("array<float>")
    big = F.lit(3.0e38)
    good = (F.size(v) == dim) & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < big)) & F.exists(v, lambda e: e != 0)
    return chunks.where(F.col(hash_col).isNotNull() & good).groupBy(F.col(hash_col).alias("hash")).agg(F.min(v).alias("vector"))


def nearest(chunks: DataFrame, k: int = 5, dim: int = 64, probes: int = PROBES, sample: int = SAMPLE, keep: int = KEEP, block: int = BLOCK, cell: int = CELL, reach: float = REACH, hash_col: str = "hash", vector_col: str = "vector") -> DataFrame:
    """(hash, neighbour, cosine, rank) of the ``k`` most similar others of every usable vector.

    Ties go to the smaller hash among the vectors found. Rows that repeat a hash count once,
    with the smallest of differing vectors. Only the centroids of the cells and the codebooks are
    fitted on a sample (``sample`` rows of smallest hash value, or 32 a cell if that is more);
    all rows are indexed and searched. Fewer than two usable
    vectors give no rows; other columns are ignored.
    """
    spark = chunks.sparkSession
    sc = spark.sparkContext
    rows = cut(usable(chunks, dim, hash_col, vector_col))
    # exact copies: number them within salted parts first, so that no group is sorted whole
    salted = Window.partitionBy("vector", "salt").orderBy("hash")
    group = Window.partitionBy("vector").orderBy("hash")
    few = rows.withColumn("salt", F.pmod(F.xxhash64("hash"), F.lit(64))).withColumn("at", F.row_number().over(salted)).where(F.col("at") <= k + 1)
    kept = cut(few.withColumn("at", F.row_number().over(group)).where(F.col("at") <= k + 1).select("hash", "vector", "at").withColumn("id", F.monotonically_increasing_id()))
    n = kept.count()
    picked = kept.select("hash", "vector").orderBy(F.xxhash64("hash"), "hash").limit(max(sample, 32 * -(-n // cell))).toPandas()
    if len(picked) < 2:
        return rows.select("hash", F.col("hash").alias("neighbour"), F.lit(0.0).alias("cosine"), F.lit(0).alias("rank")).where("false")
    index = sc.broadcast(Index(np.stack(picked["vector"].to_list()), n, cell=cell))
    base = kept.select("id", "vector")
    sizes = base.mapInPandas(_cells(index), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # one row a centroid
    n_blocks = np.ones(len(index.value.centroids), np.int64)
    for r in sizes:
        n_blocks[r.cell] = -(-r.n // block)
    placed = base.mapInPandas(_place(index, sc.broadcast(n_blocks), probes, reach), "cell int, block int, guest boolean, id long, vec binary")
    tasks = placed.repartition(parts_for(spark, n, PART_ROWS), "cell", "block").sortWithinPartitions("cell", "block", "guest")
    found = tasks.mapInPandas(_scan(index, k, keep), "id long, near array<long>, cos array<double>")
    flat = found.select("id", F.explode(F.arrays_zip("near", "cos")).alias("z")).select("id", F.col("z.near").alias("near"), F.col("z.cos").alias("cosine")).where("near >= 0")
    names = kept.select(F.col("id").alias("near"), F.col("hash").alias("neighbour"))
    best = flat.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "near"))).where(F.col("r") <= k).select("id", "near", "cosine")
    named = best.join(names, "near").join(kept.select("id", "hash"), "id")
    top = named.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour"))).select("hash", "neighbour", "cosine", "rank")
    # further copies of a vector: the first k of their group are as similar as can be; a vector may fill a third of the table, so it is salted
    crowded = cut(kept.where(F.col("at") == k + 1).select("vector"))
    many = broadcast_below(crowded, crowded.count(), 20_000)
    firsts = kept.where(F.col("at") <= k).join(many, "vector", "left_semi").select("vector", F.col("hash").alias("neighbour"), F.col("at").alias("rank"), F.explode(F.sequence(F.lit(0), F.lit(63))).alias("salt"))
    rest = rows.join(many, "vector", "left_semi").join(kept.select("hash"), "hash", "left_anti").withColumn("salt", F.pmod(F.xxhash64("hash"), F.lit(64)).cast("int"))
    more = rest.join(firsts, ["vector", "salt"]).select("hash", "neighbour", F.lit(1.0).alias("cosine"), "rank")
    return top.unionByName(more)


def close_pairs(near: DataFrame, least: float) -> DataFrame:
    """(hash_a, hash_b), smaller first, where one is among the other's neighbours with at least this cosine."""
    return near.where(F.col("cosine") >= least).select(F.least("hash", "neighbour").alias("hash_a"), F.greatest("hash", "neighbour").alias("hash_b")).distinct()
