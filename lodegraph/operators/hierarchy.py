"""Parent-child rows as full hierarchies: root, depth, path, descendants, cycles.

Rows are range-partitioned by a locality column, so most links stay inside a partition and a
hot group is split over several. Each partition builds a weighted disjoint-set forest: every
node ends up with its local root and its offset (distance) to it. Only links that leave a
partition go on, and these forests merge hierarchically: level by level, ``fan`` neighbouring
partitions unite and contract the links among them, until one group is left or nothing more
contracts (links without any locality: those are resolved by distributed pointer doubling).
Paths are local segments behind the paths of the contracted roots.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.plans.lineage import broadcast_below, cut, parts_for
from lodegraph.sources.tables import current_rows, norm_id

FAN = 8
MERGE_LIMIT = 400_000
PART_ROWS = 1_000_000
BROADCAST_ROWS = 300_000
BROADCAST_STEPS = 4_000_000
FOREST = "pid int, id string, parent string, lroot string, off long, ext string, cyc string, on_cycle boolean, seg array<string>"


def compress(parent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted find for all nodes at once: (root, offset, resolved).

    ``parent[i]`` is the index of i's parent or -1. Halving every path per step takes
    log2(depth) steps; nodes that hang on a cycle never resolve.
    """
    n = len(parent)
    root = np.where(parent < 0, np.arange(n), parent)
    off = (parent >= 0).astype(np.int64)
    end = parent < 0
    for _ in range(max(1, int(n).bit_length()) + 1):
        if end[root].all():
            break
        off += off[root] * ~end[root]
        root = root[root]
    return root, off, end[root]


def cycle_marks(parent: np.ndarray, names: np.ndarray, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For unresolved nodes: (smallest name on the cycle they reach, whether they lie on it)."""
    cyc = np.full(len(parent), None, dtype=object)
    on = np.zeros(len(parent), dtype=bool)
    seen = np.zeros(len(parent), dtype=np.int64)
    turn = 0
    for start in np.flatnonzero(open_):
        if seen[start]:
            continue
        turn += 1
        walk, i = [], int(start)
        while not seen[i]:
            seen[i] = turn
            walk.append(i)
            i = int(parent[i])
        if seen[i] == turn:
            ring = walk[walk.index(i) :]
            on[ring] = True
            cyc[ring] = min(names[j] for j in ring)
        for j in reversed(walk):
            if cyc[j] is None:
                cyc[j] = cyc[parent[j]]
    return cyc, on


def _segments(ids: np.ndarray, parent: np.ndarray, off: np.ndarray, done: np.ndarray) -> list:
    """Path of every resolved node inside its partition, from its local root down."""
    seg: list = [None] * len(ids)
    for i in np.argsort(off, kind="stable"):
        if done[i]:
            seg[i] = [ids[i]] if parent[i] < 0 else [*seg[parent[i]], ids[i]]
    return seg


def _local_forest(paths: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        got = [f for f in frames if len(f)]
        if not got:
            return
        f = pd.concat(got, ignore_index=True)
        ids = pd.Index(f["id"])
        parent = np.where(f["parent"].isna(), -1, ids.get_indexer(f["parent"]))
        root, off, done = compress(parent)
        cyc, on = cycle_marks(parent, f["id"].to_numpy(object), ~done) if not done.all() else (np.full(len(f), None, object), np.zeros(len(f), bool))
        names = f["id"].to_numpy(object)
        out = pd.DataFrame({
            "pid": np.int32(TaskContext.get().partitionId()), "id": names, "parent": f["parent"],
            "lroot": np.where(done, names[root], None), "off": np.where(done, off, 0),
            "ext": np.where(done, f["parent"].to_numpy(object)[root], None), "cyc": cyc, "on_cycle": on,
        })
        out["seg"] = _segments(names, parent, off, done) if paths else None
        for i in range(0, len(out), 10_000):
            yield out.iloc[i : i + 10_000]

    return run


def local_forest(links: DataFrame, near: str | None = None, parts: int | None = None, paths: bool = False) -> DataFrame:
    """Weighted forests of equal partitions of ``links`` (id, parent, and ``near`` for locality), cut from their lineage."""
    parts = parts or parts_for(links.sparkSession, 0, PART_ROWS)
    placed = links.repartitionByRange(parts, *([near] if near else []), "id").select("id", "parent")
    return cut(placed.mapInPandas(_local_forest(paths), FOREST))


def _merge_frame(f: pd.DataFrame) -> pd.DataFrame:
    """Contracted links (a -> r, w) of one group: root and depth of every a, or the group of its cycle.

    Links that leave the group end there too: ``via`` is then the node whose link leaves, and
    ``depth`` the weight of the way to it.
    """
    ids = pd.Index(f["a"])
    ends = f["r"].isna().to_numpy()
    parent = np.where(ends, -1, ids.get_indexer(f["r"]))
    _, _, done = compress(parent)
    # weights add up along the same halved paths
    p, total, end = np.where(parent < 0, np.arange(len(f)), parent), np.where(parent < 0, 0, f["w"]).astype(np.int64), parent < 0
    for _ in range(len(f).bit_length() + 1):
        if end[p].all():
            break
        total += np.where(end[p], 0, total[p])
        p = p[p]
    names = f["a"].to_numpy(object)
    cyc, on = cycle_marks(parent, names, ~done) if not done.all() else (np.full(len(f), None, object), np.zeros(len(f), bool))
    closed, leaves = done & ends[p], done & ~ends[p]
    return pd.DataFrame({
        "a": names, "root": np.where(closed, f["top"].to_numpy(object)[p], None), "depth": np.where(closed, total + f["tw"].to_numpy()[p], np.where(leaves, total, 0)),
        "ring": cyc, "on_ring": on, "cyc": np.where(closed, f["fc"].to_numpy(object)[p], None), "via": np.where(leaves, names[p], None),
    })


MERGED = "a string, root string, depth long, ring string, on_ring boolean, cyc string"
LINK = ["a", "r", "w", "top", "tw", "fc"]


def _merge_groups(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    got = [f for f in frames if len(f)]
    if got:
        for _, f in pd.concat(got, ignore_index=True).groupby("grp"):
            yield _merge_frame(f.reset_index(drop=True))


def _merge_one(links: DataFrame) -> DataFrame:
    """All links in one task; the caller has counted them."""
    return links.select(*LINK, F.lit(0).alias("grp")).coalesce(1).mapInPandas(_merge_groups, MERGED + ", via string").drop("via")


def _merge_large(links: DataFrame) -> DataFrame:
    """The same by pointer doubling: every round joins the links still open with all links."""
    state = cut(links.select("a", F.col("r").alias("p"), F.when(F.col("r").isNull(), F.lit(0)).otherwise(F.col("w")).alias("w"), F.col("a").alias("low"), F.struct("top", "tw", "fc").alias("end"), F.col("r").isNull().alias("done")))
    before = state.where("not done").count()
    while before:
        to = state.select(F.col("a").alias("p"), F.col("p").alias("p2"), F.col("w").alias("w2"), F.col("low").alias("low2"), F.col("end").alias("end2"), F.col("done").alias("done2"))
        step = state.where("not done").join(to, "p").select(
            "a", F.when(F.col("done2"), F.lit(None)).otherwise(F.col("p2")).alias("p"), (F.col("w") + F.col("w2")).alias("w"), F.least("low", "low2").alias("low"), F.when(F.col("done2"), F.col("end2")).otherwise(F.col("end")).alias("end"), F.col("done2").alias("done"))
        state = cut(state.where("done").unionByName(step))
        now = state.where("not done").count()
        if now == before:
            break  # every tree node of depth 2**k resolves in round k: what is left hangs on rings
        before = now
    done = state.where("done").select("a", F.col("end.top").alias("root"), (F.col("w") + F.col("end.tw")).alias("depth"), F.lit(None).cast("string").alias("ring"), F.lit(False).alias("on_ring"), F.col("end.fc").alias("cyc"))
    if not before:
        return done
    left = state.where("not done").select("a")
    rest = cut(links.join(left, "a", "left_semi").select("a", F.col("r").alias("p"), F.col("a").alias("low")))
    for _ in range(before.bit_length() + 1):
        to = rest.select(F.col("a").alias("p"), F.col("p").alias("p2"), F.col("low").alias("low2"))
        rest = cut(rest.join(to, "p").select("a", F.col("p2").alias("p"), F.least("low", "low2").alias("low")))
    on = rest.select(F.col("p").alias("a")).distinct()
    # on the ring, ``low`` covers the whole ring; a node below one takes it from the ring node it reaches
    low = rest.join(on, "a", "left_semi").select(F.col("a").alias("p"), F.col("low").alias("ring"))
    marked = rest.join(low, "p").join(on.withColumn("on_ring", F.lit(True)), "a", "left")
    return done.unionByName(marked.select("a", F.lit(None).cast("string").alias("root"), F.lit(0).cast("long").alias("depth"), "ring", F.coalesce("on_ring", F.lit(False)).alias("on_ring"), F.lit(None).cast("string").alias("cyc")))


def boundary(forest: DataFrame) -> DataFrame:
    """Contracted links: local root ``a`` enters another partition's tree at ``e``, whose local root is ``r``.

    A parent that is no node, and a tree hanging on a local cycle, end the link: ``top`` and
    ``tw`` are then the root and the depth of ``a``, and ``fc`` the cycle it hangs on.
    """
    out = forest.where("lroot = id and ext is not null").select(F.col("id").alias("a"), F.col("ext").alias("e"), "pid")
    into = forest.select(F.col("id").alias("e"), "lroot", "off", "cyc", F.col("ext").alias("up"), F.col("pid").alias("epid"), "seg")
    into = into.join(broadcast_below(out.select("e").distinct(), out.count(), BROADCAST_ROWS), "e", "left_semi")
    j = out.join(into, "e", "left")
    closed = F.col("lroot").isNull() | F.col("up").isNull()
    top = F.when(F.col("lroot").isNull(), F.when(F.col("cyc").isNull(), F.col("a"))).otherwise(F.col("lroot"))
    return j.select(
        "a", "e", "pid", "epid", "seg", F.when(~closed, F.col("lroot")).alias("r"), (F.col("off") + 1).alias("w"), F.col("off").alias("eoff"),
        F.when(closed, top).alias("top"), F.when(closed & F.col("lroot").isNotNull(), F.col("off") + 1).otherwise(F.lit(0)).alias("tw"),
        F.col("cyc").alias("fc"), F.col("lroot").alias("elroot"),
    )


def merge_links(links: DataFrame, merge_limit: int = MERGE_LIMIT, fan: int = FAN) -> DataFrame:
    """Roots, depths and rings of contracted links (with ``pid``, the partition of ``a``), merged in levels.

    A level unites ``fan`` neighbouring groups; what leaves the united group is contracted to
    one link per root. The last level is one task: should more than ``merge_limit`` links still
    be open before it, nothing is local and pointer doubling takes over. Links on rings that
    close in a later level are few; they are resolved again as they were before contraction.
    """
    now = links.select(*LINK, F.col("pid").alias("grp"))
    groups = (now.agg(F.max("grp")).first()[0] or 0) + 1
    left = now.count()
    levels = []
    while left > merge_limit and groups > fan:
        groups = -(-groups // fan)
        placed = now.withColumn("grp", F.floor(F.col("grp") / fan).cast("int"))
        got = cut(placed.repartition(groups, "grp").mapInPandas(_merge_groups, MERGED + ", via string"))
        levels.append(got)
        to = got.select(F.col("a").alias("r"), F.col("via").alias("via2"), F.col("depth").alias("d2"), "root", F.coalesce("cyc", "ring").alias("c2"))
        # one link per node whose link leaves its group, to the node at which the target's group is left
        up = placed.join(got.where("via = a").select("a"), "a", "left_semi").drop("top", "tw", "fc").join(to, "r")
        open_ = F.col("via2").isNotNull()
        now = cut(up.select("a", F.col("via2").alias("r"), (F.col("w") + F.col("d2")).alias("w"), F.when(~open_, F.col("root")).alias("top"), F.when(~open_, F.col("w") + F.col("d2")).otherwise(F.lit(0)).cast("long").alias("tw"), F.when(~open_, F.col("c2")).alias("fc"), "grp"))
        before, left = left, now.count()
        if left > before // 2:
            break
    if not levels:
        return _merge_one(now) if left <= merge_limit else _merge_large(now)
    done = cut(_merge_one(now) if left <= merge_limit else _merge_large(now))
    again = done.where("ring is not null").select("a")
    for got in reversed(levels):  # from the last contraction back to the links as they came
        up = done.select(F.col("a").alias("via"), F.col("root").alias("r2"), F.col("depth").alias("d2"), F.col("ring").alias("g2"), F.col("cyc").alias("c2"))
        open_ = F.col("via").isNotNull()
        j = got.join(up, "via", "left")
        done = cut(j.select("a", F.when(open_, F.col("r2")).otherwise(F.col("root")).alias("root"), F.when(open_, F.col("depth") + F.col("d2")).otherwise(F.col("depth")).alias("depth"), F.when(open_, F.col("g2")).otherwise(F.col("ring")).alias("ring"), (F.col("on_ring") & ~open_).alias("on_ring"), F.when(open_, F.col("c2")).otherwise(F.col("cyc")).alias("cyc")))
        again = again.unionByName(done.where("ring is not null").select("a"))
    rings = cut(links.join(again.distinct(), "a", "left_semi").select(*LINK))
    n = rings.count()
    if not n:
        return done
    fixed = _merge_one(rings) if n <= merge_limit else _merge_large(rings)
    return done.where("ring is null").unionByName(fixed)


def _ring_members(key, forest: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
    """Nodes of one partition on the way from each entry up to its local root."""
    up = dict(zip(forest["id"], forest["parent"]))
    got_ring, got_id = [], []
    for e, ring, stop in zip(entries["e"], entries["ring"], entries["elroot"]):
        i = e
        while True:
            got_ring.append(ring)
            got_id.append(i)
            if i == stop:
                break
            i = up[i]
    return pd.DataFrame({"ring": got_ring, "symbol_id": got_id})


def cycles_of(forest: DataFrame, links: DataFrame, merged: DataFrame) -> DataFrame:
    """(cycle_id, symbol_id) of all nodes on circles, within partitions and across them."""
    local = forest.where("on_cycle").select(F.col("cyc").alias("cycle_id"), F.col("id").alias("symbol_id"))
    rings = merged.where("on_ring").select("a", "ring")
    entries = links.join(rings, "a").select("e", "epid", "ring", "elroot")
    there = forest.select("pid", "id", "parent").join(entries.select(F.col("epid").alias("pid")).distinct(), "pid", "left_semi")
    walked = there.groupBy("pid").cogroup(entries.groupBy("epid")).applyInPandas(_ring_members, "ring string, symbol_id string")
    least = walked.groupBy("ring").agg(F.min("symbol_id").alias("cycle_id"))
    across = walked.join(least, "ring").select("cycle_id", "symbol_id")
    return local.unionByName(across).distinct()


def parent_links(df: DataFrame, id_col: str = "id", parent_col: str = "parent", order: str = "seq", near: str | None = "file") -> DataFrame:
    """Current (id, parent, near) links; ids compared without case and surrounding blanks, an empty parent is none.

    Null and blank ids are left out. Of several rows of an id the one of highest ``order`` holds.
    """
    own = df.select(norm_id(id_col).alias("id"), norm_id(parent_col).alias("parent"), F.col(order).alias("seq"), *([F.col(near).alias("near")] if near else [F.lit("").alias("near")]))
    cur = current_rows(own.where("id <> ''"), "id", ["parent", "near"])
    return cur.select("id", F.when(F.col("parent") != "", F.col("parent")).alias("parent"), F.coalesce("near", F.lit("")).alias("near"))


def find_cycles(links: DataFrame, near: str | None = "near", merge_limit: int = MERGE_LIMIT, parts: int | None = None, fan: int = FAN) -> DataFrame:
    """(cycle_id, symbol_id) for the nodes on a circle of parents, self-parents included; ``cycle_id`` is the smallest id on it.

    Nodes that only hang below a circle, parents that are no node and empty tables give no rows.
    """
    forest = local_forest(links, near, parts)
    out = cut(boundary(forest))
    return cycles_of(forest, out, cut(merge_links(out, merge_limit, fan)))


def root_paths(links: DataFrame) -> DataFrame:
    """(lroot, pre): the path above each local root that hangs on another partition, by doubling over the hops between partitions.

    Only contracted roots take part. What hangs on a circle gets no path.
    """
    state = cut(links.where("fc is null").select("a", F.when(F.col("elroot").isNotNull(), F.col("elroot")).alias("p"), F.coalesce("seg", F.array().cast("array<string>")).alias("pre")))
    left = state.where("p is not null").count()
    while left:
        to = state.select(F.col("a").alias("p"), F.col("p").alias("p2"), F.col("pre").alias("pre2"))
        step = state.where("p is not null").join(to, "p", "left").select("a", F.col("p2").alias("p"), F.when(F.col("pre2").isNotNull(), F.concat("pre2", "pre")).otherwise(F.col("pre")).alias("pre"))
        state = cut(state.where("p is null").unionByName(step))
        now = state.where("p is not null").count()
        if now == left:
            break  # rings between partitions
        left = now
    return state.where("p is null").select(F.col("a").alias("lroot"), "pre")


def hierarchy(links: DataFrame, near: str | None = "near", merge_limit: int = MERGE_LIMIT, parts: int | None = None, fan: int = FAN) -> DataFrame:
    """(id, root, depth, path, on_cycle, cycle_id) per node.

    A node whose parent is no node is a root. Nodes on or below a circle have null root,
    depth and path; ``cycle_id`` names the circle of those on it.
    """
    forest = local_forest(links, near, parts, paths=True)
    out = cut(boundary(forest))
    merged = cut(merge_links(out, merge_limit, fan))
    tops = cut(merged.select(F.col("a").alias("lroot"), "root", "depth").join(root_paths(out), "lroot", "left"))
    rings = cut(cycles_of(forest, out, merged).select(F.col("symbol_id").alias("id"), "cycle_id"))
    # the table itself stays where it is while what is joined to it is small, counted in rows and in steps of paths
    size = tops.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.size("pre")), F.lit(0)).alias("steps")).first()
    tops = broadcast_below(tops, max(size["rows"] * BROADCAST_STEPS // BROADCAST_ROWS, size["steps"]), BROADCAST_STEPS)
    rings = broadcast_below(rings, rings.count(), BROADCAST_ROWS)
    node = forest.select("id", "lroot", "off", "seg", F.col("ext").isNotNull().alias("open")).join(tops, "lroot", "left").join(rings, "id", "left")
    tree = F.col("lroot").isNotNull()
    root = F.when(F.col("open"), F.col("root")).when(tree, F.col("lroot")).alias("root")
    depth = F.when(F.col("open"), F.col("off") + F.col("depth")).when(tree, F.col("off")).alias("depth")
    path = F.when(F.col("open") & F.col("pre").isNotNull(), F.concat("pre", "seg")).otherwise(F.col("seg")).alias("path")
    got = node.select("id", root, depth, path, F.col("cycle_id").isNotNull().alias("on_cycle"), "cycle_id")
    known = F.col("root").isNotNull()
    return got.select("id", "root", F.when(known, F.col("depth")).alias("depth"), F.when(known, F.col("path")).alias("path"), "on_cycle", "cycle_id")


def descendants(tree: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance) pairs from the paths: as many rows as the paths have steps."""
    return tree.where("path is not null").select(F.posexplode("path").alias("at", "ancestor"), F.col("id").alias("descendant"), F.col("depth")).where("at < depth").select("ancestor", "descendant", (F.col("depth") - F.col("at")).alias("distance"))
