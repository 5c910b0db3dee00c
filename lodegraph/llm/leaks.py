"""Evaluation texts leaking into training text: Wu-Manber multi-pattern search over words.

The patterns are all passages of ``WINDOW`` consecutive words of the evaluation items. A block
of two words looks up how far the search may jump (most blocks occur in no pattern, so ten of
eleven positions are never visited); blocks that end a pattern select, by the hash bucket of
that suffix, the passages to compare with word for word. Many texts advance at once, as
arrays; long texts are cut into overlapping stretches so that no passage is missed.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.plans.lineage import too_few_splits

WINDOW = 12
STRETCH = 2048
CHARS_PER_BLOCK = 4_000_000
TABLE_BITS = 20

_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
# Code points without any width
_UNSEEN = {0xAD: None, 0x34F: None, 0x61C: None, 0x115F: None, 0x1160: None, 0x17B4: None, 0x17B5: None, 0x180E: None, 0xFEFF: None} | {i: None for a, b in ((0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0xFE00, 0xFE0F), (0xE0000, 0xE007F)) for i in range(a, b + 1)}
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[list[str]]:
    """Word sequences of a text: one, or two where tags might join or part words."""
    if "&" in text:
        text = html.unescape(text)
    tagged = "<" in text and _TAG.search(text) is not None
    forms = [_TAG.sub(" ", text), _TAG.sub("", text)] if tagged else [text]
    out: list[list[str]] = []
    for t in forms:
        if not t.isascii():
            t = unicodedata.normalize("NFKC", t.translate(_UNSEEN)).translate(_UNSEEN)
        w = _WORD.findall(t.casefold())
        if w not in out:
            out.append(w)
    return out


class Patterns:
    """Shift table, suffix buckets and the passages themselves, over integer word ids; 0 is any other word."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids: dict[str, int] = {}
        rows: dict[tuple, set[int]] = {}
        for item, text in items:
            for seq in words(text or ""):
                at = [self.ids.setdefault(w, len(self.ids) + 1) for w in seq]
                for i in range(len(at) - WINDOW + 1):
                    rows.setdefault(tuple(at[i : i + WINDOW]), set()).add(item)
        self.passages = np.array(list(rows), dtype=np.int32).reshape(-1, WINDOW)
        self.v = len(self.ids) + 1
        bucket = self.slot(self.passages[:, -2].astype(np.int64) * self.v + self.passages[:, -1])
        order = np.argsort(bucket, kind="stable")
        self.passages = self.passages[order]
        # passages of suffix bucket b: starts[b] up to starts[b + 1]
        self.starts = np.r_[0, np.cumsum(np.bincount(bucket, minlength=1 << TABLE_BITS))].astype(np.int32)
        items_of = [sorted(x) for x in rows.values()]
        self.items = [items_of[i] for i in order]
        self.shift = np.full(1 << TABLE_BITS, WINDOW - 1, dtype=np.int8)
        for end in range(1, WINDOW):  # blocks nearer the end overwrite larger shifts
            block = self.passages[:, end - 1].astype(np.int64) * self.v + self.passages[:, end]
            np.minimum.at(self.shift, self.slot(block), np.int8(WINDOW - 1 - end))

    @staticmethod
    def slot(block: np.ndarray) -> np.ndarray:
        h = block.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def search(self, ids: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(stretch, passage) of every occurrence in the stretches [first, end) of ``ids``."""
        which = np.flatnonzero(end - first >= WINDOW)
        pos = first[which] + WINDOW - 1
        hits_s, hits_p = [], []
        while len(which):
            block = ids[pos - 1] * self.v + ids[pos]
            slot = self.slot(block)
            jump = self.shift[slot]
            at = np.flatnonzero(jump == 0)
            if len(at):
                lo = self.starts[slot[at]].astype(np.int64)
                n = self.starts[slot[at] + 1] - lo
                if n.any():
                    cand = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
                    ends = np.repeat(pos[at], n)
                    same = (self.passages[cand] == ids[ends[:, None] + np.arange(1 - WINDOW, 1)]).all(axis=1)
                    hits_s.append(np.repeat(which[at], n)[same])
                    hits_p.append(cand[same])
            pos = pos + np.maximum(jump, 1)
            go = pos < end[which]
            pos, which = pos[go], which[go]
        if not hits_s:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(hits_s), np.concatenate(hits_p)


def _scan(patterns, id_col: str, text_col: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p: Patterns = patterns.value
        get = p.ids.get
        for f in frames:
            owner, parts, first, end, n = [], [], [], [], 0
            for doc, text in zip(f[id_col], f[text_col]):
                for seq in words(text or ""):
                    if len(seq) < WINDOW:
                        continue
                    parts.append(np.fromiter((get(w, 0) for w in seq), np.int64, len(seq)))
                    for s in range(0, len(seq) - WINDOW + 1, STRETCH):
                        owner.append(doc)
                        first.append(n + s)
                        end.append(n + min(len(seq), s + STRETCH + WINDOW - 1))
                    n += len(seq)
            if not parts or not len(p.passages):
                continue
            s, at = p.search(np.concatenate(parts), np.array(first), np.array(end))
            out = [(owner[i], item, int(j)) for i, j in zip(s, at) for item in p.items[j]]
            if out:
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "passage"]).drop_duplicates()

    return run


def leaked_items(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", chars_per_block: int = CHARS_PER_BLOCK) -> DataFrame:
    """(doc_id, item_id, passages): how many distinct 12-word passages of the item the document holds.

    Whole texts are searched for all items, in blocks of about ``chars_per_block`` characters of
    items, the most that a search table sent to the executors may hold. Null or empty texts, texts and items
    under twelve words and empty tables give no rows; null ids too. Rows that repeat an id are
    taken together. Other columns are ignored, whatever their names.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    own = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("item_id is not null and text is not null")
    blocks = max(1, -(-(own.agg(F.sum(F.length("text"))).first()[0] or 0) // chars_per_block))
    if few := too_few_splits(documents):
        docs = docs.repartition(few, "doc_id")
    out = None
    for b in range(blocks):
        rows = own.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()  # a block of the evaluation set, never of the corpus
        tables = spark.sparkContext.broadcast(Patterns([(r.item_id, r.text) for r in rows]))
        part = docs.mapInPandas(_scan(tables, "doc_id", "text"), "doc_id long, item_id long, passage int")
        out = part if out is None else out.unionByName(part)
    # an item lies in one block, so its passages have one number each
    return out.distinct().groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("passages"))
