import random
from datetime import datetime

import numpy as np

from lodegraph.functions.bitmaps import Bitmap
from lodegraph.operators import orphan_refs as O

SYM = "id string, name string, file string, indexed_at timestamp, key string"
REL = "source_id string, target_id string, type string, seq long, indexed_at timestamp, field string"
DOC = "symbol_name string, doc_path string, updated_at timestamp, seq long"
IDX = "run_id long, started_at timestamp, removed_files array<string>"


def at(month, day=10):
    return datetime(2025, month, day)


def test_bitmaps_against_sets():
    r = random.Random(0)
    for size in (0, 10, 5000, 200_000):
        a = np.array([r.randrange(300_000) for _ in range(size)], dtype=np.int64)
        b = np.array([r.randrange(300_000) for _ in range(size // 2)], dtype=np.int64)
        assert set(Bitmap.of(a).and_not(Bitmap.of(b)).decode().tolist()) == set(a.tolist()) - set(b.tolist())


def run(spark, sym, rel, doc, idx):
    return {(x.table_name, x.seq, x.field) for x in O.orphan_references(spark.createDataFrame(sym, SYM), spark.createDataFrame(rel, REL), spark.createDataFrame(doc, DOC), spark.createDataFrame(idx, IDX)).collect()}


def test_life_of_a_symbol(spark):
    sym = [("a", "Foo", "x.go", at(2), "k"), ("b", "Bar", "y.go", at(1), "k"), ("b", "Bar", "y.go", at(5), "k"), ("n", None, None, None, None)]
    idx = [(1, at(3, 20), ["./y.go", None]), (2, at(9), None), (3, at(7), ["x\\x.go"])]
    rel = [
        ("A", " b", "uses", 1, at(1), "f"),  # a not indexed yet; b live
        ("a", "b", "uses", 2, at(2), "f"),
        ("a", "B\t", "uses", 3, at(3, 1), "f"),  # y.go removed later in that month
        ("a", "b", "uses", 4, at(4), "f"),  # still removed
        ("a", "b", "uses", 5, at(6), "f"),  # indexed again
        ("module::q", "zz", "uses", 6, at(6), "f"),
        (None, " ", "uses", 7, at(6), "f"),
        ("a", "b", "uses", 8, None, "f"),
        ("a", "zz", "uses", 6, at(6), "f"),  # a repeated number stays a reference of its own
    ]
    doc = [("Foo()", "d", at(2), 1), (" Foo ", "d", at(1), 2), ("foo", "d", at(6), 3), (None, "d", at(6), 4), ("Bar", "d", at(4), 5)]
    assert run(spark, sym, rel, doc, idx) == {
        ("relationships", 1, "source_id"), ("relationships", 3, "target_id"), ("relationships", 4, "target_id"), ("relationships", 6, "target_id"),
        ("doc_mappings", 2, "symbol_name"), ("doc_mappings", 3, "symbol_name"), ("doc_mappings", 5, "symbol_name"),
    }


def test_hot_orphan_and_empty_tables(spark):
    rel = [("s", "gone", "uses", i, at(3), "f") for i in range(5000)] + [("s", "a", "uses", 9999, at(3), "f")]
    got = run(spark, [("s", "S", "f", at(1), "k"), ("a", "A", "f", at(1), "k")], rel, [], [])
    assert got == {("relationships", i, "target_id") for i in range(5000)}
    assert run(spark, [], rel[:2], [], []) == {("relationships", i, f) for i in (0, 1) for f in ("source_id", "target_id")}
    assert run(spark, [], [], [], []) == set()
