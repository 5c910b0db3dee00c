import pytest

from lodegraph.llm import mixing as M

DOC, TARGET = "doc_id long, text string, source string, tokens string", "source string, target_share double, max_repeats int"


def run(spark, docs, targets, **k):
    rows, report = M.mix(spark.createDataFrame([(*d, "x") for d in docs], DOC), spark.createDataFrame(targets, TARGET), **k)
    return rows.collect(), {r.source: r for r in report.collect()}


def test_shares_are_reached(spark):
    docs = [(i, "word " * (1 + i % 17), "big" if i % 10 else " Small-Src") for i in range(3000)]
    rows, rep = run(spark, docs, [("BIG", 0.6, 1), ("small_src", 0.4, 3), ("gone", 0.2, 9)], range_rows=100)
    assert rep["big"].reached_share == pytest.approx(0.6, abs=0.003) and rep["small_src"].reached_share == pytest.approx(0.4, abs=0.003)
    assert rep["gone"].tokens == 0 and rep["gone"].reached_share == 0
    assert rep["small_src"].most_repeats == 3 and max(r.repeats for r in rows if r.source == "big") == 1
    assert len({r.doc_id for r in rows}) == len(rows)
    again, _ = run(spark, docs, [("BIG", 0.6, 1), ("small_src", 0.4, 3), ("gone", 0.2, 9)], range_rows=10_000)
    assert sorted(rows) == sorted(again)  # the size of the ranges changes nothing


def test_total_beyond_a_cap(spark):
    docs = [(i, "a b c d", "s" if i < 10 else "t") for i in range(100)]
    rows, rep = run(spark, docs, [("s", 0.5, 2), ("t", 0.5, 1)], total_tokens=400)
    assert rep["s"].tokens == 2 * rep["s"].tokens_there and rep["t"].tokens == pytest.approx(200, abs=4)


def test_dirty_rows(spark):
    docs = [(1, None, "s"), (2, "", "s"), (3, "a b", None), (None, "a", "s"), (4, "x y z", "s"), (4, "x y z", "s"), (5, "q" * 40_000, "s"), (6, "a", "other")]
    rows, rep = run(spark, docs, [("s", 1.0, None), ("s", 0.5, 1), (None, 0.3, 1), ("zero", 0.0, 1)])
    assert {r.doc_id for r in rows} == {1, 2, 4, 5} and sum(r.doc_id == 4 for r in rows) == 2
    assert set(rep) == {"s"} and rep["s"].reached_share == 1.0


def test_empty(spark):
    assert run(spark, [], [("s", 1.0, 1)])[0] == [] and run(spark, [(1, "a", "s")], [])[0] == []


def test_no_row_exceeds_its_cap(spark):
    """The budget is exactly the cap, and the first ranges hold no tokens at all."""
    docs = [(i, "", "s") for i in range(20)] + [(100 + i, "a b c d", "s") for i in range(5)]
    rows, rep = run(spark, docs, [("s", 1.0, 2)], range_rows=1)
    assert {r.repeats for r in rows} == {2} and len(rows) == 25 and rep["s"].most_repeats == 2
