from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lodegraph.operators.keyed_counts import heavy_keys, keyed_counts


def test_against_counter(spark):
    """One key holds two thirds of the rows; repeated rows and nulls count as documented."""
    rows = [("hot" if i % 3 else f"k{i % 7}", "uses" if i % 2 else None, f"s{i % 40}" if i % 11 else None, i, "noise") for i in range(3000)] + [(None, None, None, 0, "x"), ("", "", "", 0, "x")]
    df = spark.createDataFrame(rows, "t string, y string, s string, n long, members string").repartition(5)
    got = {(r.t, r.y): (r.n, r.members) for r in keyed_counts(df, ["t", "y"], "s").collect()}
    n, members = Counter(), defaultdict(set)
    for t, y, s, *_ in rows:
        n[t, y] += 1
        if s is not None:
            members[t, y].add(s)
    assert got == {k: (v, len(members[k])) for k, v in n.items()}
    assert {(r.t, r.y): r.n for r in keyed_counts(df, ["t", "y"]).collect()} == dict(n)


def test_heavy_keys_at_the_bound(spark):
    df = spark.createDataFrame([("a",)] * 99 + [("b",)], "k string").withColumn("s", F.lit("x"))
    counts = keyed_counts(df, ["k"], "s")
    assert {r.k for r in heavy_keys(counts, 100).collect()} == {"a", "b"}
    assert {r.k for r in heavy_keys(counts, 101).collect()} == {"a"}


def test_empty(spark):
    assert keyed_counts(spark.createDataFrame([], "k string, s string"), ["k"], "s").count() == 0
