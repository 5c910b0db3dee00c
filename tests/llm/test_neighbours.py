import numpy as np

from lodegraph.llm import neighbours as N

ROW = "hash string, vector array<float>, id long"


def frame(spark, x, names=None):
    return spark.createDataFrame([(names[i] if names else f"h{i:05d}", None if v is None else [float(e) for e in v], 1) for i, v in enumerate(x)], ROW)


def brute(x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return s, np.argsort(-s, axis=1, kind="stable")[:, :k]


def test_recall_and_close_pairs(spark):
    """At least nine tenths of the true neighbours, and every close pair."""
    r = np.random.default_rng(0)
    centers = r.normal(size=(12, 16))
    x = (centers[r.integers(0, 12, 2500)] + 0.7 * r.normal(size=(2500, 16))).astype(np.float32)
    x[2000:2200] = x[:200] * 3 + 0.01 * r.normal(size=(200, 16))
    s, top = brute(x.astype(np.float64), 5)
    near = N.nearest(frame(spark, x), 5, 16, block=300)
    got = {(a.hash, a.neighbour) for a in near.collect()}
    want = {(f"h{i:05d}", f"h{j:05d}") for i in range(len(x)) for j in top[i]}
    assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)
    close = {tuple(sorted((f"h{i:05d}", f"h{j:05d}"))) for i in range(len(x)) for j in top[i] if s[i, j] >= 0.97}
    pairs = {(a.hash_a, a.hash_b) for a in N.close_pairs(near, 0.97).collect()}
    assert len(close - pairs) <= 0.02 * len(close) and pairs <= {tuple(sorted(w)) for w in got}


def test_copies_and_unusable(spark):
    one, two = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]
    x = [one] * 12 + [two, None, [0.0] * 4, [float("nan"), 1, 1, 1], [1.0, 2.0], [1.0, None, 0.0, 0.0] and None]
    df = frame(spark, x)
    df = df.unionByName(df)
    got = {}
    for r in N.nearest(df, 5, 4).collect():
        got.setdefault(r.hash, []).append((r.rank, r.neighbour, round(r.cosine, 6)))
    assert set(got) == {f"h{i:05d}" for i in range(13)}
    for i in range(12):
        want = [f"h{j:05d}" for j in range(12) if j != i][:5]
        assert [n for _, n, _ in sorted(got[f"h{i:05d}"])] == want
    assert all(c == 0 for _, _, c in got["h00012"]) and len(got["h00012"]) == 5


def test_tiny_and_empty(spark):
    assert N.nearest(frame(spark, [[1, 0, 0, 0]]), 5, 4).count() == 0
    assert N.nearest(frame(spark, [[1, 0, 0, 0]]).where("false"), 5, 4).count() == 0
    assert N.nearest(frame(spark, [[1, 0, 0, 0], [1, 1, 0, 0]]), 5, 4).count() == 2
