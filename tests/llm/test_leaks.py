import random

from lodegraph.llm import leaks as L

DOC, ITEM = "doc_id long, text string, item_id string", "item_id long, text string, suite string"
W = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi".split()


def run(spark, docs, items, **k):
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], DOC)
    e = spark.createDataFrame([(i, t, "x") for i, t in items], ITEM)
    return {(r.doc_id, r.item_id) for r in L.leaked_items(d, e, **k).collect()}


def test_random_texts_against_all_windows(spark):
    r = random.Random(1)
    pick = lambda n: [r.choice("a b c".split()) for _ in range(n)]
    items = [(i, " ".join(pick(30))) for i in range(12)]
    docs = [(i, " ".join(pick(r.randrange(400)))) for i in range(60)] + [(99, " ".join(pick(9000)))]
    grams = {}
    for i, t in items:
        w = t.split()
        for j in range(len(w) - 11):
            grams.setdefault(tuple(w[j : j + 12]), set()).add(i)
    want = {(d, i) for d, t in docs for j in range(len(t.split()) - 11) for i in grams.get(tuple(t.split()[j : j + 12]), ())}
    assert want and run(spark, docs, items) == want
    assert run(spark, docs, items, chars_per_block=150) == want


def test_disguises(spark):
    item = " ".join(W)
    docs = [
        (1, "// " + "\n// ".join(W[:12])), (2, " ".join(W[2:14]).upper()), (3, "&nbsp; ".join(W[:12])), (4, "<p>" + "<br/>".join(W[:12]) + "</p>"), (5, " ".join("".join(chr(ord(c) + 0xFEE0) for c in w) for w in W[:12])),
        (6, " ".join(w[0] + "\u200b\u00ad" + w[1:] for w in W[:12])), (7, " ".join(w[0] + "<b>" + w[1:] + "</b>" for w in W[:12])), (8, "> " + ", - ".join(W[:12])), (9, "_".join(W[:12])), (10, "<!-- " + " ".join(W[:12]) + " -->"),
        (20, " ".join(W[:11])), (21, " ".join([*W[:6], "x", *W[6:12]])), (22, ""), (23, None), (24, " ".join(W[:11]) + " mubar"),
    ]
    assert run(spark, docs, [(7, item)]) == {(i, 7) for i in range(1, 11)}


def test_ties_repeats_and_empties(spark):
    t = " ".join(W)
    assert run(spark, [(1, t), (1, t), (None, t)], [(1, t), (2, t), (None, t), (3, " ".join(W[:11])), (4, ""), (5, None)]) == {(1, 1), (1, 2)}
    assert run(spark, [], [(1, t)]) == set() and run(spark, [(1, t)], []) == set()
    assert run(spark, [(1, "filler " * 300_000 + t)], [(1, t)]) == {(1, 1)}


def test_passages_do_not_depend_on_the_partitions(spark):
    """Rows of one id are united, wherever they lie."""
    rows = [(1, " ".join(W[:14]), "x"), (1, " ".join(W[2:16]), "x")]
    items = spark.createDataFrame([(7, " ".join(W), "x")], ITEM)
    for parts in (1, 2):
        got = L.leaked_items(spark.createDataFrame(rows, DOC).repartition(parts), items).collect()
        assert [(r.doc_id, r.item_id, r.passages) for r in got] == [(1, 7, 5)]
