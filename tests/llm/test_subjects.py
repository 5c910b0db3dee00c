import random

from lodegraph.llm import subjects as S

TERMS = {"sea": ["anchor chain", "tide table", "cargo hold", "rudder pin"], "farm": ["seed drill", "milk yield", "crop row", "hay barn"], "fire": ["hose reel", "smoke alarm", "ladder truck", "burn ward"]}
FORMS = ["The {} and the {} share a table.", "We keep one {} per {} in the archive.", "Nobody checks the {} before the {}.", "Remember that `{}` follows the {}."]
IDLE = ["The names below are examples only.", "More on that further down.", "Page {} has the rest.", "The last cell of the table stays empty."]


def text(r, subject):
    a, b = r.sample(TERMS[subject], 2)
    if r.random() < 0.3:
        a = a.title().replace(" ", "")[0].lower() + a.title().replace(" ", "")[1:]
    return r.choice(FORMS).format(a, b)


def world(seed=3, n=400):
    r = random.Random(seed)
    docs, want = [], set()
    for i in range(n):
        mine = r.sample(list(TERMS), r.choice([0, 1, 1, 2]))
        s = [text(r, c) for c in mine for _ in range(4)] + [r.choice(IDLE).format(i) for _ in range(r.randrange(3, 6))]
        r.shuffle(s)
        docs.append((i, "# Sea chart heading\n\n" + " ".join(s) + "\n\n```\nseed drill hay barn\n```"))
        want |= {(i, c) for c in mine if 4 / len(s) >= 0.25}
    samples = [(i, text(r, c), c.upper() if i % 9 == 0 else c) for i, c in enumerate(list(TERMS) * 15)]
    samples[4] = (4, samples[4][1], "sea" if samples[4][2] != "sea" else "farm")  # a wrong label
    return docs, want, [*samples, (900, "anything", None), (901, None, "sea"), (902, "x", "no such")]


def frames(spark, docs, samples, areas=tuple(TERMS)):
    return spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, subject string"), spark.createDataFrame([(a, "d") for a in areas], "subject string, description string"), spark.createDataFrame(samples, "sample_id long, text string, subject string")


def test_held_out_accuracy(spark):
    docs, want, samples = world()
    got = {(r.doc_id, r.subject) for r in S.subjects_of(*frames(spark, docs, samples)).collect()}
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.05 * len(want)


def test_dirty_rows(spark):
    docs, _, samples = world(n=60)
    odd = [(1000, None), (1001, ""), (1002, "#"), (1003, "```\nopen"), (None, "x"), (1004, "milk yield and hay barn. " * 20_000), (1004, "more")]
    got = {(r.doc_id, r.subject) for r in S.subjects_of(*frames(spark, docs + odd, samples)).collect()}
    assert not {d for d, _ in got} & {1000, 1001, 1002, 1003, None} and (1004, "farm") in got
    assert S.subjects_of(*frames(spark, docs, samples, ())).count() == 0
    assert S.subjects_of(*frames(spark, [], samples)).count() == 0
    assert S.subjects_of(*frames(spark, docs, [])).count() == 0


def test_sentences():
    text = "# Head\n\nUnder a line\n===\nOne here. Two there!\n\n/**\n * Three lines\n * Four lines.\n */\n- five\n[reviewer] Six wraps\nonto the next line.\n```js\ncode.\n```\n***\n"
    assert S.sentences(text) == ["One here.", "Two there!", "Three lines", "Four lines.", "five", "Six wraps onto the next line."]
