"""Subject areas of documents: complement naive Bayes, expectation-maximization, calibrated posteriors.

Sentences are bags of hashed words and word pairs. Labelled samples give the first class
counts; every EM round then scores all sentences of all documents, shares them among the
subjects and "none", gives each document the mixture of its sentences, and sums the expected counts per feature (combined inside each split
before the shuffle). The complement weights of the last round, with a logistic calibration per
subject, decide for each sentence which subjects it deals with. The model never exceeds
``2**bits`` rows, whatever the corpus.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.plans.lineage import cut, too_few_splits

BITS = 19
ROUNDS = 5
LABEL_LIMIT = 100_000
MOST_SUBJECTS = 1000
SHARE = 0.25
SEED_PRIOR = 0.5
PRIOR = 10.0
DEAD_ZONE = 0.8
NONE_SCORE = 2.5

_FENCE = re.compile(r"^[ \t>*/#]*(```|~~~).*?(?:^[ \t>*/#]*\1[^\n]*$|\Z)", re.S | re.M)
_HEADING = re.compile(r"^\s{0,3}#{1,6}(\s|$)")
_UNDERLINE = re.compile(r"^\s{0,3}(=+|-{3,})\s*$")
_RULE = re.compile(r"^\s*(=+|-{3,}|\*{3,}|_{3,})\s*$")
_MARKS = re.compile(r"^[\s>*/#|+-]+|[\s*/|]+$")
_SPEAKER = re.compile(r"^\[[\w .-]+\]\s*")
_SPLIT = re.compile(r"(?<=[.!?])[\"')\]]*\s+|;\s+(?=[A-ZÄÖÜÁÉÍÓÚ`])")
_NAME = re.compile(r"\b[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]*)+(?:\.\w+)?(?:\(\))?|\w+\(\)")
_HUMP = re.compile(r"(?<=[a-zäöüßáéíóúñ])(?=[A-ZÄÖÜÁÉÍÓÚ])")
_LETTERS = re.compile(r"[^\W\d_]+")

# Frequent function words that tell the languages apart; any other language shares the first stratum with English
_STRATA = (
    {"the", "and", "of", "is", "was", "are", "with", "for", "this", "that", "every", "when", "more"},
    {"der", "die", "das", "und", "ist", "nicht", "ein", "eine", "bei", "von", "für", "mit", "wird", "werden", "ob", "vor", "sich", "nichts", "mehr", "zu"},
    {"el", "la", "los", "las", "de", "y", "en", "con", "por", "para", "se", "que", "al", "del", "cada", "más", "sin"},
)


def stratum(text: str) -> int:
    """Language stratum of a text: terms are weighed only against wording of the same language."""
    w = re.findall(r"[^\W\d_]+", text.lower())
    n = [sum(map(words.__contains__, w)) for words in _STRATA]
    return int(np.argmax(n))


def sentences(text: str) -> list[str]:
    """Sentences without headings, code blocks, comment marks and speakers."""
    text = _FENCE.sub("\n\n", text.replace("\r\n", "\n").replace("&nbsp;", " "))
    lines: list[str] = []
    block = False
    for raw in text.split("\n"):
        if _HEADING.match(raw) and not block:
            lines.append("")
            continue
        if lines and _UNDERLINE.match(raw):
            lines[-1] = ""  # what it underlines is a heading
        line = "" if _RULE.match(raw) else _SPEAKER.sub("", _MARKS.sub("", raw))
        block = raw.lstrip().startswith(("/*", "*", "//"))
        if line and lines and lines[-1] and line[0].islower() and lines[-1][-1] not in ".!?;:":
            lines[-1] += " " + line
        else:
            lines.append(line)
    return [s for line in lines if line for s in _SPLIT.split(line) if s and _LETTERS.search(s)]


@lru_cache(maxsize=1 << 18)
def _crc(word: str) -> int:
    return zlib.crc32(word.encode())


def _words(sentence: str) -> list[str]:
    """Names of program parts are left out, case and joins do not count."""
    return _LETTERS.findall(_HUMP.sub(" ", _NAME.sub(" 0 ", sentence.replace("_", " "))).lower())


def hashed(found: list[str], kinds: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed words and word pairs of all sentences at once: feature ids, and how many each sentence has."""
    rows = [_words(s) for s in found]
    n = np.fromiter(map(len, rows), np.int64, len(rows))
    word = np.fromiter((_crc(w) for r in rows for w in r), np.uint64, int(n.sum()))
    of = np.repeat(np.arange(len(rows)), n)
    joined = of[1:] == of[:-1]
    pair = ((word[:-1] * np.uint64(0x9E3779B1) + word[1:]) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(32)
    key, of = np.concatenate([word, pair[joined]]).astype(np.int64), np.concatenate([of, of[:-1][joined]])
    ids = kinds[of] << (bits - 2) | key >> (34 - bits)
    each = np.sort(of << bits | ids)
    each = each[np.r_[True, each[1:] != each[:-1]]] if len(each) else each
    return (each & ((1 << bits) - 1)).astype(np.int32), np.bincount(each >> bits, minlength=len(rows)).astype(np.int32)


def features(sentence: str, kind: int, bits: int = BITS) -> list[int]:
    return hashed([sentence], np.array([kind]), bits)[0].tolist()


def label_of(subject: str | None, known: dict[str, int]) -> int:
    return known.get(re.sub(r"[\W_]+", " ", subject).strip().casefold(), -1) if subject else -1


class Model:
    """Feature counts per subject and the complement weights they give."""

    def __init__(self, n_subjects: int, bits: int = BITS):
        self.n = n_subjects
        self.counts = np.zeros((1 << bits, n_subjects), np.float64)
        self.weights: np.ndarray | None = None

    def weigh(self, prior: float) -> None:
        """Log odds of a feature in a subject against its complement within its language stratum.

        ``prior`` pseudo-counts draw rare features to 0, the dead zone holds wording at 0 that
        leans to a subject by chance.
        """
        quarter = len(self.counts) // 4
        self.weights = np.zeros(self.counts.shape, np.float32)
        for k in range(4):
            counts = self.counts[k * quarter : (k + 1) * quarter]
            own = counts.sum(axis=0)
            share = (own + 1) / (own.sum() + self.n)
            p = (counts + prior * share) / (counts.sum(axis=1, keepdims=True) + prior)
            w = np.log(p / share) - np.log((1 - p + 1e-9) / (1 - share))
            self.weights[k * quarter : (k + 1) * quarter] = (np.sign(w) * np.maximum(np.abs(w) - DEAD_ZONE, 0)).clip(-3, 3)


def scores(weights: np.ndarray, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of weights per sentence; ``first`` are the starts of the sentences in ``ids``, none empty."""
    return np.add.reduceat(weights[ids], first, axis=0) if len(first) else np.zeros((0, weights.shape[1]), np.float32)


def _softmax(s: np.ndarray, extra: np.ndarray | float) -> np.ndarray:
    top = np.maximum(s.max(axis=1, keepdims=True), NONE_SCORE)
    e = np.exp(s - top)
    n = np.exp(NONE_SCORE - top)
    return np.concatenate([e, n], axis=1) * extra


def _posteriors(weights: np.ndarray, ids: np.ndarray, first: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Mixture of subjects of the document of each sentence, from the shares of all its sentences.

    Every sentence counts with its document's mixture, so wording that all subjects share ends
    up even, and only terms that keep to a subject gain weight.
    """
    p = _softmax(scores(weights, ids, first), 1.0)
    p /= p.sum(axis=1, keepdims=True)
    starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    mix = np.add.reduceat(p, starts, axis=0)
    found = 1 - mix[:, -1:] / mix.sum(axis=1, keepdims=True)
    mix = mix[:, :-1] ** 2
    mix *= found / np.maximum(mix.sum(axis=1, keepdims=True), 1e-9)
    return np.repeat(mix, np.diff(np.r_[starts, len(doc)]), axis=0)


def _extract(bits: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            texts = [t or "" for t in f["text"]]
            found = [sentences(t) for t in texts]
            at = np.array([len(s) for s in found], np.int32)
            ids, sizes = hashed([s for x in found for s in x], np.repeat([stratum(t) for t in texts], at), bits)
            ends = np.cumsum(at)
            by_doc = np.split(sizes, ends[:-1])
            yield pd.DataFrame({"doc_id": f["doc_id"], "n_sentences": at, "sizes": by_doc, "ids": np.split(ids, np.cumsum([s.sum() for s in by_doc])[:-1])})

    return run


def _flat(f: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, starts and document number of all sentences that have a feature."""
    sizes = np.concatenate(f["sizes"].to_list()) if len(f) else np.zeros(0, np.int32)
    doc = np.repeat(np.arange(len(f)), f["n_sentences"].to_numpy())
    ids = np.concatenate(f["ids"].to_list()) if len(f) else np.zeros(0, np.int32)
    first = np.cumsum(sizes) - sizes
    keep = sizes > 0
    return ids, first[keep].astype(np.int64), doc[keep]


def _expect(model, n: int, bits: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = model.value
        sums = np.zeros((1 << bits, n), np.float32)
        for f in frames:
            ids, first, doc = _flat(f)
            if not len(first):
                continue
            p = _posteriors(weights, ids, first, doc)
            # a feature counts once a document, however often it repeats there
            owner = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(ids)]))
            _, once = np.unique(doc[owner].astype(np.int64) << bits | ids, return_index=True)
            feature, each = ids[once], p[owner[once]]
            for c in range(n):
                sums[:, c] += np.bincount(feature, weights=each[:, c], minlength=1 << bits).astype(np.float32)
        used = np.flatnonzero(sums.any(axis=1))
        for i in range(0, len(used), 20_000):
            u = used[i : i + 20_000]
            yield pd.DataFrame({"feature": u.astype(np.int32)} | {f"c{c}": sums[u, c].astype(np.float64) for c in range(n)})

    return run


def _decide(model, subjects: list[str], share: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, slope, offset = model.value
        for f in frames:
            ids, first, doc = _flat(f)
            n = np.maximum(f["n_sentences"].to_numpy(), 1)
            deals = np.zeros((len(f), len(subjects)))
            if len(first):
                s = scores(weights, ids, first)
                post = 1 / (1 + np.exp(-np.clip(slope * s + offset, -40, 40)))
                np.add.at(deals, doc, post >= 0.5)
            part = deals / n[:, None]
            d, c = np.nonzero((part >= share - 1e-9) & (deals > 0))
            if len(d):
                yield pd.DataFrame({"doc_id": f["doc_id"].to_numpy()[d], "subject": [subjects[i] for i in c], "share": part[d, c]})

    return run


def calibrate(s: np.ndarray, label: np.ndarray, n: int, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logistic slope and offset per subject from labelled scores.

    As many sentences without evidence count as negative. ``best`` is the weight of each
    sentence's strongest feature for its label: one term alone is to be enough, so a reading
    reduced to it counts as positive too.
    """
    slope, offset = np.ones(n), np.zeros(n)
    for c in range(n):
        mine = label == c
        x = np.r_[s[:, c], np.zeros(len(s)), best[mine]].astype(np.float64)
        y = np.r_[mine, np.zeros(len(s), bool), np.ones(mine.sum(), bool)].astype(np.float64)
        pos, neg = y.sum(), len(y) - y.sum()
        if not pos or not neg:
            offset[c] = -NONE_SCORE
            continue
        t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
        a, b = 1.0, -NONE_SCORE
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
            w = np.maximum(p * (1 - p), 1e-6)
            g = np.array([((p - t) * x).sum() + 1e-3 * (a - 1), (p - t).sum()])
            h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-6]])
            step = np.linalg.solve(h, g)
            a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -2, 2)
            if abs(step).max() < 1e-6:
                break
        slope[c], offset[c] = a, b
    return slope.astype(np.float32), offset.astype(np.float32)


def train(feats: DataFrame, samples: list[tuple[str, str | None]], subjects: list[str], rounds: int = ROUNDS, bits: int = BITS) -> tuple[Model, np.ndarray, np.ndarray]:
    """Model and calibration from labelled samples and all sentences of ``feats``."""
    sc = feats.sparkSession.sparkContext
    n = len(subjects)
    known = {re.sub(r"[\W_]+", " ", x).strip().casefold(): i for i, x in enumerate(subjects)}
    rows = [(features(s, stratum(text), bits), label_of(lab, known)) for text, lab in samples for s in sentences(text or "")]
    rows = [(f, lab) for f, lab in rows if f and lab >= 0]
    seed = Model(n, bits)
    for f, lab in rows:
        seed.counts[f, lab] += 1
    model = seed
    model.weigh(SEED_PRIOR)
    kinds = "feature int, " + ", ".join(f"c{c} double" for c in range(n))
    for _ in range(rounds):
        sent = sc.broadcast(model.weights)  # 2**bits rows, a bound set by the parameter
        sums = feats.mapInPandas(_expect(sent, n, bits), kinds).groupBy("feature").agg(*[F.sum(f"c{c}").alias(f"c{c}") for c in range(n)]).toPandas()
        sent.destroy()  # its copies on the executors' disks
        nxt = Model(n, bits)
        at, got = sums["feature"].to_numpy(), sums[[f"c{c}" for c in range(n)]].to_numpy()
        nxt.counts[at] = got
        nxt.counts += seed.counts
        nxt.weigh(PRIOR)
        model = nxt
    ids = np.array([i for f, _ in rows for i in f], np.int64)
    sizes = np.array([len(f) for f, _ in rows], np.int64)
    s = scores(model.weights, ids, np.cumsum(sizes) - sizes) if rows else np.zeros((0, n))
    # a wrong label shows as a sentence that another subject claims by far; it must not bend the calibration
    label = np.array([lab for _, lab in rows], np.int64)
    fair = s[np.arange(len(s)), label] >= s.max(axis=1) - 3 if len(s) else np.zeros(0, bool)
    best = np.array([model.weights[f, lab].max() for f, lab in rows])
    return model, *calibrate(s[fair], label[fair], n, best[fair])


def subjects_of(documents: DataFrame, areas: DataFrame, samples: DataFrame, share: float = SHARE, rounds: int = ROUNDS, bits: int = BITS, label_limit: int = LABEL_LIMIT) -> DataFrame:
    """(doc_id, subject, share): subjects that at least ``share`` of a document's sentences deal with.

    ``areas`` names the subjects, ``samples`` holds labelled texts; labels are compared without
    case and punctuation, null and unknown ones are left aside, and at most ``label_limit`` rows
    of them (by smallest id) are used to fit. All documents take part in the EM rounds. Null or
    empty texts have no subject; without subjects or documents there are no rows. Repeated ids
    are judged row by row. More than ``MOST_SUBJECTS`` subjects are an error: a model has a
    column for each.
    """
    names = sorted({r.subject for r in areas.select("subject").where("subject is not null").distinct().limit(MOST_SUBJECTS + 1).collect()})
    if len(names) > MOST_SUBJECTS:
        raise ValueError(f"more than {MOST_SUBJECTS} subjects")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    if few := too_few_splits(documents):
        docs = docs.repartition(few, "doc_id")
    feats = cut(docs.mapInPandas(_extract(bits), "doc_id long, n_sentences int, sizes array<int>, ids array<int>"))
    if not names:
        return feats.select("doc_id", F.lit("").alias("subject"), F.lit(0.0).alias("share")).where("false")
    rows = samples.select("sample_id", "text", "subject").where("text is not null and subject is not null").orderBy("sample_id").limit(label_limit).collect()
    model, slope, offset = train(feats, [(r.text, r.subject) for r in rows], names, rounds, bits)
    sent = documents.sparkSession.sparkContext.broadcast((model.weights, slope, offset))
    return feats.mapInPandas(_decide(sent, names, share), "doc_id long, subject string, share double")
