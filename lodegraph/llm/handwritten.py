"""Generated, minified, vendored and data files among source files: linear support-vector classifiers.

Two classifiers share the labels that ``symbols.generated`` gives each file, noisy as it is.
The body classifier sees hashed character n-grams of the code and of its shape, the components
of the path and how the code relates to its repository, with all comments that might give the
file away masked; the head classifier sees only the comments, all of them: those at the top, at
the foot and between code are judged each on their own, and the strongest counts. A file is
always judged by classifiers fitted on other repositories, so no wrong label is learned by heart.
"""

from __future__ import annotations

import re
import string
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.plans.lineage import cut
from lodegraph.sources.tables import current_rows, current_wide, norm_path

BITS = 18
SAMPLE_FILES = 16_000
HEAD_LINES = 14
EPOCHS = 12
ROUNDS = 3
SHARDS = 8
SHARD_FILES = 1000
FOLDS = 4
PLACES = ("top", "foot", "between")

# comments and strings are scanned together: what opens first holds the other. All begin with one of a few
# characters, to which the search skips; the group holds a comment without that first character
_SPANS = re.compile(
    r"[/#<\"'`](?:(?P<comment>(?<=/)(?:\*[^*]*+(?:\*(?!/)[^*]*+)*+(?:\*/|\Z)|(?<![:\w\"'].)/[^\n]*+)|(?<=#)(?<![\w\"'&].)(?!\[|!)[^\n]*+|(?<=<)!--.*?-->"
    r"|(?<=\")\"\"[^\"]*+(?:\"(?!\"\")[^\"]*+)*+(?:\"\"\"|\Z))"
    r"|(?<=\")[^\"\\\n]*+(?:\\.[^\"\\\n]*+)*+\"|(?<=')[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'|(?<=`)[^`\\]*+(?:\\.[^`\\]*+)*+`)",
    re.S,
)
_WORD = re.compile(r"[^\W\d_]+")
_LOWER_WORD = re.compile(r"[a-z]+")
_VERSION = re.compile(r"v\d+\.\d")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_HEX = re.compile(r"^(?:0x)?[0-9a-f]{6,}$")


def _crc(s: str, bits: int = BITS) -> int:
    return zlib.crc32(s.encode("utf-8", "replace")) & ((1 << bits) - 1)


@lru_cache(1 << 14)
def _mark(m: str, bits: int) -> tuple[int, ...]:
    """A mark has three ids, so that it weighs more than one of many n-grams."""
    return tuple(_crc(x, bits) for x in (m, m + "'", m + "''"))


def _grams(data: np.ndarray, n: int, salt: int, bits: int) -> np.ndarray:
    """Hashed n-grams of bytes in their order, repeated ones too."""
    if len(data) < n:
        return np.zeros(0, np.int32)
    a = data.astype(np.uint64)
    h = np.full(len(a) - n + 1, np.uint64(salt), np.uint64)
    for i in range(n):
        h ^= a[i : len(a) - n + 1 + i]
        h *= np.uint64(0x100000001B3)
    h ^= h >> np.uint64(29)
    h &= np.uint64((1 << bits) - 1)
    return h.astype(np.int32)


def _distinct(a: np.ndarray) -> np.ndarray:
    """Sorted, each once: for a few thousand small numbers several times as quick as ``np.unique``."""
    a = np.sort(a)
    keep = np.ones(len(a), bool)
    np.not_equal(a[1:], a[:-1], out=keep[1:])
    return a[keep]


def _comments(text: str) -> tuple[dict[str, str], str]:
    """The comments by place (top, foot, between), and the text without any comment.

    At the top are comments that begin in the first lines or before any code, at the foot those
    that no code follows.
    """
    end = 0
    for _ in range(HEAD_LINES):
        end = text.find("\n", end) + 1
        if not end:
            end = len(text)
            break
    found, body, last = [], [], 0
    for m in _SPANS.finditer(text):
        if m["comment"] is None:
            continue
        found.append(m)
        body.append(text[last : m.start()])
        last = m.end()
    body.append(text[last:])
    first, foot = 0, len(found)
    while first < len(found) and not body[first].strip():
        first += 1
    while foot and body[foot].strip() in ("", "?>"):
        foot -= 1
    places: dict[str, list[str]] = {p: [] for p in PLACES}
    for i, m in enumerate(found):
        places["top" if m.start() < end or i < first else "foot" if i >= foot else "between"].append(m[0])
    return {p: "\n".join(c) for p, c in places.items()}, "".join(body)


# the first letter stands alone, so that the search skips to it
_UPPER = re.compile(r"[ceinpst](?<=\b.)(?:(?<=c)lass|(?<=i)nterface|(?<=t)(?:rait|ype)|(?<=s)truct|(?<=p)ackage|(?<=n)amespace|(?<=e)num)\s+(?:App\\)?([A-Za-z]\w*)")


def _stem(repo: str) -> str:
    return re.split(r"[\W_]", repo.strip().lower())[0] if repo else ""


def _split(text: str) -> tuple[dict[str, str], str]:
    return _comments(text.replace("\r", "").lstrip("\ufeff"))


def features(path: str, repo: str, comments: dict[str, str], body: str, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids for the body and for the head classifier, the latter as parts that -1 separates: the top, then other places with comments."""
    own = _stem(repo)
    marks: list[str] = []
    steps = path.split("/")
    for s in steps[1:-1]:
        marks.append(f"dir:{s.lower()}")
    marks += [f"dirs:{a}/{b}".lower() for a, b in zip(steps[1:-1], steps[2:-1])]
    parts = steps[-1].split(".")
    marks.append("ext:" + parts[-1].lower())
    marks += [f"suffix:{p.lower()}" for p in parts[1:-1]]
    last = _PART.findall(parts[0])
    if last:
        marks.append(f"end:{last[-1].lower()}")
    firsts = {_PART.findall(n)[0].lower() for n in _UPPER.findall(body) if _PART.search(n)}
    mine = bool(own) and any(n.startswith(own) or (len(n) > 3 and own.startswith(n)) for n in firsts)
    if firsts and own:
        marks.append("named:own" if mine else "named:foreign")
    marks.append("mentions:own" if mine or (own and own in body.lower()) else "mentions:none")
    lines = body.split("\n")
    longest, size = max(map(len, lines)), max(1, len(body))
    marks.append(f"longest:{min(12, int(longest).bit_length())}")
    marks.append(f"mean:{min(10, int(size / max(1, len(lines)))).bit_length()}")
    raw = np.frombuffer(body.encode("utf-8", "replace"), np.uint8)
    count = np.bincount(raw, minlength=256).tolist()
    digits, blanks = sum(count[48:58]) / size, (count[9] + count[10] + count[32]) / size
    if body.isascii():
        letter = _LETTER[raw]
        words = int(letter[:1].sum()) + int(np.count_nonzero(letter[1:] > letter[:-1]))
    else:
        words = len(_WORD.findall(body))
    marks += [f"digits:{int(digits * 12)}", f"blanks:{int(blanks * 12)}", f"words:{int(words / size * 40)}"]
    shape = np.frombuffer(body.translate(_SHAPE).encode("utf-8", "replace"), np.uint8)
    keep = np.ones(len(shape), bool)
    keep[1:] = (shape[1:] != shape[:-1]) | ~_RUNS[shape[1:]]
    ids = _distinct(np.concatenate([np.array([i for m in marks for i in _mark(m, bits)], np.int32), _grams(raw, 4, 17, bits), _grams(shape[keep], 6, 23, bits)])).astype(np.int64)
    parts: list = []
    for place, said in comments.items():
        lower = said.lower()
        words = _LOWER_WORD.findall(lower) if said.isascii() else [*map(str.lower, _WORD.findall(said))]
        if own:
            words = ["own" if w == own else w for w in words]
        tags = {"@" + m.lower() for m in re.findall(r"@[\w-]+", said)} | {m for m in ("/*!", "<auto", "(c)") if m in lower} | ({"v0.0"} if _VERSION.search(lower) else set())
        terms = {t: t.encode("utf-8", "replace") for t in tags.union(words)}
        if terms or place == "top":
            after = {w: b" " + terms[w] for w in words}
            pairs = [*set(zip(words, words[1:]))]
            grams: list[int] = []
            # what is said at the top and at the foot is learned together; between code the same words often mean a part of the file
            for key in ("between",) if place == "between" else ("h", place):
                first = {t: zlib.crc32(b, _KEYS[key]) for t, b in terms.items()}
                grams += [*first.values(), *(zlib.crc32(after[b], first[a]) for a, b in pairs)]
            parts += [[-1], _distinct(np.array(grams or [0], np.int64) & ((1 << bits) - 1))]
    return ids, np.concatenate(parts[1:])


def _parts(ids: np.ndarray) -> list[np.ndarray]:
    """The rows of features that -1 separates."""
    at = np.flatnonzero(ids < 0)
    return np.split(ids[ids >= 0], at - np.arange(len(at)))


_KEYS = {k: zlib.crc32(f"{k}:".encode()) for k in ("h", *PLACES)}  # the checksum of a prefix, to go on from
_LETTER, _RUNS = (np.isin(np.arange(256), [*map(ord, c)]) for c in (string.ascii_letters, "a0 "))  # _RUNS: runs of these in a shape count as one
_SHAPE = {i: ("a" if chr(i).isalpha() or i == 95 else "0" if chr(i).isdigit() else chr(i)) for i in range(128)} | {9: " "} | {i: "a" for i in range(192, 592)}


class Svm:
    """Linear support-vector machine by averaged stochastic subgradients on unit-length rows."""

    def __init__(self, w: np.ndarray | None = None, b: float = 0.0, bits: int = BITS):
        self.w = np.zeros(1 << bits, np.float32) if w is None else w
        self.b = b

    def fit(self, rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, done: int = 0, epochs: int = EPOCHS, lam: float = 2e-5, seed: int = 5) -> Svm:
        """Goes on from the present weights, after ``done`` steps; the result is the mean over the last half of the epochs."""
        rng = np.random.default_rng([seed, done])
        w, b = self.w.astype(np.float64), float(self.b)
        total, tb, n, scale, t = np.zeros(len(w), np.float64), 0.0, 0, 1.0, done
        norm = [1 / max(1.0, len(r)) ** 0.5 for r in rows]
        for epoch in range(epochs):
            for i in rng.permutation(len(rows)):
                t += 1
                eta = 1 / (lam * (t + 5e4))
                r, s = rows[i], norm[i]
                m = (w[r].sum() * scale * s + b) * y[i]
                scale *= 1 - eta * lam
                if m < 1:
                    w[r] += eta * weight[i] * y[i] * s / scale
                    b += 0.02 * eta * weight[i] * y[i]
            if epoch >= epochs // 2:
                total += w * scale
                tb += b
                n += 1
        self.w, self.b = (total / max(1, n)).astype(np.float32), tb / max(1, n)
        return self

    def margin(self, ids: np.ndarray) -> float:
        return float(self.w[ids].sum() / max(1.0, len(ids)) ** 0.5 + self.b)


def _threshold(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """Cut with the best weighted F1 on repositories that took no part in fitting."""
    if not len(margin) or not (y > 0).any() or not (y < 0).any():
        return 0.0
    order = np.argsort(-margin)
    tp = np.cumsum((weight * (y > 0))[order])
    fp = np.cumsum((weight * (y < 0))[order])
    f1 = 2 * tp / (tp + fp + (weight * (y > 0)).sum())
    i = int(f1.argmax())
    nxt = margin[order[i + 1]] if i + 1 < len(order) else margin[order[i]] - 1e-3
    return float((margin[order[i]] + nxt) / 2)


def _extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        if not len(f):
            continue
        got = [features(p, r or "", *_split(t or "")) for p, r, t in zip(f["path"], f["repo"], f["content"])]
        yield f.drop(columns=["content"]).assign(body=[g[0].astype(np.int32).tobytes() for g in got], head=[g[1].astype(np.int32).tobytes() for g in got])


def fold_of(repo: str | None) -> int:
    return zlib.crc32((repo or "").encode()) % FOLDS


def _target(f: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Label, weight and fold of the sampled files."""
    lead = (f["yes"] - f["no"]).to_numpy(np.float64)
    return np.where(lead > 0, 1.0, -1.0), np.minimum(3.0, np.abs(lead)) / 3, np.array([fold_of(r) for r in f["repo"]], np.int64)


def _fit_shard(state, whole: set[int], epochs: int, round_: int):
    """One round of all models over one shard of the sample: weights, and the number of files behind them."""

    def fit(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("path")
        y, weight, fold = _target(f)
        out = []
        for col in ("body", "head"):
            rows = [_parts(np.frombuffer(r, np.int32)) for r in f[col]]
            flat = [p for r in rows for p in r]
            of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
            for k in range(FOLDS):
                use = np.ones(len(of), bool) if k in whole else (fold != k)[of]
                w, b = state.value[col, k]
                m = Svm(w.copy(), b).fit([p for p, u in zip(flat, use) if u], y[of][use], weight[of][use], round_ * epochs * int(use.sum()), epochs)
                out.append((col, k, m.w.astype(np.float16).tobytes(), m.b, int(use.sum())))
        return pd.DataFrame(out, columns=["col", "fold", "w", "b", "n"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [f for f in frames if len(f)]
        if held:  # the shards of a partition, of SHARD_FILES files or an eighth of the sample each
            for _, f in pd.concat(held, ignore_index=True).groupby("shard"):
                yield fit(f)

    return run


def _held_out(state):
    """Margins of the sampled files by the models of their own fold."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models = {k: Svm(*v) for k, v in state.value.items()}
        for f in frames:
            if len(f):
                y, weight, fold = _target(f)
                yield pd.DataFrame({"path": f["path"], "y": y, "weight": weight} | {c: [max(map(models[c, k].margin, _parts(np.frombuffer(r, np.int32)))) for r, k in zip(f[c], fold)] for c in ("body", "head")})

    return run


def train(sample: DataFrame) -> list[tuple[Svm, Svm, float, float]] | None:
    """Per fold of repositories, body and head classifiers fitted on the other folds, and the cuts.

    The sample stays in shards on the executors. In each round every shard goes on from the
    common weights with its own files, and the weights are averaged (iterative parameter
    mixing); only these, two vectors a fold and shard, come to the driver. The cuts come from
    the margins of files whose repository took no part in fitting, over all folds together; as
    the sample has the labels at their natural ratio, they hold for all files. With a single
    fold there is nothing to hold out, and all files fit all models. None without both labels.
    """
    sc = sample.sparkSession.sparkContext
    sides = pd.DataFrame([(fold_of(r["repo"]), r["yes"], r["n"]) for r in sample.groupBy("repo", (F.col("yes") > F.col("no")).alias("yes")).agg(F.count(F.lit(1)).alias("n")).collect()], columns=["fold", "yes", "n"])  # two rows a repository of the bounded sample
    if sides["yes"].nunique() < 2:
        return None
    whole = {k for k in range(FOLDS) if sides[sides["fold"] != k]["yes"].nunique() < 2}
    shards = max(1, min(SHARDS, int(sides["n"].sum()) // SHARD_FILES))
    placed = cut(sample.withColumn("shard", F.pmod(F.xxhash64(F.lit(3), "path"), F.lit(shards))).repartition(shards, "shard"))
    state = {(c, k): (np.zeros(1 << BITS, np.float32), 0.0) for c in ("body", "head") for k in range(FOLDS)}
    for r in range(ROUNDS):
        sent = sc.broadcast(state)
        got = placed.mapInPandas(_fit_shard(sent, whole, EPOCHS // ROUNDS, r), "col string, fold int, w binary, b double, n long").toPandas()
        for key, g in got[got["n"] > 0].sort_values(["n", "b"]).groupby(["col", "fold"]):
            n = g["n"].to_numpy(np.float64) / g["n"].sum()
            state[key] = (sum(np.frombuffer(w, np.float16) * np.float32(x) for w, x in zip(g["w"], n)), float((g["b"] * n).sum()))
        del got
        sent.destroy()
    held = placed.mapInPandas(_held_out(sc.broadcast(state)), "path string, y double, weight double, body double, head double").toPandas().sort_values("path")  # four numbers a sampled file
    cuts = {c: _threshold(held[c].to_numpy(), held["y"].to_numpy(), held["weight"].to_numpy()) for c in ("body", "head")}
    return [(Svm(*state["body", k]), Svm(*state["head", k]), cuts["body"], cuts["head"]) for k in range(FOLDS)]


def _judge(model):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for p, r, t in zip(f["path"], f["repo"], f["content"]):
                said, code = _split(t or "")
                if not _WORD.search(_comments(t)[1] if t and "\r" in t else code):
                    rows.append((p, -1.0, -1.0))  # nothing but comments, if anything
                    continue
                mb, mh, cb, ch = model.value[fold_of(r)]
                b, h = features(p, r or "", said, code)
                rows.append((p, mb.margin(b) - cb, max(map(mh.margin, _parts(h))) - ch))
            if rows:
                yield pd.DataFrame(rows, columns=["path", "body", "head"])

    return run


def file_labels(symbols: DataFrame) -> DataFrame:
    """(path, yes, no): current symbols of each file marked as generated and as not."""
    cur = current_rows(symbols.select("id", "seq", "file", "generated"), "id", ["file", "generated"])
    return cur.where("generated is not null").groupBy(norm_path("file").alias("path")).agg(F.count_if("generated").alias("yes"), F.count_if(~F.col("generated")).alias("no"))


def judged(source_files: DataFrame, symbols: DataFrame, sample_files: int = SAMPLE_FILES) -> DataFrame:
    """(path, repo-independent margins ``body`` and ``head``): above 0 speaks against hand-written source.

    The current content of every file is judged. At most ``sample_files`` labelled files, those
    of smallest hash of their path whatever their label, are used to fit. Null or blank contents
    are hand-written; null paths are left out; without labels of both kinds no file stands out.
    """
    cur = current_wide(source_files, "path", ["repo", "content"])
    known = file_labels(symbols).where("yes <> no").join(source_files.select("path"), "path", "left_semi")
    picks = F.broadcast(cut(known.orderBy(F.xxhash64("path"), "path").limit(sample_files)))  # at most sample_files short rows
    sample = cur.join(picks, "path").where("content <> ''").select("path", "repo", "content", "yes", "no").mapInPandas(_extract, "path string, repo string, yes long, no long, body binary, head binary")
    fitted = train(cut(sample))
    if fitted is None:
        return cur.select("path", F.lit(-1.0).alias("body"), F.lit(-1.0).alias("head"))
    model = source_files.sparkSession.sparkContext.broadcast(fitted)
    return cur.select("path", "repo", "content").mapInPandas(_judge(model), "path string, body double, head double")


def not_by_hand(source_files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file) of every file whose body or head classifier speaks against hand-written source."""
    return judged(source_files, symbols).where("body > 0 or head > 0").select(F.col("path").alias("file"))
