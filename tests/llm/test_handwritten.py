import random
import re
import zlib
from types import SimpleNamespace

import pandas as pd

from lodegraph.llm import handwritten as H

FILE, SYM = "path string, repo string, content string, seq long, yes long", "id string, seq long, file string, generated boolean"
NOUN = "ledger token route queue parcel gauge".split()


def hand(r, own):
    body = "".join(f"\n  // waits for the {r.choice(NOUN)} before it goes on\n  async {r.choice(NOUN)}{r.randrange(99)}(a: string) {{\n    if (a === undefined) {{\n      throw new Error('{r.choice(NOUN)} missing');\n    }}\n    return this.{r.choice(NOUN)}.push(a);\n  }}\n" for _ in range(4))
    return f"import {{ X }} from './x.js';\n\nexport class {own.title()}Keeper{r.randrange(99)} {{{body}}}\n"


def machine(r, own):
    head = r.choice(["// Code generated by toolx. DO NOT EDIT.\n", ""])
    return head + f"export class {own.title()}Fields {{\n" + "".join(f"  _op{i}() {{ return this.raw[{r.randrange(999)}]; }}\n" for i in range(25)) + "}\n"


def data(r, own):
    return f"export const T{own} = [\n" + "".join("  " + ", ".join(hex(r.randrange(256)) for _ in range(12)) + ",\n" for _ in range(25)) + "];\n"


def world(seed=1, repos=8, n=40, every=4):
    r = random.Random(seed)
    files, symbols, want = [], [], set()
    for k in range(repos):
        own = "".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(3))
        for i in range(n):
            made = i % every == 0
            path = f"{own}-core/src/{'gen' if made and i % 8 else 'core'}/f{i}.ts"
            files.append((path, f"{own}-core", (r.choice([machine, data]) if made else hand)(r, own), 1, 7))
            want |= {path} if made else set()
            for j in range(3):
                symbols.append((f"{k}-{i}-{j}", 1, "./" + path, None if r.random() < 0.4 else made != (r.random() < 0.08)))
    return files, symbols, want


def test_held_out_accuracy(spark):
    files, symbols, want = world()
    got = {x.file for x in H.not_by_hand(spark.createDataFrame(files, FILE), spark.createDataFrame(symbols, SYM)).collect()}
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.05 * len(want)


def test_bounded_sample_keeps_the_ratio_of_labels(spark):
    """One file of ten is no hand's work and the sample is smaller than the world: the cut must not drift."""
    files, symbols, want = world(seed=3, repos=10, n=100, every=10)
    got = {x.path for x in H.judged(spark.createDataFrame(files, FILE), spark.createDataFrame(symbols, SYM), sample_files=400).where("body > 0 or head > 0").collect()}
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.05 * len(want)


def test_dirty_rows(spark):
    files, symbols, _ = world(repos=3, n=16)
    odd = [("q/a.ts", None, None, 1, 1), ("q/b.ts", None, "", 1, 1), ("q/c.ts", "q", "// nothing yet\n", 1, 1), (None, "q", "x", 1, 1), ("q/d", "q", "x" * 2_000_000, 1, 1), ("q/e.ts", "q", "old", 1, 1), ("q/e.ts", "q", "", 2, 1)]
    got = {x.path: (x.body, x.head) for x in H.judged(spark.createDataFrame(files + odd, FILE), spark.createDataFrame(symbols + [(None, 1, None, True), ("z", 1, None, True)], SYM)).collect()}
    assert all(got[p] == (-1.0, -1.0) for p in ("q/a.ts", "q/b.ts", "q/c.ts", "q/e.ts")) and None not in got and "q/d" in got


def test_without_labels_or_files(spark):
    files, symbols, _ = world(repos=2, n=8)
    f, s = spark.createDataFrame(files, FILE), spark.createDataFrame(symbols, SYM)
    assert H.not_by_hand(f, s.where("false")).count() == 0
    assert H.not_by_hand(f, s.where("generated")).count() == 0
    assert H.not_by_hand(f.where("false"), s).count() == 0


def test_marker_far_below_the_top(spark):
    """Bodies as by hand: only a comment after all code tells, with others between."""
    r = random.Random(4)
    files, symbols, want = [], [], set()
    for k in range(8):
        own = "".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(3))
        for i in range(40):
            path, text = f"{own}-core/src/f{r.randrange(10**6)}.ts", hand(r, own)
            if i % 4 == 0:
                mark = f"// Code generated by toolx v{r.randrange(9)}. DO NOT EDIT.\n"
                text = text + mark if i % 8 else mark + text
                want.add(path)
            files.append((path, f"{own}-core", text, 1, 7))
            symbols.append((f"{k}-{i}", 1, path, i % 4 == 0))
    assert all(f[2].count("\n") > H.HEAD_LINES + 2 for f in files)
    got = {x.path for x in H.judged(spark.createDataFrame(files, FILE), spark.createDataFrame(symbols, SYM)).where("head > 0").collect()}
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.05 * len(want)


def test_comment_marks_in_late_strings():
    code = "".join(f"const a{i} = {i};\n" for i in range(60)) + "const glob = 'src/*.ts', open = \"/* not a comment\", url = ` // nor this # one`;\nfunction last() {}\n"
    said, body = H._comments(code + "// it's the end\n")
    assert body == code + "\n" and said == {"top": "", "foot": "// it's the end", "between": ""}


ODD = ['"', "'", "`", "/*", "*/", "//", "#", "<!--", "-->", '"""', "\n", "\\", "\t", " ", "aB", "9", "_", "é", "世", "²", "\ud800", "*", "!", "[", "&", ":", "class Foo", "type", "@x", "(c)", "v1.2", "own"]
PLAIN_SPANS = re.compile(
    r"(?P<comment>/\*.*?(?:\*/|\Z)|(?<![:\w\"'])//[^\n]*|(?<![\w\"'&])#(?!\[|!)[^\n]*|<!--.*?-->|\"\"\".*?(?:\"\"\"|\Z))"
    r"|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`",
    re.S,
)


def odd_texts(n, seed=2):
    r = random.Random(seed)
    return ["".join(r.choices(ODD, k=r.randrange(80))) for _ in range(n)]


def test_one_scan_of_each_file(monkeypatch):
    """A file is scanned for comments once when it is judged; the scan was made twice."""
    scanned, scan = [], H._comments
    monkeypatch.setattr(H, "_comments", lambda t: scanned.append(t) or scan(t))
    r = random.Random(1)
    texts = [hand(r, "own"), machine(r, "own"), "// nothing yet\n", "x"]
    frame = pd.DataFrame({"path": list("abcd"), "repo": "own-core", "content": texts})
    got = pd.concat(H._judge(SimpleNamespace(value=[(H.Svm(), H.Svm(), 0.5, 0.5)] * H.FOLDS))(iter([frame])))
    assert scanned == texts and got["body"].tolist() == [-0.5, -0.5, -1.0, -0.5]


def test_scan_as_by_the_plain_pattern():
    for t in odd_texts(3000):
        assert [(m[0], m["comment"] is None) for m in H._SPANS.finditer(t)] == [(m[0], m["comment"] is None) for m in PLAIN_SPANS.finditer(t)]


def test_features_as_by_their_definition():
    def grams(data, n, salt):
        out = set()
        for i in range(len(data) - n + 1):
            h = salt
            for b in data[i : i + n]:
                h = (h ^ b) * 0x100000001B3 % 2**64
            out.add((h ^ h >> 29) % 2**H.BITS)
        return out

    def head(place, said):
        words = ["own" if w == "own" else w.lower() for w in H._WORD.findall(said)]
        terms = {*words} | {f"{a} {b}" for a, b in zip(words, words[1:])} | {"@" + m.lower() for m in re.findall(r"@[\w-]+", said)}
        terms |= {m for m in ("/*!", "<auto", "(c)", "v0.0") if m in re.sub(r"\d+", "0", said.lower())}
        keys = ("between",) if place == "between" else ("h", place)
        return {zlib.crc32(f"{k}:{t}".encode("utf-8", "replace")) % 2**H.BITS for k in keys for t in terms}

    for t in odd_texts(300) + [hand(random.Random(1), "own"), "", "x"]:
        said, body = H._split(t)
        ids, heads = H.features("own-core/src/a.b.ts", "own-core", said, body)
        shape = re.sub(r"[ \t]+", " ", re.sub("0+", "0", re.sub("a+", "a", "".join("a" if c.isascii() and c.isalpha() or c == "_" or 192 <= ord(c) < 592 else "0" if c.isascii() and c.isdigit() else c for c in body))))
        marks = [m for m in ("dir:src", "ext:ts", "suffix:b", "end:a", f"longest:{min(12, max(map(len, body.split(chr(10)))).bit_length())}")]
        marks += [f"{n}:{int(sum(map(f, body)) / max(1, len(body)) * 12)}" for n, f in (("digits", "0123456789".__contains__), ("blanks", " \t\n".__contains__))] + [f"words:{int(len(H._WORD.findall(body)) / max(1, len(body)) * 40)}"]
        want = grams(body.encode("utf-8", "replace"), 4, 17) | grams(shape.encode("utf-8", "replace"), 6, 23) | {zlib.crc32((m + q).encode()) % 2**H.BITS for m in marks for q in ("", "'", "''")}
        assert want <= {*ids.tolist()} and len({*ids.tolist()} - want) <= 9 and ids.tolist() == sorted({*ids.tolist()})
        told = [head(p, said[p]) for p in H.PLACES]
        assert [p.tolist() for p in H._parts(heads)] == [sorted(told[0] or {0})] + [sorted(x) for x in told[1:] if x]
