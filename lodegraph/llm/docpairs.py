"""Functions paired with their documentation.

Comment spans and function spans are extracted independently of each other; an as-of interval
join then gives every function the nearest comment that ends before it (or, for doc strings,
the first one inside it), and rejects it if a statement lies between. What remains is judged:
marks, tags, placeholders, directives, decoration, code and words that the signature already
says are taken away, and only comments that still say something make a pair.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.sources.tables import current_rows, current_wide, norm_id

NOVEL_WORDS = 3

# Words that add nothing to a signature, placeholders, section heads and directives
_EMPTY = set("a an the this that these it its of to in on for from by with and or as at is are be was were has have will do does into onto method function constructor getter setter accessor member procedure class object instance value values param params parameter parameters arg args argument arguments return returns returned returning result results take takes taking give gives given get gets set sets call calls called implement implements implementation string str int integer number float double bool boolean void none null undefined array list map dict any type types der die das den dem ein eine einen und oder von zu mit für auf im ist wird gibt zurück methode funktion el la los las un una de del y o en con para por se es devuelve método función".split())
_PLACEHOLDER = re.compile(r"^\W*(?:todo|fixme|xxx|tbd|tba|hack|wip|n\s*/?\s*a|none|null|see\s+(?:above|below)|siehe\s+(?:oben|unten)|v[ée]ase\s+(?:arriba|abajo)|self[\s-]*explanatory|selbsterklärend|(?:auto[\s-]*)?generated(?:\s+(?:method|function|constructor))?\s*(?:stub)?|auto[\s-]*generated\s+method\s+stub|no\s+(?:description|documentation|comment)|description|documentation|comment|placeholder|stub|foo|bar|test|blah|asdf|lorem\s+ipsum.*|(?:words?\W+|filler\W+){2,}|document\s+(?:this|me)|describe(?:\s+(?:this|me))?|missing\s+(?:doc\w*|comment))\W*$", re.I)
_TODO = re.compile(r"^\W*(?:TODO|FIXME|XXX|HACK|TBD|WIP|NOTE\s+TO\s+SELF)\b(?:\s*\([^)]*\))?\s*:?.*$")
_DIRECTIVE = re.compile(r"^\W*(?:eslint|tslint|jshint|jslint|prettier|stylelint|istanbul|c8|v8|phpcs|phpstan|psalm|phan|nolint|noinspection|noqa|pylint|flake8|mypy|pyright|type:\s*ignore|ts-(?:ignore|nocheck|expect-error|check)|biome|deno-lint|go:\w+|\+build|region|endregion|#region|#endregion|sourceMappingURL|coding[:=]|vim:|-\*-|@(?:codeCoverageIgnore|psalm|phpstan|ts-)|use strict)\b[^.!?]*$", re.I)
_HEAD = re.compile(r"^\W*(?:args?|arguments?|param(?:eter)?s?|returns?|yields?|raises?|throws?|examples?|usage|notes?|attributes?|inputs?|outputs?|parameter|rückgabe|parámetros)\s*:?\s*$", re.I)
_TAG = re.compile(r"^[@\\](\w[\w-]*)\s*(.*)$", re.S)
_INLINE = re.compile(r"\{@\s*(\w+)\s*([^}]*)\}")
_SILENT = {"since", "version", "author", "internal", "private", "public", "protected", "inheritdoc", "override", "see", "link", "ignore", "hidden", "readonly", "static", "abstract", "final", "async", "access", "package", "category", "group", "template", "memberof", "module", "namespace", "copyright", "license", "date", "todo", "fixme", "beta", "alpha", "api", "type", "typedef", "example", "test", "covers", "var", "global", "class", "function", "method", "constructor", "event", "fires", "listens", "name", "kind", "lends", "mixin", "requires", "exports", "file", "filesource", "subpackage", "uses", "usedby", "suppress", "suppresswarnings", "nullable"}
_NAMED = {"param", "arg", "argument", "property", "prop", "throws", "throw", "exception", "raises"}
_TYPE = re.compile(r"^(?:\{[^}]*\}|\\?[A-Za-z_][\w\\]*(?:\[\]|<[^>]*>)?(?:\|[\w\\\[\]<>]+)*(?=\s+\$|\s*$))\s*")
_FIELD = re.compile(r"^[-*•]?\s*`?\$?[A-Za-z_]\w*`?\s*(?:\([^)]*\))?\s*[:=–-]\s*`?[\w\[\]<>|.,\\ ]{0,40}`?$")
_REST_FIELD = re.compile(r"^:(?:param|type|returns?|rtype|raises?|arg)\b[^:]*:\s*")
_CODE = re.compile(r"(?:;\s*$|^\s*(?:return|const|let|var|if|for|foreach|while|switch|import|from|func|def|fn|echo|print|throw|await|else|try|catch)\b[^.!?]*[(){};=:\[\]$]|^\s*[\w$.\->]+\s*(?:=|:=|\+=|=>)\s*\S|^\s*[\w$.\->]+\([^)]*\)\s*;?\s*$|^\s*[{}()\[\];]+\s*$|^\s*(?:>>>|\.\.\.|\$)\s+\w|</?\w+[^>]*>\s*$)")
_MARK = re.compile(r"^\s*(?:/\*+!?|\*+/|\*(?!\*)|///?!?|\"\"\"|'''|#(?=\s|$|!)|<!--|--(?=\s))?\s?|\s*(?:\*+/|\"\"\"|'''|-->)\s*$")
_WORDS = re.compile(r"[^\W\d_]+")
_HUMPS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[^\W\d_A-Z]+|[A-Z]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def _strip(text: str) -> list[str]:
    """Lines of a comment without its marks; a ``#`` that starts a phrase in stripped text stays a word."""
    text = text.replace("\r\n", "\n").replace("\r", "\n").replace("﻿", "")
    return [_MARK.sub("", _MARK.sub("", line)).strip() for line in text.split("\n")]


def _stem(w: str) -> str:
    for end in ("ies", "ing", "ed", "es", "s", "e", "y"):
        if w.endswith(end) and len(w) - len(end) >= 3:
            return w[: -len(end)]
    return w


def _known(signature: str, name: str) -> set[str]:
    parts = [p.lower() for i in re.findall(r"[^\W\d]\w*", f"{name} {signature}") for p in _HUMPS.findall(i)]
    return {_stem(p) for p in parts}


def _novel(words: list[str], known: set[str]) -> int:
    n = 0
    seen = set()
    for w in words:
        w = w.lower()
        if w in _EMPTY or w in seen:
            continue
        seen.add(w)
        if ord(w[0]) >= 0x2E80:  # scripts without blanks: two characters make a word
            n += len(w) // 2
        elif len(w) > 1:
            s = _stem(w)
            if s not in known and _stem(s) not in known:
                n += 1
    return n


def description(comment: str, signature: str, name: str = "") -> str | None:
    """The prose of a comment that its signature does not already say, or None."""
    kept: list[str] = []
    fence = False
    for line in _strip(comment):
        if line.startswith(("```", "~~~")):
            fence = not fence
            continue
        if fence:
            continue
        line = _INLINE.sub(lambda m: "" if m[1].lower() in _SILENT else m[2], line).strip()
        line = _REST_FIELD.sub("", line)
        tag = _TAG.match(line)
        if tag:
            what, rest = tag[1].lower(), tag[2]
            if what in _SILENT or what.startswith(("phpstan", "psalm", "ts-", "eslint")):
                kept.append("")
                continue
            rest = _TYPE.sub("", rest, count=1)
            if what in _NAMED:
                rest = re.sub(r"^\[?\$?[\w.]+(?:=[^\]]*)?\]?\s*", "", rest, count=1)
            line = rest.lstrip("-–: ")
            kept.append("")
        if not line or not _WORDS.search(line) or _HEAD.match(line) or _TODO.match(line) or _DIRECTIVE.match(line) or _FIELD.match(line) or _CODE.search(line):
            kept.append("")
            continue
        kept.append(line)
    text = re.sub(r"\n{2,}", "\n\n", "\n".join(kept)).strip()
    if not text:
        return None
    flat = re.sub(r"\s+", " ", re.sub(r"`[^`]*[(){};=][^`]*`|<[^>]+>|https?://\S+", " ", text)).strip()
    known = _known(signature, name)
    for s in _SENTENCE.split(flat):
        if not _PLACEHOLDER.match(s) and _novel(_WORDS.findall(s), known) >= NOVEL_WORDS:
            return re.sub(r"[ \t]*\n[ \t]*", "\n", text)
    return None


def attach(f_start: np.ndarray, c_end: np.ndarray, statements: np.ndarray) -> np.ndarray:
    """As-of interval join: index of the nearest comment ending before each function, or -1.

    ``c_end`` and ``statements`` (positions of code that is neither) are sorted. A comment is
    not eligible if a statement lies between its end and the function, or if another function
    already starts there.
    """
    at = np.searchsorted(c_end, f_start, "left") - 1
    ok = at >= 0
    end = np.where(ok, c_end[at] if len(c_end) else 0, 0)
    between = np.searchsorted(statements, f_start, "left") - np.searchsorted(statements, end, "right")
    return np.where(ok & (between == 0), at, -1)


def _pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        # a line axis for the batch: the comment lines of a symbol, then its signature, which is also a statement to all that follows
        comments = f["doc_comment"].tolist()
        height = np.array([0 if c is None else c.count("\n") + 1 for c in comments], np.int64)
        f_at = np.cumsum(height + 1)
        has = height > 0
        c_end = (f_at - 1)[has]
        rows = np.flatnonzero(has)
        got = attach(f_at, c_end, f_at)
        out_id, out_sig, out_desc = [], [], []
        for i, c in enumerate(got):
            if c < 0:
                continue
            desc = description(comments[rows[c]], f["signature"].iat[i], f["name"].iat[i] or "")
            if desc:
                out_id.append(f["id"].iat[i])
                out_sig.append(f["signature"].iat[i].strip())
                out_desc.append(desc)
        if out_id:
            yield pd.DataFrame({"symbol_id": out_id, "signature": out_sig, "description": out_desc})


def documented(symbols: DataFrame) -> DataFrame:
    """(symbol_id, signature, description) of current functions and methods whose comment says something.

    Of several rows of an id the one of highest ``seq`` holds. Null or blank signatures, null or
    empty comments and other kinds make no pair; null ids are left out.
    """
    own = symbols.select("id", norm_id("id").alias("key"), "seq", "kind", "name", "signature", "doc_comment")
    cur = current_rows(own, "key", ["id", "kind", "name", "signature", "doc_comment"])
    fit = cur.where(F.col("kind").isin("function", "method") & F.col("signature").rlike(r"\S") & F.col("doc_comment").isNotNull())
    return fit.select("id", "name", "signature", "doc_comment").mapInPandas(_pairs, "symbol_id string, signature string, description string")


# -- whole source files ------------------------------------------------------------------------

_SLASH = r"(?P<c>/\*.*?(?:\*/|\Z)|//[^\n]*(?:\n[ \t]*//[^\n]*)*)|(?P<s>\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`)"
_SPANS = {
    "c": re.compile(_SLASH, re.S),
    "php": re.compile(_SLASH.replace(r"//[^\n]*(?:\n", r"(?://|#(?!\[))[^\n]*(?:\n"), re.S),
    "py": re.compile(r"(?P<c>#[^\n]*(?:\n[ \t]*#[^\n]*)*)|(?P<s>(?:[rRuUbB]{0,2})(?:\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'))", re.S),
}
_FUNCS = {
    "go": re.compile(r"^func\s+(?:\([^)]*\)\s*)?(?P<n>\w+)\s*(?:\[[^\]]*\])?\([^{\n]*", re.M),
    "py": re.compile(r"^[ \t]*(?:async[ \t]+)?def[ \t]+(?P<n>\w+)[ \t]*\([^:]*?\)[^:\n]*:", re.M | re.S),
    "php": re.compile(r"^[ \t]*(?:(?:public|protected|private|static|final|abstract)\s+)*function\s+&?(?P<n>\w+)\s*\([^{;]*", re.M),
    "c": re.compile(r"^[ \t]*(?:(?:export|default|public|private|protected|static|async|override|abstract|readonly)\s+)*(?:function\s*\*?\s*(?P<n>\w+)\s*(?:<[^>\n]*>)?\s*\([^{;]*|(?!(?:if|for|while|switch|catch|return|function|with|new|await|typeof|else|do|super)\b)(?P<m>[\w$#]+)\s*(?:<[^>\n]*>)?\s*\([^(){};=\n]*(?:\([^()]*\)[^(){};=\n]*)*\)\s*(?::[^{;=\n]+)?(?=\{))", re.M),
}
_EXTENSION = {"py": "py", "go": "go", "php": "php", "ts": "c", "js": "c", "mjs": "c", "tsx": "c", "jsx": "c"}


def file_pairs(text: str, ext: str) -> list[tuple[int, str, str, str]]:
    """(line, name, signature, description) of the documented functions of a source file."""
    kind = _EXTENSION.get(ext.lower())
    if kind is None or not text:
        return []
    text = text.replace("\r\n", "\n").lstrip("﻿")
    spans = _SPANS["py" if kind == "py" else "php" if kind == "php" else "c"]
    marks = [(m.start(), m.end(), m.lastgroup, m[0]) for m in spans.finditer(text)]
    blank = list(text)
    for s, e, _, t in marks:
        blank[s:e] = ["\n" if ch == "\n" else " " for ch in t]
    code = "".join(blank)
    funcs = [(m.start() + len(m[0]) - len(m[0].lstrip()), m.end(), m["n"] or m.groupdict().get("m"), " ".join(text[m.start() : m.end()].split()).rstrip(":{ ")) for m in _FUNCS[kind].finditer(code)]
    line_of = np.cumsum(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 10) + 1 if text else np.zeros(0, int)
    # decorators and attributes are no statements; every other line of code is one where it starts
    starts = np.array([m.start(1) for m in re.finditer(r"^[ \t]*(?!@|#\[)([^\s])", code, re.M)], np.int64)
    comments = [(s, e, t) for s, e, g, t in marks if g == "c"]
    f_start = np.array([f[0] for f in funcs], np.int64)
    got = attach(f_start, np.array([c[1] for c in comments], np.int64), starts)
    out = []
    for i, (at, end, name, sig) in enumerate(funcs):
        comment = comments[got[i]][2] if got[i] >= 0 else None
        if kind == "py":
            inside = next((t for s, e, g, t in marks if g == "s" and s >= end), None)
            pos = next((s for s, e, g, t in marks if g == "s" and s >= end), -1)
            if inside is not None and not code[end:pos].strip():
                comment = re.sub(r"^[rRuUbB]{0,2}('''|\"\"\"|'|\")|('''|\"\"\"|'|\")$", "", inside)
        desc = description(comment, sig, name) if comment else None
        if desc:
            out.append((int(line_of[at]), name, sig, desc))
    return out


def _file_pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = [(p, *x) for p, t in zip(f["path"], f["content"]) for x in file_pairs(t or "", p.rsplit(".", 1)[-1])]
        if rows:
            yield pd.DataFrame(rows, columns=["file", "line", "name", "signature", "description"]).astype({"line": "int32"})


def documented_in_files(source_files: DataFrame) -> DataFrame:
    """(file, line, name, signature, description) from the current content of every source file.

    Null and empty contents, unknown extensions and undocumented functions give no rows.
    """
    cur = current_wide(source_files, "path", ["content"])
    return cur.select("path", "content").where("content <> ''").mapInPandas(_file_pairs, "file string, line int, name string, signature string, description string")
