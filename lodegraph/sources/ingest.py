"""Sources: file scans, source parsing, coverage, diffs, commit logs, Markdown front matter, API specifications."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.functions.exprs import any_glob, title_case

# Default scan globs
INCLUDE = ["**/*.ts", "**/*.tsx", "**/*.js", "**/*.php", "**/*.py", "**/*.go"]
EXCLUDE = ["**/node_modules/**", "**/vendor/**", "**/dist/**", "**/.git/**"]
SYMBOLS = "id string, name string, kind string, file string, start_line int, end_line int, parent string, exported boolean, language string, doc_comment string, signature string, seq long"


def scan(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None, max_size: int | None = None) -> DataFrame:
    """(path, content, hash) of the files under a folder, paths relative to it; larger files than ``max_size`` are left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    if max_size is not None:
        raw = raw.where(F.col("length") <= max_size)
    base = re.escape(root.rstrip("/"))
    rel = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*(?=/)", ""), f"^{base}/", "")
    out = raw.select(rel.alias("path"), F.decode("content", "UTF-8").alias("content"), F.sha2("content", 256).alias("hash"))
    return out.where(any_glob("path", include or INCLUDE) & ~any_glob("path", exclude if exclude is not None else EXCLUDE))


_LINE_RULES = {
    "ts": [("class", r"(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)"), ("interface", r"(?:export\s+)?interface\s+(\w+)"), ("enum", r"(?:export\s+)?enum\s+(\w+)"), ("type", r"(?:export\s+)?type\s+(\w+)\s*[=<]"), ("function", r"(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s+(\w+)"), ("function", r"(?:export\s+)?const\s+(\w+)\s*=\s*(?:async\s*)?\([^)]*\)\s*(?::[^=]+)?=>"), ("method", r"\s+(?:(?:public|private|protected|static|async|override|readonly)\s+)*(?!if\b|for\b|while\b|switch\b|catch\b|return\b)(\w+)\s*\([^)]*\)\s*(?::[^{]+)?\{")],
    "php": [("class", r"\s*(?:final\s+|abstract\s+|readonly\s+)*class\s+(\w+)"), ("interface", r"\s*interface\s+(\w+)"), ("trait", r"\s*trait\s+(\w+)"), ("method", r"\s+(?:(?:public|private|protected|static|final|abstract)\s+)+function\s+&?(\w+)"), ("function", r"function\s+&?(\w+)")],
    "go": [("method", r"func\s+\([^)]*\)\s*(\w+)"), ("function", r"func\s+(\w+)"), ("interface", r"type\s+(\w+)\s+interface"), ("class", r"type\s+(\w+)\s+struct")],
}
_LINE_RULES["js"] = _LINE_RULES["tsx"] = _LINE_RULES["mjs"] = _LINE_RULES["ts"]


def _symbol_id(file: str, name: str, kind: str) -> str:
    import hashlib

    return hashlib.sha256(f"{file}::{name}::{kind}".encode()).hexdigest()[:16]


def parse_python(path: str, text: str) -> list[tuple]:
    """Symbols of a Python file from its syntax tree; an invalid file has none."""
    try:
        tree = ast.parse(text.lstrip("﻿"))
    except (SyntaxError, ValueError):
        return []
    out: list[tuple] = []

    def walk(node: ast.AST, parent: str | None, in_class: bool) -> None:
        for n in ast.iter_child_nodes(node):
            if isinstance(n, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                kind = "class" if isinstance(n, ast.ClassDef) else "constructor" if in_class and n.name == "__init__" else "method" if in_class else "function"
                sig = None if kind == "class" else f"{n.name}({ast.unparse(n.args)})" + (f": {ast.unparse(n.returns)}" if n.returns else "")
                sid = _symbol_id(path, n.name, kind)
                out.append((sid, n.name, kind, path, n.lineno, n.end_lineno, parent, not n.name.startswith("_"), "python", ast.get_docstring(n), sig))
                walk(n, sid, kind == "class")
            else:
                walk(n, parent, in_class)

    walk(tree, None, False)
    return out


def parse_lines(path: str, text: str) -> list[tuple]:
    """Symbols of a brace language by line patterns and brace depth: approximate by design."""
    ext = path.rsplit(".", 1)[-1].lower()
    rules = [(k, re.compile(p)) for k, p in _LINE_RULES.get(ext, [])]
    lang = {"ts": "typescript", "tsx": "typescript", "js": "javascript", "mjs": "javascript"}.get(ext, ext)
    lines = text.replace("\r\n", "\n").split("\n")
    out: list[tuple] = []
    stack: list[tuple[str, int, int]] = []
    depth, doc = 0, []
    for no, line in enumerate(lines, 1):
        bare = re.sub(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|//.*$", "", line)
        stripped = line.strip()
        hit = None if stripped.startswith(("*", "/*", "//", "#")) else next(((k, m[1]) for k, p in rules if (m := p.match(line))), None)
        if stripped.startswith(("*", "/*", "//")):
            doc.append(stripped)
        elif hit:
            kind, name = hit
            parent = next((s for s, d, _ in reversed(stack) if d < depth + 1), None)
            sid = _symbol_id(path, name, kind)
            out.append([sid, name, kind, path, no, no, parent, "export" in line or ext in ("go", "php") and name[:1].isupper(), lang, "\n".join(doc) or None, stripped.rstrip("{ ") if kind in ("function", "method") else None])
            if "{" in bare:
                stack.append((sid, depth, len(out) - 1))
            doc = []
        elif stripped:
            doc = []
        depth += bare.count("{") - bare.count("}")
        while stack and depth <= stack[-1][1]:
            out[stack.pop()[2]][5] = no
    for _, _, i in stack:
        out[i][5] = len(lines)
    return [tuple(x) for x in out]


STRATEGIES: dict[str, Callable[[str, str], list[tuple]]] = {"py": parse_python} | {e: parse_lines for e in _LINE_RULES}


def extract_symbols(files: DataFrame, strategies: dict[str, Callable[[str, str], list[tuple]]] | None = None) -> DataFrame:
    """Symbol rows of (path, content); ``strategies`` adds or replaces a parser per extension."""
    table = {**STRATEGIES, **(strategies or {})}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = [c.split()[0] for c in SYMBOLS.split(", ")]
        for f in frames:
            rows: list[tuple] = []
            for p, t in zip(f["path"], f["content"]):
                parse = table.get(p.rsplit(".", 1)[-1].lower())
                rows += parse(p, t or "") if parse else []
            if not rows:
                continue
            g = pd.DataFrame(rows, columns=cols[:-1]).assign(seq=range(len(rows)))
            yield g.astype({"start_line": "int32", "end_line": "int32", "seq": "int64"})

    return files.select("path", "content").mapInPandas(run, SYMBOLS)


def lcov(texts: DataFrame) -> DataFrame:
    """(file, line, hits) from lcov texts (column ``value``); text without records gives nothing."""
    rec = texts.select(F.explode(F.split("value", "end_of_record")).alias("r")).withColumn("file", F.regexp_extract("r", r"(?m)^SF:(.+?)\s*$", 1)).where("file <> ''")
    d = rec.select("file", F.explode(F.regexp_extract_all("r", F.lit(r"(?m)^DA:(\d+,\d+)"), F.lit(1))).alias("d"))
    path = F.regexp_replace(F.replace("file", F.lit("\\"), F.lit("/")), r"^\./", "")
    return d.select(path.alias("file"), F.substring_index("d", ",", 1).cast("int").alias("line"), F.substring_index("d", ",", -1).cast("int").alias("hits"))


def lcov_functions(texts: DataFrame) -> DataFrame:
    """(file, name, line, hits) of the functions in lcov texts."""
    rec = texts.select(F.explode(F.split("value", "end_of_record")).alias("r")).withColumn("file", F.regexp_extract("r", r"(?m)^SF:(.+?)\s*$", 1)).where("file <> ''")
    part = lambda p, a, b: rec.select("file", F.explode(F.regexp_extract_all("r", F.lit(p), F.lit(1))).alias("x")).select("file", F.substring_index("x", ",", 1).cast("int").alias(a), F.regexp_replace("x", r"^\d+,", "").alias(b))
    return part(r"(?m)^FN:(\d+,.+?)\s*$", "line", "name").join(part(r"(?m)^FNDA:(\d+,.+?)\s*$", "hits", "name"), ["file", "name"], "left").select("file", "name", "line", F.coalesce("hits", F.lit(0)).alias("hits"))


_HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def parse_diff(text: str) -> list[tuple]:
    """Hunks of a unified diff: (old_path, new_path, status, idx, old_start, old_lines, new_start, new_lines, content)."""
    out: list[tuple] = []
    for block in re.split(r"(?m)^(?=diff --git )", text):
        head = re.match(r"diff --git a/(.+?) b/(.+)", block)
        if not head:
            continue
        status = "added" if "\nnew file mode" in block else "deleted" if "\ndeleted file mode" in block else "renamed" if "\nrename from " in block else "modified"
        hunk, body, n = None, [], 0
        for line in [*block.split("\n"), "@@end"]:
            m = _HUNK.match(line)
            if m or line == "@@end":
                if hunk:
                    out.append((head[1], head[2], status, n, *hunk, "\n".join(body)))
                    n += 1
                hunk, body = ((int(m[1]), int(m[2] or 1), int(m[3]), int(m[4] or 1)), [line]) if m else (None, [])
            elif hunk:
                body.append(line)
        if not n:
            out.append((head[1], head[2], status, -1, 0, 0, 0, 0, ""))
    return out


def git_diff(texts: DataFrame) -> DataFrame:
    """Hunks of the diffs in column ``value``; a file without hunks keeps one row of index -1."""
    names = ["old_path", "file", "status", "idx", "old_start", "old_lines", "new_start", "new_lines", "content"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [r for t in f["value"] for r in parse_diff(t or "")]
            if rows:
                yield pd.DataFrame(rows, columns=names).astype({c: "int32" for c in names[3:8]})

    return texts.select("value").mapInPandas(run, "old_path string, file string, status string, idx int, old_start int, old_lines int, new_start int, new_lines int, content string")


def git_log(texts: DataFrame, mark: str = "|||") -> DataFrame:
    """(message, files) of the commits in a log whose blocks end in ``mark`` followed by file names."""
    b = texts.select(F.explode(F.split("value", r"\n\n(?=[^\n]*" + re.escape(mark) + ")")).alias("b")).where(F.col("b").contains(mark))
    rest = F.filter(F.transform(F.split(F.substring_index("b", mark, -1), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return b.select(F.trim(F.substring_index("b", mark, 1)).alias("message"), rest.alias("files"))


def front_matter(docs: DataFrame) -> DataFrame:
    """(path, title, symbols, body) of Markdown with a leading ``---`` block; without one title and symbols are null."""
    head = F.regexp_extract("content", r"(?s)\A---\r?\n(.*?)\r?\n---", 1)
    inline = F.regexp_extract("head", r"(?m)^symbols:\s*\[(.*)\]", 1)
    listed = F.regexp_extract_all(F.regexp_extract("head", r"(?ms)^symbols:\s*\n((?:\s*-\s.*(?:\n|\z))+)", 1), F.lit(r"-\s+([^\n]+)"), F.lit(1))
    clean = lambda a: F.filter(F.transform(a, lambda x: F.trim(x, F.lit(" \"'\r"))), lambda x: x != "")
    return docs.withColumn("head", head).select(
        "path", F.nullif(F.trim(F.regexp_extract("head", r"(?m)^title:\s*[\"']?(.*?)[\"']?\s*$", 1)), F.lit("")).alias("title"), F.when(F.col("head") != "", clean(F.when(inline != "", F.split(inline, ",")).otherwise(listed))).alias("symbols"), F.regexp_replace("content", r"(?s)\A---\r?\n.*?\r?\n---\r?\n?", "").alias("body")
    )


def discovered_docs(paths: DataFrame) -> DataFrame:
    """(path, title, module) of Markdown files: title from the file name, module from the first folder."""
    return paths.where(F.col("path").rlike(r"(?i)\.mdx?$")).select("path", title_case("path").alias("title"), F.when(F.col("path").contains("/"), F.substring_index("path", "/", 1)).alias("module"))


def openapi(specs: DataFrame) -> DataFrame:
    """Endpoints (method, path, params, response, symbol_id) of JSON specifications in column ``value``."""
    op = "operationId string, parameters array<struct<name:string,schema:struct<type:string>>>, responses map<string,struct<content:map<string,struct<schema:struct<type:string,`$ref`:string>>>>>"
    item = ", ".join(f"`{m}` struct<{', '.join(p.replace(' ', ':', 1) for p in re.split(r', (?=[a-z]+ )|, (?=[a-zA-Z]+ )', op))}>" for m in ("get", "post", "put", "delete", "patch"))
    schema = f"struct<paths:map<string,struct<parameters:array<struct<name:string,schema:struct<type:string>>>,{', '.join(x.replace(' ', ':', 1) for x in re.split(r', (?=`)', item))}>>>"
    p = specs.select(F.explode(F.from_json("value", schema)["paths"]).alias("path", "item"))
    each = p.select("path", F.col("item.parameters").alias("shared"), F.explode(F.array(*[F.struct(F.lit(m.upper()).alias("method"), F.col(f"item.{m}").alias("op")) for m in ("get", "post", "put", "delete", "patch")])).alias("x")).where("x.op is not null")
    none = F.array().cast("array<struct<name:string,schema:struct<type:string>>>")
    pars = F.concat(F.coalesce("shared", none), F.coalesce("x.op.parameters", none))
    ok = F.coalesce(F.try_element_at("x.op.responses", F.lit("200")), F.try_element_at("x.op.responses", F.lit("201")))
    body = F.try_element_at(ok["content"], F.lit("application/json"))["schema"]
    pairs = F.transform(pars, lambda q: F.struct(q["name"].alias("k"), F.coalesce(q["schema"]["type"], F.lit("string")).alias("v")))
    return each.select("x.method", F.regexp_replace("path", r"\{([^}]+)\}", ":$1").alias("path"), F.map_from_entries(F.array_distinct(pairs)).alias("params"), F.coalesce(F.element_at(F.split(body["$ref"], "/"), -1), body["type"]).alias("response"), F.coalesce("x.op.operationId", F.concat(F.lower("x.method"), F.lit(":"), "path")).alias("symbol_id"))
