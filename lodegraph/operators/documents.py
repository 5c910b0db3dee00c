"""Documents: sections, fenced blocks, navigation, undocumented symbols, example checks."""

from __future__ import annotations

import ast
import json
import re
import shlex
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.plans.lineage import cut


def text_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("doc"), F.posexplode(F.split(text, "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)


def sections(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, level, heading, start_line, end_line): a section ends before the next heading, the last one with the text."""
    lines = text_lines(docs, key, text)
    heads = lines.where(F.col("text").rlike(r"^#{1,6}\s+\S")).select("doc", "line", F.length(F.regexp_extract("text", "^(#+)", 1)).alias("level"), F.regexp_replace("text", r"^#+\s+", "").alias("heading"))
    size = docs.select(F.col(key).alias("doc"), F.size(F.split(text, "\n")).alias("n"))
    w = Window.partitionBy("doc").orderBy("line")
    return heads.withColumn("next", F.lead("line").over(w)).join(size, "doc").select("doc", "level", "heading", F.col("line").alias("start_line"), F.coalesce(F.col("next") - 1, F.col("n")).alias("end_line"))


def fenced_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, start_line, end_line, language, code): pairs of fences by a running count; unclosed and empty blocks are dropped."""
    lines = text_lines(docs, key, text).withColumn("fence", F.col("text").rlike("^```"))
    w = Window.partitionBy("doc").orderBy("line")
    at = lines.withColumn("no", F.sum(F.col("fence").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    block = at.where("no % 2 = 1 or fence").withColumn("block", F.floor((F.col("no") + 1) / 2))
    g = block.groupBy("doc", "block").agg(
        F.min("line").alias("start_line"), F.max("line").alias("end_line"), F.count_if("fence").alias("fences"), F.min_by(F.trim(F.regexp_replace("text", "^```", "")), "line").alias("language"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~F.col("fence"), F.struct("line", "text")))), lambda x: x["text"]), "\n").alias("code"),
    )
    return g.where((F.col("fences") == 2) & (F.trim("code") != "")).select("doc", "start_line", "end_line", "language", "code")


def navigation(docs: DataFrame) -> DataFrame:
    """(path, previous, next) within each module, by title and path; explicit links win.

    The rows are range-partitioned over the whole order, so a large module is spread out; only
    the first and last row of each partition travel to its neighbours.
    """
    key = ["module", "title", "path"]
    rows = cut(docs.select(*key, F.col("previous").alias("p"), F.col("next").alias("n")).repartitionByRange(*key).withColumn("pid", F.spark_partition_id()))
    row = F.struct(*key)
    ends = rows.groupBy("pid").agg(F.min(row).alias("first"), F.max(row).alias("last"))  # a row a partition
    over = Window.orderBy("pid")
    ends = ends.select("pid", F.lag("last").over(over).alias("before"), F.lead("first").over(over).alias("after"))
    w = Window.partitionBy("pid").orderBy(*key)
    at = rows.join(F.broadcast(ends), "pid").select("path", "module", "p", "n", F.coalesce(F.lag(row).over(w), "before").alias("b"), F.coalesce(F.lead(row).over(w), "after").alias("a"))
    near = lambda c: F.when(F.col(f"{c}.module").eqNullSafe(F.col("module")) & F.col(c).isNotNull(), F.col(f"{c}.path"))
    return at.select("path", F.coalesce("p", near("b")).alias("previous"), F.coalesce("n", near("a")).alias("next"))


def undocumented(symbols: DataFrame, mappings: DataFrame) -> DataFrame:
    return symbols.join(mappings.select(F.col("symbol_name").alias("name")), "name", "left_anti")


def with_doc_ref(symbols: DataFrame, mappings: DataFrame) -> DataFrame:
    """(id, doc_ref): the document mapped last to the symbol's name, else what it had."""
    m = mappings.groupBy(F.col("symbol_name").alias("name")).agg(F.max_by("doc_path", "seq").alias("d"))
    return symbols.join(m, "name", "left").select("id", F.coalesce("d", "doc_ref").alias("doc_ref"))


def _xml(code: str) -> None:
    from xml.parsers.expat import ExpatError, ParserCreate

    try:
        ParserCreate().Parse(code, True)  # no external entities are read
    except ExpatError as e:
        raise ValueError(str(e)) from None


def _shell(code: str) -> None:
    shlex.split(code, comments=True)


def _closed(code: str) -> None:
    """Brackets outside strings and comments are closed in order."""
    open_: list[str] = []
    for c in re.sub(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`|//[^\n]*|/\*.*?\*/|(?<!\w)#[^\n]*", "", code, flags=re.S):
        if c in "([{":
            open_.append(c)
        elif c in ")]}" and (not open_ or open_.pop() + c not in ("()", "[]", "{}")):
            raise ValueError(f"unexpected {c}")
    if open_:
        raise ValueError(f"unclosed {open_[-1]}")


# language of a fence: a function that raises SyntaxError or ValueError, or returns a text, if the code is invalid
VALIDATORS: dict[str, Callable[[str], object]] = (
    dict.fromkeys(("python", "py", "python3"), ast.parse) | {"json": json.loads} | dict.fromkeys(("xml", "svg"), _xml) | dict.fromkeys(("bash", "sh", "shell", "zsh"), _shell)
    | dict.fromkeys(("typescript", "ts", "tsx", "javascript", "js", "jsx", "php", "go", "java", "c", "cpp", "csharp", "cs", "rust", "css", "scss"), _closed)
)


def _valid(validators: dict, language: str, code: str) -> str:
    if not code.strip():
        return "empty block"
    try:
        said = validators[language](code) if language in validators else None
    except (SyntaxError, ValueError) as e:
        return str(e)
    return said if isinstance(said, str) else ""


def checked_examples(blocks: DataFrame, validators: dict[str, Callable[[str], object]] | None = None) -> DataFrame:
    """(doc, start_line, valid, error) of code blocks, each by the validator of its language.

    ``validators`` adds or replaces some. Empty blocks are invalid; others of languages without
    a validator, or without a language, are valid.
    """
    table = {**VALIDATORS, **(validators or {})}

    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                errors = [_valid(table, (a or "").lower(), c or "") for a, c in zip(f["language"], f["code"])]
                yield f[["doc", "start_line"]].assign(valid=[not e for e in errors], error=errors)

    return blocks.mapInPandas(check, f"doc {dict(blocks.dtypes)['doc']}, start_line int, valid boolean, error string")


def merged(stored: DataFrame, configured: DataFrame) -> DataFrame:
    """Documents by path: a stored row goes before a configured one, which gives the order (``pos``) where it has one."""
    c = configured.select("path", F.col("title").alias("c_title"), "pos")
    return stored.select("path", F.col("title").alias("s_title"), F.lit(True).alias("stored")).join(c, "path", "full_outer").select("path", F.when(F.col("stored"), F.col("s_title")).otherwise(F.col("c_title")).alias("title"), "pos")


def grouped(docs: DataFrame, by: str) -> DataFrame:
    """(group, n, first, last): documents per category or module with the first and last path."""
    return docs.groupBy(F.coalesce(F.col(by), F.lit("general")).alias("group")).agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first"), F.max("path").alias("last"))


def pass_rate(checked: DataFrame) -> DataFrame:
    """One row: examples, valid ones, and their percentage (0 without examples)."""
    return checked.agg(F.count(F.lit(1)).alias("n"), F.count_if("valid").alias("n_valid")).withColumn("percent", F.coalesce(F.round(F.try_divide(F.col("n_valid") * 100.0, F.col("n")), 4), F.lit(0.0)))


def without_section(docs: DataFrame, heading: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, text) with the sections of this heading cut out."""
    gone = sections(docs, key, text).where(F.col("heading") == heading).groupBy("doc").agg(F.collect_list(F.struct("start_line", "end_line")).alias("cuts"))
    j = docs.select(F.col(key).alias("doc"), F.col(text).alias("text")).join(gone, "doc", "left")
    numbered = F.transform(F.split("text", "\n"), lambda t, i: F.struct(t.alias("t"), (i + 1).alias("i")))
    kept = F.filter(numbered, lambda x: ~F.exists("cuts", lambda c: x["i"].between(c["start_line"], c["end_line"])))
    return j.select("doc", F.when(F.col("cuts").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda x: x["t"]), "\n")).alias("text"))


def page_lines(symbols: DataFrame) -> DataFrame:
    """(file, start_line, id, line): the lines of a Markdown page per file, to be written in this order."""
    line = F.concat(F.lit("- `"), "kind", F.lit("` **"), "name", F.lit("** (L"), "start_line", F.lit("-"), "end_line", F.lit(")"), F.when(F.col("summary") != "", F.concat(F.lit(": "), "summary")).otherwise(F.lit("")))
    head = symbols.select("file").distinct().select("file", F.lit(0).alias("start_line"), F.lit("").alias("id"), F.concat(F.lit("# "), "file").alias("line"))
    return head.unionByName(symbols.select("file", "start_line", "id", line.alias("line")))


def registered_order(docs: DataFrame) -> DataFrame:
    """(path, category, position): documents (path, title, category) in the order of a register, by title and path within their category."""
    w = Window.partitionBy("category").orderBy("title", "path")
    return docs.select("path", "category", F.row_number().over(w).alias("position"))
