"""What source text says: relationships, dynamic registrations, complexity and documentation comments.

Files are split into lines and every pattern runs on single lines, so a file of any length is
spread and only the matches are joined to the symbols around them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.operators.coverage import enclosing, lines_in_symbols

# Names of calls that register something
REGISTRATIONS = (
    "registerTool", "registerCommand", "registerHandler", "registerProvider", "on", "addEventListener", "subscribe", "listen", "addListener",
    "route", "get", "post", "put", "delete", "patch", "use", "register", "bind", "singleton", "transient", "describe", "test", "it", "beforeEach", "afterEach",
)
REGISTRATION = r"(?:^|[^\w$])(" + "|".join(REGISTRATIONS) + r""")\s*\(\s*(?:["'`]([^"'`\n]*)["'`]|([A-Za-z_$][\w$]*))"""
COMMENT_LINE = r"^\s*(?://|/?\*|#|<!--)"
# possessive, so that a line of any length needs no stack
STRINGS = r""""[^"\\]*+(?:\\.[^"\\]*+)*+"|'[^'\\]*+(?:\\.[^'\\]*+)*+'|//.*$|/\*.*?\*/"""
BRANCH = r"\b(?:if|else|elif|case|for|foreach|while|catch|except)\b|&&|\|\||\?\?|\?[^.?:>,)=]"
NO_CALLS = ("if", "for", "while", "switch", "catch", "return", "function", "new", "typeof", "await", "super", "elseif", "foreach", "match", "func", "def", "fn", "and", "or", "not", "in", "import", "require", "constructor", "array", "isset", "empty", "list", "echo", "print", "else", "elif", "assert", "yield", "lambda", "make", "len", "append", "panic", "range", "select", "go", "defer")

# edge type, extensions (null: all), pattern with the target in group 1; several targets are parted by commas
EDGE_PATTERNS = (
    ("uses", ("ts", "js", "mjs"), r"""(?:^|\s)(?:from|import)\s*["']([^"']+)["']"""),
    ("uses", ("php",), r"^use\s+(?:function\s+|const\s+)?\\?([A-Za-z_][\w\\]*)"),
    ("uses", ("py",), r"^\s*(?:from\s+([\w.]+)\s+import\b)"),
    ("uses", ("py",), r"^\s*import\s+([\w., ]+)"),
    ("uses", ("go",), r"""^(?:import\s+|\t)(?:[\w.]+\s+)?"([^"]+)"\s*$"""),
    ("inherits", ("ts", "js", "mjs", "php"), r"\b(?:class|interface)\s+[\w$]+(?:<[^>]*>)?\s+extends\s+([\w$\\.]+)"),
    ("inherits", ("py",), r"^\s*class\s+\w+\(([\w., ]+)"),
    ("implements", ("ts", "js", "mjs", "php"), r"\bclass\s[^{]*\bimplements\s+([\w$\\., ]+)"),
    ("instantiates", ("ts", "js", "mjs", "php"), r"\bnew\s+([A-Za-z_$\\][\w$\\.]*)"),
    ("calls", None, r"(?:^|[^\w$])([A-Za-z_$][\w$]*)\s*\("),
)


def lines(files: DataFrame) -> DataFrame:
    """(file, line, text) of (path, content), numbered from 1; null contents have none."""
    return files.select(F.col("path").alias("file"), F.posexplode(F.split(F.replace("content", F.lit("\r"), F.lit("")), "\n")).alias("at", "text")).select("file", (F.col("at") + 1).alias("line"), "text")


def _around(found: DataFrame, symbols: DataFrame) -> DataFrame:
    """Adds ``id``, the smallest symbol around (file, line), null where there is none."""
    points = found.select("file", "line").distinct().withColumn("ref", F.struct("file", "line"))
    at = enclosing(symbols, points).select(F.col("ref.file").alias("file"), F.col("ref.line").alias("line"), "id")
    return found.join(at, ["file", "line"], "left")


def registrations(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file, line, pattern, registered, id): calls that register a name, by the function or method around them.

    The first argument must be a string or a name; calls outside any function are left out, as
    are comment lines. Null contents give no rows; repeated calls on a line count once.
    """
    own = lines(files).where(F.col("text").rlike(REGISTRATION) & ~F.col("text").rlike(COMMENT_LINE))
    m = own.select("file", "line", F.explode(F.regexp_extract_all("text", F.lit(REGISTRATION), F.lit(0))).alias("m"))
    name = F.coalesce(F.nullif(F.regexp_extract("m", REGISTRATION, 2), F.lit("")), F.nullif(F.regexp_extract("m", REGISTRATION, 3), F.lit("")))
    found = m.select("file", "line", F.regexp_extract("m", REGISTRATION, 1).alias("pattern"), name.alias("registered")).where("registered is not null").distinct()
    return _around(found, symbols.where(F.col("kind").isin("function", "method"))).where("id is not null").select("file", "line", "pattern", "registered", "id")


def source_edges(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(source_id, target_id, type, resolved) from the text of the files.

    Imports start at ``module::<file>``; all else at the smallest symbol around the line, or at
    the module where there is none. A target is the symbol written last under its short name,
    else the text itself. Comment lines, keywords and a symbol's own declaration give no edge.
    """
    text = lines(files).where(~F.col("text").rlike(COMMENT_LINE)).withColumn("ext", F.lower(F.regexp_extract("file", r"\.([^./]+)$", 1)))
    parts = []
    for kind, exts, pattern in EDGE_PATTERNS:
        rows = text.where(F.col("text").rlike(pattern)) if exts is None else text.where(F.col("ext").isin(*exts) & F.col("text").rlike(pattern))
        parts.append(rows.select("file", "line", F.lit(kind).alias("type"), F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("t")))
    each = reduce(lambda a, b: a.unionByName(b), parts).select("file", "line", "type", F.explode(F.split("t", ",")).alias("t")).select("file", "line", "type", F.trim("t").alias("t"))
    each = each.where((F.col("t") != "") & ~((F.col("type") == "calls") & F.col("t").isin(*NO_CALLS))).distinct()
    at = _around(each, symbols)
    source = F.when((F.col("type") == "uses") | F.col("id").isNull(), F.concat(F.lit("module::"), "file")).otherwise(F.col("id"))
    short = F.element_at(F.split("t", r"[\\./]"), -1)
    edges = at.select(source.alias("source_id"), "type", "t", F.when(short != "", short).otherwise(F.col("t")).alias("name")).distinct()
    known = symbols.groupBy("name").agg(F.max_by("id", "seq").alias("to"))
    named = edges.join(known, "name", "left").where(~F.col("to").eqNullSafe(F.col("source_id")))
    return named.select("source_id", F.coalesce("to", "t").alias("target_id"), "type", F.col("to").isNotNull().alias("resolved")).distinct()


def branches(text: Column | str) -> Column:
    """Branching points on a line of code, strings and comments aside."""
    return F.size(F.regexp_extract_all(F.regexp_replace(text, STRINGS, ""), F.lit(BRANCH), F.lit(0)))


def metrics(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id, lines_of_code, complexity, parameters) of the functions and methods; complexity is 1 without source text."""
    from lodegraph.functions.exprs import parameter_count

    own = symbols.where(F.col("kind").isin("function", "method", "constructor"))
    hits = lines(files).where(~F.col("text").rlike(COMMENT_LINE)).select("file", "line", branches("text").alias("hits")).where("hits > 0")
    n = lines_in_symbols(own, hits).groupBy("id").agg(F.sum("hits").alias("n"))
    return own.join(n, "id", "left").select("id", (F.col("end_line") - F.col("start_line") + 1).alias("lines_of_code"), (F.coalesce("n", F.lit(0)) + 1).alias("complexity"), parameter_count("signature").alias("parameters"))


def doc_parts(comment: Column | str) -> Column:
    """Struct (summary, tags) of a block comment: lines without their marks, those with a tag apart; null for other texts."""
    c = F.col(comment) if isinstance(comment, str) else comment
    inner = F.regexp_replace(F.regexp_replace(F.replace(c, F.lit("\r"), F.lit("")), r"^/\*\*\s*", ""), r"\s*\*/$", "")
    rows = F.transform(F.split(inner, "\n"), lambda x: F.regexp_replace(x, r"^\s*\*\s?", ""))
    tag = lambda x: x.rlike(r"^@\w")
    blank = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    summary = blank(F.array_join(F.filter(rows, lambda x: ~tag(x)), " "))
    return F.when(c.startswith("/**"), F.struct(F.nullif(summary, F.lit("")).alias("summary"), F.transform(F.filter(rows, tag), blank).alias("tags")))


def python_summary(docstring: Column | str) -> Column:
    """First line of a Python doc string without its quotes."""
    c = F.col(docstring) if isinstance(docstring, str) else docstring
    return F.trim(F.substring_index(F.trim(F.regexp_replace(c, "^(\"\"\"|'''|\"|')|(\"\"\"|'''|\"|')$", ""), F.lit(" \t\r\n")), "\n", 1))


def go_summary(comment: Column | str) -> Column:
    """First sentence of the line comments above a Go declaration."""
    c = F.col(comment) if isinstance(comment, str) else comment
    flat = F.trim(F.array_join(F.transform(F.split(c, "\n"), lambda x: F.regexp_replace(x, r"^//\s?", "")), " "))
    return F.element_at(F.split(flat, r"\.\s"), 1)
