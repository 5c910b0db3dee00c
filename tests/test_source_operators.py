import json

import pytest
from pyspark.sql import functions as F

from lodegraph.functions import exprs as X
from lodegraph.operators import catalogues as C
from lodegraph.operators import documents, rules, sourcecode

FILES, SYMBOLS = "path string, content string, text string", "id string, name string, kind string, file string, start_line int, end_line int, seq long, signature string"

TS = """import { Server } from './server.js';
// new Ghost()
export class Routes extends Base implements Plugin, Part {
  setup(app: Server) {
    if (a && b) { app.get("/users", list); }
    const s = new Store();   // if this && that
    for (const x of xs) { helper(x ? 1 : 2); }
    app.registerTool('search', run);
  }
}
"""


def frames(spark):
    files = spark.createDataFrame([("a.ts", TS, "x"), ("b.ts", None, "x"), ("c.ts", "", "x"), (None, "x", "x"), ("d.py", "from lib.tools import y\n\ndef go(a):\n    return make_all(a)\n", "x"), ("min.js", 'x("' + 'a\\"b' * 200_000 + '");', "x")], FILES)
    symbols = spark.createDataFrame(
        [("r", "Routes", "class", "a.ts", 3, 10, 1, None), ("s", "setup", "method", "a.ts", 4, 9, 2, "setup(app: Server)"), ("g", "go", "function", "d.py", 3, 4, 3, "go(a)"), ("st0", "Store", "class", "z.ts", 1, 1, 1, None), ("st", "Store", "class", "z.ts", 1, 1, 9, None), (None, "q", "method", None, None, None, None, None)],
        SYMBOLS,
    )
    return files, symbols


def test_registrations(spark):
    files, symbols = frames(spark)
    got = {(r.line, r.pattern, r.registered, r.id) for r in sourcecode.registrations(files, symbols).collect()}
    assert got == {(5, "get", "/users", "s"), (8, "registerTool", "search", "s")}


def test_edges(spark):
    files, symbols = frames(spark)
    got = {(r.source_id, r.target_id, r.type, r.resolved) for r in sourcecode.source_edges(files, symbols).collect()}
    assert {("module::a.ts", "./server.js", "uses", False), ("r", "Base", "inherits", False), ("r", "Plugin", "implements", False), ("r", "Part", "implements", False), ("s", "st", "instantiates", True), ("s", "helper", "calls", False), ("module::d.py", "lib.tools", "uses", False), ("g", "make_all", "calls", False)} <= got
    assert not any("Ghost" in t for _, t, _, _ in got) and not any(t in ("if", "for") for _, t, _, _ in got)


def test_metrics(spark):
    files, symbols = frames(spark)
    got = {r.id: (r.lines_of_code, r.complexity, r.parameters) for r in sourcecode.metrics(files, symbols).collect()}
    assert got["s"] == (6, 1 + 4, 1) and got["g"] == (2, 1, 1)  # if, &&, for, ? :
    assert sourcecode.metrics(files.where("false"), symbols.where("id = 's'")).first().complexity == 1


def test_doc_comments(spark):
    df = spark.createDataFrame([("/**\n * Sends it.\r\n * Twice.\n * @param a the one\n * @return b\n */",), ("// no",), (None,), ("/** */",)], "c string")
    got = [r.p for r in df.select(sourcecode.doc_parts("c").alias("p")).collect()]
    assert (got[0].summary, got[0].tags) == ("Sends it. Twice.", ["@param a the one", "@return b"]) and got[1] is None and got[2] is None and got[3].summary is None
    t = spark.createDataFrame([('"""First line.\n\nMore."""', "// Go sends it. And more.\n// Rest")], "p string, g string").select(sourcecode.python_summary("p").alias("p"), sourcecode.go_summary("g").alias("g")).first()
    assert (t.p, t.g) == ("First line.", "Go sends it")


def test_catalogues():
    assert len(C.PHP_RULES) == 19 and len(C.TYPESCRIPT_RULES) == 20 and len(C.PHP_RESERVED) == 17
    assert [r.name for r in C.base_rules(["go"], layers=False, imports=False, limits=False)] == ["class-pascal-case", "method-camel-case", "function-camel-case"]
    assert "__init__" in C.reserved_names(["python", "php"]) and C.reserved_names(["go", "cobol"]) == []
    assert C.base_rules(["php"], max_lines=7, return_type=True)[-2].config == {"max": 7}


def test_reserved_names_pass(spark):
    cols = ", ".join(f"{c} {'int' if c.endswith('line') else 'struct<linesOfCode:int,cyclomaticComplexity:int,parameterCount:int>' if c == 'metrics' else 'string'}" for c in rules.SYMBOL_COLUMNS)
    row = lambda i, n: {"id": i, "name": n, "kind": "method", "file": "a.php", "signature": "f(): int"}
    s = spark.createDataFrame([row("1", "__callStatic"), row("2", "Bad_Name"), row("3", "fine")], cols)
    e = spark.createDataFrame([], "source_id string, target_id string, type string")
    assert [(r.rule, r.symbol_id) for r in C.catalogue_violations("php", s, e).collect()] == [("php:naming_method", "2")]
    assert C.catalogue_violations("typescript", s, e).count() == 0


@pytest.mark.parametrize("x, text", [(0.25, "0.3"), (0.35, "0.3"), (1.05, "1.1"), (2.5, "2.5"), (0.75, "0.8"), (12345.65, "12345.6"), (0.0, "0.0")])
def test_to_fixed(spark, x, text):
    """One decimal of the exact binary value; exact halves go up."""
    assert spark.range(1).select(X.to_fixed(F.lit(x)).alias("t")).first().t == text


def test_legacy_hash_and_kinds(spark):
    df = spark.createDataFrame([("hello", "OrderEvent", "class"), ("", "x", "class"), ("a longer text that overflows", "X", "method")], "t string, name string, kind string").withColumn("sym_extends", F.lit(None).cast("string")).withColumn("sym_implements", F.array(F.lit("IListener")))
    got = df.select(X.legacy_hash("t").alias("h"), C.refined_kind("php").alias("php"), C.refined_kind("go").alias("go")).collect()
    assert [r.h for r in got[:2]] == ["1n1e4y", "0"] and got[2].h.startswith("-") or got[2].h
    assert [(r.php, r.go) for r in got] == [("event", "event"), ("listener", "class"), ("method", "method")]


def test_validators(spark):
    blocks = spark.createDataFrame([(1, 1, "json", "{}"), (1, 2, "json", "{"), (1, 3, "xml", "<a/>"), (1, 4, "xml", "<a>"), (1, 5, "zig", "x"), (1, 6, "py", ""), (1, 7, None, "x"), (1, 8, "bash", "if x; then y; fi"), (1, 9, "bash", "echo 'open")], "doc int, start_line int, language string, code string")
    own = {"zig": lambda code: "no zig here"}
    got = {r.start_line: r.valid for r in documents.checked_examples(blocks, own).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False, 5: False, 6: False, 7: True, 8: True, 9: False}
    assert json.loads("{}") == {}
