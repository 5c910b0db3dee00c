import pytest
from pyspark.sql import functions as F

from lodegraph import schemas
from lodegraph.functions import exprs as X
from lodegraph.operators import changes, coverage, diagrams, documents, graph, patterns, resolution, retrieval, rules, search, trace
from lodegraph.plans import reference_queries
from lodegraph.sources import sinks

EDGE = "source_id string, target_id string, type string"
SYM = "id string, name string, qualified_name string, kind string, file string, start_line int, end_line int, parent string, visibility string, exported boolean, signature string, layer string, sym_implements array<string>, tags array<string>, summary string, seq long"


def sym(spark, rows):
    cols = [c.split()[0] for c in SYM.split(", ")]
    return spark.createDataFrame([tuple({"name": r["id"], "kind": "class", "file": "src/a.ts", "start_line": 1, "end_line": 10, "seq": i, **r}.get(c) for c in cols) for i, r in enumerate(rows)], SYM).withColumn("metrics", F.lit(None).cast("struct<linesOfCode:int,cyclomaticComplexity:int,parameterCount:int>"))


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("pattern, value, want", [("src/*.ts", "src/a.ts", True), ("src/*.ts", "src/b/a.ts", False), ("src/**", "src/b/a.ts", True), ("a.b", "axb", False), ("*.ts", "a.ts\n", False), ("", "a", False), ("a?.ts", ".ts", True), ("(x)", "(x)", True)])
def test_globs(spark, pattern, value, want):
    assert one(spark, X.glob(F.lit(value), pattern)) is want


@pytest.mark.parametrize("qualified, name, want", [("App\\Foo", "Foo", "Foo"), ("Cls.method", "method", "method"), ("A::b", "b", "b"), ("src/user.service.ts", "x", "ts"), (None, "plain", "plain"), ("", "", "unknown")])
def test_short_names(spark, qualified, name, want):
    got = one(spark, X.short_name(F.lit(qualified).cast("string"), F.lit(name)))
    assert got == want if want != "unknown" else got in ("", "unknown")


def test_scalar_expressions(spark):
    assert one(spark, X.layer_of(F.lit("src/user.ts"), F.lit("UserController"))) == "presentation"
    assert one(spark, X.language_of(F.lit("a/b.MJS"))) == "javascript"
    assert one(spark, X.parameter_count(F.lit("f(a, b): void"))) == 2
    assert one(spark, X.parameter_count(F.lit("f()"))) == 0
    assert one(spark, X.has_return_type(F.lit("f(a): void"))) is True
    assert one(spark, X.has_return_type(F.lit("f(a) {"))) is False
    assert one(spark, X.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0)))) == 0.0
    assert one(spark, X.cosine(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0)))) is None
    assert one(spark, X.title_case(F.lit("docs/getting-started.md"))) == "Getting Started"
    with pytest.raises(ValueError):
        X.chunk_words(F.lit("x"), 5, 5)


def test_chunks_keep_short_texts(spark):
    assert one(spark, X.chunk_words(F.lit(" a  b"), 5, 1)) == [" a  b"]
    words = " ".join(map(str, range(12)))
    assert one(spark, X.chunk_words(F.lit(words), 5, 1)) == ["0 1 2 3 4", "4 5 6 7 8", "8 9 10 11"]


def test_last_edge_wins(spark):
    df = spark.createDataFrame([("A", "B", "calls", 1), ("A", "B", "inherits", 2)], EDGE + ", seq long")
    assert [tuple(r) for r in graph.last_edge(df).collect()] == [("A", "B", "inherits")]


def test_impact_of_cycle_and_diamond(spark):
    cycle = spark.createDataFrame([("A", "B", "calls"), ("B", "C", "calls"), ("C", "A", "calls")], EDGE)
    roots = spark.createDataFrame([("A",)], "id string")
    assert {r.id for r in graph.impact_radius(cycle, roots, 10).collect()} == {"B", "C"}
    diamond = spark.createDataFrame([("A", "D", "x"), ("B", "D", "x"), ("C", "D", "x"), ("A", "B", "x"), ("A", "C", "x")], EDGE)
    got = graph.impact_radius(diamond, spark.createDataFrame([("D",)], "id string"), 3).collect()
    assert {(r.id, r.depth) for r in got} == {("A", 1), ("B", 1), ("C", 1)}
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}", "x") for i in range(6)], EDGE)
    assert {r.id for r in graph.impact_radius(chain, spark.createDataFrame([("n6",)], "id string"), 3).collect()} == {"n5", "n4", "n3"}


def test_rules(spark):
    s = sym(spark, [{"id": "d", "file": "src/domain/a.ts"}, {"id": "i", "file": "src/infra/b.ts"}, {"id": "m", "name": "BadName", "kind": "method", "qualified_name": "C.BadName", "signature": "f()"}])
    e = spark.createDataFrame([("d", "i", "uses"), ("d", "zz", "uses")], EDGE)
    r = [rules.Rule("b", "layer_boundary", {"source": "src/domain/**", "forbidden": ["src/infra/**"]}), rules.Rule("n", "naming_convention", {"kind": "method", "pattern": "^[a-z]"}), rules.Rule("r", "missing_return_type", {}), rules.Rule("none", "layer_boundary", {"source": "**"}), rules.Rule("odd", "no_such_type", {})]
    got = {(x.rule, x.symbol_id, x.severity) for x in rules.violations(r, s, e).collect()}
    assert got == {("b", "d", "error"), ("n", "m", "warning"), ("r", "m", "warning")}
    assert rules.violations([], s, e).count() == 0
    assert [x.severity for x in rules.select_rules(r, include=["b"], override={"b": {"severity": "info"}})] == ["warning"]


def test_dead_code_and_docs(spark):
    s = sym(spark, [{"id": "live", "kind": "function"}, {"id": "dead", "kind": "function"}, {"id": "hidden", "kind": "function", "exported": False}, {"id": "t", "kind": "function", "file": "tests/x.ts"}, {"id": "p", "kind": "class"}, {"id": "c", "kind": "method", "parent": "p"}])
    e = spark.createDataFrame([("dead", "live", "calls")], EDGE)
    dead = rules.dead_code(s, e)
    assert {r.id for r in dead.collect()} == {"dead"}
    marked = rules.mark_dead(s.withColumn("violations", F.array(F.lit("dead_code"))), dead).where("id = 'dead'").first()
    assert marked.violations == ["dead_code"]
    m = spark.createDataFrame([("live", "a.md"), ("gone", "b.md")], "symbol_name string, doc_path string")
    assert [r.doc_path for r in rules.orphan_docs(m, s).collect()] == ["b.md"]


def test_patterns(spark):
    s = sym(spark, [{"id": "e", "name": "OrderEvent", "kind": "event"}, {"id": "l", "name": "SendOrderListener", "kind": "listener"}, {"id": "e2", "name": "Lost", "kind": "event"}, {"id": "f", "kind": "class"}, {"id": "mk", "name": "createIt", "kind": "method", "parent": "f"}, {"id": "s", "kind": "class"}, {"id": "sc", "kind": "constructor", "visibility": "private", "parent": "s"}, {"id": "if", "name": "Strat", "kind": "interface"}, {"id": "a", "sym_implements": ["if"]}, {"id": "b", "sym_implements": ["Strat"]}, {"id": "r", "name": "UserRepository", "kind": "repository"}])
    e = spark.createDataFrame([("mk", "a", "instantiates"), ("x", "if", "uses")], EDGE)
    rows = patterns.all_patterns(s, e).collect()
    got = {(r.kind, r.primary): r for r in rows}
    members = {k: {r.member for r in rows if (r.kind, r.primary) == k} for k in got}
    assert members["observer", "e"] == {"e", "l"} and got["observer", "e"].confidence == 0.9
    assert got["observer", "e2"].violations == ["No listeners found for event 'Lost'"]
    assert members["factory", "f"] == {"f", "mk"}
    assert got["singleton", "s"].confidence == 0.6 and len(got["singleton", "s"].violations) == 1
    assert members["strategy", "if"] == {"if", "a", "b"} and got["strategy", "if"].confidence == 0.85
    assert got["repository", "r"].confidence == 0.3
    flow = {tuple(r) for r in patterns.event_flow(s, spark.createDataFrame([("mk", "e", "uses"), ("l", "e", "uses")], EDGE)).collect()}
    assert flow == {("e", "emitter", "mk", True), ("e", "listener", "l", True), ("e2", "none", None, False)}
    assert diagrams.event_flow_diagram(patterns.event_flow(s, e), s).count() == 1


def test_snapshot_diff_and_hunks(spark):
    old = sym(spark, [{"id": "a", "signature": "a()"}, {"id": "b", "start_line": 1, "end_line": 5}, {"id": "c", "start_line": 1, "end_line": 5}, {"id": "d"}, {"id": "same"}])
    new = sym(spark, [{"id": "a", "signature": "a(x)"}, {"id": "b", "start_line": 1, "end_line": 7}, {"id": "c", "start_line": 3, "end_line": 7}, {"id": "n"}, {"id": "same"}])
    d = changes.snapshot_diff(old, new)
    assert {(r.name, r.change) for r in d.collect()} == {("a", "signature_changed"), ("b", "body_changed"), ("c", "moved"), ("d", "removed"), ("n", "added")}
    assert d.where("name = 'b'").first().details == "body size changed (5 → 7 lines)"
    h = spark.createDataFrame([("src/a.ts", 0, 8, 2, "one"), ("src/a.ts", 1, 9, 1, "two")], "file string, idx int, new_start int, new_lines int, content string")
    got = {r.name: r.diff for r in changes.change_impact(d, h).collect()}
    assert got["a"] == "one\ntwo" and "b" not in got and got["n"]
    edge = spark.createDataFrame([("src/a.ts", 0, 1, 2, "touches line 3")], "file string, idx int, new_start int, new_lines int, content string")
    assert {r.name for r in changes.change_impact(d, edge).collect()} >= {"c"}


def test_change_impact_reaches_every_symbol_of_a_file(spark, tmp_path):
    old = [{"id": f"m{i:02}", "file": "src/a.ts", "start_line": 10 * i, "end_line": 10 * i + 8, "signature": "f()"} for i in range(12)]
    rows = old + [{**r, "signature": "f(x)"} for r in old]
    sym(spark, rows).write.parquet(str(tmp_path / "symbols.parquet"))
    got = {r.name: (r.change, r.diff) for r in reference_queries.change_impact(spark, str(tmp_path)).collect()}
    assert got == {r["id"]: ("signature_changed", "@@ " + r["id"]) for r in old}


@pytest.mark.parametrize("shift", [0, 1])
def test_doc_guard_goes_by_updates_not_by_parity(spark, tmp_path, shift):
    old = [{"id": i, "signature": "f()"} for i in ("told", "untold", "bare")]
    sym(spark, old + [{**r, "signature": "f(x)"} for r in old]).write.parquet(str(tmp_path / "symbols.parquet"))
    rows = [("told", "a.md", None, "2025-01-01", 2 + shift), ("told", "a.md", None, "2025-02-01", 4 + shift), ("untold", "b.md", None, "2025-01-01", 6 + shift)]
    m = spark.createDataFrame(rows, "symbol_name string, doc_path string, section string, updated_at string, seq long")
    m.withColumn("updated_at", F.col("updated_at").cast("timestamp")).write.parquet(str(tmp_path / "doc_mappings.parquet"))
    assert {r.name for r in reference_queries.doc_guard(spark, str(tmp_path)).collect()} == {"untold", "bare"}


def test_coverage_and_enclosing(spark):
    s = sym(spark, [{"id": "outer", "start_line": 1, "end_line": 200}, {"id": "inner", "start_line": 60, "end_line": 70}])
    lines = spark.createDataFrame([("src/a.ts", i, i % 2) for i in range(50, 80)], "file string, line int, hits int")
    got = {r.id: (r.lines_found, r.lines_hit) for r in coverage.symbol_coverage(s, lines).collect()}
    assert got == {"outer": (30, 15), "inner": (11, 5)}
    p = spark.createDataFrame([("p", "src/a.ts", 65), ("q", "src/a.ts", 199), ("r", "src/a.ts", 999)], "ref string, file string, line int")
    assert {(r.ref, r.id) for r in coverage.enclosing(s, p).collect()} == {("p", "inner"), ("q", "outer")}


def test_documents(spark):
    text = "# A\nx\n## B\n```py\nprint(1)\n```\n```\n\n```\n```js\nopen"
    d = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    assert [(r.heading, r.start_line, r.end_line) for r in documents.sections(d).orderBy("start_line").collect()] == [("A", 1, 2), ("B", 3, 11)]
    blocks = documents.fenced_blocks(d)
    assert [(r.start_line, r.end_line, r.language, r.code) for r in blocks.collect()] == [(4, 6, "py", "print(1)")]
    bad = spark.createDataFrame([(1, 1, "python", "def f(:"), (1, 2, "json", "{}"), (1, 3, "zig", "x")], "doc long, start_line int, language string, code string")
    assert [r.valid for r in documents.checked_examples(bad).orderBy("start_line").collect()] == [False, True, True]
    nav = spark.createDataFrame([("a", "A", "m", None, None), ("b", "B", "m", "x", None), ("c", "C", "n", None, None)], "path string, title string, module string, previous string, next string")
    assert {(r.path, r.previous, r.next) for r in documents.navigation(nav).collect()} == {("a", None, "b"), ("b", "x", None), ("c", None, None)}


def test_resolution_order(spark):
    s = sym(spark, [{"id": "1", "name": "Ns\\Foo"}, {"id": "2", "name": "bar"}, {"id": "3", "name": "count", "file": "src/utils.ts"}])
    refs = spark.createDataFrame([("r1", "f", "", "bar"), ("r2", "f", "", "F"), ("r3", "f", "Ns", "Foo"), ("r4", "f", "", "./utils::count"), ("r5", "f", "", "count2")], "ref string, file string, namespace string, target string")
    imp = spark.createDataFrame([("f", "F", "Ns\\Foo")], "file string, alias string, qualified string")
    assert {(r.ref, r.id, r.how) for r in resolution.resolve(refs, s, imp).collect()} == {("r1", "2", "exact"), ("r2", "1", "import"), ("r3", "1", "namespace"), ("r4", "3", "path"), ("r5", None, None)}


def test_tracing_and_apis(spark):
    c = spark.createDataFrame([("ABC-1 and ABC-1 XY-22", ["a.ts", "b.test.ts"]), ("none", ["a.ts"])], "message string, files array<string>")
    refs = trace.commit_refs(c)
    assert {(r.ticket, r.file) for r in refs.collect()} == {(t, f) for t in ("ABC-1", "XY-22") for f in ("a.ts", "b.test.ts")}
    src = spark.createDataFrame([("a.ts", "x\n// ref: AB-1 // ref: AB-2")], "file string, content string")
    assert {(r.ticket, r.line) for r in trace.comment_refs(src).collect()} == {("AB-1", 2), ("AB-2", 2)}
    ctl = sym(spark, [{"id": "c", "name": "UserController"}, {"id": "m", "kind": "method", "parent": "c", "tags": ["GET /u/{id}", "x"], "signature": "get(id: string)", "summary": "Returns User"}])
    code = trace.endpoints_in_code(ctl)
    spec = spark.createDataFrame([("get", "/u/:id", {"id": "number", "q": "string"}, "Account", "op"), ("post", "/n", {}, None, "p")], "method string, path string, params map<string,string>, response string, symbol_id string")
    got = {(r.type, r.endpoint, r.details) for r in trace.compare_apis(code, spec).collect()}
    assert got == {
        ("missing_in_code", "POST /n", "Exists in spec (p) but not in code"), ("type_mismatch", "GET /u/:id", "Parameter 'id' type mismatch: code='string' spec='number'"),
        ("type_mismatch", "GET /u/:id", "Parameter 'q' exists in spec but missing in code"), ("type_mismatch", "GET /u/:id", "Response type mismatch: code='User' spec='Account'"),
    }


def _mock(texts):
    out = []
    for t in texts:
        v = [0.0] * 8
        for i, ch in enumerate(t):
            v[i % 8] += ord(ch)
        n = sum(x * x for x in v) ** 0.5 or 1.0
        out.append([x / n for x in v])
    return out


def test_retrieval(spark):
    d = spark.createDataFrame([("a", "alpha beta"), ("b", "alpha beta"), ("c", "")], "source string, text string")
    c = retrieval.chunks(d, "source", "text")
    assert c.count() == 2
    vec = retrieval.embedded(c.select(F.col("hash").alias("id"), F.col("content").alias("text")), _mock)
    store = vec.select(F.col("id").alias("hash"), F.lit("s").alias("source"), F.lit("x").alias("symbol_id"), "vector")
    assert [round(r.score, 5) for r in retrieval.top_k(store, _mock(["alpha beta"])[0], 5).collect()] == [1.0, 1.0]
    text = spark.createDataFrame([("\n".join(map(str, range(1, 21))), 5, 6)], "content string, start int, end int")
    assert text.select(retrieval.source_window("content", "start", "end", 1, 3).alias("w")).first().w.asDict() == {"text": "4\n5\n6", "omitted": 1}


def test_upserts_and_schema(spark):
    old = spark.createDataFrame([("a", "x", 5), ("b", "y", 1)], "id string, v string, seq long")
    new = spark.createDataFrame([("a", "z", 2), ("c", "w", 1), ("c", "w2", 2)], "id string, v string, seq long")
    assert {(r.id, r.v) for r in sinks.upsert(old, new, ["id"]).collect()} == {("a", "z"), ("b", "y"), ("c", "w2")}
    legacy = spark.createDataFrame([("a", "n", "class", "f", 3, 1)], "id string, name string, kind string, file string, start_line int, end_line int")
    full = schemas.align(legacy, "symbols")
    assert full.columns == [f.name for f in schemas.schema("symbols").fields]
    ok, bad = schemas.quarantine(full)
    assert (ok.count(), bad.count()) == (0, 1)


def test_search(spark):
    s = sym(spark, [{"id": "b", "name": "Foo_x", "file": "b"}, {"id": "a", "name": "fooYx", "file": "a"}, {"id": "c", "name": "bar"}])
    assert [r.id for r in search.search(s, " foo_x ").collect()] == ["a", "b"]
    assert search.search(s, None, limit=0).count() == 1
