from lodegraph.sources import ingest, sinks
from lodegraph.streaming import incremental


def values(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "value string")


def test_scan(spark, tmp_path):
    for p, t in (("src/a.ts", "class A {}"), ("src/node_modules/b.ts", "x"), ("c.md", "x"), ("big.py", "y" * 100)):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    assert {r.path for r in ingest.scan(spark, str(tmp_path), ["**.ts", "*.py"], max_size=50).collect()} == {"src/a.ts"}


def test_symbols_of_sources(spark):
    py = "class A:\n    def __init__(self): pass\n    def m(self, x: int) -> str:\n        '''Doc.'''\n        return ''\ndef f(): pass\n"
    ts = "/** d */\nexport class B {\n  run(a: string): void {\n    if (a) { x(); }\n  }\n}\n"
    df = spark.createDataFrame([("a.py", py), ("b.ts", ts), ("bad.py", "def ("), ("x.zig", "y"), ("n.go", None)], "path string, content string")
    got = {(r.file, r.name, r.kind, r.start_line, r.end_line) for r in ingest.extract_symbols(df).collect()}
    assert got == {("a.py", "A", "class", 1, 5), ("a.py", "__init__", "constructor", 2, 2), ("a.py", "m", "method", 3, 5), ("a.py", "f", "function", 6, 6), ("b.ts", "B", "class", 2, 6), ("b.ts", "run", "method", 3, 5)}


def test_lcov(spark):
    text = "TN:\nSF:./src/a.ts\nFN:5,greet\nFNDA:12,greet\nDA:5,12\nDA:6,0\nend_of_record\nSF:b.ts\nDA:1,3\nend_of_record\n"
    assert {tuple(r) for r in ingest.lcov(values(spark, text, "garbage", "")).collect()} == {("src/a.ts", 5, 12), ("src/a.ts", 6, 0), ("b.ts", 1, 3)}
    assert [tuple(r) for r in ingest.lcov_functions(values(spark, text)).collect()] == [("./src/a.ts", "greet", 5, 12)]


def test_diff_and_log(spark):
    text = "diff --git a/x.ts b/x.ts\nindex 1..2\n--- a/x.ts\n+++ b/x.ts\n@@ -1,2 +1,3 @@\n a\n+b\n@@ -9 +10 @@\n-c\n+d\ndiff --git a/n.ts b/n.ts\nnew file mode 100644\n"
    got = [(r.file, r.status, r.idx, r.new_start, r.new_lines) for r in ingest.git_diff(values(spark, text)).orderBy("file", "idx").collect()]
    assert got == [("n.ts", "added", -1, 0, 0), ("x.ts", "modified", 0, 1, 3), ("x.ts", "modified", 1, 10, 1)]
    log = "AB-1 fix|||\na.ts\nb.ts\n\nAB-2 more|||\nc.ts\n"
    assert [(r.message, r.files) for r in ingest.git_log(values(spark, log)).collect()] == [("AB-1 fix", ["a.ts", "b.ts"]), ("AB-2 more", ["c.ts"])]


def test_front_matter_and_discovery(spark):
    df = spark.createDataFrame([("a.md", '---\ntitle: "T"\nsymbols:\n  - A\n  - "B"\n---\nbody'), ("b.md", "---\nsymbols: [X, Y]\n---\n"), ("m/c-d.md", "plain")], "path string, content string")
    got = {r.path: r for r in ingest.front_matter(df).collect()}
    assert (got["a.md"].title, got["a.md"].symbols, got["a.md"].body) == ("T", ["A", "B"], "body")
    assert got["b.md"].symbols == ["X", "Y"] and got["m/c-d.md"].symbols is None
    assert {tuple(r) for r in ingest.discovered_docs(df).collect()} >= {("m/c-d.md", "C D", "m")}


def test_openapi(spark):
    spec = '{"paths": {"/u/{id}": {"parameters": [{"name": "id", "schema": {"type": "string"}}], "get": {"operationId": "g", "responses": {"200": {"content": {"application/json": {"schema": {"$ref": "#/c/User"}}}}}}}}}'
    r = ingest.openapi(values(spark, spec)).collect()
    assert [(x.method, x.path, x.params, x.response, x.symbol_id) for x in r] == [("GET", "/u/:id", {"id": "string"}, "User", "g")]


def test_stream_and_windows(spark, tmp_path):
    inbox, store = tmp_path / "in", tmp_path / "out"
    spark.createDataFrame([("a.py", "def f(): pass", 1)], "path string, content string, seq long").write.parquet(str(inbox / "1"))
    spark.read.parquet(str(inbox / "1")).write.mode("append").parquet(str(inbox))
    incremental.index_stream(spark, str(inbox), str(store), str(tmp_path / "cp")).awaitTermination(60)
    assert {r.name for r in spark.read.parquet(str(store)).collect()} == {"f"}
    ev = spark.sql("select timestamp'2025-01-01 00:00:00' ts, 1L user_id, 'x' event_type, 1.0D value union all select timestamp'2025-01-01 00:10:00', 1L, 'x', 2.0D union all select timestamp'2025-01-01 02:00:00', 1L, 'x', 3.0D")
    assert sorted(r.n for r in incremental.sessions(ev).collect()) == [1, 2]
    assert [r.total for r in incremental.tumbling(ev).collect()] == [6.0]
    assert incremental.sliding(ev).count() == 2


def test_matrix_text(spark):
    m = spark.createDataFrame([("A-1", "symbol", 'x"y')], "ticket string, role string, value string")
    assert [r.line for r in sinks.matrix_text(m).collect()][-1] == '| A-1 | symbol | x"y |'
    assert [r.line for r in sinks.matrix_text(m, "csv").collect()] == ["ticket,role,value", '"A-1","symbol","x""y"']
