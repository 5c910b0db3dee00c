import numpy as np
import pytest

from lodegraph.llm import docpairs as P

SIG = "splitReceiptDigest(ward: string, slot: int): float"


@pytest.mark.parametrize("comment", [
    "", "//", "/** */", '"""?"""', "N/A", "// tbd", "see above", "siehe oben", "Getter.", "TODO(parse): describe\n@param value", "@param {string} ward\n@returns {string}", "@inheritdoc", "{@inheritDoc}",
    "// eslint-disable-next-line no-console", "return this.ward.get(ward);", "const a = load(b);\nif (a) return a;", "Splits the receipt digest.", "This method splits the receipt digest.", "Split receipt digest and returns float",
    "words words words, filler filler", "Auto-generated method stub", "------------------", "Parameters:\n    ward: string", "@since 1.2\n@internal", "TODO: remove after the migration.", "x",
])
def test_says_nothing(comment):
    assert P.description(comment, SIG, "splitReceiptDigest") is None


@pytest.mark.parametrize("comment", [
    "Caller must hold the write lock on the slot.", "// Splits the receipt digest. Two passes are needed here.", "/**\n * TODO: remove after the migration.\n * Skips every queue that was closed before the cut-off.\n */",
    "Wird nachts aufgerufen, damit der ward vor Geschäftsbeginn wieder zum slot passt.", "Debe llamarse antes de cerrar el token, de lo contrario se pierde.", "# of orders still waiting for a batch, counting the open ones twice.",
    "See above for why the slot is copied: it is changed in place by its owner.", "Getter with a side effect: touching the slot extends its life by 5 minutes.", "@param ward must never be older than the last settlement", "@deprecated use the batch loader instead, it keeps order",
    "夜間に呼び出されて在庫を合わせる", '"""Rounds half up because\n    the downstream system rejects decimals.\n    """',
])
def test_says_something(comment):
    assert P.description(comment, SIG, "splitReceiptDigest")


def test_as_of_join():
    f, c, s = np.array([10, 20, 30, 40]), np.array([8, 25, 27, 45]), np.array([10, 20, 26, 30, 40])
    assert P.attach(f, c, s).tolist() == [0, -1, 2, -1]
    assert P.attach(f, np.zeros(0, int), s).tolist() == [-1] * 4
    assert P.attach(np.zeros(0, int), c, s).tolist() == []


def test_rows(spark):
    rows = [("A", 1, "method", "f", "f()", "Caller must hold the write lock.", "x"), ("A", 2, "method", "f", "f()", "tbd", "x"), ("b", 1, "function", "g", " ", "Caller must hold the write lock.", None), ("c", 1, "class", "h", "h()", "Caller must hold the write lock.", None), ("d", 1, "function", None, "d()", "Caller must hold\r\nthe write lock.", None), ("e", 1, "function", "e", "e()", None, None), ("E2", 1, "function", "e", "e()", "Caller must hold the write lock.", None), (None, 1, "function", "e", "e()", "Caller must hold the write lock.", None), ("long", 1, "function", "e", "e()", "the lock " * 50_000 + "must hold while writing", None)]
    df = spark.createDataFrame(rows, "id string, seq long, kind string, name string, signature string, doc_comment string, key string")
    assert {r.symbol_id for r in P.documented(df.unionByName(df)).collect()} == {"d", "E2", "long"}
    assert P.documented(df.where("false")).count() == 0


def test_source_files(spark):
    go = "package a\n\n// Holds the write lock until the batch is stored.\nfunc (s *T) Store(x int) int {\n\treturn 1\n}\n\n// Stray remark about nothing in particular here.\nvar y = 1\nfunc Bare() {}\n"
    py = "def f(x):\n    '''Rounds half up because the ledger rejects decimals.'''\n    return x\n\n# Keeps the last entries in memory.\n@cache\ndef g(): pass\n\ndef h():\n    return 'Rounds half up because the ledger says so'\n"
    ts = "const s = '// not a comment for this function';\n/** Drops what the importer has not confirmed. */\nexport async function load(a: string): Promise<void> {\n}\n"
    df = spark.createDataFrame([("a.go", 1, go), ("b.py", 1, "old"), ("b.py", 2, py), ("c.ts", 1, ts), ("d.rb", 1, "x"), ("e.js", 1, None), (None, 1, "x")], "path string, seq long, content string")
    assert {(r.file, r.name, r.line) for r in P.documented_in_files(df).collect()} == {("a.go", "Store", 4), ("b.py", "f", 1), ("b.py", "g", 7), ("c.ts", "load", 3)}
