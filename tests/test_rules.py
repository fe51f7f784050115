"""Classifier, naming, layers and fields: one input, one answer."""

import pytest
from pyspark.sql import functions as F

from repograph.functions import rules, text

PATHS = {
    "src/app/service.py": "source", "tests/test_a.py": "test", "src/test_a.py": "test", "a/b.spec.ts": "test", "src/my_testimony.py": "test", "node_modules/x/index.js": "vendor",
    "docs/build/x.py": "docs", "build/docs/x.md": "build", ".github/ci.yml": "build", "logo.PNG": "asset", "setup.py": "config", ".app.yaml": "config", "app.yaml": "unknown",
    "README.md": "docs", "db/migrations/0001_x.py": "migration", "20240101_add.sql": "migration", "src/gen/a.py": "generated", "a_pb2.py": "generated", "Makefile": "config", "x.zzz": "unknown", "src\\win\\a.py": "source",
}
NAMES = [
    ("python", "get_item", "function", True), ("python", "getItem", "function", False), ("python", "__init__", "method", True), ("python", "_x", "function", True), ("python", "i", "function", True), ("python", "Item", "class", True), ("python", "_Item", "class", True), ("python", "item", "class", False),
    ("java", "getItem", "method", True), ("java", "get_item", "method", False), ("java", "Item", "class", True), ("typescript", "View", "function", True), ("typescript", "_view", "function", False), ("typescript", "view", "class", False), ("unknown", "$$", "function", True),
]


def column(spark, values, f):
    df = spark.createDataFrame([(i, *v) if isinstance(v, tuple) else (i, v) for i, v in enumerate(values)])
    return [r[0] for r in df.orderBy("_1").select(f(*[F.col(c) for c in df.columns[1:]])).collect()]


def test_categories(spark):
    assert column(spark, list(PATHS), rules.category) == list(PATHS.values())


def test_generated_by_first_line(spark):
    df = spark.createDataFrame([("src/a.py", "# Code generated by x"), ("src/a.py", None)], "p string, l string")
    assert [r[0] for r in df.select(rules.category(F.col("p"), F.col("l"))).collect()] == ["generated", "source"]


def test_naming(spark):
    got = column(spark, [(n, lang, kind) for lang, n, kind, _ in NAMES], rules.naming_ok)
    assert got == [ok for *_, ok in NAMES]


def test_layers(spark):
    paths = ["src/domain/a.py", "domain/a.py", "web/components/x.tsx", "src/x/OrderRepository.java", "src/x/user_service.py", "src/utils.py", "x/main.go"]
    assert column(spark, paths, rules.layer) == ["Domain", "Other", "Frontend", "Infra", "Application", "Shared", "Other"]


def test_repo_parts(spark):
    df = spark.createDataFrame([("https://host.example/a/b.git/",), ("https://host.example/a/b/tree/x",)], "u string")
    assert [tuple(r[0]) for r in df.select(rules.repo_parts(F.col("u"))).collect()] == [("a", "b"), ("a", "b")]
    with pytest.raises(Exception, match="no repository URL"):
        spark.createDataFrame([("https://host.example/a",)], "u string").select(rules.repo_parts(F.col("u"))).collect()


def test_text_functions(spark):
    df = spark.createDataFrame([("a/b/c/d/e/f.py",), ("x.py",), ("",)], "p string")
    assert [r[0] for r in df.select(text.ancestors(F.col("p"))).collect()] == [["a", "a/b", "a/b/c", "a/b/c/d"], [], []]
    lines = ["", "a", "a\n", "a\r\nb", "\n\n"]
    assert column(spark, lines, text.count_lines) == [len(x.splitlines()) for x in lines]
    assert column(spark, ["{{}{}}", "", "}{"], text.brace_depth) == [2, 0, 0]
    assert column(spark, ["3", "x", "3.7", "-2"], text.to_int) == [3, 0, 0, -2]
