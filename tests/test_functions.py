import pytest
from pyspark.sql import functions as F

from codestrata.functions.formatting import RefFormat, format_ref, join_refs, ref_text
from codestrata.functions.modules import Module, module_root
from codestrata.functions.patterns import is_exported, is_test_file, package_matches
from codestrata.functions.re2 import to_java

PATTERNS = [
    ("a.io/p/domain", ["a.io/p/domain"], True), ("a.io/p/domain", ["a.io/p/domain/..."], True), ("a.io/p/domain/sub", ["a.io/p/domain/..."], True),
    ("a.io/p/other", ["a.io/p/domain/..."], False), ("a.io/p", [], False), ("a/bc", ["a/b/..."], False), ("a", [""], False), ("a", ["/..."], False), ("", ["/..."], False),
    ("...", ["..."], True), ("a", ["..."], False), ("a_b", ["a%b", "axb"], False), ("x/y", ["a", "x/..."], True),
]


def _value(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("v")).first()["v"]


def test_package_patterns(spark):
    for value, patterns, expected in PATTERNS:
        assert _value(spark, package_matches(F.col("x"), *patterns), x=value) is expected, (value, patterns)


def test_patterns_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([("a/b",)], "x string").write.parquet(str(tmp_path / "t"))
    plan = spark.read.parquet(str(tmp_path / "t")).where(package_matches(F.col("x"), "a/..."))._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(x,a/)" in plan


@pytest.mark.parametrize("name,test", [("pkg/foo_test.go", True), ("pkg\\foo_test.go", True), ("pkg/foo.go", False), ("test.go", False)])
def test_test_files(spark, name, test):
    assert _value(spark, is_test_file(F.col("x")), x=name) is test


@pytest.mark.parametrize("name,exported", [("Order", True), ("Éa", True), ("𐐀a", True), ("order", False), ("_X", False), ("", False), ("ǅa", False)])
def test_exported(spark, name, exported):
    assert _value(spark, is_exported(F.col("x")), x=name) is exported


FOUND = [
    (r"b$", "ab\n", False), (r"b$", "ab", True), (r"(?m)b$", "ab\nc", True), (r"(?P<n_1>a)b", "ab", True), (r"[[:alpha:]]+1", "a1", True), (r"[[:alpha:]]+1", ":1", False),
    (r"x.y", "x\ry", True), (r"x.y", "x\ny", False), (r"(?s)x.y", "x\ny", True), (r"a\sb", "a\x0bb", False), (r"a\sb", "a\tb", True), (r"[\s]", "\x0b", False), (r"[\S]", " ", False),
    (r"\bé", "é", False), (r"\bab\b", "x ab.", True), (r"[[a]", "[", True), (r"[a&&b]", "&", True), (r"a{,2}", "a{,2}", True), (r"\pL+$", "éa", True), (r"\p{Greek}", "α", True), (r"\P{Greek}", "α", False),
    (r"\x{41}", "A", True), (r"\Qa.b\E", "axb", False), (r"[^[:^digit:]]", "5", True), (r"[]a]", "]", True), (r"(?i)AB", "ab", True), (r"(?i)é", "É", True), (r"(?i)ж", "Ж", True), (r"(?i:é)é", "Éé", True), (r"(?i:é)é", "ÉÉ", False), (r"(?i)a(?-i)é", "AÉ", False), (r"é", "É", False), (r"a{2,3}", "aa", True), (r"\v", "\x0b", True), (r"a|b*", "", True),
]


def test_re2_patterns(spark):
    for pattern, text, found in FOUND:
        assert _value(spark, F.col("x").rlike(to_java(pattern)), x=text) is found, (pattern, text)


@pytest.mark.parametrize("pattern", ["(", ")", "[a", "a**", "a++", "*a", r"\1", "(?=a)", "(?!a)", "(?<=a)b", "(?>a)", "a{1001}", "[[:nope:]]", "(?P<n>a)(?P<n>b)", "(?U)a+", r"\C", "a\\", r"\y"])
def test_patterns_that_re2_has_not(pattern):
    with pytest.raises(ValueError):
        to_java(pattern)


def test_a_pattern_is_a_string():
    with pytest.raises(TypeError):
        to_java(None)


REF = {"ord": 0, "package_id": "a.io/p", "package_name": "p", "filename": "x.go", "line": 12, "col": 7, "kind": "function", "match": "func F"}
FORMATS = [
    ({}, RefFormat(), "x.go:12:7 func F"), ({}, RefFormat(package=True), "x.go:12:7 package a.io/p func F"), ({}, RefFormat(column=False), "x.go:12 func F"),
    ({}, RefFormat(file=False), "line=12:7 func F"), ({"line": 0}, RefFormat(file=False), "column=7 func F"), ({"line": 0}, RefFormat(), "x.go:7 func F"),
    ({"filename": "", "line": 0, "col": 0}, RefFormat(match=False, kind=True), "function"), ({}, RefFormat(kind=True), "x.go:12:7 func F"), ({"match": ""}, RefFormat(kind=True), "x.go:12:7 function"),
    ({k: "" for k in ("package_id", "filename", "kind", "match")} | {"line": 0, "col": 0}, RefFormat(), "ref"), ({"filename": "", "match": "", "line": 0, "col": 0}, RefFormat(), "function"),
]


def test_formatted_refs(spark):
    for changes, options, expected in FORMATS:
        ref = REF | changes
        assert ref_text(ref, options) == expected
        assert _value(spark, format_ref(options), **ref) == expected


def test_joined_refs():
    assert join_refs([]) == ""
    assert join_refs(["a"]) == "a"
    assert join_refs(["a", "b"]) == "* a\n* b"
    assert join_refs(["a", "b"], "") == "ab"
    assert join_refs(["a", "b"], " | ") == "a | b"


@pytest.mark.parametrize("ids,root", [([], ""), (["a/b"], "a/b"), (["a/foo", "a/foobar"], "a/foo"), (["foo", "fob"], "fo"), (["a.io/x/p", "a.io/x/q"], "a.io/x"), (["a.io/x", "a.io/x/q"], "a.io/x")])
def test_module_root(ids, root):
    assert module_root(ids) == root


def test_module_patterns():
    m = Module("a.io/x")
    assert m.pkg("domain/...") == "a.io/x/domain/..." and m.pkgs("a", "b") == ["a.io/x/a", "a.io/x/b"]
