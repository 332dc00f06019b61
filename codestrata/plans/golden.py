"""A small Go module with its rows written by hand: holds the scanner, and what rests on it, against SQL.

The module's files are written to the shared scratch folder and scanned like any other; the SQL is the expected rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions.formatting import format_refs, joined
from codestrata.operators.relations import by_row
from codestrata.sources.scratch import fresh, put

from .rules import Rule, RuleViolation
from .workspace import Workspace, load_workspace

MODULE = "shop.test/golden"
FILES = {
    "go.mod": f"module {MODULE}\n\ngo 1.22\n",
    "main.go": f'''package main

import (
	"fmt"

	side "github.com/acme/side"
	. "{MODULE}/store"
)

const Limit, low = 4, 1

func main() {{
	s := New([32]byte{{}}, Limit)
	fmt.Println(s.Size(), func(a [2]int) int {{ return len("é") }}([2]int{{}}))
	defer side.Close()
}}
''',
    "store/store.go": '''package store

import "errors"

type Key [32]byte
type (
	Box[T any] struct{ items []T }
	Reader interface {
		Read(key [32]byte, p []byte) (n int, err error)
	}
)

var ErrÉtat, errOther = errors.New("x"), error(nil)

func New(key [32]byte, n int) *Box[int] { return pick(key, n) }

func pick(a [Lim * 2]byte, b, c [4]int, d ...[2]int) (out *Box[int]) {
	const inner = 1
	return make(a).b().c(d[0], Map[int, string](e))
}

func (b *Box[T]) Size() int { return len(b.items) }

func (k Key) Hash(m Map[int, [2]int]) [4]byte { return k.sum(m) }

func broken(x int { return 1 }

func after() { (func() {})() }

type Last map[Key]int
''',
    "store/store_test.go": 'package store\n\nimport "testing"\n\nfunc TestNew(t *testing.T) { t.Log(New) }\n',
    "vendor/v/v.go": "package v\n",
}
MAIN, STORE = "main.go", "store/store.go"
#: The rows that the module has, by relation: file, line, column, match, and the relation's own columns.
ROWS = {
    "packages": (("name", "n_files", "n_errors"), [("main.go", 1, 9, "package main", "main", 1, 0), (STORE, 1, 9, "package store", "store", 1, 1)]),
    "files": ((), [(MAIN, 1, 1, "file package main"), (STORE, 1, 1, "file package store")]),
    "types": (("name", "type_kind"), [
        (STORE, 5, 6, "type Key array", "Key", "array"), (STORE, 7, 2, "type Box struct", "Box", "struct"), (STORE, 8, 2, "type Reader interface", "Reader", "interface"),
        (STORE, 30, 6, "type Last map", "Last", "map"),
    ]),
    "functions": (("name", "receiver"), [
        (MAIN, 12, 1, "func main", "main", ""), (STORE, 15, 1, "func New", "New", ""), (STORE, 17, 1, "func pick", "pick", ""), (STORE, 22, 1, "func (*) Size", "Size", "*"),
        (STORE, 24, 1, "func (Key) Hash", "Hash", "Key"), (STORE, 26, 1, "func broken", "broken", ""), (STORE, 28, 1, "func after", "after", ""),
    ]),
    "variables": (("name", "var_kind"), [
        (MAIN, 10, 7, "const Limit", "Limit", "const"), (MAIN, 10, 14, "const low", "low", "const"), (STORE, 13, 5, "var ErrÉtat", "ErrÉtat", "var"), (STORE, 13, 15, "var errOther", "errOther", "var"),
        (STORE, 18, 8, "var inner", "inner", "var"),
    ]),
    "functioncalls": (("callee",), [
        (MAIN, 13, 7, "New([32]byte{}, Limit)", "New"), (MAIN, 14, 2, 'fmt.Println(s.Size(), func(a [2]int) int { return len("é") }([2]int{}))', "fmt.Println"), (MAIN, 14, 14, "s.Size()", "s.Size"),
        (MAIN, 14, 24, 'func(a [2]int) int { return len("é") }([2]int{})', ""), (MAIN, 14, 52, 'len("é")', "len"), (MAIN, 15, 8, "side.Close()", "side.Close"),
        (STORE, 13, 26, 'errors.New("x")', "errors.New"), (STORE, 13, 43, "error(nil)", "error"), (STORE, 15, 50, "pick(key, n)", "pick"),
        (STORE, 19, 9, "make(a).b().c(d[0], Map[int, string](e))", "c"), (STORE, 19, 9, "make(a).b()", "b"), (STORE, 19, 9, "make(a)", "make"), (STORE, 19, 29, "Map[int, string](e)", ""),
        (STORE, 22, 38, "len(b.items)", "len"), (STORE, 24, 56, "k.sum(m)", "k.sum"), (STORE, 28, 16, "(func() {})()", ""),
    ]),
    "dependencies": (("import_path", "within_workspace", "external", "standard_library", "target_package_name"), [
        (MAIN, 4, 2, "dependency fmt (external)", "fmt", False, True, True, ""), (MAIN, 6, 2, "dependency github.com/acme/side (external)", "github.com/acme/side", False, True, False, "side"),
        (MAIN, 7, 2, f"dependency {MODULE}/store (workspace)", f"{MODULE}/store", True, False, False, "."), (STORE, 3, 8, "dependency errors (external)", "errors", False, True, True, ""),
    ]),
}


_folders: dict[str, str] = {}


def workspace(spark: SparkSession) -> Workspace:
    application = spark.sparkContext.applicationId
    if application not in _folders:
        root = fresh(spark, "golden")
        for path, text in FILES.items():
            put(spark, f"{root}/{path}", text.encode())
        _folders[application] = root
    return load_workspace(spark, _folders[application])


def _own_file(column: str):
    return F.regexp_replace(column, r"^.*/golden-[0-9a-f]+/", "")


def _rows(spark: SparkSession, relation: str) -> DataFrame:
    ws = workspace(spark)
    frame = getattr(ws, "function_calls" if relation == "functioncalls" else relation).frame
    if relation == "packages":
        frame = frame.withColumn("n_files", F.size("files")).withColumn("n_errors", F.size("errors"))
    return frame.select(_own_file("filename").alias("filename"), "package_id", "line", "col", "kind", "match", *ROWS[relation][0])


def _literal(value) -> str:
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else f"CAST({value} AS INT)" if isinstance(value, int) and not isinstance(value, bool) else str(value)


def _rows_sql(relation: str) -> str:
    own, rows = ROWS[relation]
    columns = ["filename", "package_id", "line", "col", "kind", "match", *own]
    kind = {"packages": "package", "files": "file", "dependencies": "dependency"}.get(relation, relation[:-1])
    out = []
    for f, line, col, match, *rest in rows:
        values = [f, MODULE if f == MAIN else f"{MODULE}/store", line, col, kind, match, *rest]
        out.append("SELECT " + ", ".join(f"{_literal(v)} AS {c}" for c, v in zip(columns, values)))
    return "\nUNION ALL ".join(out)


def _texts(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    made = spark.createDataFrame(rows, "name string, text string")
    return made.withColumn("text", F.regexp_replace("text", r"[^ \n]*/golden-[0-9a-f]+/", ""))


def _reports(spark: SparkSession) -> DataFrame:
    """What rules and formatting say of the module, as text."""
    ws = workspace(spark)
    exported = ws.types.is_exported().name_matches_regex("(?i)^(KEY|LAST)$").refs()
    rows = [("format_refs", format_refs(exported)), ("joined", joined(exported, "; ")), ("format_refs_empty", format_refs(exported.where("false")))]
    state = ws.variables.name_matches_regex("(?i)^ERRétat$").refs()
    rows.append(("unicode_case", joined(state, "; ")))
    rows.append(("by_row_names", joined(ws.functions.name_matches(by_row(lambda n: n[::-1] == "weN")).refs(), "; ")))
    rows.append(("by_row_matcher", joined(ws.function_calls.matching(by_row(lambda c: len(c.callee) == 10)).refs(), "; ")))
    for name, rule in (
        ("violated", Rule("no side").dependencies().depend_on("github.com/...")), ("kept", Rule("no sql").dependencies().depend_on("database/...")),
        ("missing", Rule("has Open").functions().name_matches_regex("^Open$").should_exist()), ("found", Rule("has New").functions().name_matches_regex("^New$").should_exist()),
        ("misconfigured", Rule("empty").functions()),
    ):
        try:
            rule.test(ws)
            rows.append((name, "holds"))
        except RuleViolation as e:
            rows.append((name, str(e)))
    return _texts(spark, rows)


REPORTS = [
    ("format_refs", "* store/store.go:5:6 type Key array\n* store/store.go:30:6 type Last map"), ("joined", "store/store.go:5:6 type Key array; store/store.go:30:6 type Last map"), ("format_refs_empty", ""),
    ("unicode_case", "store/store.go:13:5 var ErrÉtat"), ("by_row_names", "store/store.go:15:1 func New"), ("by_row_matcher", 'main.go:15:8 side.Close(); store/store.go:13:26 errors.New("x")'),
    ("violated", f'rule "no side" violated: 1 match(es)\nmain.go:6:2 package {MODULE} dependency github.com/acme/side (external)'), ("kept", "holds"),
    ("missing", 'rule "has Open" not satisfied: expected at least one match but found none'), ("found", "holds"), ("misconfigured", 'rule "empty" misconfigured: no matcher configured'),
]

QUERIES = {f"scan_{r}": (lambda spark, sf, r=r: _rows(spark, r)) for r in ROWS} | {"scan_reports": lambda spark, sf: _reports(spark)}
ORACLES = {f"scan_{r}": _rows_sql(r) for r in ROWS} | {"scan_reports": "\nUNION ALL ".join(f"SELECT {_literal(n)} AS name, {_literal(t)} AS text" for n, t in REPORTS)}
