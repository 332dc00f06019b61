import os
import time

import pytest
from pyspark.sql import functions as F

from codestrata.plans import workspace as W
from codestrata.plans.rules import Rule, RuleError, RuleViolation
from codestrata.sources import snapshot
from codestrata.sources.goparse import parse, unquote
from codestrata.sources.scan import build_fits, name_fits, scan, tags

M = "shop.test/store"
SOURCES = {
    "go.mod": f"module {M}\n\ngo 1.22\n",
    "main.go": f'package main\n\nimport (\n\t"fmt"\n\t. "{M}/orders"\n\tstock "{M}/stock"\n)\n\nfunc main() {{\n\to := Open(stock.Shelf{{}})\n\tfmt.Println(o.Total())\n}}\n',
    "orders/order.go": 'package orders\n\nimport "errors"\n\ntype Order struct{ n int }\n\ntype lines []int\n\nvar ErrEmpty, errLate = errors.New("empty"), errors.New("late")\n\nconst Limit = 3\n\nfunc Open(x any) *Order { return &Order{} }\n\nfunc (o *Order) Total() int { return o.n }\n',
    "orders/order_test.go": 'package orders\n\nimport "testing"\n\nfunc TestOpen(t *testing.T) { Open(nil) }\n',
    "orders/win_windows.go": "package orders\n\nfunc OnlyThere() {}\n",
    "orders/tagged.go": "//go:build ignore || (windows && !cgo)\n\npackage orders\n\nfunc Tagged() {}\n",
    "stock/shelf.go": "package stock\n\ntype Shelf struct{}\n",
    "vendor/x/x.go": "package x\n", "testdata/y.go": "package y\n", "_skip/z.go": "package z\n", "other/go.mod": "module other\n", "other/o.go": "package other\n",
}


def lay(folder, sources=SOURCES):
    for name, text in sources.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(folder)


@pytest.fixture(scope="module")
def ws(spark, tmp_path_factory):
    return W.load_workspace(spark, lay(tmp_path_factory.mktemp("mod")))


def test_scanned_relations(ws):
    assert [(r["id"], r["name"], [os.path.basename(f) for f in r["files"]]) for r in ws.packages.all()] == [(M, "main", ["main.go"]), (f"{M}/orders", "orders", ["order.go"]), (f"{M}/stock", "stock", ["shelf.go"])]
    assert [(r["name"], r["type_kind"], r["line"], r["col"], r["match"]) for r in ws.types.all()] == [("Order", "struct", 5, 6, "type Order struct"), ("lines", "array", 7, 6, "type lines array"), ("Shelf", "struct", 3, 6, "type Shelf struct")]
    assert [(r["name"], r["receiver"], r["match"]) for r in ws.functions.all()] == [("main", "", "func main"), ("Open", "", "func Open"), ("Total", "*Order", "func (*Order) Total")]
    assert [(r["name"], r["var_kind"], r["line"], r["col"]) for r in ws.variables.all()] == [("ErrEmpty", "var", 9, 5), ("errLate", "var", 9, 15), ("Limit", "const", 11, 7)]
    assert [(r["callee"], r["line"], r["col"], r["match"]) for r in ws.function_calls.all()] == [("Open", 10, 7, "Open(stock.Shelf{})"), ("fmt.Println", 11, 2, "fmt.Println(o.Total())"), ("o.Total", 11, 14, "o.Total()"), ("errors.New", 9, 25, 'errors.New("empty")'), ("errors.New", 9, 46, 'errors.New("late")')]
    assert [(r["import_path"], r["within_workspace"], r["standard_library"], r["target_package_name"], r["line"], r["col"]) for r in ws.dependencies.all()] == [("fmt", False, True, "", 4, 2), (f"{M}/orders", True, False, ".", 5, 2), (f"{M}/stock", True, False, "stock", 6, 2), ("errors", False, True, "", 3, 8)]
    assert ws.module_root() == M and ws.packages.match(lambda c: c.name == "stock").first()["line"] == 1
    assert ws.files.match(lambda c: F.lit(True)).first()["match"] == "file package main"


def test_partitions_of_each_relation(ws):
    assert ws.types.is_exported().len() + ws.types.is_unexported().len() == ws.types.len()
    assert ws.functions.is_method().len() + ws.functions.is_function().len() == ws.functions.len()
    assert ws.dependencies.is_within_workspace().len() + ws.dependencies.is_external().len() == ws.dependencies.len()


def test_tests_are_loaded_if_asked_for(spark, tmp_path):
    frames = scan(spark, lay(tmp_path), include_tests=True)
    assert frames["functions"].where("name = 'TestOpen'").count() == 1


def test_errors_of_a_load(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        scan(spark, lay(tmp_path / "a", {"x.go": "package x\n"}))
    with pytest.raises(FileNotFoundError):
        scan(spark, lay(tmp_path / "b", {"go.mod": "module m\n", "note.txt": ""}))
    broken = scan(spark, lay(tmp_path / "c", {"go.mod": "module m\n", "x.go": "package x\n\nfunc f( {\n"}))
    assert broken["packages"].first()["errors"][0]["pos"].endswith("x.go:3:9")


def test_graph_and_facade(ws):
    assert [r["id"] for r in ws.package_graph().transitive_dependencies(M).collect()] == [f"{M}/orders", f"{M}/stock"]
    assert W.match_types(ws, lambda c: c.name == "Order").count() == 1 and W.match_types(None, lambda c: c.name == "Order") is None
    assert W.match_dependencies(ws, None).count() == 0
    assert ws.import_tree().child("shop.test").child("store").child("orders").n_deps == 1
    ws.create_views("w_")
    assert ws.types.frame.sparkSession.sql("SELECT count(*) FROM w_types").first()[0] == 3


def test_rules(ws):
    Rule("ok").dependencies().in_package(f"{M}/orders/...").depend_on(f"{M}/stock/...").test(ws)
    with pytest.raises(RuleViolation, match=r'rule "no" violated: 2 match\(es\)\n\* .*main.go:5:2 package shop.test/store dependency shop.test/store/orders \(workspace\)\n\* '):
        Rule("no").dependencies().is_within_workspace().test(ws)
    with pytest.raises(RuleViolation, match="not satisfied: expected at least one match but found none"):
        Rule("r").types().name_matches_regex("^Nope").should_exist().test(ws)
    Rule("r").types().in_package(f"{M}/stock").name_matches(lambda n: n == "Shelf").should_exist().test(ws)
    for rule in (Rule("m").packages(), Rule("m").files(), Rule("m").types(), Rule("m").functions(), Rule("m").variables(), Rule("m").function_calls()):
        with pytest.raises(RuleError, match="no matcher configured"):
            rule.evaluate(ws)
        with pytest.raises(RuleViolation, match='rule "m" misconfigured: no matcher configured'):
            rule.test(ws)
    with pytest.raises(RuleError, match="workspace is nil"):
        Rule("n").dependencies().evaluate(None)
    assert Rule("d").dependencies().evaluate(ws).count() == 4
    assert Rule("p").packages().should_exist().evaluate(ws).count() == 3
    assert Rule("or").types().in_package(f"{M}/orders").in_package(f"{M}/stock").is_exported().evaluate(ws).count() == 2
    assert Rule("last").functions().is_method().is_function().is_exported().is_unexported().evaluate(ws).count() == 1
    assert Rule("slot").functions().name_matches_regex("^Open$").name_matches(lambda n: n == "Total").evaluate(ws).count() == 1
    assert Rule("both").dependencies().is_standard_library().is_third_party().evaluate(ws).count() == 0
    assert Rule("recv").functions().is_method().has_receiver("").evaluate(ws).count() == 1
    assert Rule("test").files().is_test().is_not_test().match(lambda c: F.lit(True)).evaluate(ws).count() == 3


def test_disk_cache(spark, tmp_path):
    source, cache = lay(tmp_path / "m"), str(tmp_path / "cache")
    first = snapshot.fingerprint(source)
    assert snapshot.fingerprint(source) == first
    (tmp_path / "m/vendor/x/x.go").write_text("package x // changed\n")
    assert snapshot.fingerprint(source) == first
    assert snapshot.fingerprint(lay(tmp_path / "n")) != first
    said = []
    fresh = W.load_workspace(spark, source, disk_cache_dir=cache, reporter=said.append)
    assert len(os.listdir(cache)) == 1 and "loaded from the disk cache" not in said
    again = W.load_workspace(spark, source, disk_cache_dir=cache, reporter=said.append)
    assert said[-1] == "loaded from the disk cache"
    for name, frame in fresh.frames().items():
        assert sorted(map(str, frame.collect())) == sorted(map(str, again.frames()[name].collect())), name
    path = os.path.join(cache, first)
    (tmp_path / "cache" / first / "meta.json").write_text("{")
    assert snapshot.read(spark, path) is None and snapshot.read(spark, path + "x") is None
    (tmp_path / "cache" / first / "meta.json").write_text('{"version": -1}')
    assert snapshot.read(spark, path) is None
    time.sleep(0.01)
    (tmp_path / "m/main.go").write_text("package main\n")
    assert snapshot.fingerprint(source) != first
    root = tmp_path / "vendor"
    assert snapshot.fingerprint(lay(root)) != snapshot.fingerprint(lay(tmp_path / ".hidden"))


def test_memory_cache(spark, tmp_path):
    source = lay(tmp_path)
    assert W.load_workspace(spark, source, in_memory=True) is W.load_workspace(spark, source, in_memory=True)
    assert W.load_workspace(spark, source) is not W.load_workspace(spark, source)


def test_names_and_constraints():
    holds = tags()
    assert name_fits("a.go", holds) and name_fits("linux.go", holds) and name_fits("a_linux.go", holds) and name_fits("a_linux_amd64_test.go", holds)
    assert not name_fits("a_windows.go", holds) and not name_fits("a_linux_arm64.go", holds) and name_fits("a_b.go", holds)
    assert build_fits(b"//go:build linux && (amd64 || arm64) && !ignore\n\npackage x\n", holds) and not build_fits(b"// c\n//go:build ignore\npackage x\n", holds)
    assert build_fits(b"package x\n//go:build ignore\n", holds)


def test_literals():
    assert unquote('"a\\x41\\u00e9\\n"') == "aAé\n" and unquote("`a\\n`") == "a\\n" and unquote('"\\q"') is None


CODE = b"""package x
import ( . "a"; _ "b" )
type T[P any, Q ~int|string] struct { A[int]; b []int; *C; d.E `tag`; f func(int) (x, y int) }
type U [N*2]int
type W = map[string]chan<- int
type X interface { M(a, b int) error; ~int | Y[int]; fmt.Stringer }
func (s *Stack[T]) Push(v T) { s.items = append(s.items, v) }
func (s Stack[T]) Len() int { const k = 3; var q, r = f[int](1), (g)(2); type loc int; return len(s.items) }
func gen[K comparable, V any](m map[K]V, f func(K) V) (out []V, err error) {
  if x, ok := m[k]; ok && (T{1}) == y { a().b() } else if z := (S{}); z.ok() { }
  for i := range 10 { c[i].D(func() { inner() }) }
  switch v := x.(type) { case int, []string: h(v); case nil: default: go func() { w() }() }
  select { case <-ch: p(); case ch <- v: case y := <-ch: q(y) }
L: for ;; { continue L }
  _ = []byte("x"); x := map[string][]T{"a": {{1, 2}, {f(3), 4}}}; y := &T{A: 1, B: []int{1,2}}
  return struct{ a int }{1}, func() error { return nil }()
}
"""


def test_parser_quirks():
    p = parse(CODE)
    assert p.error is None
    assert [(r[3], r[4]) for r in p.types] == [("T", "struct"), ("U", "array"), ("W", "map"), ("X", "interface"), ("loc", "type")]
    assert [(r[3], r[4]) for r in p.functions] == [("Push", "*"), ("Len", ""), ("gen", "")]
    assert [(r[3], r[4]) for r in p.variables] == [("k", "var"), ("q", "var"), ("r", "var")]
    assert [r[3] for r in p.calls] == ["append", "", "", "len", "b", "a", "z.ok", "D", "inner", "h", "", "w", "p", "q", "", "f", ""]
    assert [r[2:] for r in p.imports] == [("a", "."), ("b", "_")]


def test_columns_count_bytes():
    p = parse('package x\nvar é, b = 1, f("ü", g())\n'.encode())
    assert [r[:2] for r in p.variables] == [(2, 5), (2, 9)] and [r[:2] for r in p.calls] == [(2, 16), (2, 24)]
    assert parse(b"package x\nvar a = \"open\n").error[0] == "2:9"


def test_reports(spark, tmp_path):
    from codestrata.report import cache_report, load_report

    said = []
    load_report(spark, lay(tmp_path / "m"), said.append)
    assert any("packages 3, files 3" in s for s in said)
    assert set(cache_report(spark, str(tmp_path / "m"), str(tmp_path / "c"), said.append)) == {"cold", "warm"}


ARRAYS = b"""package p

type I interface {
	Put(key [32]byte, m M[string, int]) [4]int
	Get(a, b [N * 2]byte) (out [N]int, err error)
	M[int, string]
}

func f1(key [32]byte) int { return c1(key) }
func f2(a, b [4]int, c [N*2]byte, d ...[2]int) (x [4]int, y M[int, string]) { return c2(a) }
func f3(m M[K, V], M[int, int]) { c3() }
func f4[T [4]int | ~string, U M[string, [2]int]](t T, fn func([3]int, x [2]string) [2]bool) { k := func(z [len("ab")]int) {}; k(z) }
func (r *R) m1(p [N][2]string, q []int, s map[[2]int]string) *[3]byte { return r.c4(p) }
func f5(x pkg.G[int], y *pkg.G[[2]int], w [2]pkg.G[int], v ...G[int]) { c5() }
func f6() M[int, string] { return c6() }
func f7(a [4]*int, b [4]func(), c [4]chan int, d [4]struct{ e int }, e [4]interface{}, f [4](int), g [4]<-chan int) { c7() }
"""


def test_array_parameters_of_every_kind():
    p = parse(ARRAYS)
    assert p.error is None and [r[3] for r in p.functions] == ["f1", "f2", "f3", "f4", "m1", "f5", "f6", "f7"]
    assert [r[3] for r in p.calls] == ["c1", "c2", "c3", "len", "k", "r.c4", "c5", "c6", "c7"]


def test_a_syntax_error_costs_no_later_declaration():
    p = parse(b"package p\nfunc a(x int { b() }\n\nfunc c() { d() }\ntype T struct{ x [}\nvar v = '\nconst k = \"x\nfunc e() { g() }\n\x01\ntype U int\n")
    assert [r[3] for r in p.functions] == ["a", "c", "e"] and [r[3] for r in p.calls] == ["d", "g"] and [r[3] for r in p.types] == ["T", "U"] and p.error[0] == "2:14"
    assert [r[3] for r in p.variables] == ["v", "k"] and parse(b"").error and parse(b"\x00").error
