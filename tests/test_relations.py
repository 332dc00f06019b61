import pytest
from pyspark.sql import functions as F

from codestrata.functions.formatting import format_refs, joined
from codestrata.operators.graph import PackageGraph
from codestrata.operators.relations import Dependencies, Files, FunctionCalls, Functions, Packages, Types, Variables, by_row
from codestrata.operators.tree import tree

P = "m.io/app"


def dep(package, path, filename="main.go", within=False):
    return {"package_id": package, "filename": filename, "import_path": path, "within_workspace": within, "external": not within, "standard_library": "." not in path, "line": 1, "col": 1, "kind": "dependency", "match": f"dependency {path}"}


@pytest.fixture(scope="module")
def deps(spark):
    return Dependencies.of(spark, [dep(P, "fmt"), dep(f"{P}/sub", f"{P}/inner", "sub.go", True), dep(P, "testing", "main_test.go"), dep(P, "github.com/org/pkg")])


def test_dependency_filters(deps):
    assert deps.in_package(f"{P}/...").len() == 4 and deps.in_package().len() == 4 and deps.not_in_package().len() == 4
    assert deps.not_in_package(f"{P}/sub/...").len() == 3
    assert deps.is_test().len() == 1 and deps.is_not_test().len() == 3 and deps.in_test().len() == 1 and deps.not_in_test().len() == 3
    assert deps.is_within_workspace().len() == 1 and deps.is_external().len() == 3
    assert deps.is_standard_library().len() == 2 and deps.is_third_party().len() == 1
    assert deps.depend_on("fmt").len() == 1 and deps.depends_on("github.com/org/...").len() == 1 and deps.do_not_depend_on("fmt").len() == 3
    assert deps.in_package(P).in_package(f"{P}/sub").len() == 0
    refs = deps.match(lambda c: c.import_path == "fmt").collect()
    assert len(refs) == 1 and refs[0]["filename"] == "main.go"
    assert deps.match(None).count() == 0
    assert [r["import_path"] for r in deps.all()][0] == "fmt"


def test_python_predicates_run_as_udfs(deps):
    assert deps.match(by_row(lambda c: len(c.import_path) == 3 and c.import_path.upper() == "FMT")).count() == 1
    for wrong in (lambda c: c.name == "and" and c.import_path == "", lambda c: len(c.import_path) == 3, lambda c: None, lambda c: "x"):
        with pytest.raises(Exception):
            deps.match(wrong)
    assert deps.match(lambda c: True).count() == deps.frame.count()


def test_filters_become_one_condition(deps):
    plan = deps.in_package(P).is_not_test().is_external().frame._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Filter") <= 1


def test_tree(spark):
    rows = Dependencies.of(spark, [dep(P, p) for p in ("fmt", "github.com/org/a", "github.com/org/b", "m.io/app/domain", "m.io/app/domain", "x//y", "z/", "")])
    root = tree(rows.frame)
    assert [c.name for c in root.children] == ["fmt", "github.com", "m.io", "x", "z"]
    assert root.child("fmt").n_deps == 1 and not root.child("fmt").children
    assert [c.name for c in root.child("github.com").child("org").children] == ["a", "b"]
    domain = root.child("m.io").child("app").child("domain")
    assert domain.n_deps == 2 and len(domain.dependencies) == 2
    assert root.child("x").child("y").path == "x/y"
    assert root.child("z").n_deps == 0 and not root.child("z").dependencies


def test_exploration(spark):
    pairs = [("app/ui/t", "app/domain"), ("app/ui/t", "app/audio"), ("app/ui/s", "app/domain"), ("app/use", "app/domain")]
    d = Dependencies.of(spark, [dep(a, b) for a, b in pairs])
    assert [r[0] for r in d.unique_targets().collect()] == ["app/audio", "app/domain"]
    assert [r[0] for r in d.unique_source_packages().collect()] == ["app/ui/s", "app/ui/t", "app/use"]
    by = {r["package_id"]: r["targets"] for r in d.group_by_source_package().collect()}
    assert by == {"app/ui/t": ["app/audio", "app/domain"], "app/ui/s": ["app/domain"], "app/use": ["app/domain"]}
    to = {r["import_path"]: (r["n"], r["sources"]) for r in d.group_by_target_package().collect()}
    assert to["app/domain"] == (3, ["app/ui/s", "app/ui/t", "app/use"]) and to["app/audio"] == (1, ["app/ui/t"])
    assert {k: v.len() for k, v in d.by_source_package().items()} == {"app/ui/t": 2, "app/ui/s": 1, "app/use": 1}
    assert d.by_target_package()["app/domain"].unique_source_packages().count() == 3


def test_names_and_receivers(spark):
    f = Functions.of(spark, [{"name": n, "receiver": r} for n, r in [("Save", "*Repo"), ("find", "Repo"), ("New", ""), ("_x", ""), ("", "*")]])
    assert f.is_exported().len() == 2 and f.is_unexported().len() == 3
    assert f.is_method().len() == 3 and f.is_function().len() == 2
    assert f.has_receiver("Repo").len() == 2 and f.has_receiver("").len() == 5 and f.has_receiver("repo").len() == 0
    assert f.name_matches(lambda n: n.startswith("S")).len() == 1
    assert f.name_matches(by_row(lambda n: n[:1] in ("f", "N") and len(n) > 2)).len() == 2
    assert f.name_matches_regex("^[A-Z]").len() == 2
    assert f.is_exported().is_unexported().len() == 0
    for bad in ("(", "(?=a)"):
        with pytest.raises(ValueError):
            f.name_matches_regex(bad)
    with pytest.raises(TypeError):
        f.name_matches(None)
    assert Types.of(spark, [{"name": "A", "type_kind": "struct"}]).match(lambda c: c.type_kind == "struct").count() == 1
    assert Variables.of(spark, []).is_exported().len() == 0


def test_files_and_calls_by_their_own_names(spark):
    calls = FunctionCalls.of(spark, [{"filename": "p/f.go", "callee": "fmt.Println"}, {"filename": "p/f_test.go", "callee": "fmt.Println"}])
    assert calls.is_test().len() == 1 and calls.is_not_test().len() == 1
    files = Files.of(spark, [{"package_id": P, "filename": "gen.go", "file_filename": "a_test.go"}, {"package_id": P, "filename": "b.go", "file_filename": "b.go"}])
    assert files.is_test().len() == 1
    d = Dependencies.of(spark, [dep(P, "fmt", "b.go"), dep(P, "io", "b.go")])
    assert files.without(d).len() == 1 and files.having(d).len() == 1
    assert {r["file_filename"]: r["imports"] for r in files.with_dependencies(d).collect()} == {"a_test.go": [], "b.go": ["fmt", "io"]}


def test_packages(spark):
    rows = [{"id": "a/x", "name": "x", "files": ["x.go", "x_test.go"]}, {"id": "a/y", "name": "y", "files": ["y.go"]}, {"id": "a/z", "name": "z", "files": []}]
    p = Packages.of(spark, rows)
    assert p.is_test().len() == 1 and p.is_not_test().len() == 2 and p.in_package("a/x").len() == 1
    refs = {r["package_id"]: (r["filename"], r["line"], r["col"], r["match"]) for r in p.match(lambda c: F.lit(True)).collect()}
    assert refs == {"a/x": ("x.go", 1, 1, "package x"), "a/y": ("y.go", 1, 1, "package y"), "a/z": ("", 1, 1, "package z")}
    key = lambda c: F.when(c.name == "z", "").otherwise(F.lit("k"))
    assert [(r["key"], r["packages"]) for r in p.group_by(key).collect()] == [("k", ["a/x", "a/y"])]
    assert {k: v.len() for k, v in p.groups(key).items()} == {"k": 2}
    assert p.module_root() == "a" and Packages.of(spark, []).module_root() == ""


EDGES = [("r", "a"), ("r", "i"), ("a", "d"), ("i", "d"), ("c1", "c2"), ("c2", "c1"), ("r/x", "r")]


def test_rows_by_package_keep_their_order(spark):
    rows = [dep("b", "y"), dep("a", "z"), dep("b", "x"), dep("a", "y"), dep("b", "y")]
    d = Dependencies.of(spark, rows)
    assert [(r["package_id"], r["import_path"]) for r in d.rows_by_source_package().collect()] == [("a", "z"), ("a", "y"), ("b", "y"), ("b", "x"), ("b", "y")]
    assert [(r["import_path"], r["package_id"]) for r in d.rows_by_target_package().collect()] == [("x", "b"), ("y", "b"), ("y", "a"), ("y", "b"), ("z", "a")]
    assert [tuple(r) for r in d.targets_by_source_package().collect()] == [("a", "y", 1), ("a", "z", 1), ("b", "x", 1), ("b", "y", 2)]


def test_graph(spark):
    d = Dependencies.of(spark, [dep(a, b, within=True) for a, b in EDGES + EDGES[:1]] + [dep("s", "fmt")])
    g = PackageGraph.of(d)
    ids = lambda df: [r["id"] for r in df.collect()]
    assert ids(g.nodes()) == ["a", "c1", "c2", "d", "i", "r", "r/x"]
    assert ids(g.direct_dependencies("r")) == ["a", "i"] and ids(g.direct_dependencies()) == [] and ids(g.direct_dependencies("d")) == []
    assert ids(g.transitive_dependencies("r")) == ["a", "d", "i"] and ids(g.transitive_dependencies("d")) == []
    assert ids(g.transitive_dependencies("r/...")) == ["a", "d", "i", "r"]
    assert ids(g.transitive_dependencies("c1")) == ["c1", "c2"]
    assert g.transitively_reaches(["r"], ["d"]) and not g.transitively_reaches(["d"], ["r"])
    assert g.directly_reaches(["r"], ["a"]) and not g.directly_reaches(["r"], ["d"])
    assert ids(g.importers("d")) == ["a", "i"] and ids(g.importers("r/...")) == ["r/x"] and ids(g.importers("r/x")) == []


def test_rows_are_appended_and_attached(spark):
    p = Packages.of(spark, [{"id": "a"}]).plus(Packages.of(spark, [{"id": "a"}, {"id": "b"}]))
    assert p.len() == 3
    d = Dependencies.of(spark, [dep("a", "y"), dep("a", "x")])
    assert sorted((r["id"], r["imports"]) for r in p.with_dependencies(d).collect()) == [("a", ["y", "x"]), ("a", ["y", "x"]), ("b", [])]
    refs = d.refs()
    assert joined(refs, "\n") == "main.go:1:1 dependency y\nmain.go:1:1 dependency x" and joined(refs.where("false"), ",") == ""
    assert format_refs(refs) == "* main.go:1:1 dependency y\n* main.go:1:1 dependency x" and format_refs(refs.where("false")) == ""
