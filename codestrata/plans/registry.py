"""Every operator as a query over the tables, beside SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions.formatting import REPORT, RefFormat, format_ref
from codestrata.functions.modules import common_root
from codestrata.operators.graph import PackageGraph
from codestrata.operators.relations import Packages, Relation
from codestrata.operators.tree import tree_nodes

from . import golden, virtual
from .rules import Rule
from .workspace import Workspace

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

APP = virtual.MODULE
DOMAIN, INFRA, UI = f"{APP}/domain/...", f"{APP}/infrastructure/...", f"{APP}/ui/..."
ALL = ("packages", "files", "types", "functions", "variables", "functioncalls", "dependencies")
NAMED = ("types", "functions", "variables")


def _of(ws: Workspace, name: str) -> Relation:
    return getattr(ws, "function_calls" if name == "functioncalls" else name)


def _like(column: str, *patterns: str) -> str:
    """package_matches as SQL."""
    tests = [f"({column} = '{p[:-4]}' OR starts_with({column}, '{p[:-4]}/'))" if p.endswith("/...") else f"{column} = '{p}'" for p in patterns]
    return "(" + " OR ".join(tests) + ")"


def _summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("package_id").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"), F.sum("ord").cast("long").alias("sum_ord"))


SUMMARY = "SELECT package_id, count(*) AS n, min(ord) AS first_ord, max(ord) AS last_ord, CAST(sum(ord) AS BIGINT) AS sum_ord FROM {0} WHERE {1} GROUP BY package_id"


def _with(relation: str, sql: str) -> str:
    return f"WITH {virtual.DUCK[relation]}\n{sql}"


def _filter(name: str, relation: str, narrow: Callable[[Relation], Relation], condition: str) -> None:
    QUERIES[name] = lambda spark, sf: _summary(narrow(_of(virtual.workspace(spark, sf), relation)).frame)
    ORACLES[name] = _with(relation, SUMMARY.format(relation, condition))


def _add(name: str, query: Query, sql: str) -> None:
    QUERIES[name], ORACLES[name] = query, sql


TEST = {r: "ends_with(filename, '_test.go')" for r in ALL} | {"files": "ends_with(file_filename, '_test.go')", "packages": "len(list_filter(files, lambda x: ends_with(x, '_test.go'))) > 0"}
for _r in ALL:
    _filter(f"in_package_{_r}", _r, lambda x: x.in_package(DOMAIN, f"{APP}/ui/p23"), _like("package_id", DOMAIN, f"{APP}/ui/p23"))
    _filter(f"not_in_package_{_r}", _r, lambda x: x.not_in_package(DOMAIN, UI), f"NOT {_like('package_id', DOMAIN, UI)}")
    _filter(f"is_test_{_r}", _r, lambda x: x.is_test(), TEST[_r])
    _filter(f"is_not_test_{_r}", _r, lambda x: x.is_not_test(), f"NOT ({TEST[_r]})")
    _add(f"len_{_r}", lambda spark, sf, r=_r: _of(virtual.workspace(spark, sf), r).count(), _with(_r, f"SELECT count(*) AS n FROM {_r}"))
UPPER = r"regexp_matches(name, '^\p{Lu}')"
for _r in NAMED:
    _filter(f"is_exported_{_r}", _r, lambda x: x.is_exported(), UPPER)
    _filter(f"is_unexported_{_r}", _r, lambda x: x.is_unexported(), f"NOT {UPPER}")
    _filter(f"name_matches_{_r}", _r, lambda x: x.name_matches(lambda n: n.endswith("tion")), "ends_with(name, 'tion')")
    _filter(f"name_regex_{_r}", _r, lambda x: x.name_matches_regex(r"^(?:th|on)[a-m]+e?$|[[:upper:]]\w*s\b"), r"regexp_matches(name, '^(?:th|on)[a-m]+e?$|[[:upper:]]\w*s\b')")
_filter("is_method", "functions", lambda x: x.is_method(), "receiver <> ''")
_filter("is_function", "functions", lambda x: x.is_function(), "receiver = ''")
_filter("has_receiver", "functions", lambda x: x.has_receiver("Order"), "contains(receiver, 'Order')")
_filter("within_workspace", "dependencies", lambda x: x.is_within_workspace(), "within_workspace")
_filter("external", "dependencies", lambda x: x.is_external(), "external")
_filter("stdlib", "dependencies", lambda x: x.is_standard_library(), "standard_library")
_filter("third_party", "dependencies", lambda x: x.is_third_party(), "external AND NOT standard_library")
_filter("depend_on", "dependencies", lambda x: x.depend_on(INFRA, "std/s3"), _like("import_path", INFRA, "std/s3"))
_filter("do_not_depend_on", "dependencies", lambda x: x.do_not_depend_on(INFRA, "std/s3"), f"NOT {_like('import_path', INFRA, 'std/s3')}")

#: A matcher for each relation, and its condition.
MATCHERS: dict[str, tuple[Callable[..., Column], str]] = {
    "packages": (lambda c: F.size(c.files) > 3, "len(files) > 3"), "files": (lambda c: c.file_filename.contains("click"), "contains(file_filename, 'click')"),
    "types": (lambda c: (c.type_kind == "struct") & (F.length(c.name) > 12), "type_kind = 'struct' AND length(name) > 12"), "functions": (lambda c: (c.receiver == "") & c.name.startswith("The"), "receiver = '' AND starts_with(name, 'The')"),
    "variables": (lambda c: (c.var_kind == "const") & (c.name == "the"), "var_kind = 'const' AND name = 'the'"), "functioncalls": (lambda c: c.callee == "assistant.1", "callee = 'assistant.1'"),
    "dependencies": (lambda c: c.import_path.startswith("github.com/"), "starts_with(import_path, 'github.com/')"),
}
REFS = "package_id, filename, line, col, kind, match"
PACKAGE_REFS = "id AS package_id, files[1] AS filename, CAST(1 AS INT) AS line, CAST(1 AS INT) AS col, 'package' AS kind, 'package ' || name AS match"
FILE_REFS = "package_id, filename, CAST(1 AS INT) AS line, CAST(1 AS INT) AS col, kind, match"


def _refs_sql(relation: str) -> str:
    return {"packages": PACKAGE_REFS, "files": FILE_REFS}.get(relation, REFS)


for _r in ALL:
    _add(
        f"match_{_r}",
        lambda spark, sf, r=_r: _of(virtual.workspace(spark, sf), r).match(MATCHERS[r][0]).drop("package_name"),
        _with(_r, f"SELECT ord, {_refs_sql(_r)} FROM {_r} WHERE {MATCHERS[_r][1]}"),
    )


def _deps(spark: SparkSession, sf: str):
    return virtual.workspace(spark, sf).dependencies


_add("unique_targets", lambda spark, sf: _deps(spark, sf).unique_targets(), _with("dependencies", "SELECT DISTINCT import_path FROM dependencies"))
_add("unique_sources", lambda spark, sf: _deps(spark, sf).unique_source_packages(), _with("dependencies", "SELECT DISTINCT package_id FROM dependencies"))
_add("group_by_source", lambda spark, sf: _deps(spark, sf).group_by_source_package().withColumn("targets", F.array_join("targets", ",")), _with("dependencies", "SELECT package_id, count(*) AS n, string_agg(DISTINCT import_path, ',' ORDER BY import_path) AS targets FROM dependencies GROUP BY package_id"))
_add("group_by_target", lambda spark, sf: _deps(spark, sf).group_by_target_package().withColumn("sources", F.array_join("sources", ",")), _with("dependencies", "SELECT import_path, count(*) AS n, string_agg(DISTINCT package_id, ',' ORDER BY package_id) AS sources FROM dependencies GROUP BY import_path"))
_add("rows_by_source", lambda spark, sf: _deps(spark, sf).rows_by_source_package().select("package_id", "ord", "filename", "import_path", "match"), _with("dependencies", "SELECT package_id, ord, filename, import_path, match FROM dependencies"))
_add("rows_by_target", lambda spark, sf: _deps(spark, sf).rows_by_target_package().select("import_path", "ord", "filename", "package_id", "match"), _with("dependencies", "SELECT import_path, ord, filename, package_id, match FROM dependencies"))
_add("targets_by_source", lambda spark, sf: _deps(spark, sf).targets_by_source_package(), _with("dependencies", "SELECT package_id, import_path, count(*) AS n FROM dependencies GROUP BY 1, 2"))
_add("reverse_lookup", lambda spark, sf: _deps(spark, sf).depend_on(f"{APP}/domain/p24").unique_source_packages(), _with("dependencies", f"SELECT DISTINCT package_id FROM dependencies WHERE import_path = '{APP}/domain/p24'"))
_add("packages_group_by", lambda spark, sf: virtual.workspace(spark, sf).packages.group_by(lambda c: F.when(c.id.contains("/domain/"), "").otherwise(F.split(c.id, "/")[2])).withColumn("packages", F.array_join("packages", ",")), _with("packages", "SELECT string_split(id, '/')[3] AS key, string_agg(id, ',' ORDER BY ord, id) AS packages FROM packages WHERE NOT contains(id, '/domain/') GROUP BY 1"))


def _tree_sql(ctes: str, relation: str) -> str:
    return f"""
WITH {ctes},
p AS (SELECT import_path, list_filter(string_split(import_path, '/'), lambda s: s <> '') AS p, ends_with(import_path, '/') AS o FROM {relation}),
x AS (SELECT p, o, unnest(range(1, len(p) + 1)) AS d FROM p WHERE len(p) > 0)
SELECT array_to_string(p[1:d], '/') AS path, array_to_string(p[1:d - 1], '/') AS parent_path, p[d] AS name, CAST(d AS INT) AS depth,
  count(*) FILTER (d = len(p) AND NOT o) AS n_deps
FROM x GROUP BY 1, 2, 3, 4"""


_add("tree_nodes", lambda spark, sf: tree_nodes(virtual.imports(spark, sf)), _tree_sql(virtual.DUCK_IMPORTS, "dependencies"))
_add("tree_nodes_links", lambda spark, sf: tree_nodes(virtual.links(spark, sf)), _tree_sql(virtual.DUCK_LINKS, "links"))


def _module_root(spark: SparkSession, sf: str) -> DataFrame:
    found = Packages(virtual.links(spark, sf).select(F.col("package_id").alias("id"))).root_bounds().first()
    inside = virtual.workspace(spark, sf).packages.module_root()
    return spark.createDataFrame([("links", common_root(found["least"], found["greatest"])), ("packages", inside)], "relation string, module_root string")


_ROOT = "SELECT '{0}' AS relation, CASE WHEN p = a OR NOT contains(p, '/') THEN p ELSE regexp_replace(p, '/[^/]*$', '') END AS module_root FROM (SELECT a, a[1:list_max(list_filter(range(0, length(a) + 1), lambda i: i <= length(b) AND a[1:i] = b[1:i]))] AS p FROM (SELECT min({1}) AS a, max({1}) AS b FROM {2}))"
_add("module_root", _module_root, f"WITH {virtual.DUCK_IMPORTS}, {virtual.DUCK_LINKS}\n{_ROOT.format('links', 'package_id', 'links')} UNION ALL {_ROOT.format('packages', 'id', 'packages')}")


def _without(spark: SparkSession, sf: str) -> DataFrame:
    ws = virtual.workspace(spark, sf)
    return ws.files.without(ws.dependencies.is_standard_library()).frame.select("package_id", "file_filename")


_add("files_without_stdlib", _without, _with("dependencies", "SELECT package_id, file_filename FROM files WHERE file_filename NOT IN (SELECT filename FROM dependencies WHERE standard_library)"))


def _attached(spark: SparkSession, sf: str) -> DataFrame:
    ws = virtual.workspace(spark, sf)
    return ws.files.with_dependencies(ws.dependencies).select("package_id", "file_filename", F.size("imports").cast("long").alias("n"), F.array_join(F.array_sort("imports"), ",").alias("imports"))


_add("files_with_dependencies", _attached, _with("dependencies", "SELECT f.package_id, file_filename, count(d.ord) AS n, coalesce(string_agg(import_path, ',' ORDER BY import_path), '') AS imports FROM files f LEFT JOIN dependencies d ON d.filename = file_filename GROUP BY 1, 2"))



def _attached_packages(spark: SparkSession, sf: str) -> DataFrame:
    ws = virtual.workspace(spark, sf)
    return ws.packages.with_dependencies(ws.dependencies).select("id", F.size("imports").cast("long").alias("n"), F.array_join(F.array_distinct(F.array_sort("imports")), ",").alias("imports"))


_add("packages_with_dependencies", _attached_packages, _with("dependencies", "SELECT id, count(d.ord) AS n, coalesce(string_agg(DISTINCT import_path, ',' ORDER BY import_path), '') AS imports FROM packages p LEFT JOIN dependencies d ON d.package_id = id GROUP BY 1"))

GRAPH = f"{virtual.DUCK_IMPORTS}, edges AS (SELECT DISTINCT package_id AS src, import_path AS dst FROM dependencies WHERE within_workspace)"


def _graph(spark: SparkSession, sf: str) -> PackageGraph:
    return PackageGraph.of(_deps(spark, sf))


def _reach(patterns: str) -> str:
    return f"""
WITH RECURSIVE {GRAPH},
r(id) AS (SELECT dst FROM edges WHERE {patterns} UNION SELECT dst FROM edges JOIN r ON src = r.id)"""


_add("graph_nodes", lambda spark, sf: _graph(spark, sf).nodes(), f"WITH {GRAPH} SELECT src AS id FROM edges UNION SELECT dst FROM edges")
_add("graph_direct", lambda spark, sf: _graph(spark, sf).direct_dependencies(DOMAIN), f"WITH {GRAPH} SELECT DISTINCT dst AS id FROM edges WHERE {_like('src', DOMAIN)}")
_add("graph_importers", lambda spark, sf: _graph(spark, sf).importers(INFRA), f"WITH {GRAPH} SELECT DISTINCT src AS id FROM edges WHERE {_like('dst', INFRA)}")
_add("graph_transitive", lambda spark, sf: _graph(spark, sf).transitive_dependencies(DOMAIN), _reach(_like("src", DOMAIN)) + " SELECT id FROM r")
_add("graph_transitive_ui", lambda spark, sf: _graph(spark, sf).transitive_dependencies(UI), _reach(_like("src", UI)) + " SELECT id FROM r")
_add(
    "graph_transitively_reaches",
    lambda spark, sf: spark.createDataFrame([(_graph(spark, sf).transitively_reaches([DOMAIN], [UI]),)], "reaches boolean"),
    _reach(_like("src", DOMAIN)) + f" SELECT count(*) > 0 AS reaches FROM r WHERE {_like('id', UI)}",
)
_add(
    "graph_directly_reaches",
    lambda spark, sf: spark.createDataFrame([(_graph(spark, sf).directly_reaches([DOMAIN], [UI]),)], "reaches boolean"),
    f"WITH {GRAPH} SELECT count(*) > 0 AS reaches FROM edges WHERE {_like('src', DOMAIN)} AND {_like('dst', UI)}",
)


def _formatted(options: RefFormat) -> Query:
    return lambda spark, sf: _deps(spark, sf).is_third_party().refs().select("ord", format_ref(options).alias("text"))


_THIRD = "FROM dependencies WHERE external AND NOT standard_library"
_add("format_refs", _formatted(RefFormat()), _with("dependencies", f"SELECT ord, filename || ':' || line || ':' || col || ' ' || match AS text {_THIRD}"))
_add("format_refs_report", _formatted(REPORT), _with("dependencies", f"SELECT ord, filename || ':' || line || ':' || col || ' package ' || package_id || ' ' || match AS text {_THIRD}"))
_add("format_refs_kind", _formatted(RefFormat(kind=True, match=False, file=False, column=False)), _with("dependencies", f"SELECT ord, 'line=' || line || ' ' || kind AS text {_THIRD}"))


def _rule(name: str, relation: str, state: Callable[[Rule], object], condition: str) -> None:
    query = lambda spark, sf: state(Rule(name)).evaluate(virtual.workspace(spark, sf)).drop("package_name")
    _add(f"rule_{name}", query, _with(relation, f"SELECT ord, {_refs_sql(relation)} FROM {relation} WHERE {condition}"))


_rule("packages", "packages", lambda r: r.packages().in_package(DOMAIN).is_test().should_exist(), f"{_like('id', DOMAIN)} AND {TEST['packages']}")
_rule("files", "files", lambda r: r.files().not_in_package(UI).match(lambda c: c.file_filename.contains("error")), f"NOT {_like('package_id', UI)} AND contains(file_filename, 'error')")
_rule("types", "types", lambda r: r.types().in_package(DOMAIN).is_exported().name_matches_regex("sh$"), rf"{_like('package_id', DOMAIN)} AND {UPPER} AND ends_with(name, 'sh')")
_rule("functions", "functions", lambda r: r.functions().is_not_test().is_method().has_receiver("Service").name_matches(lambda n: n == "and"), f"NOT {TEST['functions']} AND receiver <> '' AND contains(receiver, 'Service') AND name = 'and'")
_rule("variables", "variables", lambda r: r.variables().in_package(UI).is_unexported().name_matches(lambda n: F.length(n) > 15), f"{_like('package_id', UI)} AND NOT {UPPER} AND length(name) > 15")
_rule("functioncalls", "functioncalls", lambda r: r.function_calls().in_package(DOMAIN).match(lambda c: c.callee.startswith("system.")), f"{_like('package_id', DOMAIN)} AND starts_with(callee, 'system.')")
_rule("dependencies", "dependencies", lambda r: r.dependencies().in_package(DOMAIN).is_not_test().depend_on(INFRA), f"{_like('package_id', DOMAIN)} AND NOT {TEST['dependencies']} AND {_like('import_path', INFRA)}")
_rule("or_patterns", "dependencies", lambda r: r.dependencies().in_package(DOMAIN).in_package(UI).is_third_party(), f"{_like('package_id', DOMAIN, UI)} AND external AND NOT standard_library")
_rule("last_wins_test", "dependencies", lambda r: r.dependencies().is_test().is_not_test().is_within_workspace().is_external().depends_on("std/s1"), f"NOT {TEST['dependencies']} AND external AND import_path = 'std/s1'")


def _should_exist(spark: SparkSession, sf: str) -> DataFrame:
    ws = virtual.workspace(spark, sf)
    rows = [(p, not Rule(p).packages().in_package(p).should_exist().evaluate(ws).isEmpty()) for p in (DOMAIN, f"{APP}/nowhere/...")]
    return spark.createDataFrame(rows, "pattern string, holds boolean")


_add("should_exist", _should_exist, _with("packages", " UNION ALL ".join(f"SELECT '{p}' AS pattern, count(*) > 0 AS holds FROM packages WHERE {_like('id', p)}" for p in (DOMAIN, f"{APP}/nowhere/..."))))


QUERIES |= golden.QUERIES
ORACLES |= golden.ORACLES


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """What of the domain layer depends on the infrastructure layer, and where."""
    return Rule("the domain depends on no other layer").dependencies().in_package(DOMAIN).is_not_test().depend_on(INFRA).evaluate(virtual.workspace(spark, sf))
