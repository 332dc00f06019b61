"""Relations over tables that are not Go code: the same definitions, in Spark and as text for DuckDB.

Each definition is a list of SQL expressions that both engines read alike; where their functions differ, a
placeholder has each engine's own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import Workspace

MODULE = "example.com/app"
ENGINES = {
    "spark": {"k": "CAST(get_json_object(props, '$.k') AS INT)", "words": r"filter(split(text, '\\s+'), x -> x <> '')", "hrefs": "regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)"},
    "duckdb": {"k": "CAST(json_extract(props, '$.k') AS INT)", "words": r"list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')", "hrefs": "regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)"},
}


def layer(n: str) -> str:
    return f"CASE {n} % 4 WHEN 0 THEN 'domain' WHEN 1 THEN 'application' WHEN 2 THEN 'infrastructure' ELSE 'ui' END"


#: name: expression, step by step: a step may use the names of the steps before it.
IMPORTS = [
    {"ord": "event_id", "s": "20 + user_id % 80", "k": "{k}", "filename": "'src/' || event_type || '/f' || (event_id % 997) || CASE WHEN event_id % 5 = 0 THEN '_test.go' ELSE '.go' END", "line": "CAST(event_id % 1000 + 1 AS INT)", "event_type": "event_type"},
    {"ord": "ord", "s": "s", "event_type": "event_type", "filename": "filename", "line": "line", "package_name": "'p' || s", "package_id": f"'{MODULE}/' || {layer('s')} || '/p' || s",
     "import_path": f"CASE WHEN k < 10 THEN 'std/s' || k WHEN k < 20 THEN 'github.com/vendor/p' || k ELSE '{MODULE}/' || {layer('k')} || '/p' || k END"},
]
NAMES = [
    {"doc_id": "doc_id", "lang": "lang", "source": "source", "words": "{words}"},
    {"doc_id": "doc_id", "words": "words", "package_name": "source", "package_id": f"'{MODULE}/' || {layer('doc_id')} || '/' || source", "filename": "'src/' || lang || '/d' || doc_id || CASE WHEN doc_id % 5 = 0 THEN '_test.go' ELSE '.go' END",
     "type_kind": "CASE doc_id % 6 WHEN 0 THEN 'struct' WHEN 1 THEN 'interface' WHEN 2 THEN 'array' WHEN 3 THEN 'map' WHEN 4 THEN 'func' ELSE 'type' END",
     "receiver": "CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN '*OrderService' ELSE 'OrderRepository' END", "var_kind": "CASE doc_id % 2 WHEN 0 THEN 'var' ELSE 'const' END"},
]
CALLS = [
    {"ord": "conv_id * 1000 + turn", "package_id": f"'{MODULE}/' || {layer('conv_id')} || '/c' || (conv_id % 50)", "package_name": "'c' || (conv_id % 50)", "filename": "'src/chat/c' || conv_id || CASE WHEN conv_id % 5 = 0 THEN '_test.go' ELSE '.go' END",
     "line": "CAST(turn + 1 AS INT)", "callee": "role || '.' || turn"},
]
REF_DEPENDENCY = "'dependency ' || import_path || CASE WHEN within_workspace THEN ' (workspace)' ELSE ' (external)' END"


def _exprs(step: dict[str, str], engine: str) -> list[str]:
    return [f"{e.replace('{k}', ENGINES[engine]['k']).replace('{words}', ENGINES[engine]['words'])} AS {n}" for n, e in step.items()]


def _spark(df: DataFrame, steps: list[dict[str, str]]) -> DataFrame:
    for step in steps:
        df = df.selectExpr(*_exprs(step, "spark"))
    return df


def _duck(table: str, steps: list[dict[str, str]]) -> str:
    sql = table
    for step in steps:
        sql = f"(SELECT {', '.join(_exprs(step, 'duckdb'))} FROM {sql})"
    return sql


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependencies from events; which lie within the workspace is a join with the distinct package ids."""
    rows = _spark(spark.read.parquet(f"{sf_dir}/events.parquet"), IMPORTS)
    ids = rows.select(F.col("package_id").alias("import_path"), F.lit(True).alias("known")).distinct()
    flagged = rows.join(ids, "import_path", "left").withColumn("within_workspace", F.coalesce("known", F.lit(False))).drop("known")
    return flagged.selectExpr("ord", "package_id", "package_name", "filename", "line", "1 AS col", "'dependency' AS kind", f"{REF_DEPENDENCY} AS match", "import_path", "within_workspace",
                              "NOT within_workspace AS external", "NOT contains(import_path, '.') AS standard_library", "'' AS target_package_name", "s", "event_type")


DUCK_IMPORTS = f"""
v0 AS (SELECT * FROM {_duck('events', IMPORTS)}),
v1 AS (SELECT *, import_path IN (SELECT package_id FROM v0) AS within_workspace FROM v0),
dependencies AS (
  SELECT ord, package_id, package_name, filename, line, CAST(1 AS INT) AS col, 'dependency' AS kind, {REF_DEPENDENCY} AS match, import_path, within_workspace,
    NOT within_workspace AS external, NOT contains(import_path, '.') AS standard_library, s, event_type FROM v1
),
files AS (
  SELECT min(ord) AS ord, package_id, any_value(package_name) AS package_name, filename, 'file' AS kind, 'file package ' || any_value(package_name) AS match, filename AS file_filename
  FROM dependencies GROUP BY package_id, filename
),
packages AS (
  SELECT min(ord) AS ord, package_id, package_id AS id, any_value(package_name) AS name, list(file_filename ORDER BY file_filename) AS files FROM files GROUP BY package_id
)"""


def files(dependencies: DataFrame) -> DataFrame:
    made = dependencies.groupBy("package_id", "filename").agg(F.min("ord").alias("ord"), F.first("package_name").alias("package_name"))
    return made.selectExpr("ord", "package_id", "package_name", "filename", "1 AS line", "1 AS col", "'file' AS kind", "'file package ' || package_name AS match", "filename AS file_filename")


def packages(held: DataFrame) -> DataFrame:
    made = held.groupBy("package_id").agg(F.min("ord").alias("ord"), F.first("package_name").alias("name"), F.sort_array(F.collect_list("file_filename")).alias("files"))
    return made.selectExpr("ord", "package_id", "name AS package_name", "'' AS filename", "0 AS line", "0 AS col", "'package' AS kind", "'package ' || name AS match", "package_id AS id", "name", "files", "CAST(array() AS array<struct<pos: string, msg: string, kind: int>>) AS errors")


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each word of each document; types, functions and variables are views of it."""
    rows = _spark(spark.read.parquet(f"{sf_dir}/documents.parquet"), NAMES)
    each = rows.select("*", F.posexplode("words").alias("k", "name")).drop("words")
    return each.selectExpr("doc_id * 1000000 + k AS ord", "package_id", "package_name", "filename", "CAST(k + 1 AS INT) AS line", "1 AS col", "name", "type_kind", "receiver", "var_kind")


DUCK_NAMES = f"""
n0 AS (SELECT *, unnest(words) AS name, unnest(range(0, len(words))) AS i FROM {_duck('documents', NAMES)}),
names AS (SELECT doc_id * 1000000 + i AS ord, package_id, package_name, filename, CAST(i + 1 AS INT) AS line, CAST(1 AS INT) AS col, name, type_kind, receiver, var_kind FROM n0),
types AS (SELECT *, 'type' AS kind, 'type ' || name || CASE WHEN type_kind = 'type' THEN '' ELSE ' ' || type_kind END AS match FROM names),
functions AS (SELECT *, 'function' AS kind, 'func ' || CASE WHEN receiver = '' THEN '' ELSE '(' || receiver || ') ' END || name AS match FROM names),
variables AS (SELECT *, 'variable' AS kind, var_kind || ' ' || name AS match FROM names)"""
DUCK_CALLS = f"functioncalls AS (SELECT *, CAST(1 AS INT) AS col, 'functioncall' AS kind, callee || '()' AS match FROM {_duck('conversations', CALLS)})"
DUCK = {"dependencies": DUCK_IMPORTS, "files": DUCK_IMPORTS, "packages": DUCK_IMPORTS, "types": DUCK_NAMES, "functions": DUCK_NAMES, "variables": DUCK_NAMES, "functioncalls": DUCK_CALLS}


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _spark(spark.read.parquet(f"{sf_dir}/conversations.parquet"), CALLS)
    return rows.selectExpr("*", "1 AS col", "'functioncall' AS kind", "callee || '()' AS match")


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each link of each page: import_path is its target, package_id the page's address without scheme and query."""
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").selectExpr("page_id", f"regexp_replace(url, '{URL_ENDS}', '') AS package_id", f"{ENGINES['spark']['hrefs']} AS h")
    return rows.select("page_id", "package_id", F.posexplode("h").alias("k", "import_path")).selectExpr("page_id * 1000 + k AS ord", "package_id", "import_path")


URL_ENDS = "^[a-z]+://|[?#].*$"
DUCK_LINKS = f"""
l0 AS (SELECT page_id, regexp_replace(url, '{URL_ENDS}', '', 'g') AS package_id, {ENGINES['duckdb']['hrefs']} AS h FROM pages),
links AS (SELECT page_id * 1000 + i AS ord, package_id, import_path FROM (SELECT page_id, package_id, unnest(h) AS import_path, unnest(range(0, len(h))) AS i FROM l0))"""


def workspace(spark: SparkSession, sf_dir: str) -> Workspace:
    """All seven relations over the tables in a folder."""
    deps = imports(spark, sf_dir)
    held = files(deps)
    words = names(spark, sf_dir)
    kinds = {
        "types": words.selectExpr("*", "'type' AS kind", "'type ' || name || CASE WHEN type_kind = 'type' THEN '' ELSE ' ' || type_kind END AS match"),
        "functions": words.selectExpr("*", "'function' AS kind", "'func ' || CASE WHEN receiver = '' THEN '' ELSE '(' || receiver || ') ' END || name AS match"),
        "variables": words.selectExpr("*", "'variable' AS kind", "var_kind || ' ' || name AS match"),
    }
    return Workspace.of({"dependencies": deps, "files": held, "packages": packages(held), "functioncalls": calls(spark, sf_dir), **kinds})
