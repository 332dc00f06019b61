from codestrata.operators.relations import Dependencies
from codestrata.operators.schema import SCHEMAS
from codestrata.plans.rules import Rule
from codestrata.plans.workspace import Workspace
from codestrata.streaming import watch


def test_rules_watch_a_stream(spark, tmp_path):
    rows = [{"package_id": "a/domain", "import_path": p, "external": True, "filename": "x.go", "line": 1, "col": 2, "kind": "dependency", "match": p} for p in ("fmt", "github.com/x")]
    Dependencies.of(spark, rows).frame.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMAS["dependencies"]).parquet(f"{tmp_path}/in")
    ws = Workspace(None, None, None, None, None, None, Dependencies(stream))
    seen = []
    query = watch(Rule("r").dependencies().depend_on("github.com/...").evaluate(ws), lambda n, refs: seen.extend(refs.collect()), f"{tmp_path}/at", once=True)
    query.awaitTermination(60)
    assert [r["match"] for r in seen] == ["github.com/x"]
