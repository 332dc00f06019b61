"""The seven relations of a workspace. No column is null: '' and 0 stand for what is absent."""

from __future__ import annotations

from pyspark.sql import types as T

KINDS = ("package", "file", "type", "function", "variable", "functioncall", "dependency")


def _fields(spec: str) -> list[T.StructField]:
    kinds = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "boolean": T.BooleanType()}
    pairs = (item.split() for item in spec.split(","))
    return [T.StructField(name, kinds[kind], False) for name, kind in pairs]


REF = _fields("ord long, package_id string, package_name string, filename string, line int, col int, kind string, match string")
REF_COLUMNS = [f.name for f in REF]
ERROR = T.StructType(_fields("pos string, msg string, kind int"))

SCHEMAS: dict[str, T.StructType] = {
    "packages": T.StructType([*REF, *_fields("id string, name string"), T.StructField("files", T.ArrayType(T.StringType(), False), False), T.StructField("errors", T.ArrayType(ERROR, False), False)]),
    "files": T.StructType([*REF, *_fields("file_filename string")]),
    "types": T.StructType([*REF, *_fields("name string, type_kind string")]),
    "functions": T.StructType([*REF, *_fields("name string, receiver string")]),
    "variables": T.StructType([*REF, *_fields("name string, var_kind string")]),
    "functioncalls": T.StructType([*REF, *_fields("callee string")]),
    "dependencies": T.StructType([*REF, *_fields("import_path string, within_workspace boolean, external boolean, standard_library boolean, target_package_name string")]),
}
