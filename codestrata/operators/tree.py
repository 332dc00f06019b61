"""The hierarchy of import paths: a flat table of nodes, and a nested view for the driver."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


def tree_nodes(rows: DataFrame, path: str = "import_path") -> DataFrame:
    """path, parent_path, name, depth, n_deps of every prefix of every path.

    Empty segments make no node. A row counts at the node of its whole path, unless the path ends in a
    slash: then its nodes exist but it counts nowhere. Distinct paths are counted before they are split.
    """
    counted = rows.groupBy(F.col(path).alias("whole")).agg(F.count(F.lit(1)).alias("rows"))
    parts = F.filter(F.split("whole", "/"), lambda s: s != "")
    steps = counted.select("rows", F.col("whole").endswith("/").alias("open"), parts.alias("p")).where(F.size("p") > 0)
    depth = F.explode(F.sequence(F.lit(1), F.size("p"))).alias("depth")
    spread = steps.select("rows", "open", "p", depth)
    prefix = lambda n: F.array_join(F.slice("p", 1, n), "/")
    own = F.when((F.col("depth") == F.size("p")) & ~F.col("open"), F.col("rows")).otherwise(0)
    nodes = spread.select(prefix(F.col("depth")).alias("path"), prefix(F.col("depth") - 1).alias("parent_path"), F.element_at("p", F.col("depth")).alias("name"), "depth", own.alias("own"))
    return nodes.groupBy("path", "parent_path", "name", "depth").agg(F.sum("own").cast("long").alias("n_deps"))


@dataclass
class TreeNode:
    name: str = ""
    path: str = ""
    n_deps: int = 0
    dependencies: list[Row] = field(default_factory=list)
    children: list[TreeNode] = field(default_factory=list)

    def child(self, name: str) -> TreeNode | None:
        return next((c for c in self.children if c.name == name), None)


def tree(rows: DataFrame, path: str = "import_path", with_rows: bool = True) -> TreeNode:
    """The nested view, children by name; its size is that of the result, as asked for."""
    root = TreeNode()
    at = {"": root}
    for r in tree_nodes(rows, path).orderBy("depth", "name").collect():
        at[r["path"]] = node = TreeNode(r["name"], r["path"], r["n_deps"])
        at[r["parent_path"]].children.append(node)
    if with_rows:
        for row in rows.where((F.col(path) != "") & ~F.col(path).endswith("/")).orderBy("ord").collect():
            at["/".join(s for s in row[path].split("/") if s)].dependencies.append(row)
    return root
