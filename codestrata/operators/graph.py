"""The graph of packages that import each other, and what reaches what in it.

Reachability is a semi-naive fixpoint: each round follows the edges of the nodes found in the round before,
and drops those that are known. Edges and each round's nodes are written to the session's shared scratch folder, so plans
stay short and a lost executor costs no round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.functions.patterns import package_matches
from codestrata.sources.scratch import saved

from .relations import Dependencies


class PackageGraph:
    """Distinct edges src, dst between packages of the workspace."""

    def __init__(self, edges: DataFrame) -> None:
        self.edges = edges.select("src", "dst").distinct()

    @classmethod
    def of(cls, dependencies: Dependencies) -> PackageGraph:
        inside = dependencies.frame.where("within_workspace")
        return cls(inside.select(F.col("package_id").alias("src"), F.col("import_path").alias("dst")))

    def nodes(self) -> DataFrame:
        """Every package with an edge, in order."""
        return self.edges.select(F.col("src").alias("id")).union(self.edges.select("dst")).distinct().orderBy("id")

    def direct_dependencies(self, *patterns: str) -> DataFrame:
        return self.edges.where(package_matches(F.col("src"), *patterns)).select(F.col("dst").alias("id")).distinct().orderBy("id")

    def importers(self, *patterns: str) -> DataFrame:
        return self.edges.where(package_matches(F.col("dst"), *patterns)).select(F.col("src").alias("id")).distinct().orderBy("id")

    def directly_reaches(self, sources: list[str], targets: list[str]) -> bool:
        hit = package_matches(F.col("src"), *sources) & package_matches(F.col("dst"), *targets)
        return not self.edges.where(hit).isEmpty()

    def transitive_dependencies(self, *patterns: str) -> DataFrame:
        """Packages reached by one hop or more; a source is among them if another source or a cycle leads to it."""
        return self._fixpoint(patterns).orderBy("id")

    def _fixpoint(self, patterns: tuple[str, ...] | list[str], target=None) -> DataFrame:
        edges = saved(self.edges, "edges")
        frontier = saved(PackageGraph(edges).direct_dependencies(*patterns), "reach")
        known = frontier
        while True:
            if target is not None and not frontier.where(target).isEmpty():
                return frontier.where(target)
            step = edges.join(frontier, F.col("src") == F.col("id"), "left_semi").select(F.col("dst").alias("id")).distinct()
            frontier = saved(step.join(known, "id", "left_anti"), "reach")
            if frontier.isEmpty():
                return known if target is None else known.where(F.lit(False))
            known = known.unionByName(frontier)

    def transitively_reaches(self, sources: list[str], targets: list[str]) -> bool:
        """Whether a package of sources reaches one of targets by one hop or more; stops at the first that does."""
        return not self._fixpoint(sources, package_matches(F.col("id"), *targets)).isEmpty()
