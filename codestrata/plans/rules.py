"""Named architecture rules: queries that must find nothing, or something.

A rule is stated before any data is at hand and compiles to one DataFrame. Repeated patterns add up (any of
them may match), and of opposite filters the last one holds; that is where rules differ from a relation's
methods, each of which narrows the rows further.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any, Self

from pyspark.sql import DataFrame

from codestrata.functions.formatting import REPORT, format_ref, join_refs
from codestrata.functions.re2 import to_java
from codestrata.operators.relations import Matcher, Relation

from .workspace import Workspace


class RuleError(ValueError):
    """A rule that can't be evaluated as it is stated."""


class RuleViolation(AssertionError):
    """A rule that does not hold."""


class Rule:
    """Entry point: Rule("name").dependencies()... states a rule about one relation."""

    def __init__(self, name: str) -> None:
        self.name = name

    def packages(self) -> PackageRule:
        return PackageRule(self.name)

    def files(self) -> FileRule:
        return FileRule(self.name)

    def types(self) -> TypeRule:
        return TypeRule(self.name)

    def functions(self) -> FunctionRule:
        return FunctionRule(self.name)

    def variables(self) -> VariableRule:
        return VariableRule(self.name)

    def function_calls(self) -> FunctionCallRule:
        return FunctionCallRule(self.name)

    def dependencies(self) -> DependencyRule:
        return DependencyRule(self.name)


class BaseRule:
    relation = ""
    #: Settings besides a matcher of which one is enough to evaluate.
    enough: tuple[str, ...] = ()
    needs_matcher = True

    def __init__(self, name: str) -> None:
        self.name = name
        self._in: list[str] = []
        self._not_in: list[str] = []
        self._tests: bool | None = None
        self._matcher: Matcher | None = None
        self._should_exist = False

    def in_package(self, *patterns: str) -> Self:
        self._in += patterns
        return self

    def not_in_package(self, *patterns: str) -> Self:
        self._not_in += patterns
        return self

    def is_test(self) -> Self:
        self._tests = True
        return self

    def is_not_test(self) -> Self:
        self._tests = False
        return self

    def match(self, matcher: Matcher | None) -> Self:
        self._matcher = matcher
        return self

    def _set(self, setting: str) -> bool:
        value = getattr(self, setting)
        return value is not None and value != "" and (value is not False or setting in ("_exported", "_method"))

    def _narrow(self, rows: Any) -> Relation:
        """The kind's own filters, in a fixed order."""
        return rows

    def rows(self, workspace: Workspace | None) -> Relation:
        if workspace is None:
            raise RuleError("workspace is nil")
        if self.needs_matcher and self._matcher is None and not any(self._set(e) for e in self.enough):
            raise RuleError("no matcher configured")
        rows: Relation = getattr(workspace, self.relation)
        rows = rows.in_package(*self._in).not_in_package(*self._not_in)
        if self._tests is not None:
            rows = rows.is_test() if self._tests else rows.is_not_test()
        rows = self._narrow(rows)
        return rows if self._matcher is None else rows.matching(self._matcher)

    def evaluate(self, workspace: Workspace | None) -> DataFrame:
        """The source locations that the rule finds, as a lazy result."""
        return self.rows(workspace).refs()

    def test(self, workspace: Workspace | None) -> None:
        """Raise RuleViolation, with every location, if the rule does not hold."""
        try:
            refs = self.evaluate(workspace)
        except RuleError as e:
            raise RuleViolation(f'rule "{self.name}" misconfigured: {e}') from e
        if self._should_exist:
            if refs.isEmpty():
                raise RuleViolation(f'rule "{self.name}" not satisfied: expected at least one match but found none')
        else:
            found = [r["text"] for r in refs.select("ord", format_ref(REPORT).alias("text")).orderBy("ord").toLocalIterator()]
            if found:  # one run: what is counted is what is shown
                raise RuleViolation(f'rule "{self.name}" violated: {len(found)} match(es)\n{join_refs(found, REPORT.separator)}')


class Existing(BaseRule):
    def should_exist(self) -> Self:
        self._should_exist = True
        return self


class NamedRule(BaseRule):
    enough = ("_exported", "_name_test")

    def __init__(self, name: str) -> None:
        super().__init__(name)
        self._exported: bool | None = None
        self._name_test: Callable[[Any], Any] | None = None

    def is_exported(self) -> Self:
        self._exported = True
        return self

    def is_unexported(self) -> Self:
        self._exported = False
        return self

    def name_matches(self, test: Callable[[Any], Any] | None) -> Self:
        self._name_test = test
        return self

    def name_matches_regex(self, pattern: str) -> Self:
        java = to_java(pattern)
        self._name_test = lambda column: column.rlike(java)
        return self

    def _narrow(self, rows: Any) -> Relation:
        if self._exported is not None:
            rows = rows.is_exported() if self._exported else rows.is_unexported()
        rows = self._narrow_more(rows)
        return rows.name_matches(self._name_test) if self._name_test else rows

    def _narrow_more(self, rows: Any) -> Any:
        return rows


class PackageRule(Existing):
    relation = "packages"
    enough = ("_should_exist",)


class FileRule(BaseRule):
    relation = "files"


class TypeRule(NamedRule, Existing):
    relation = "types"
    enough = (*NamedRule.enough, "_should_exist")


class FunctionRule(NamedRule, Existing):
    relation = "functions"
    enough = (*NamedRule.enough, "_should_exist", "_method", "_receiver")

    def __init__(self, name: str) -> None:
        super().__init__(name)
        self._method: bool | None = None
        self._receiver = ""

    def is_method(self) -> Self:
        self._method = True
        return self

    def is_function(self) -> Self:
        self._method = False
        return self

    def has_receiver(self, part: str) -> Self:
        self._receiver = part
        return self

    def _narrow_more(self, rows: Any) -> Any:
        if self._method is not None:
            rows = rows.is_method() if self._method else rows.is_function()
        return rows.has_receiver(self._receiver) if self._receiver else rows


class VariableRule(NamedRule):
    relation = "variables"


class FunctionCallRule(BaseRule):
    relation = "function_calls"


class DependencyRule(BaseRule):
    relation = "dependencies"
    needs_matcher = False

    def __init__(self, name: str) -> None:
        super().__init__(name)
        self._within: bool | None = None
        self._standard = self._third_party = False
        self._on: list[str] = []
        self._not_on: list[str] = []

    def is_within_workspace(self) -> Self:
        self._within = True
        return self

    def is_external(self) -> Self:
        self._within = False
        return self

    def is_standard_library(self) -> Self:
        self._standard = True
        return self

    def is_third_party(self) -> Self:
        self._third_party = True
        return self

    def depend_on(self, *patterns: str) -> Self:
        self._on += patterns
        return self

    depends_on = depend_on

    def do_not_depend_on(self, *patterns: str) -> Self:
        self._not_on += patterns
        return self

    def _narrow(self, rows: Any) -> Any:
        if self._within is not None:
            rows = rows.is_within_workspace() if self._within else rows.is_external()
        if self._standard:
            rows = rows.is_standard_library()
        if self._third_party:
            rows = rows.is_third_party()
        return rows.depend_on(*self._on).do_not_depend_on(*self._not_on)
