"""Module paths: patterns below a module, and the root that a set of package ids has in common."""

from __future__ import annotations

import os
from collections.abc import Iterable


class Module(str):
    """A module path that makes package patterns: Module("a").pkg("b/...") is "a/b/..."."""

    __slots__ = ()

    def pkg(self, sub: str) -> str:
        return f"{self}/{sub}"

    def pkgs(self, *subs: str) -> list[str]:
        return [self.pkg(s) for s in subs]


def common_root(least: str | None, greatest: str | None) -> str:
    """The longest path that the byte-wise least and greatest ids share: cut at a slash, unless it is the least id
    itself or holds no slash."""
    if least is None or greatest is None:
        return ""
    shared = os.path.commonprefix([least, greatest])
    if shared == least:
        return shared
    at = shared.rfind("/")
    return shared[:at] if at >= 0 else shared


def module_root(ids: Iterable[str]) -> str:
    ids = [i.encode() for i in ids]
    return common_root(min(ids).decode(), max(ids).decode()) if ids else ""
