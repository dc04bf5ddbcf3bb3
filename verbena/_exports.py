"""Names that modules export, and those that would hide builtins."""

from __future__ import annotations

import dis
import sys
from collections.abc import Callable

from verbena.options import get_option

#: Exported with a trailing underscore; without it they are found as attributes only.
CONFLICTS = {
    "base": {"min", "max", "sum", "abs", "round", "all", "any", "re"},
    "dplyr": {"filter", "slice"},
}
CONFLICTS["all"] = CONFLICTS["base"] | CONFLICTS["dplyr"]

_IMPORT = {dis.opmap[o] for o in ("IMPORT_FROM",) if o in dis.opmap}


def conflict_access(namespace: dict, conflicts: set[str]) -> Callable[[str], object]:
    """A module's ``__getattr__``: ``module.sum`` works, ``from module import sum`` only with the
    option ``allow_conflict_names``."""

    def access(name: str):
        if name in conflicts:
            caller = sys._getframe(1)
            importing = caller.f_lasti >= 0 and caller.f_code.co_code[caller.f_lasti] in _IMPORT
            if not importing or get_option("allow_conflict_names"):
                return namespace[f"{name}_"]
        raise AttributeError(name)

    return access


def exported(namespace: dict, conflicts: set[str] = frozenset()) -> list[str]:
    names = [k for k in namespace if not k.startswith("_")]
    return names + ([c for c in conflicts if f"{c}_" in namespace] if get_option("allow_conflict_names") else [])
