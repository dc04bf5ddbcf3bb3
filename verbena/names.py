"""Column name repair."""

from __future__ import annotations

import inspect
import keyword
import re
from collections import Counter


class NameNonUniqueError(ValueError):
    """A name occurs more than once."""


def _text(name) -> str:
    return "" if name is None or (isinstance(name, float) and name != name) else str(name)


def _suffix_free(name: str) -> str:
    """A name without the position that repair added before."""
    return "" if re.fullmatch(r"_\d+|__", name) else re.sub(r"(?<!_)(__\d+)+$", "", name)


def _numbered(names: list[str]) -> list[str]:
    counts = Counter(names)
    return [f"{n}__{i}" if not n or counts[n] > 1 else n for i, n in enumerate(names)]


def _unique(names: list) -> list[str]:
    return _numbered([_suffix_free(_text(n)) for n in names])


def _syntactic(name) -> str:
    name = re.sub(r"\W", "_", _suffix_free(_text(name)))
    return f"_{name}" if name and (keyword.iskeyword(name) or name[0].isdigit()) else name


def _universal(names: list[str]) -> list[str]:
    return _numbered([_syntactic(n) for n in names])


def _checked(names: list[str]) -> list[str]:
    names = [_text(n) for n in names]
    twice = [n for n, k in Counter(names).items() if k > 1]
    if twice:
        raise NameNonUniqueError(f"names are not unique: {twice}")
    if any(not _suffix_free(n) for n in names):
        raise NameNonUniqueError("names cannot be empty or a position")
    return names


def repair_names(names, repair="check_unique") -> list[str]:
    """Names repaired by a policy (minimal, unique, universal, check_unique), a list of new
    names, or a function of one name or, by its annotation, of all names."""
    names = list(names)
    if isinstance(repair, str):
        policies = {"minimal": lambda x: [_text(n) for n in x], "unique": _unique, "universal": _universal, "check_unique": _checked}
        if repair not in policies:
            raise ValueError(f"name repair must be one of {sorted(policies)}, not {repair!r}")
        return policies[repair](names)
    if callable(repair):
        try:
            first = next(iter(inspect.signature(repair).parameters.values()), None)
            note = first.annotation if first is not None else None
        except (TypeError, ValueError):
            note = None
        single = note in (None, str, "str", inspect.Parameter.empty)
        return [repair(n) for n in names] if single else list(repair(names))
    if not isinstance(repair, (list, tuple)) or len(repair) != len(names):
        raise ValueError("as many new names as columns are needed")
    return list(repair)


def make_names(names, unique: bool = False) -> list[str]:
    """Valid identifiers: other characters become underscores, a leading digit gets one."""
    one = isinstance(names, str) or not hasattr(names, "__iter__")
    out = [re.sub(r"\W+", "_", _text(n)) for n in ([names] if one else names)]
    out = [f"_{s}" if not s or s[0].isdigit() else s for s in out]
    return repair_names(out, "unique") if unique else out


def make_unique(names) -> list[str]:
    return make_names(names, unique=True)
