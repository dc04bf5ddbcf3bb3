"""Options. Names with ``.`` and ``_`` are the same."""

from __future__ import annotations

import contextlib
import tomllib
from pathlib import Path
from typing import Any


class Options(dict):
    """Options that can also be read as attributes."""

    def __getattr__(self, name: str) -> Any:
        try:
            return self[name]
        except KeyError:
            raise AttributeError(name) from None


def _key(name: str) -> str:
    return name.replace(".", "_")


#: ``max_levels``: distinct values that become factor levels or column names on the driver, at most;
#: ``max_groups``: groups that a function is called on one after the other, at most.
OPTIONS = Options(allow_conflict_names=False, backends=[], dplyr_summarise_inform=True, nan_is_na=False, max_levels=100_000, max_groups=10_000)


def load(*paths: Path) -> None:
    """Options from TOML files, later ones first in authority."""
    for path in paths:
        if path.is_file():
            OPTIONS.update({_key(k): v for k, v in tomllib.loads(path.read_text()).items()})


load(Path.home() / ".verbena.toml", Path(".verbena.toml"))


def options(*args, _return: bool | None = None, **kwargs) -> Options | None:
    """All options, those named, or, when some are set, their previous values."""
    if not args and not kwargs:
        return Options(OPTIONS)
    names, pairs = [], {}
    for a in args:
        if isinstance(a, dict):
            pairs |= {_key(k): v for k, v in a.items()}
        else:
            names.append(_key(a))
    pairs |= {_key(k): v for k, v in kwargs.items()}
    out = Options({k: OPTIONS[k] for k in [*names, *pairs] if k in OPTIONS})
    OPTIONS.update(pairs)
    wanted = bool(names) and not pairs if _return is None else _return
    return out if wanted or (names and _return is None) else None


@contextlib.contextmanager
def options_context(**kwargs):
    """Options for the duration of a block."""
    before = dict(OPTIONS)
    options(**kwargs)
    try:
        yield
    finally:
        OPTIONS.clear()
        OPTIONS.update(before)


def get_option(name: str, default: Any = None) -> Any:
    return OPTIONS.get(_key(name), default)


def few(df, what: str) -> list:
    """The rows of a DataFrame that the driver needs, ``max_levels`` at most; more are an error."""
    most = OPTIONS["max_levels"]
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} {what}; the option max_levels raises the limit")
    return rows


def add_option(name: str, default: Any = None) -> None:
    OPTIONS[_key(name)] = default
