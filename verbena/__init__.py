"""A grammar of data manipulation on Apache Spark.

``from verbena.all import *`` gives the verbs and functions; frames are piped with ``>>``.
"""

from __future__ import annotations

from verbena.expr import c, f, register_func, register_verb
from verbena.options import add_option, get_option, options, options_context

__version__ = "0.1.0"
__all__ = ["add_option", "arg_match", "c", "f", "get_option", "get_versions", "options", "options_context", "register_func", "register_verb"]


def get_versions(prnt: bool = True) -> dict[str, str] | None:
    """Print (or return) the versions of what this library runs on."""
    import sys

    import numpy
    import pandas
    import pyarrow
    import pyspark

    out = {"python": sys.version, "verbena": __version__, "pyspark": pyspark.__version__, "numpy": numpy.__version__, "pandas": pandas.__version__, "pyarrow": pyarrow.__version__}
    if not prnt:
        return out
    for name, version in out.items():
        print(f"{name:10}: {version}")
    return None


def arg_match(arg, argname: str, values, errmsg: str | None = None):
    """``arg``, which must be one of some values."""
    values = list(values)
    if arg not in values:
        raise ValueError(errmsg or f"`{argname}` must be one of {values}.")
    return arg
