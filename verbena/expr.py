"""Symbolic expressions, functions and verbs.

``f.x + 1`` builds a tree; nothing is computed until a verb lowers the tree against a frame.
"""

from __future__ import annotations

import functools
from typing import Any

import numpy as np


class Expr:
    """A delayed expression. Comparisons build expressions, so it has no truth value."""

    __slots__ = ()
    __hash__ = object.__hash__

    def __bool__(self):
        raise TypeError("an expression has no truth value; combine conditions with & and |")

    def __iter__(self):
        raise TypeError("an expression cannot be iterated")

    def __getattr__(self, name):
        if name.startswith("__"):
            raise AttributeError(name)
        return Attr(self, name)

    def __getitem__(self, key):
        return Item(self, key)

    def __array_ufunc__(self, ufunc, method, *inputs, **kwargs):
        if method != "__call__":
            return NotImplemented
        return Call("array_ufunc", (inputs[0], ufunc, *inputs[1:]), kwargs)

    def __neg__(self):
        return Op("neg", (self,))

    def __pos__(self):
        return self

    def __invert__(self):
        return Op("~", (self,))

    def __rshift__(self, other):
        return NotImplemented


def _binary(symbol: str, swapped: bool = False):
    def method(self, other):
        return Op(symbol, (other, self) if swapped else (self, other))

    return method


for _name, _symbol in {"add": "+", "sub": "-", "mul": "*", "truediv": "/", "floordiv": "//", "mod": "%", "pow": "**", "and": "&", "or": "|", "xor": "^"}.items():
    setattr(Expr, f"__{_name}__", _binary(_symbol))
    setattr(Expr, f"__r{_name}__", _binary(_symbol, True))
for _name, _symbol in {"eq": "==", "ne": "!=", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}.items():
    setattr(Expr, f"__{_name}__", _binary(_symbol))
Expr.__hash__ = object.__hash__


class Col(Expr):
    __slots__ = ("name",)

    def __init__(self, name: str | int):
        self.name = name

    def __repr__(self):
        return f"f.{self.name}"


class Attr(Expr):
    __slots__ = ("attr", "parent")

    def __init__(self, parent: Expr, attr: str):
        self.parent, self.attr = parent, attr

    def __call__(self, *args, **kwargs):
        return Method(self.parent, self.attr, args, kwargs)

    def __repr__(self):
        return f"{self.parent!r}.{self.attr}"


class Method(Expr):
    __slots__ = ("args", "kwargs", "name", "parent")

    def __init__(self, parent, name, args, kwargs):
        self.parent, self.name, self.args, self.kwargs = parent, name, args, kwargs


class Item(Expr):
    __slots__ = ("key", "parent")

    def __init__(self, parent, key):
        self.parent, self.key = parent, key


class Op(Expr):
    __slots__ = ("args", "symbol")

    def __init__(self, symbol: str, args: tuple):
        self.symbol, self.args = symbol, args

    def __repr__(self):
        return f"({f' {self.symbol} '.join(map(repr, self.args))})"


class Call(Expr):
    """A call of a registered function whose arguments hold expressions."""

    __slots__ = ("args", "kwargs", "name")

    def __init__(self, name: str, args: tuple = (), kwargs: dict | None = None):
        self.name, self.args, self.kwargs = name, args, kwargs or {}

    def __rrshift__(self, data):
        """Plain data piped into a function is its first argument."""
        if has_expr(data):
            return Call(self.name, (data, *self.args), self.kwargs)
        return FUNCTIONS[self.name](data, *self.args, **self.kwargs)

    def __repr__(self):
        return f"{self.name}({', '.join(map(repr, self.args))})"


class Range(Expr):
    """``c[a:b]`` or ``c[a:b:step]``: positions or columns; the stop is part of it only when a
    step is given."""

    __slots__ = ("parts",)

    def __init__(self, parts: tuple):
        self.parts = parts

    def values(self) -> list:
        """The numbers of a range without expressions."""
        out: list = []
        for part in self.parts:
            if isinstance(part, slice):
                start, stop = part.start or 0, part.stop
                step = part.step or (1 if stop >= start else -1)
                out += range(start, stop + ((1 if step > 0 else -1) if part.step is not None else 0), step)
            else:
                out.append(part)
        return out

    def __iter__(self):
        return iter(self.values())


class Symbol:
    """``f``: ``f.x``, ``f['x']`` and ``f[0]`` are columns."""

    def __getattr__(self, name: str) -> Col:
        if name.startswith("__"):
            raise AttributeError(name)
        return Col(name)

    def __getitem__(self, key):
        if isinstance(key, slice):
            return Range((key,))
        if isinstance(key, tuple):
            return Range(key)
        if isinstance(key, Col):
            return key
        return Col(key)

    def __repr__(self):
        return "f"


class Collection:
    """``c(...)`` concatenates, ``c[...]`` builds ranges."""

    def __call__(self, *args):
        if any(has_expr(a) for a in args):
            return Call("c_", args)
        out: list = []
        for a in args:
            out += list(a) if isinstance(a, (list, tuple, range, np.ndarray, Range)) else [a]
        return out

    def __getitem__(self, key):
        key = key if isinstance(key, tuple) else (key,)
        out = Range(key)
        plain = all(not has_expr(p) if not isinstance(p, slice) else not any(has_expr(x) for x in (p.start, p.stop)) and isinstance(p.stop, int) and (p.start or 0) >= 0 <= p.stop for p in key)
        return out if not plain or any(isinstance(p, str) for p in key) else RangeList(out)


class RangeList(list):
    """A plain range that selectors can still read as a range."""

    def __init__(self, source: Range):
        super().__init__(source.values())
        self.source = source

    def __invert__(self):
        return Op("~", (self.source,))

    def __neg__(self):
        return Op("neg", (self.source,))


f = Symbol()
c = Collection()


def has_expr(x: Any) -> bool:
    """Whether an argument holds an expression anywhere."""
    if isinstance(x, (Expr, Symbol)):
        return True
    if isinstance(x, slice):
        return has_expr(x.start) or has_expr(x.stop)
    if isinstance(x, dict):
        return any(map(has_expr, x.values()))
    return isinstance(x, (list, tuple)) and any(map(has_expr, x))


def columns_of(x: Any) -> set:
    """Names and positions of the columns that an expression reads."""
    if isinstance(x, Col):
        return {x.name}
    if isinstance(x, (Attr, Item)):
        return columns_of(x.parent) | (columns_of(x.key) if isinstance(x, Item) else set())
    if isinstance(x, Op):
        return set().union(*map(columns_of, x.args))
    if isinstance(x, (Call, Method)):
        out = set().union(*map(columns_of, x.args), *map(columns_of, x.kwargs.values()), set())
        return out | (columns_of(x.parent) if isinstance(x, Method) else set())
    if isinstance(x, (list, tuple)):
        return set().union(*map(columns_of, x), set())
    if isinstance(x, dict):
        return set().union(*map(columns_of, x.values()), set())
    return set()


#: Registered functions: name -> how to lower a call.
FUNCTIONS: dict[str, Any] = {}


class Function:
    """A function of the grammar. With an expression among its arguments (or without any data)
    a call is delayed; on plain data it runs at once."""

    def __init__(self, name, lower, kind, eager=None, always=False):
        self.__name__, self.lower, self.kind, self.eager, self.always = name, lower, kind, eager, always
        self.__doc__ = lower.__doc__
        FUNCTIONS[name] = self

    def __call__(self, *args, **kwargs):
        plain = args and isinstance(args[0], (list, tuple, range, np.ndarray)) and not has_expr(args)
        if (self.always and not (plain and self.eager)) or any(map(has_expr, args)) or has_expr(kwargs):
            return Call(self.__name__, args, kwargs)
        if self.eager is not None:
            return self.eager(*args, **kwargs)
        if not args:
            return Call(self.__name__, args, kwargs)
        from verbena.frame import evaluate

        return evaluate(self, args, kwargs)

    def __repr__(self):
        return f"<function {self.__name__}>"


def function(kind: str = "row", name: str | None = None, eager=None, always: bool = False):
    """Register a function. ``kind``: row (a value for each row), agg (one for each group),
    window (needs the rows of the group in order), select (column selection), special."""

    def wrap(lower):
        return Function(name or lower.__name__, lower, kind, eager, always)

    return wrap


class VerbCall:
    """A verb that waits for its frame: ``frame >> verb(...)``."""

    def __init__(self, verb, args, kwargs):
        self.verb, self.args, self.kwargs = verb, args, kwargs

    def __rrshift__(self, data):
        return self.verb.run(data, *self.args, **self.kwargs)

    def __repr__(self):
        return f"<{self.verb.__name__} waiting for data>"


class Verb:
    """A verb of the grammar, to be called on a frame or piped into."""

    def __init__(self, fn, tables: int, plain: bool):
        functools.update_wrapper(self, fn)
        self.run_fn, self.tables, self.plain = fn, tables, plain

    def run(self, data, /, *args, **kwargs):
        from verbena.frame import Frame, as_frame, is_table

        if is_table(data):
            data = as_frame(data)
        elif not self.plain:
            raise TypeError(f"{self.__name__}() needs a frame, not {type(data).__name__}")
        if isinstance(data, Frame):
            args = tuple(as_frame(a) if is_table(a) else a for a in args)
            kwargs = {k: as_frame(v) if is_table(v) else v for k, v in kwargs.items()}
        return self.run_fn(data, *args, **kwargs)

    def __call__(self, *args, **kwargs):
        from verbena.frame import is_table

        given = sum(map(is_table, args[: self.tables])) + sum(is_table(kwargs.get(k)) for k in ("_data", "data", "x", "y"))
        if args and is_table(args[0]) and given >= self.tables:
            return self.run(*args, **kwargs)
        vector = args and isinstance(args[0], (list, tuple, range, np.ndarray))
        if self.plain and vector and not any(map(has_expr, args)) and len(args) >= self.plain:
            return self.run(*args, **kwargs)
        for key in ("_data", "data", "x"):
            if is_table(kwargs.get(key)):
                return self.run(kwargs.pop(key), *args, **kwargs)
        return VerbCall(self, args, kwargs)


def verb(fn=None, *, tables: int = 1, plain: int = 0):
    """Make a verb. ``tables``: frames it needs; ``plain``: it also works on plain data when
    called with at least so many arguments."""
    return Verb(fn, tables, plain) if fn is not None else lambda fn: Verb(fn, tables, plain)


register_verb = verb


def register_func(kind: str = "row"):
    """Make an expression function of a Column-in, Column-out function."""

    def wrap(fn):
        return Function(fn.__name__, lambda ctx, *args, **kwargs: fn(*[ctx.col(a) for a in args], **kwargs), kind)

    return wrap
