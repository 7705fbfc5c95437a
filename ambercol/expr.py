"""Expressions over named columns, turned into Spark columns once the table they meet is known.

An expression holds a function from a frame's schema to a Column. Type errors are raised from the schema, before any job runs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import fail
from .functions import numeric
from .types import is_integer, is_numeric


@dataclass(frozen=True)
class Scope:
    """What an expression is bound to: a frame, and how its rows are ordered."""

    df: DataFrame
    order_by: tuple[str, ...]

    def type_of(self, c: Column) -> T.DataType:
        return self.df.select(c.alias("x")).schema["x"].dataType


@dataclass(frozen=True, eq=False)
class Expr:
    op: str
    args: tuple
    build: Callable[[Scope], Column] = field(repr=False)

    def bind(self, scope: Scope) -> Column:
        return self.build(scope)

    def columns(self) -> list[str]:
        """Names that the expression reads, in order of first use."""
        own = [self.args[0]] if self.op == "col" else []
        return list(dict.fromkeys(own + [n for a in self.args if isinstance(a, Expr) for n in a.columns()]))

    # arithmetic
    def _math(self, op: str, other, f, back: bool = False) -> Expr:
        a, b = (const(other), self) if back else (self, const(other))

        def build(s: Scope) -> Column:
            x, y = a.bind(s), b.bind(s)
            for c in (x, y):
                t = s.type_of(c)
                if not is_numeric(t):
                    raise fail(op, f"operand is {t.simpleString()}.", "use numeric columns; take str_len() of text first.")
            return f(s, x, y)

        return Expr(op, (a, b), build)

    def add(self, other) -> Expr:
        return self._math("add", other, lambda s, x, y: _wide(s, x) + _wide(s, y))

    def sub(self, other) -> Expr:
        return self._math("sub", other, lambda s, x, y: _wide(s, x) - _wide(s, y))

    def mul(self, other) -> Expr:
        return self._math("mul", other, lambda s, x, y: _wide(s, x) * _wide(s, y))

    def truediv(self, other) -> Expr:
        return self._math("truediv", other, lambda s, x, y: numeric.divide(x, y))

    def mod(self, other) -> Expr:
        return self._math("mod", other, lambda s, x, y: numeric.mod(x, y))

    def floor_div(self, other) -> Expr:
        return self._math("floor_div", other, lambda s, x, y: numeric.floor_div_int(x, y) if is_integer(s.type_of(x)) and is_integer(s.type_of(y)) else numeric.floor_div(x, y))

    def pow(self, other) -> Expr:
        return self._math("pow", other, lambda s, x, y: F.pow(x, y))

    __add__, __sub__, __mul__, __truediv__, __mod__, __floordiv__, __pow__ = add, sub, mul, truediv, mod, floor_div, pow

    def __radd__(self, other) -> Expr:
        return const(other).add(self)

    def __rsub__(self, other) -> Expr:
        return const(other).sub(self)

    def __rmul__(self, other) -> Expr:
        return const(other).mul(self)

    def __rtruediv__(self, other) -> Expr:
        return const(other).truediv(self)

    def __rmod__(self, other) -> Expr:
        return const(other).mod(self)

    def __rpow__(self, other) -> Expr:
        return const(other).pow(self)

    # comparison
    def _compare(self, op: str, other, f) -> Expr:
        b = const(other)

        def build(s: Scope) -> Column:
            x, y = self.bind(s), b.bind(s)
            tx, ty = s.type_of(x), s.type_of(y)
            text = [isinstance(t, T.StringType) for t in (tx, ty)]
            if any(text):
                if not all(text):
                    raise fail(op, f"{tx.simpleString()} is compared with {ty.simpleString()}.", "compare columns and values of one kind.")
                if op not in ("eq", "ne"):
                    raise fail(op, "text has no defined order here.", "use eq, ne, isin or a str_ predicate.")
            floats = any(isinstance(t, (T.FloatType, T.DoubleType)) for t in (tx, ty))
            if floats:
                return f(x, y) & ~F.isnan(x) & ~F.isnan(y) if op != "ne" else numeric.ne_nan(x, y)
            return f(x, y)

        return Expr(op, (self, b), build)

    def eq(self, other) -> Expr:
        return self._compare("eq", other, lambda x, y: x == y)

    def ne(self, other) -> Expr:
        return self._compare("ne", other, lambda x, y: x != y)

    def lt(self, other) -> Expr:
        return self._compare("lt", other, lambda x, y: x < y)

    def le(self, other) -> Expr:
        return self._compare("le", other, lambda x, y: x <= y)

    def gt(self, other) -> Expr:
        return self._compare("gt", other, lambda x, y: x > y)

    def ge(self, other) -> Expr:
        return self._compare("ge", other, lambda x, y: x >= y)

    __eq__, __ne__, __lt__, __le__, __gt__, __ge__ = eq, ne, lt, le, gt, ge  # type: ignore[assignment]
    __hash__ = object.__hash__

    def __bool__(self):
        raise fail("bool", "an expression has no truth value.", "combine expressions with &, | and ~.")

    # logic
    def _logic(self, op: str, other, f) -> Expr:
        def build(s: Scope) -> Column:
            cs = [e.bind(s) for e in ((self,) if other is None else (self, const(other)))]
            for c in cs:
                if not isinstance(s.type_of(c), T.BooleanType):
                    raise fail(op, f"operand is {s.type_of(c).simpleString()}.", "compare it first.")
            return f(*cs)

        return Expr(op, (self,) if other is None else (self, const(other)), build)

    def and_(self, other) -> Expr:
        return self._logic("and_", other, lambda x, y: x & y)

    def or_(self, other, strict: bool = False) -> Expr:
        """Kleene's or; with ``strict`` NULL if either side is NULL."""
        return self._logic("or_", other, numeric.strict_or if strict else lambda x, y: x | y)

    def not_(self) -> Expr:
        return self._logic("not_", None, lambda x: ~x)

    __and__, __or__, __invert__ = and_, or_, not_

    def isin(self, values: list) -> Expr:
        if not isinstance(values, (list, tuple, set, frozenset)) or not values:
            raise fail("isin", f"{values!r} is no non-empty list.", "pass a list of values.")
        if any(v is None for v in values):
            raise fail("isin", "the list holds None.", "test NULL with is_null().")
        return Expr("isin", (self, tuple(values)), lambda s: self.bind(s).isin(list(values)))

    def is_null(self) -> Expr:
        return Expr("is_null", (self,), lambda s: self.bind(s).isNull())

    def fill_null(self, value) -> Expr:
        v = const(value)
        return Expr("fill_null", (self, v), lambda s: F.coalesce(self.bind(s), v.bind(s)))

    def replace(self, old, new) -> Expr:
        a, b = const(old), const(new)
        return Expr("replace", (self, a, b), lambda s: F.when(self.bind(s) == a.bind(s), b.bind(s)).otherwise(self.bind(s)))

    def round(self, ndigits: int = 0) -> Expr:
        return Expr("round", (self, ndigits), lambda s: numeric.round_half_even(self.bind(s), ndigits))

    # text
    def _text(self, op: str, f) -> Expr:
        def build(s: Scope) -> Column:
            x = self.bind(s)
            if not isinstance(s.type_of(x), T.StringType):
                raise fail(op, f"operand is {s.type_of(x).simpleString()}.", "use a text column.")
            return f(x)

        return Expr(op, (self,), build)

    def str_len(self) -> Expr:
        return self._text("str_len", F.char_length)

    def str_contains(self, part: str) -> Expr:
        return self._text("str_contains", lambda x: x.contains(F.lit(part)))

    def str_startswith(self, part: str) -> Expr:
        return self._text("str_startswith", lambda x: x.startswith(F.lit(part)))

    def str_endswith(self, part: str) -> Expr:
        return self._text("str_endswith", lambda x: x.endswith(F.lit(part)))

    def str_eq(self, value: str) -> Expr:
        return self._text("str_eq", lambda x: x == F.lit(value))

    # positional: Chain computes these as columns of their own
    def cumsum(self) -> Expr:
        return Expr("cumsum", (self,), _positional("cumsum"))

    def shift(self, n: int = 1) -> Expr:
        if isinstance(n, bool) or not isinstance(n, int) or n < 0:
            raise fail("shift", f"n is {n!r}.", "use an int of 0 or more.")
        return Expr("shift", (self, n), _positional("shift"))

    def rolling(self, window: int, agg: str = "sum", min_periods: int | None = None) -> Expr:
        if isinstance(window, bool) or not isinstance(window, int) or window < 1:
            raise fail("rolling", f"window is {window!r}.", "use an int of 1 or more.")
        if agg not in ("sum", "mean"):
            raise fail("rolling", f"{agg!r} is no aggregate here.", "use 'sum' or 'mean'.")
        return Expr("rolling", (self, window, agg, min_periods), _positional("rolling"))


def _wide(s: Scope, c: Column) -> Column:
    """Integers narrower than 64 bits are widened, so that sums and products do not overflow where they need not."""
    return c.cast("long") if is_integer(s.type_of(c)) else c


def _positional(op: str):
    def build(s: Scope) -> Column:
        raise fail(op, "a positional expression stands where none can.", "use it in derive() or filter() of a query with an order.")

    return build


def col(name: str) -> Expr:
    def build(s: Scope) -> Column:
        if name not in s.df.columns:
            raise fail("c", f"no column {name!r}.", f"use one of {', '.join(c for c in s.df.columns if not c.startswith('__'))}.")
        return F.col(f"`{name}`")

    return Expr("col", (name,), build)


def const(value) -> Expr:
    """A literal; expressions pass through."""
    if isinstance(value, Expr):
        return value
    if value is None:
        raise fail("const", "None is no operand.", "test NULL with is_null().")
    return Expr("const", (value,), lambda s: F.lit(value))
