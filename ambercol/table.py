"""The lazy table API: open a query, add steps, compile. Each step is a DataFrame step, and rows are made when a result is asked for.

Some steps run small jobs of their own before that: checks (unique keys, NULL group keys), and counts and quantiles for positions.

Rows keep an order: that of the column named ``position`` (or the business order given), until sort() sets another. Positional
expressions and limit() follow it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import fail
from .expr import Expr, Scope, col, const
from .operators import grouping, joins, positional
from .plans.order import numbered, ranked
from .types import dtype_of

#: The names of the table API, by the class that has them.
NAMES = {
    "boundary": ("app", "from_arrow", "from_numpy", "to_arrow", "to_pandas", "to_numpy"),
    "app": ("capabilities", "open_stream", "query", "schema", "c"),
    "chain": ("filter", "derive", "group", "reduce", "sort", "limit", "nrows", "compile", "jobs", "explain"),
    "expr": ("add", "sub", "mul", "truediv", "mod", "pow", "eq", "ne", "lt", "le", "gt", "ge", "and_", "not_", "isin", "is_null", "cumsum", "shift", "str_len", "str_contains", "str_startswith", "str_endswith", "str_eq"),
}
OPERATIONS = (
    "series", "map", "compare", "filter", "mask", "where", "gather", "sort", "slice", "reduce", "rolling_sum", "shift", "cumsum", "groupby", "groupby_multi", "group_count_distinct", "pack_keys",
    "encode_pattern", "text_length", "text_contains", "text_startswith", "text_endswith", "text_equals", "text_regex_replace", "rng_fill_i32", "rng_fill_f64", "rng_sample_no_replace",
    "rng_permutation", "rng_compat", "map_round", "unique_inverse", "unique", "lookup",
)


class Table:
    """Named columns of equal length: a DataFrame and the order of its rows."""

    def __init__(self, df: DataFrame, order_by: str | list[str] | None = None, scales: dict[str, dict] | None = None):
        self.df = df
        self.order_by = tuple([order_by] if isinstance(order_by, str) else order_by or ())
        self.scales = scales or {}

    @property
    def names(self) -> list[str]:
        return self.df.columns

    @property
    def ncols(self) -> int:
        return len(self.df.columns)

    def column(self, name: str) -> DataFrame:
        return self.df.select(F.col(f"`{name}`"))

    def schema(self) -> list[dict]:
        return [{"name": f.name, "logical": dtype_of(f.dataType), "physical": dtype_of(f.dataType), "nullable": f.nullable, **self.scales.get(f.name, {})} for f in self.df.schema]

    def query(self) -> Chain:
        return Chain(self.df, self.order_by)

    def to_pandas(self):
        from .sources.adapters import to_pandas

        return to_pandas(self._ordered())

    def to_arrow(self):
        return self._ordered().toArrow()

    def to_numpy(self, column: str, fill: bool = False):
        from .sources.adapters import to_numpy

        return to_numpy(self._ordered(), column, fill)

    def _ordered(self) -> DataFrame:
        return self.df.orderBy(*self.order_by) if self.order_by and all(c in self.df.columns for c in self.order_by) else self.df


class Chain:
    """A query under way. Each step returns a new chain; ``jobs`` lists the steps so far."""

    def __init__(self, df: DataFrame, order_by: tuple[str, ...] = (), jobs: tuple[dict, ...] = (), sorted_by: tuple = ()):
        self.df, self.order_by, self._jobs, self.sorted_by = df, tuple(order_by), jobs, sorted_by

    def _next(self, df: DataFrame, op: str, inputs: list[str], params: dict, **changes) -> Chain:
        job = {"op": op, "inputs": inputs, "params": params, "out": df.columns}
        made = Chain(df, changes.get("order_by", self.order_by), (*self._jobs, job), changes.get("sorted_by", self.sorted_by))
        return made

    def _named(self, op: str, *names: str) -> None:
        for n in names:
            if n not in self.df.columns:
                raise fail(op, f"no column {n!r}.", f"use one of {', '.join(self.df.columns)}.")

    def _order(self, op: str) -> list[str]:
        if self.sorted_by:
            raise fail(op, "the rows were sorted, and positions follow the query's own order.", "derive before sort(), or open the sorted table anew.")
        if not self.order_by:
            raise fail(op, "the rows have no order.", "open the table with order_by.")
        return list(self.order_by)

    def _settled(self, e: Expr, temp: list[str]) -> tuple[DataFrame, Expr]:
        """The frame with each positional part of the expression computed into a column of its own, inside out."""
        args = []
        for a in e.args:
            if isinstance(a, Expr):
                self, a = self._inner(a, temp)
            args.append(a)
        if e.op in ("cumsum", "shift", "rolling"):
            base, kind = args[0].bind(Scope(self.df, self.order_by)), None
            kind = self.df.select(base.alias("x")).schema["x"].dataType
            if not isinstance(kind, T.NumericType):
                raise fail(e.op, f"operand is {kind.simpleString()}.", "use a numeric column.")
            order, value, out = self._order(e.op), f"__x{len(temp)}", f"__y{len(temp)}"
            temp += [value, out]
            df = self.df.withColumn(value, base)
            if e.op == "cumsum":
                df = positional.cumsum(df, value, out, order)
            elif e.op == "shift":
                df = positional.shift(df, value, e.args[1], out, order)
            else:
                f = positional.rolling_sum if e.args[2] == "sum" else positional.rolling_mean
                df = f(df, value, e.args[1], out, order, e.args[3])
            return Chain(df, self.order_by, self._jobs, self.sorted_by), col(out)
        if not any(a is not b for a, b in zip(args, e.args)):
            return self, e
        return self, _rebuilt(e, args)

    def _inner(self, e: Expr, temp: list[str]):
        return self._settled(e, temp) if _has_position(e) else (self, e)

    def _bound(self, e: Expr, op: str):
        """(frame, column, temporary columns) of an expression."""
        if not isinstance(e, Expr):
            raise fail(op, f"{e!r} is no expression.", "build one with c().")
        self._named(op, *e.columns())
        temp: list[str] = []
        chain, e = self._inner(e, temp)
        return chain.df, e.bind(Scope(chain.df, self.order_by)), temp

    def filter(self, e: Expr) -> Chain:
        """Rows for which the expression is true."""
        df, c, temp = self._bound(e, "filter")
        kind = df.select(c.alias("x")).schema["x"].dataType
        if not isinstance(kind, T.BooleanType):
            raise fail("filter", f"the expression is {kind.simpleString()}.", "compare it.")
        return self._next(df.filter(c).drop(*temp), "filter", e.columns(), {"expr": repr(e)})

    def derive(self, name: str, e: Expr) -> Chain:
        if name in self.df.columns:
            raise fail("derive", f"there is a column {name!r}.", "choose another name.")
        df, c, temp = self._bound(const(e), "derive")
        return self._next(df.withColumn(name, c).drop(*temp), "derive", const(e).columns(), {"name": name, "expr": repr(e)})

    def group(self, key: str | list[str], aggs: dict, null_keys: str = "refuse", drop_null_measures: bool = False) -> Chain:
        """Groups in order of their keys, columns named column.aggregate. NULL keys are refused unless kept or dropped."""
        keys = [key] if isinstance(key, str) else list(key)
        df = grouping.group(self.df, keys, aggs, null_keys, drop_null_measures)
        return self._next(df, "group", [*keys, *aggs], {"aggs": aggs}, order_by=tuple(keys), sorted_by=())

    def reduce(self, op: str, column: str | None = None):
        """One aggregate over all rows, at once."""
        if column is None:
            if len(self.df.columns) != 1:
                raise fail("reduce", f"there are {len(self.df.columns)} columns.", "name one.")
            column = self.df.columns[0]
        self._named("reduce", column)
        if isinstance(self.df.schema[column].dataType, T.StringType) and op not in ("count", "nunique"):
            raise fail("reduce", f"{column!r} is text.", "count it.")
        return grouping.reduce(self.df, op, column)

    def sort(self, *keys: str, desc: bool = False, flags: list[bool] | None = None, nulls_first: bool = False, position: str | None = None) -> Chain:
        """Stable: rows with a NULL in any key last (or first), ties in the order before.

        ``desc`` holds for all keys; ``flags`` has one such flag for each. ``position`` names a column for each row's place in the order before, which is
        the permutation that sorts.
        """
        if not isinstance(desc, bool):
            raise fail("sort", f"desc is {desc!r}.", "pass True or False for all keys.")
        flags = [desc] * len(keys) if flags is None else list(flags)
        if len(flags) != len(keys) or not all(isinstance(f, bool) for f in flags):
            raise fail("sort", f"flags are {flags!r}.", "pass True or False, one for each key.")
        if not keys:
            raise fail("sort", "no key is given.", "name one.")
        self._named("sort", *keys)
        df = self.df
        if position is not None:
            if position in df.columns:
                raise fail("sort", f"there is a column {position!r}.", "choose another name.")
            df = ranked(df, self._order("sort"), position)
        gone = F.lit(False)
        for k in keys:
            gone = gone | F.col(f"`{k}`").isNull()
        order = [gone.desc() if nulls_first else gone.asc()]
        for k, down in zip(keys, flags):
            col = F.col(f"`{k}`")
            order.append((col.desc_nulls_first() if down else col.asc_nulls_first()) if nulls_first else (col.desc_nulls_last() if down else col.asc_nulls_last()))
        before = self.sorted_by or tuple(F.col(f"`{c}`").asc() for c in self.order_by)
        order = (*order, *before)
        return self._next(df.orderBy(*order), "sort", list(keys), {"desc": desc}, sorted_by=order)

    def positions(self, name: str) -> Chain:
        """Each row's place, from 0, in the order that holds now. The rows are sorted and written once for it."""
        if name in self.df.columns:
            raise fail("positions", f"there is a column {name!r}.", "choose another name.")
        order = self.sorted_by or tuple(F.col(f"`{c}`").asc() for c in self._order("positions"))
        return self._next(numbered(self.df, order, name), "positions", [], {"name": name}, order_by=(name,), sorted_by=())

    def limit(self, n: int | None, offset: int = 0) -> Chain:
        """Rows offset to offset + n in order; n None takes all from offset on."""
        for v in (n, offset):
            if v is not None and (isinstance(v, bool) or not isinstance(v, int) or v < 0):
                raise fail("limit", f"{v!r} is no count.", "use an int of 0 or more.")
        order = self.sorted_by or tuple(F.col(f"`{c}`").asc() for c in self.order_by)
        df = self.df.orderBy(*order) if order else self.df
        df = df.offset(offset) if offset else df
        return self._next(df if n is None else df.limit(n), "limit", [], {"n": n, "offset": offset})

    # beyond the registry
    def join(self, other: Table | DataFrame, key: str, how: str = "inner", other_key: str | None = None) -> Chain:
        build = other.df if isinstance(other, Table) else other
        f: Callable = {"inner": joins.join_inner, "left": joins.join_left, "semi": joins.semi_join, "anti": joins.anti_join}.get(how)
        if f is None:
            raise fail("join", f"{how!r} is no join here.", "use inner, left, semi or anti.")
        return self._next(f(self.df, build, key, other_key), "join", [key], {"how": how})

    def select(self, *names: str) -> Chain:
        self._named("select", *names)
        return self._next(self.df.select(*(F.col(f"`{n}`") for n in names)), "select", list(names), {})

    def union(self, other: Table | DataFrame) -> Chain:
        return self._next(self.df.unionByName(other.df if isinstance(other, Table) else other), "union", [], {})

    def intersect(self, other: Table | DataFrame) -> Chain:
        return self._next(self.df.intersect(other.df if isinstance(other, Table) else other), "intersect", [], {})

    def subtract(self, other: Table | DataFrame) -> Chain:
        return self._next(self.df.subtract(other.df if isinstance(other, Table) else other), "subtract", [], {})

    def nrows(self) -> int:
        return self.df.count()

    def jobs(self) -> list[dict]:
        return list(self._jobs)

    def explain(self) -> str:
        """Catalyst's plan, without running it."""
        return self.df._jdf.queryExecution().explainString(self.df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def compile(self) -> Table:
        """The result as a table, still lazy; rows come in key order after group()."""
        return Table(self.df, () if self.sorted_by else self.order_by)


def _has_position(e: Expr) -> bool:
    return e.op in ("cumsum", "shift", "rolling") or any(isinstance(a, Expr) and _has_position(a) for a in e.args)


def _rebuilt(e: Expr, args: list) -> Expr:
    """The same operation over other operands."""
    own = [a for a in args]
    method = {"fill_null": "fill_null", "replace": "replace", "round": "round", "isin": "isin", "is_null": "is_null", "str_len": "str_len"}.get(e.op, e.op)
    if e.op in ("str_contains", "str_startswith", "str_endswith", "str_eq"):
        raise fail(e.op, "text has no positional form.", "derive the shifted column first.")
    return getattr(own[0], method)(*own[1:])


class App:
    """Entry point over a Spark session: expressions, tables, streams, and what the engine can do."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    c = staticmethod(col)

    def table(self, df: DataFrame, order_by: str | list[str] | None = None) -> Table:
        return Table(df, order_by)

    def query(self, table: Table | DataFrame, order_by: str | list[str] | None = None) -> Chain:
        return (table if isinstance(table, Table) else Table(table, order_by)).query()

    def schema(self, table: Table) -> list[dict]:
        return table.schema()

    def open_stream(self, path: str, mode: str = "lazy", budget_bytes: int | None = None):
        """A block table; with ``mode`` 'full' its rows are read in one go if they fit the budget, else 'lazy' by blocks."""
        from .sources.blocks import open_blocks

        return open_blocks(self.spark, path, mode, budget_bytes)

    def available(self, op: str) -> bool:
        """Whether an operation is there: all of ``OPERATIONS`` are, on any cluster."""
        return op in OPERATIONS

    def capabilities(self) -> dict:
        return {"op_count": len(OPERATIONS), "ops": list(OPERATIONS), "names": {k: list(v) for k, v in NAMES.items()}, "engine": f"Spark {self.spark.version}"}


def app(spark: SparkSession) -> App:
    return App(spark)
