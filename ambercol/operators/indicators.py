"""Technical indicators over trailing rows, many outputs in one pass over the ordered rows.

A spec names an output, an indicator and its parameters. Windows must be full; a NULL or NaN in one gives NaN, or NULL where that is
asked for (``missing``). Returns and rates of change over 0 are infinite, or NaN for 0 over 0, as for IEEE floats. Signals are 0 or
1, and NaN compares false.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import fail
from ..functions.numeric import divide
from ..plans.order import with_window

NAN = float("nan")
#: Indicator to the parameters that it takes.
PARAMETERS = {
    "sma": ("w",), "rsum": ("w",), "rmin": ("w",), "rmax": ("w",), "rstd": ("w", "ddof"), "boll_up": ("w", "k"), "boll_lo": ("w", "k"), "zscore": ("w",), "stoch_k": ("w",),
    "rsi": ("w",), "mom": ("lag",), "roc": ("lag",), "returns": (), "axpb": ("a", "b"), "map_div": ("v",),
    "above_sma": ("w",), "rsi_lt": ("w", "level"), "rsi_gt": ("w", "level"), "cond_and": ("a", "b"),
}
SIGNALS = ("above_sma", "rsi_lt", "rsi_gt", "cond_and")


def _validated(outputs: list[tuple[str, str, dict]]) -> None:
    seen: dict[str, str] = {}
    for name, op, given in outputs:
        if op not in PARAMETERS:
            raise fail("indicators", f"{name!r} asks for {op!r}.", f"use one of {', '.join(PARAMETERS)}.")
        if name in seen:
            raise fail("indicators", f"{name!r} is named twice.", "give each output a name of its own.")
        if extra := set(given) - set(PARAMETERS[op]):
            raise fail("indicators", f"{name!r}: {op} takes no {', '.join(sorted(extra))}.", f"pass {', '.join(PARAMETERS[op]) or 'no parameters'}.")
        if missing := set(PARAMETERS[op]) - set(given) - {"ddof"}:
            raise fail("indicators", f"{name!r}: {op} lacks {', '.join(sorted(missing))}.", "pass it.")
        for p in ("w", "lag"):
            if p in given and (isinstance(given[p], bool) or not isinstance(given[p], int) or given[p] < 1):
                raise fail("indicators", f"{name!r}: {p} is {given[p]!r}.", "use an int of 1 or more.")
        if "ddof" in given and not 0 <= given["ddof"] < given["w"]:
            raise fail("indicators", f"{name!r}: ddof is {given['ddof']!r}.", "use 0 up to w less 1.")
        if op == "cond_and":
            for p in ("a", "b"):
                if seen.get(given[p]) not in SIGNALS:
                    raise fail("indicators", f"{name!r}: {given[p]!r} is no signal before it.", "name an earlier signal.")
        elif any(isinstance(v, float) and not math.isfinite(v) for v in given.values()):
            raise fail("indicators", f"{name!r} has a parameter that is not finite.", "use finite numbers.")
        seen[name] = op


def _builders(x: Column, w: Window, missing: float | None = NAN) -> dict[str, Callable[..., Column]]:
    valid = F.when(~F.isnan(x), x)
    gap = F.lit(missing).cast("double")

    def full(width: int, value: Callable[[Window], Column], reach: int = 0) -> Column:
        frame = w.rowsBetween(-(width - 1), Window.currentRow)
        wide = w.rowsBetween(-(width - 1 + reach), Window.currentRow)
        there = (F.count(F.lit(1)).over(frame) == width) & (F.count(valid).over(wide) == F.count(F.lit(1)).over(wide))
        return F.when(there, value(frame)).otherwise(gap)

    before = lambda n: F.lag(valid, n).over(w)
    growth = lambda n: divide(x, F.lag(x, n).over(w)) - 1
    or_nan = lambda c: F.coalesce(c, gap)
    mean = lambda n: full(n, lambda f: F.avg(valid).over(f))
    std = lambda n, ddof=0: full(n, lambda f: F.sqrt(F.var_pop(valid).over(f) * n / (n - ddof)) if ddof else F.stddev_pop(valid).over(f))
    low, high = (lambda n: full(n, lambda f: F.min(valid).over(f))), (lambda n: full(n, lambda f: F.max(valid).over(f)))

    def stoch(n):
        return F.when(high(n) == low(n), F.when(F.isnan(high(n)), F.lit(NAN)).otherwise(50.0)).otherwise((valid - low(n)) / F.nullif(high(n) - low(n), F.lit(0.0)) * 100)

    def rsi(n):
        # gains and losses were laid down as columns, so a window over them is no window over a window; sums, not means, as a
        # division of both by n rounds, and a ratio that lies on a signal's level leaves it
        up = full(n, lambda f: F.sum("__gain").over(f), 1)
        down = full(n, lambda f: F.sum("__loss").over(f), 1)
        flat = F.when(up == 0, 50.0).otherwise(100.0)
        return F.when(F.isnan(up), F.lit(NAN)).when(down == 0, flat).otherwise(100.0 - 100.0 / (1.0 + up / F.nullif(down, F.lit(0.0))))

    signal = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return {
        "sma": lambda w: mean(w), "rsum": lambda w: full(w, lambda f: F.sum(valid).over(f)), "rmin": lambda w: low(w), "rmax": lambda w: high(w), "rstd": lambda w, ddof=0: std(w, ddof),
        "boll_up": lambda w, k: mean(w) + std(w) * k, "boll_lo": lambda w, k: mean(w) - std(w) * k,
        "zscore": lambda w: F.when(std(w) == 0, 0.0).otherwise(or_nan((valid - mean(w)) / F.nullif(std(w), F.lit(0.0)))), "stoch_k": lambda w: or_nan(stoch(w)), "rsi": lambda w: rsi(w),
        "mom": lambda lag: or_nan(valid - before(lag)), "roc": lambda lag: or_nan(growth(lag) * 100), "returns": lambda: or_nan(growth(1)),
        "axpb": lambda a, b: or_nan(valid * a + b), "map_div": lambda v: or_nan(valid / F.nullif(F.lit(float(v)), F.lit(0.0))),
        "above_sma": lambda w: signal((valid > mean(w)) & ~F.isnan(mean(w))), "rsi_lt": lambda w, level: signal((rsi(w) < level) & ~F.isnan(rsi(w))), "rsi_gt": lambda w, level: signal((rsi(w) > level) & ~F.isnan(rsi(w))),
    }


def indicators(df: DataFrame, column: str, outputs: list[tuple[str, str, dict]], order_by: str | list[str], partition_by: list[str] | None = None, missing: float | None = NAN) -> DataFrame:
    """Add an output column for each (name, indicator, parameters); ``missing`` stands where a window is not full."""
    _validated(outputs)
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    reach = max([1, *(p.get("w", 0) + 1 for _, _, p in outputs), *(p.get("lag", 0) + 1 for _, _, p in outputs), 2])
    x = F.col(column).cast("double")
    rows = with_window(df, order, 2, lambda w: {"__step": F.when(~F.isnan(x), x) - F.lag(F.when(~F.isnan(x), x)).over(w)}, partition_by)
    rows = rows.withColumns({"__gain": F.greatest(F.coalesce("__step", F.lit(0.0)), F.lit(0.0)), "__loss": F.greatest(-F.coalesce("__step", F.lit(0.0)), F.lit(0.0))})
    plain = [o for o in outputs if o[1] != "cond_and"]
    out = with_window(rows, order, reach, lambda w: {name: _builders(x, w, missing)[op](**given) for name, op, given in plain}, partition_by)
    for name, op, given in outputs:
        if op == "cond_and":
            out = out.withColumn(name, (F.col(given["a"]) * F.col(given["b"])).cast("int"))
    return out.drop("__step", "__gain", "__loss")
