"""Python-compatible rounding.

The reference rounds with Python's ``round(x, n)``: half-to-even on the *exact* binary
value of the double. Spark's ``round`` rounds the shortest decimal rendering half-up,
so ``0.75525`` (stored as 0.755249999…) becomes 0.7553 in Spark and 0.7552 in Python.
``pyround`` scales with an error-free product (Dekker's split), so it sees the exact
fraction and decides ties the way Python does. The argument is bound once through a
one-element ``transform`` so a large expression is not evaluated repeatedly.

``python_round_sql`` rewrites every ``round(x, n)`` of an SQL text into the same
arithmetic, so the DuckDB oracle rounds like the reference too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPLIT = 134217729.0  # 2**27 + 1


def _exact_round(v: Column, scale: float) -> Column:
    p = v * scale
    c = v * _SPLIT
    hi = c - (c - v)
    lo = v - hi
    err = (hi * scale - p) + lo * scale  # p + err == v * scale exactly
    n = F.floor(p).cast("double")
    frac = (p - n) + err
    up = (frac > 0.5) | ((frac == 0.5) & (F.pmod(n, F.lit(2.0)) == 1.0))
    r = F.when(up, n + 1.0).otherwise(n) / scale
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < 1e15)
    return F.when(finite, r).otherwise(v)


def pyround(x: Column | str, ndigits: int) -> Column:
    """``round(x, ndigits)`` with Python's semantics (NULL/NaN pass through)."""
    scale = float(10 ** ndigits)
    if scale >= 2 ** 26:
        raise ValueError("ndigits too large for an exact split")
    if isinstance(x, str):  # a plain column: no need to bind it
        return _exact_round(F.col(x).cast("double"), scale)
    return F.element_at(F.transform(F.array(x.cast("double")), lambda v: _exact_round(v, scale)), 1)


def _sql_round(x: str, nd: int) -> str:
    s = f"cast({10 ** nd} as double)"
    v = f"cast(({x}) as double)"
    p = f"({v} * {s})"
    c = f"({v} * cast(134217729 as double))"
    hi = f"({c} - ({c} - {v}))"
    lo = f"({v} - {hi})"
    err = f"(({hi} * {s} - {p}) + {lo} * {s})"
    n = f"floor({p})"
    frac = f"(({p} - {n}) + {err})"
    return (f"(case when {v} is null then null when ({frac} > 0.5 or ({frac} = 0.5 and {n} % 2 = 1)) "
            f"then ({n} + 1) / {s} else {n} / {s} end)")


def python_round_sql(sql: str) -> str:
    """Rewrite ``round(expr, n)`` calls (not ``bround``) into exact half-even rounding."""
    out, i, low = [], 0, sql.lower()
    while True:
        j = low.find("round(", i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        if j > 0 and (low[j - 1].isalnum() or low[j - 1] == "_"):
            out.append(sql[i:j + 6])
            i = j + 6
            continue
        depth, k, comma = 1, j + 6, -1
        while depth:
            ch = sql[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
            elif ch == "," and depth == 1:
                comma = k
            elif ch == "'":
                k = sql.index("'", k + 1)
            k += 1
        if comma < 0:
            out.append(sql[i:k])
            i = k
            continue
        arg = python_round_sql(sql[j + 6:comma])
        nd = int(sql[comma + 1:k - 1].strip())
        out.append(sql[i:j] + _sql_round(arg, nd))
        i = k


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and pass it to ``body`` as a lambda variable.

    Catalyst trees duplicate a Python-side Column that is referenced several times, and
    higher-order functions are not covered by subexpression elimination; binding through
    a one-element ``transform`` keeps an expensive value (a vote, a regex scan) from
    being recomputed for every reference.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def where_computed(df: DataFrame, condition: Column) -> DataFrame:
    """``df.where(condition)`` for a condition on columns that are dear to compute.

    A plain filter is pushed below the projections that make its columns, so that all of them are put into the condition, over
    and over where they build on each other, and are computed again above it. On a generated column it stays where it is.
    """
    return df.select("*", F.explode_outer(F.array(condition)).alias("__keep")).where("__keep").drop("__keep")
