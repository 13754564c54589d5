"""Distances between vectors (arrays of numbers), as native expressions.

Each is a FLOAT, computed in DOUBLE from left to right.  A null vector or
element gives null.  Vectors of different lengths are an error ("must match").
``sql_*`` give SQL text, the functions of the same names give columns, and
``register`` puts Arrow forms under the public names, for plain ``spark.sql``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

METRICS = {"l2sq": "l2_distance", "cos": "cosine_distance", "ip": "negative_dot_product"}

_DOUBLES = "CAST(CAST({} AS ARRAY<FLOAT>) AS ARRAY<DOUBLE>)"


def _sum(term: str, a: str, b: str) -> str:
    return f"aggregate(zip_with({_DOUBLES.format(a)}, {_DOUBLES.format(b)}, (x_, y_) -> {term}), 0D, (s_, x_) -> s_ + x_)"


def _checked(a: str, b: str, value: str) -> str:
    bad = f"raise_error(concat('vector dimensions must match: ', size({a}), ' and ', size({b})))"
    return f"CAST(CASE WHEN size({a}) <> size({b}) THEN {bad} ELSE {value} END AS FLOAT)"


def sql_l2(a: str, b: str) -> str:
    return _checked(a, b, _sum("(x_ - y_) * (x_ - y_)", a, b))


def sql_cosine(a: str, b: str) -> str:
    """One pass sums the product and both squares."""
    pairs = f"zip_with({_DOUBLES.format(a)}, {_DOUBLES.format(b)}, (x_, y_) -> named_struct('x', x_, 'y', y_))"
    step = "named_struct('d', s_.d + v_.x * v_.y, 'a', s_.a + v_.x * v_.x, 'b', s_.b + v_.y * v_.y)"
    end = "CASE WHEN s_.a = 0 OR s_.b = 0 THEN 1D ELSE 1D - s_.d / (sqrt(s_.a) * sqrt(s_.b)) END"
    return _checked(a, b, f"aggregate({pairs}, named_struct('d', 0D, 'a', 0D, 'b', 0D), (s_, v_) -> {step}, s_ -> {end})")


def sql_negative_dot(a: str, b: str) -> str:
    return _checked(a, b, f"-({_sum('x_ * y_', a, b)})")


MACROS = {"l2_distance": sql_l2, "cosine_distance": sql_cosine, "negative_dot_product": sql_negative_dot}


def vector_literal(q) -> str:
    """SQL text of a query vector."""
    values = [float(x) for x in q]
    if not values or not all(map(math.isfinite, values)):
        raise ValueError("a query vector needs finite numbers")
    return "CAST(array(" + ", ".join(f"{x!r}D" for x in values) + ") AS ARRAY<FLOAT>)"


def distance(metric: str, column: str, q) -> Column:
    """Distance of a column (its name) to a query vector, or to another column if ``q`` is a name."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    return F.expr(MACROS[METRICS[metric]](column, q if isinstance(q, str) else vector_literal(q)))


def _rows(a: pd.Series, b: pd.Series, of) -> pd.Series:
    def one(x, y):
        if x is None or y is None:
            return None
        x, y = (np.asarray(v, np.float64).astype(np.float32).astype(np.float64) for v in (x, y))
        if len(x) != len(y):
            raise ValueError(f"vector dimensions must match: {len(x)} and {len(y)}")
        value = of(x, y)
        return None if math.isnan(value) else np.float32(value)

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float32" if len(a) == 0 else object)


def _add(v: np.ndarray) -> float:
    """Left to right, as the native form adds."""
    return float(np.add.accumulate(v)[-1]) if len(v) else 0.0


def _cosine(x: np.ndarray, y: np.ndarray) -> float:
    na, nb = _add(x * x), _add(y * y)
    return 1.0 if not na or not nb else 1 - _add(x * y) / (math.sqrt(na) * math.sqrt(nb))


def register(spark: SparkSession) -> None:
    kernels = {"l2_distance": lambda x, y: _add((x - y) ** 2), "cosine_distance": _cosine, "negative_dot_product": lambda x, y: -_add(x * y)}

    def named(of):
        @F.pandas_udf("float")
        def call(a: pd.Series, b: pd.Series) -> pd.Series:
            return _rows(a, b, of)

        return call

    for name, of in kernels.items():
        spark.udf.register(name, named(of))
