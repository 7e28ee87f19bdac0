"""Site functions by name: of columns (they stay in generated code), or of pandas series, which SQL can call too."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

KNOWN: dict[str, tuple[int, Callable[..., Column]]] = {}


def define(name: str, arity: int, f: Callable[..., Column]) -> Callable[..., Column]:
    """f of so many values at a site, called through ``apply``; a name that is taken gets the new function."""
    if not 1 <= arity <= 4:
        raise ValueError("site functions take one to four values")
    if len(inspect.signature(f).parameters) != arity:
        raise ValueError(f"{name} doesn't take {arity} values")
    KNOWN[name] = arity, f
    return f


def apply(name: str, *values):
    arity, f = KNOWN[name]
    if len(values) != arity:
        raise ValueError(f"{name} takes {arity} values")
    return f(*values)


def register(spark: SparkSession, name: str, f: Callable, returns: str = "double", arity: int = 1) -> Callable[..., Column]:
    """f of pandas series, for what columns can't say; it goes by its name in SQL and in ``apply``."""
    made = spark.udf.register(name, F.pandas_udf(f, returns))
    KNOWN[name] = arity, made
    return made
