"""How a query is registered: its name, the canonical views it reads, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerf.sources.views import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None, *views: str):
    """Register a function of the views (as DataFrames); sql names them as tables."""

    def register(f: Callable[..., DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(*[view(spark, sf_dir, v) for v in views])
        if sql:
            ORACLE[name] = with_views(sql, *views)
        return f

    return register


def query_on_tables(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir) that reads the driver's tables itself."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return register


def r(name: str, digits: int = 4) -> Column:
    """Half up on the binary number, as the SQL side rounds."""
    x = F.col(name).cast("double") * 10.0**digits
    return (F.signum(x) * F.floor(F.abs(x) + 0.5) / 10.0**digits).alias(name)


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """All double and decimal columns rounded, so that the order of sums does not show."""
    return df.select(*[r(c, digits) if t == "double" or t.startswith("decimal") else F.col(c) for c, t in df.dtypes])
