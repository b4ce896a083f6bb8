"""Registered queries: a Spark callable, its SQL twin and one column list for both.

The column list ("script_id:i score:d name:s ok:b") fixes order and types on both sides, so
results can be compared value by value.  Doubles are rounded to six places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_SPARK = {"i": "bigint", "s": "string", "b": "boolean"}
_DUCK = {"i": "BIGINT", "s": "VARCHAR", "b": "BOOLEAN"}


def register(name: str, columns: str, sql: str | None = None, ctes: str = ""):
    """Decorator; ``sql`` is the body of the final SELECT, ``ctes`` come before it."""
    cols = [c.rsplit(":", 1) for c in columns.split()]

    def shape(df: DataFrame) -> DataFrame:
        # ``+ 0.0`` turns a negative zero into zero
        return df.select(*[(F.round(F.col(c).cast("double"), 6) + F.lit(0.0) if t == "d" else F.col(c).cast(_SPARK[t])).alias(c)
                           for c, t in cols])

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf: shape(fn(spark, sf))
        if sql is not None:
            casts = ", ".join(f"round(CAST({c} AS DOUBLE), 6) + 0.0 AS {c}" if t == "d" else f"CAST({c} AS {_DUCK[t]}) AS {c}" for c, t in cols)
            lead = f"{ctes.strip().rstrip(',')}, " if ctes.strip() else ""
            SQL[name] = f"WITH RECURSIVE {lead}final_rows AS ({sql.strip()}) SELECT {casts} FROM final_rows"
        return fn

    return wrap
