"""Order, limit and top-k over a stage's output."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fields import Resolver, quoted
from ..lang import ast


def _key(df: DataFrame, name: str):
    return F.col(quoted(name)) if name in df.columns else Resolver(df)(name).value()


def order_by(df: DataFrame, keys: tuple[ast.Key, ...]) -> DataFrame:
    return df.orderBy(*[_key(df, k.column).desc_nulls_last() if k.descending else _key(df, k.column).asc_nulls_last() for k in keys])


def top(df: DataFrame, n: int, key: str) -> DataFrame:
    """The ``n`` rows with the greatest ``key``; equal ones by the other orderable columns, as they stand."""
    rest = [F.col(quoted(f.name)).asc_nulls_last() for f in df.schema.fields if f.name != key and f.dataType.typeName() not in ("struct", "map", "array", "variant")]
    return df.orderBy(_key(df, key).desc_nulls_last(), *rest).limit(n)
