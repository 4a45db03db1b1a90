"""Registration of queries and assembly of their SQL twins.

A twin is one SELECT over named views. The views it mentions, directly or through other views, are
put in front of it as a WITH list. The SQL is only used to compare results.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.plans.bridge import BANK_VIEWS, BASE_TABLES, BankTables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
VIEWS: dict[str, str] = {
    name: re.sub(r"\{(\w+)\}", r"\1", text.replace("@TS", "TIMESTAMP")) for name, text in BANK_VIEWS.items()}

DIGITS = 6


def view(name: str, sql: str) -> None:
    """A named SELECT for the twins."""
    if name in BASE_TABLES or name in VIEWS:
        raise ValueError(f"{name} is taken")
    VIEWS[name] = sql


def _needed(sql: str, found: list[str]) -> list[str]:
    words = set(re.findall(r"\b[a-z_][a-z0-9_]*\b", re.sub(r"'[^']*'", "", sql)))
    for name, text in VIEWS.items():
        if name in words and name not in found:
            _needed(text, found)
            if name not in found:
                found.append(name)
    return found


def with_views(body: str, rounded: Sequence[str] = (), digits: int = DIGITS) -> str:
    """The SELECT with its views in front; the columns in `rounded` are rounded at the end."""
    if rounded:
        columns = ", ".join(f'round("{c}", {digits}) AS "{c}"' for c in rounded)
        body = f"SELECT * REPLACE ({columns}) FROM ({body}) final_rows"
    elif body.lstrip().upper().startswith("WITH"):
        body = f"SELECT * FROM ({body}) final_rows"
    names = _needed(body, [])
    if not names:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names) + "\n" + body


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Every floating column rounded, since the order of additions differs between engines."""
    return df.select(*[F.round(F.col(f"`{f.name}`"), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType)
                       else F.col(f"`{f.name}`") for f in df.schema.fields])


def query(name: str, sql: str | None = None, rounds: Sequence[str] = (), digits: int = DIGITS
          ) -> Callable[[Callable[[BankTables], DataFrame]], Callable]:
    """Register a function of the bank tables as a query, with its SQL twin."""
    def register(build: Callable[[BankTables], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, folder: build(BankTables(spark, folder))
        if sql is not None:
            ORACLES[name] = with_views(sql, rounds, digits)
        return build
    return register
