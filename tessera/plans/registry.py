"""The catalogue of queries: each a plan and, where SQL can say it, the same query for DuckDB."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.sources import adapters

Plan = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}
#: Of spellings that differ, {word} stands for the first in Spark and for the second in DuckDB.
WORDS = {"int_div": ("div", "//"), "xor": ("^", "xor"), "text": ("string", "varchar")}


def oracle(sql: str) -> str:
    """The text for DuckDB: adapters become common table expressions."""
    used = [n for n in adapters.SQL if f"{{{n}}}" in sql]
    for n in used + [t for t in adapters.TABLES if f"{{{t}}}" in sql]:
        sql = sql.replace(f"{{{n}}}", n)
    for w, (_, duck) in WORDS.items():
        sql = sql.replace(f"{{{w}}}", duck)
    if not used:
        return sql
    with_ = ", ".join(f"{n} AS ({adapters.SQL[n]})" for n in used)
    body = sql.strip()
    if re.match(r"(?i)with recursive\b", body):
        return f"WITH RECURSIVE {with_}, {body[14:].lstrip()}"
    return f"WITH {with_}, {body[4:].lstrip()}" if re.match(r"(?i)with\b", body) else f"WITH {with_} {body}"


def sql_query(name: str, sql: str, duck: str | None = None) -> None:
    """Register a query written in SQL over {table}s; duck is its text for DuckDB where that differs."""
    names = sorted(set(re.findall(r"\{(\w+)\}", sql)) - set(WORDS))
    text = sql.replace(" IGNORE NULLS)", ") IGNORE NULLS")
    for w, (spark_word, _) in WORDS.items():
        text = text.replace(f"{{{w}}}", spark_word)

    def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(text, **{n: adapters.frame(spark, sf_dir, n) for n in names})

    QUERIES[name] = plan
    ORACLES[name] = oracle(duck or sql)


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan of the DataFrame API, with its text for DuckDB over {table}s."""

    def keep(plan: Plan) -> Plan:
        QUERIES[name] = plan
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return plan

    return keep


def plan(name: str) -> Callable[[Plan], Plan]:
    """Register a plan of the DataFrame API for a query whose SQL is there for DuckDB."""

    def keep(own: Plan) -> Plan:
        if name not in ORACLES:
            raise KeyError(name)
        QUERIES[name] = own
        return own

    return keep
