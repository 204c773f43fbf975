"""Where the queries of all plan modules are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """The rows dealt by their key to some tasks for each core: a table of a few megabytes is a single task, and to judge a record takes up to a millisecond."""
    spark = rows.sparkSession
    return rows.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


def good():
    return F.col("quality") == 1


def toxic():
    return F.col("toxic") == 1


def clopper_sql(counts: str, key: str, digits: int, empty: str = "") -> str:
    """SQL for exact intervals of the counts (key, k, n) by sixty bisections of both tails."""
    term = "exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(m{0}) + (n - i) * ln(1 - m{0}))"
    tail = lambda lo, hi, m: f"coalesce(list_sum(list_transform(range({lo}, {hi}), lambda i: {term.format(m)})), 0)"
    return f"""
WITH RECURSIVE c AS ({counts}),
b AS (SELECT {key}, k, n, 0.0::DOUBLE AS l0, 1.0::DOUBLE AS l1, 0.0::DOUBLE AS h0, 1.0::DOUBLE AS h1, 0 AS step FROM c
UNION ALL SELECT {key}, k, n, CASE WHEN low THEN ml ELSE l0 END, CASE WHEN low THEN l1 ELSE ml END, CASE WHEN high THEN mh ELSE h0 END, CASE WHEN high THEN h1 ELSE mh END, step + 1
FROM (SELECT *, {tail("k", "n + 1", "l")} < 0.025 AS low, {tail("0", "k + 1", "h")} > 0.025 AS high FROM (SELECT *, (l0 + l1) / 2 AS ml, (h0 + h1) / 2 AS mh FROM b WHERE step < 60)))
SELECT {key}, k, n, round(CASE WHEN k = 0 OR n = 0 THEN 0.0 ELSE least((l0 + l1) / 2, k / n) END, {digits}) AS low, round(CASE WHEN n = 0 THEN 0.0 WHEN k = n THEN 1.0 ELSE greatest((h0 + h1) / 2, k / n) END, {digits}) AS high{empty} FROM b WHERE step = 60
"""
