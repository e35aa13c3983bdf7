"""Where queries are registered: each with its name, its function and, if SQL can express it, its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tesserae.session import Session

TABLES = {"region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"], "lineitem": None, "events": ["event_id"], "documents": ["doc_id"], "embeddings": ["vec_id"], "pages": ["page_id"], "benchmark": ["item_id"], "labels": None, "conversations": ["conv_id", "turn"]}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def opened(spark: SparkSession, sf_dir: str, script: str) -> Session:
    """A session over the tables that a script names."""
    db = Session(spark)
    for name, keys in TABLES.items():
        if f"*{name}" in script or f"~{name}:" in script or f" {name}:" in script:
            db.register(name, spark.read.parquet(f"{sf_dir}/{name}.parquet"), keys)
    return db


def script(name: str, text: str, sql: str | None = None, columns: list[str] | None = None, setup: str | list | None = None, shape: Callable[[DataFrame], DataFrame] | None = None, params: dict | None = None) -> None:
    """Register a query in the text language; `shape` rounds its columns to what SQL gives."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        steps = [setup] if isinstance(setup, str) else setup or []
        db = opened(spark, sf_dir, text + " ".join(steps))
        for s in steps:
            db.run(s)
        out = db.run(text, params)
        out = out.toDF(*columns) if columns else out
        return shape(out) if shape else out

    run.__name__ = name
    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = sql


def plan(name: str, sql: str | None = None):
    """Register a query written as a function of (tables, spark)."""

    def wrap(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"), spark)

        run.__name__ = name
        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return wrap
