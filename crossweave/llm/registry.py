"""Queries of this subpackage and the SQL they are compared to."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

MODULES = ("token_files", "packing", "hyperplanes", "token_counts", "url_trees", "automaton", "additive", "probminhash", "disclosure", "bwt_repeats", "infill", "manifest", "language_codes")


def load() -> tuple[dict, dict]:
    """(queries, SQL) by name, in the order of the operators."""
    for module in MODULES:
        importlib.import_module(f"crossweave.llm.{module}")
    return QUERIES, SQL


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


def refuse_names(df: DataFrame, *names: str) -> None:
    """Raises where a table has a column of a name that an operator adds, in any case: it would be overwritten without a word."""
    taken = {c.lower() for c in df.columns} & set(names)
    if taken:
        raise ValueError(f"the table has columns named {sorted(taken)}; rename them")


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)
