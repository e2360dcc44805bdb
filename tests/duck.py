"""Comparison of Spark results with DuckDB SQL, order aside."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
from pyspark.sql import DataFrame


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    out = duckdb.connect()
    for f in os.listdir(sf_dir):
        out.sql(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{sf_dir}/{f}')")
    return out


def same(found: DataFrame, wanted: pd.DataFrame) -> None:
    found = found.toPandas()
    names = sorted(found.columns)
    assert names == sorted(wanted.columns)
    rows = lambda df: sorted(map(tuple, df[names].astype(str).to_numpy().tolist()))
    assert rows(found) == rows(wanted)
