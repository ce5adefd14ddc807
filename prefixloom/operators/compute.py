"""Functions over block payloads, by name. An unknown name, or parameters where none are taken, is an error row, not a failed job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefixloom.functions.binary import U64


def byte_sum(payload: Column) -> Column:
    """Sum of the bytes mod 2^64: DECIMAL(20,0). Counts each hex pair instead of walking a list of all bytes as objects."""
    import numpy as np
    import pandas as pd

    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda b: int(np.frombuffer(b, np.uint8).sum(dtype=np.uint64)), na_action="ignore").astype("Int64")

    run.__annotations__ = {"x": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "bigint")(payload).cast(U64)


OPERATORS: dict[str, Callable[[Column], Column]] = {"byte_sum": byte_sum}


def compute(requests: DataFrame, operator: str = "operator", params: str = "params", payload: str = "payload") -> DataFrame:
    """requests with (result, error)."""
    known = F.lit(False)
    result = F.lit(None).cast(U64)
    for name, f in OPERATORS.items():
        known = known | (F.col(operator) == name)
        result = F.when((F.col(operator) == name) & (F.coalesce(F.octet_length(params), F.lit(0)) == 0), f(F.col(payload))).otherwise(result)
    error = F.when(~F.coalesce(known, F.lit(False)), "unknown operator").when(F.coalesce(F.octet_length(params), F.lit(0)) > 0, "unexpected parameters").when(F.col(payload).isNull(), "not found")
    return requests.withColumns({"result": result, "error": error})


def placement(local: Column, remote: Column, remote_allowed: Column, mode: str = "hybrid") -> Column:
    """Where a function runs: local, remote, fetch, or null if it can't."""
    out = F.when(local, "local")
    if mode != "fetch_local_only":
        out = out.when(remote & remote_allowed, "remote")
    return out if mode == "remote_only" else out.when(remote, "fetch")
