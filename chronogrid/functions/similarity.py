"""Sequence similarity.

The ratio has no native form. The Arrow function below is meant for distinct pairs that
already passed ``may_reach``, a native bound no true match can fail.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not import the package


def ratio(a: str, b: str) -> float:
    if not a and not b:
        return 1.0
    if not a or not b:
        return 0.0
    return SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(T.DoubleType())
def seq_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of ``a`` (searched) to ``b``; the order of the arguments matters."""
    return pd.Series([ratio(x or "", y or "") for x, y in zip(a, b)], dtype="float64")


def may_reach(a: Column, b: Column, floor: float) -> Column:
    """False only for pairs whose ratio cannot be ``floor`` or more.

    Matched blocks form a common subsequence, so deleting and inserting the rest is an
    edit script of ``(1 - ratio) * (len a + len b)`` steps and bounds the edit distance.
    The lengths alone bound it too and are compared first.
    """
    budget = F.lit(1.0 - floor + 1e-9) * (F.length(a) + F.length(b))
    return (F.abs(F.length(a) - F.length(b)) <= budget) & (F.levenshtein(a, b) <= budget)
