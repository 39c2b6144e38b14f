"""Similarity that no built-in expresses: matcher ratios, diffs and Unicode normal forms, as vectorised functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    import unicodedata

    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """2 * matches / length by longest matching blocks, with the junk heuristic of long texts; null for a null."""
    from difflib import SequenceMatcher

    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("op", "a", "b")])))
def word_diff(a: pd.Series, b: pd.Series) -> pd.Series:
    """Changed runs of words between two texts, without the junk heuristic."""
    from difflib import SequenceMatcher

    out = []
    for x, y in zip(a, b):
        x, y = (x or "").split(), (y or "").split()
        ops = SequenceMatcher(None, x, y, autojunk=False).get_opcodes()
        out.append([{"op": o, "a": " ".join(x[i:j]), "b": " ".join(y[k:m])} for o, i, j, k, m in ops if o != "equal"])
    return pd.Series(out)


def multiset_diff(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """(keys, n_a, n_b): rows whose count differs between two frames; one aggregation on each side, no pairs."""
    x = a.groupBy(*keys).agg(F.count("*").alias("n_a"))
    y = b.groupBy(*keys).agg(F.count("*").alias("n_b"))
    return x.join(y, list(keys), "full_outer").fillna(0, ["n_a", "n_b"]).filter("n_a <> n_b")
