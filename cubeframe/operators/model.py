"""Vectorised model inference over feature arrays."""

from __future__ import annotations

from collections.abc import Callable
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LOADED: dict[str, object] = {}


def infer(df: DataFrame, features: str, load: Callable[[], Callable[[np.ndarray], np.ndarray]], name: str, nodata: float | None = None) -> DataFrame:
    """``prediction`` for each row: the model is loaded once in each worker; rows with a missing feature get ``nodata``."""

    @F.pandas_udf("double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if name not in _LOADED:
            _LOADED[name] = load()
        for x in batches:
            some = x.notna().to_numpy()
            out = np.full(len(x), np.nan if nodata is None else nodata)
            if some.any():
                rows = np.stack(x[some]).astype(float)
                fine = ~np.isnan(rows).any(1)
                at = np.flatnonzero(some)[fine]
                if len(at):
                    out[at] = np.asarray(_LOADED[name](rows[fine]), float)
            out = pd.Series(out, index=x.index)
            yield out

    return df.withColumn("prediction", predict(features))
