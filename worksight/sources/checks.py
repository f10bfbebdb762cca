"""Checks of tables made in the pass that does the work."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Observed:
    """A frame whose rows, missing keys and NaN cells are counted as an action reads it.

    ``df`` takes the place of the frame in a plan; nothing is scanned for the counts. They are
    those of the first action that reads ``df``, and ``figures`` waits for it.
    """

    def __init__(self, df: DataFrame, name: str, key: str | None = None):
        self._observation = Observation(f"{name}-{uuid.uuid4().hex}")
        metrics = [F.count(F.lit(1)).alias("n_rows")]
        if key is not None:
            metrics.append(F.count_if(F.col(key).isNull()).alias("null_keys"))
        cells = F.lit(0)
        for field in df.schema:
            if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
                cells = cells + F.coalesce(F.isnan(F.col(f"`{field.name}`")), F.lit(False)).cast("int")
        metrics.append(F.coalesce(F.sum(cells), F.lit(0)).alias("nan_cells"))
        self.df = df.observe(self._observation, *metrics)

    def figures(self) -> dict[str, int]:
        return {name: int(value) for name, value in self._observation.get.items()}
