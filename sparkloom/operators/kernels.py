"""Per-group numeric and sequential kernels, run by ``applyInPandas`` on one stream or window at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def greedy_endpoint_nms(pairs: DataFrame, group: str, radius: int) -> DataFrame:
    """Rows ``(group, first, second, score)`` kept greedily by (score desc, first, second): a row goes if a kept one of
    its group has both ends within ``radius``. Equal ends keep their best score first. Kept ends are held in a
    grid of cells, so a group costs about its number of rows."""
    schema = f"{group} {pairs.schema[group].dataType.simpleString()}, first bigint, second bigint, score double"

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["score", "first", "second"], ascending=[False, True, True]).drop_duplicates(["first", "second"])
        cells: dict[tuple[int, int], list[tuple[int, int]]] = {}
        size, kept = max(1, radius), []
        for i, (a, b) in enumerate(zip(g["first"].tolist(), g["second"].tolist())):
            ca, cb = a // size, b // size
            near = (p for x in (-1, 0, 1) for y in (-1, 0, 1) for p in cells.get((ca + x, cb + y), ()))
            if any(abs(a - p) <= radius and abs(b - q) <= radius for p, q in near):
                continue
            cells.setdefault((ca, cb), []).append((a, b))
            kept.append(i)
        return g.iloc[kept][[group, "first", "second", "score"]]

    return pairs.groupBy(group).applyInPandas(run, schema)


def greedy_spatial_nms(points: DataFrame, group: str, radius: float) -> DataFrame:
    """Rows ``(group, id, x, y, score)`` kept greedily by (score desc, id): a point goes if a kept one is within ``radius`` (inclusive)."""
    schema = f"{group} {points.schema[group].dataType.simpleString()}, id bigint, x double, y double, score double"

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["score", "id"], ascending=[False, True])
        cells: dict[tuple[int, int], list[tuple[float, float]]] = {}
        kept = []
        for i, (x, y) in enumerate(zip(g["x"].tolist(), g["y"].tolist())):
            c = (int(x // radius), int(y // radius))
            near = (p for a in (-1, 0, 1) for b in (-1, 0, 1) for p in cells.get((c[0] + a, c[1] + b), ()))
            if any((x - p) ** 2 + (y - q) ** 2 <= radius * radius for p, q in near):
                continue
            cells.setdefault(c, []).append((x, y))
            kept.append(i)
        return g.iloc[kept][[group, "id", "x", "y", "score"]]

    return points.groupBy(group).applyInPandas(run, schema)
