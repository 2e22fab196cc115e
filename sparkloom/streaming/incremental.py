"""Incremental operators over ordered frames, in batch per stream and as Structured Streaming with state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def motion_score(drift: np.ndarray, visible: np.ndarray, reach: float) -> float:
    """1 - the share of points that are visible and within ``reach`` of where they were; 1 without a visible point."""
    return 1.0 - float(np.mean(visible & (drift <= reach))) if len(drift) and visible.any() else 1.0


def select_keyframes(frames: DataFrame, stream: str, order: str, reach: float, target: float) -> DataFrame:
    """``(stream, order, reason)`` of keyframes from rows ``(stream, order, step array<double>, seen array<boolean>, forced)``.

    ``step`` is how far each point moves from this frame to the next, ``seen`` whether it is seen there. A point once
    unseen stays so until the next keyframe. Where the motion score passes ``target``, the last frame below it becomes
    a keyframe, if it is later than the last keyframe, else the frame itself, else the next one; forced frames always
    do. First and last frames are keyframes. One stream is one sequential fold.
    """
    kind, rank = (frames.schema[c].dataType.simpleString() for c in (stream, order))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(order).reset_index(drop=True)
        n, keys, good = len(g), {0: "first"}, None
        drift = seen = None
        steps, sights = [np.asarray(x, float) for x in g["step"]], [np.asarray(x, bool) for x in g["seen"]]

        def restart(at: int, to: int) -> None:
            nonlocal drift, seen
            drift, seen = np.zeros(len(steps[at])), np.ones(len(steps[at]), bool)
            for i in range(at, to + 1):
                m = min(len(drift), len(steps[i]))
                drift, seen = drift[:m] + steps[i][:m], seen[:m] & sights[i][:m]

        last = 0
        for i in range(n - 1):
            if drift is None:
                restart(i, i)
            else:
                m = min(len(drift), len(steps[i]))
                drift, seen = drift[:m] + steps[i][:m], seen[:m] & sights[i][:m]
            forced = bool(g["forced"][i]) and i > last
            if motion_score(drift, seen, reach) > target or forced:
                key = i if forced else good if good is not None and good > last else i if i > last else i + 1
                keys[key] = "forced" if forced else "motion"
                last, good, drift = key, None, None
                if key <= i:
                    restart(key, i)
            else:
                good = i
        keys.setdefault(n - 1, "last")
        return pd.DataFrame({stream: g[stream].iloc[0], order: g[order].iloc[sorted(keys)].to_numpy(), "reason": [keys[k] for k in sorted(keys)]})

    return frames.select(stream, order, "step", "seen", "forced").groupBy(stream).applyInPandas(run, f"{stream} {kind}, {order} {rank}, reason string")


def admitted(frames: DataFrame, stream: str, order: str, place: str, target: float) -> DataFrame:
    """``(stream, order, anchor)``: frames farther than ``target`` from the frame admitted before; nearer ones are skipped, the anchor stays."""
    kind, rank = (frames.schema[c].dataType.simpleString() for c in (stream, order))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(order)
        out, anchor, at = [], None, None
        for o, p in zip(g[order].tolist(), g[place].tolist()):
            if anchor is None or abs(p - at) > target:
                out.append((o, anchor))
                anchor, at = o, p
        frame = pd.DataFrame(out, columns=[order, "anchor"], dtype=object)
        frame.insert(0, stream, g[stream].iloc[0])
        return frame

    return frames.select(stream, order, place).groupBy(stream).applyInPandas(run, f"{stream} {kind}, {order} {rank}, anchor {rank}")


def propagated(points: DataFrame, track: str, order: str, conf: str, cov: str, inside: Column, least_conf: float, most_sigma: float) -> DataFrame:
    """Points of tracks up to the first that leaves the image, loses confidence or grows too uncertain, with ``confidence``
    (least so far), ``covariance`` (sum so far) and ``length``."""
    w = Window.partitionBy(track).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = points.withColumn("confidence", F.min(conf).over(w)).withColumn("covariance", F.sum(cov).over(w)).withColumn("length", F.count("*").over(w))
    ok = inside & (F.col("confidence") > least_conf) & (F.sqrt("covariance") <= most_sigma)
    return rows.withColumn("_ok", F.bool_and(ok).over(w)).where("_ok").drop("_ok")


def best_hops(paths: DataFrame, track: list[str], hop: str, cov: str, distance: str, scale: float) -> DataFrame:
    """Per track the hop of least covariance, ties to the shorter; ``accepted`` where it is within (sqrt(cov) + 1) * scale of the sequential place."""
    best = paths.groupBy(*track).agg(F.min(F.struct(F.col(cov).alias("c"), F.col(hop).alias("h"), F.col(distance).alias("d"))).alias("b"))
    return best.select(*track, F.col("b.h").alias(hop), F.col("b.c").alias(cov), (F.col("b.d") < (F.sqrt("b.c") + 1) * scale).alias("accepted"))


def histories(points: DataFrame, track: str, order: str, value: str, reach: int) -> DataFrame:
    """Adds ``history``: the last ``reach`` values of the track, oldest first."""
    w = Window.partitionBy(track).orderBy(order).rowsBetween(-(reach - 1), 0)
    return points.withColumn("history", F.collect_list(value).over(w))


def admitted_stream(frames: DataFrame, stream: str, order: str, place: str, target: float) -> DataFrame:
    """:func:`admitted` over an unbounded source: the state of a stream is its anchor, so it does not grow."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        anchor, at = state.get if state.exists else (None, None)
        rows = pd.concat(list(batches)).sort_values(order)
        out = []
        for o, p in zip(rows[order].tolist(), rows[place].tolist()):
            if anchor is None or (o > anchor and abs(p - at) > target):
                out.append((key[0], o, anchor))
                anchor, at = o, p
        state.update((anchor, at))
        yield pd.DataFrame(out, columns=[stream, order, "anchor"], dtype=object)

    return frames.select(stream, order, place).groupBy(stream).applyInPandasWithState(run, f"{stream} bigint, {order} bigint, anchor bigint", f"{order} bigint, {place} double", "append", "NoTimeout")


def windowed_counts(events: DataFrame, at: str, key: str, width: str, late: str) -> DataFrame:
    """Rows per time window and key, for batch and streams alike; in a stream rows later than ``late`` are dropped. An extra."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(F.window(at, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")
