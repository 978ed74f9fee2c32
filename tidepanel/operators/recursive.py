"""Operators whose value depends on their own value a row before: one pandas group for each instrument, through Arrow."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def _schema(df: DataFrame, more: str) -> str:
    return ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", " + more


def ewm(panel: DataFrame, value: str, *, span: float | None = None, alpha: float | None = None, adjust: bool = False, least: int = 0) -> DataFrame:
    """ewm_mean and ewm_std (bias-corrected) of a series; a missing value decays the weights of the ones before."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("date")
        w = rows[value].astype(float).ewm(span=span, alpha=alpha, adjust=adjust, min_periods=least, ignore_na=False)
        return rows.assign(ewm_mean=w.mean(), ewm_std=w.std(bias=False))

    return panel.groupBy("instrument").applyInPandas(run, _schema(panel, "ewm_mean double, ewm_std double"))


def zigzag(values: np.ndarray, up: float, down: float) -> np.ndarray:
    """1 at a peak, -1 at a trough, 0 elsewhere: extrema from which the series moves by down (from a peak) or up (from a trough)."""
    out = np.zeros(len(values), int)
    known = np.flatnonzero(~np.isnan(values))
    if not len(known):
        return out
    low = high = known[0]
    way = 0
    for k in known[1:]:
        v = values[k]
        if way >= 0 and v > values[high] or way == 0 and v == values[high]:
            high = k
        if way <= 0 and v < values[low]:
            low = k
        if way >= 0 and v <= values[high] * (1 - down):
            out[high], way, low = 1, -1, k
        elif way <= 0 and v >= values[low] * (1 + up):
            out[low], way, high = -1, 1, k
    if way > 0:
        out[high] = 1
    elif way < 0:
        out[low] = -1
    return out


def trend_labels(panel: DataFrame, value: str, up: float, down: float) -> DataFrame:
    """extremum (1 peak, -1 trough), trend (1 from a trough to the next peak, 0 from a peak to the next trough), trend_position
    (1 at a leg's low, 0 at its high) and to_next (relative change to the next extremum)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("date").reset_index(drop=True)
        v = rows[value].to_numpy(float)
        e = zigzag(v, up, down)
        trend, place, to_next = (np.full(len(v), np.nan) for _ in range(3))
        at = np.flatnonzero(e)
        for a, b in zip(at, at[1:]):
            leg = slice(a, b)
            low, high = min(v[a], v[b]), max(v[a], v[b])
            trend[leg] = float(e[a] < 0)
            place[leg] = 1 - (v[leg] - low) / (high - low) if high > low else np.nan
            to_next[leg] = (v[b] - v[leg]) / v[leg]
        return rows.assign(extremum=e, trend=trend, trend_position=place, to_next=to_next)

    return panel.groupBy("instrument").applyInPandas(run, _schema(panel, "extremum int, trend double, trend_position double, to_next double"))


def breakout_labels(panel: DataFrame, value: str, window: int, up: float, down: float, wait: int = 1) -> DataFrame:
    """breakout: 1 if, in the window rows after wait - 1 more, the series first reaches value * (1 + up), -1 if first value * (1 - down), else 0."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("date").reset_index(drop=True)
        v = rows[value].to_numpy(float)
        out = np.zeros(len(v), int)
        for k in range(wait, wait + window):
            ahead = np.full(len(v), np.nan)
            ahead[: max(0, len(v) - k)] = v[k:]
            open_ = out == 0
            out[open_ & (ahead >= v * (1 + up))] = 1
            out[open_ & (out == 0) & (ahead <= v * (1 - down))] = -1
        return rows.assign(breakout=out)

    return panel.groupBy("instrument").applyInPandas(run, _schema(panel, "breakout int"))
